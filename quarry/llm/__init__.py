"""Training-data operators: sharding, de-duplication, scoring, packing, media.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
