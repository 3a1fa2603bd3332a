"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from quarry.plans.carriers import carrier, with_carriers

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, carriers: tuple[str, ...] = (), tables: tuple[str, ...] = ()):
    """Registers a function of (carriers..., tables...) DataFrames under `name`."""

    def register(f):
        def run(spark, sf_dir):
            args = [carrier(spark, sf_dir, c) for c in carriers] + [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables]
            return f(*args)

        run.__name__ = name
        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_carriers(sql, *carriers)
        return f

    return register
