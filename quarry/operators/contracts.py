"""Web contracts from source lines: operations that servers offer and clients call, and how they meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.rules import lines

# Fixed values: (side, pattern); group 1 is the method, group 2 the path.
PATTERNS = (
    ("provider", r"@\w+\.(get|post|put|delete|patch)\s*\(\s*[\"']([^\"']+)[\"']"),
    ("provider", r"@\w+\.(route)\s*\(\s*[\"']([^\"']+)[\"']"),
    ("provider", r"\b(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\s*,"),
    ("provider", r"@(Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*)?[\"']([^\"']+)[\"']"),
    ("provider", r"\b(?:r|router|mux)\.(GET|POST|PUT|DELETE|HandleFunc)\s*\(\s*\"([^\"]+)\""),
    ("consumer", r"\b(?:axios|http|client|requests|httpx|dio)\.(get|post|put|delete|patch)\s*\(\s*[fr]?[\"'`]([^\"'`]+)[\"'`]"),
    ("consumer", r"\b(fetch)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]"),
)


def operations(files: DataFrame) -> DataFrame:
    """side, method, route, path, line: the first pattern that matches a line; parameters of a route become {}."""
    found = F.coalesce(*[F.when(F.col("text").rlike(p), F.struct(F.lit(s).alias("side"), F.lower(F.regexp_extract("text", p, 1)).alias("m"), F.regexp_extract("text", p, 2).alias("raw"))) for s, p in PATTERNS])
    rows = lines(files).withColumn("o", found).where("o is not null")
    method = F.when(F.col("o.m").isin("route", "request", "handlefunc", "fetch"), "any").otherwise(F.col("o.m"))
    bare = F.regexp_replace(F.regexp_replace("o.raw", r"^https?://[^/]+", ""), r"\?.*$", "")
    route = F.regexp_replace(F.regexp_replace(bare, r"\$?\{[^}]*\}|:[A-Za-z_]\w*|<[^>]+>", "{}"), r"(?<=.)/+$", "")
    return rows.select("o.side", method.alias("method"), route.alias("route"), "path", "line")


def gaps(found: DataFrame) -> DataFrame:
    """kind (missing, unused), method, route: calls that nobody serves, and routes that nobody calls."""
    c = found.where("side = 'consumer'").select("method", "route").distinct()
    p = found.where("side = 'provider'").select(F.col("method").alias("p_method"), F.col("route").alias("p_route")).distinct()
    met = (F.col("route") == F.col("p_route")) & ((F.col("method") == F.col("p_method")) | (F.col("method") == "any") | (F.col("p_method") == "any"))
    missing = c.join(p, met, "left_anti").select(F.lit("missing").alias("kind"), "method", "route")
    unused = p.join(c, met, "left_anti").select(F.lit("unused").alias("kind"), F.col("p_method").alias("method"), F.col("p_route").alias("route"))
    return missing.unionByName(unused)


def _named(column: str, stem: bool):
    return F.array_compact(F.array(F.struct(F.col(column).alias("key"), F.lit(0).alias("sub")), F.when(F.lit(stem) & (T.operation_stem(F.col(column)) != F.col(column)), F.struct(T.operation_stem(F.col(column)).alias("key"), F.lit(1).alias("sub")))))


def matched_operations(consumer: DataFrame, provider: DataFrame) -> DataFrame:
    """Consumer operations (name, input_type, output_type, seq) with `offer` (name, input_type, output_type, position) and `how`.

    A provider's operation (name, input_type, output_type, position) is known by its name and by its name without the verb; of
    several with one key the last counts. A consumer's meets it by its own name (exact), else by its name without the verb
    (normalized), else by nothing (null).
    """
    offer = F.struct("name", "input_type", "output_type", "position")
    keys = provider.select("position", offer.alias("offer"), F.explode(_named("name", True)).alias("k")).groupBy("k.key").agg(F.max_by("offer", F.struct("position", "k.sub")).alias("offer"))
    asked = consumer.select("name", F.explode(_named("name", True)).alias("k")).distinct()
    met = asked.join(keys, F.col("k.key") == keys["key"]).groupBy("name").agg(F.min_by(F.struct("offer", "k.sub"), "k.sub").alias("m"))
    how = F.when(F.col("m.sub") == 0, "exact").when(F.col("m.sub") == 1, "normalized")
    return consumer.join(met, "name", "left").select(*consumer.columns, F.col("m.offer").alias("offer"), how.alias("how"))


def contract_gaps(consumer: DataFrame, provider: DataFrame) -> DataFrame:
    """kind, name, seq, position of every gap between two contracts; for the tables see `matched_operations`.

    Kinds are missing_operation (nobody offers it), unused_operation (nobody asks for it), input_type_mismatch,
    input_type_missing (sent, but not expected) and output_type_mismatch. Types that one side does not state are no gap otherwise.
    """
    met = matched_operations(consumer, provider)
    sent, taken = F.coalesce("input_type", F.lit("")), F.coalesce("offer.input_type", F.lit(""))
    wanted, given = F.coalesce("output_type", F.lit("")), F.coalesce("offer.output_type", F.lit(""))
    inputs = F.when((sent != "") & (taken == ""), "input_type_missing").when((sent != "") & ~T.types_compatible(sent, taken), "input_type_mismatch")
    outputs = F.when((wanted != "") & (given != "") & ~T.types_compatible(wanted, given), "output_type_mismatch")
    kinds = F.when(F.col("offer").isNull(), F.array(F.lit("missing_operation"))).otherwise(F.array_compact(F.array(inputs, outputs)))
    own = met.select(F.explode(kinds).alias("kind"), "name", "seq", F.col("offer.position").alias("position"))
    used = met.where("offer IS NOT NULL").select("offer.name").distinct()
    unused = provider.join(used, "name", "left_anti").select(F.lit("unused_operation").alias("kind"), "name", F.lit(None).cast("long").alias("seq"), "position")
    return own.unionByName(unused)
