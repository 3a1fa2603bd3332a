"""All queries of the engine by name, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scores
from quarry.operators import rules
from quarry.plans import base, carriers, checks, contexts, detect, find, graph, more, patterns, projects, scan, state, stats  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, match rules, honour inline markers, and score each language by its findings."""
    files = carriers.carrier(spark, sf_dir, "files")
    hits = rules.match_patterns(files, scan.RULES, honour_markers=True).join(files.select("path", "language"), "path")
    per = hits.groupBy("language").agg(F.count(F.lit(1)).alias("findings"), F.sum(scores.penalty(F.col("severity"))).alias("penalty"))
    return per.select("language", "findings", F.round(scores.decayed(10.0, F.col("penalty")), 4).alias("score"))


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
