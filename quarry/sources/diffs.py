"""Unified diffs as rows: one window pass over the lines, no parser state on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def parse(diffs: DataFrame) -> DataFrame:
    """diff_id, path, kind (added, deleted, context), line, text of every line in a hunk of (diff_id, text).

    Added and context lines have numbers of the new file, deleted ones of the old.
    """
    rows = diffs.select("diff_id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    order = Window.partitionBy("diff_id").orderBy("at")
    hunk = F.col("raw").rlike(HUNK)
    head = F.col("raw").rlike(r"^(diff --git |index |--- |\+\+\+ |new file|deleted file|similarity |rename |Binary )")
    rows = rows.withColumn("path", F.last(F.when(F.col("raw").rlike(r"^\+\+\+ "), F.regexp_extract("raw", r"^\+\+\+ (?:b/)?(.*?)\s*$", 1)), True).over(order))
    rows = rows.withColumn("section", F.sum((hunk | F.col("raw").rlike("^diff --git ")).cast("int")).over(order))
    rows = rows.withColumn("new_at", F.last(F.when(hunk, F.regexp_extract("raw", HUNK, 3).cast("int")), True).over(order)).withColumn("old_at", F.last(F.when(hunk, F.regexp_extract("raw", HUNK, 1).cast("int")), True).over(order))
    inside = rows.where(~hunk & ~head & F.col("new_at").isNotNull() & F.col("raw").rlike(r"^[ +\-]"))
    sign = F.substring("raw", 1, 1)
    within = Window.partitionBy("diff_id", "section").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda signs: F.coalesce(F.sum(sign.isin(*signs).cast("int")).over(within), F.lit(0))
    kind = F.when(sign == "+", "added").when(sign == "-", "deleted").otherwise("context")
    line = F.when(sign == "-", F.col("old_at") + count(["-", " "])).otherwise(F.col("new_at") + count(["+", " "]))
    return inside.select("diff_id", "path", kind.alias("kind"), line.cast("int").alias("line"), F.expr("substring(raw, 2)").alias("text"))


def ranges(diff_rows: DataFrame) -> DataFrame:
    """path, first, last of runs of consecutive added lines."""
    w = Window.partitionBy("diff_id", "path").orderBy("line")
    isle = diff_rows.where("kind = 'added'").withColumn("isle", F.col("line") - F.row_number().over(w))
    return isle.groupBy("diff_id", "path", "isle").agg(F.min("line").alias("first"), F.max("line").alias("last")).drop("isle")
