"""Report documents from findings: SARIF, JUnit, JSON, Markdown. Findings are nested and serialised on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = {"critical": "error", "high": "error", "medium": "warning"}


def sarif_results(findings: DataFrame) -> DataFrame:
    """seq, rule_id and a SARIF 2.1.0 result object as JSON for each finding."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    region = F.struct(F.greatest("line", F.lit(1)).alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    body = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("seq", "rule_id", level.alias("level"), F.to_json(body).alias("result"))


def sarif_document(findings: DataFrame, tool: str = "quarry") -> str:
    """A whole SARIF document, for result sets that a reader can take in one file: it is read to the driver."""
    import json

    results = [json.loads(r["result"]) for r in sarif_results(findings).orderBy("seq").toLocalIterator()]
    rules = sorted({r["ruleId"] for r in results})
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool, "rules": [{"id": r} for r in rules]}}, "results": results}]})


def write_json(findings: DataFrame, path: str, root: str = "") -> None:
    """One JSON line a finding, with paths relative to `root`, written by the executors."""
    relative = F.when(F.startswith("path", F.lit(root)), F.expr(f"substring(path, {len(root) + 1})")).otherwise(F.col("path")) if root else F.col("path")
    findings.withColumn("path", relative).write.mode("overwrite").json(path)


def junit_cases(findings: DataFrame) -> DataFrame:
    """A test case element for each frame: failed with the number of blockers, or passed."""
    per = findings.groupBy("frame_id").agg(F.count_if("is_blocker").alias("failures"), F.count(F.lit(1)).alias("n"))
    case = F.when(F.col("failures") > 0, F.concat(F.lit('<testcase name="'), "frame_id", F.lit('"><failure message="'), F.col("failures").cast("string"), F.lit(' blockers"/></testcase>'))).otherwise(F.concat(F.lit('<testcase name="'), "frame_id", F.lit('"/>')))
    return per.select("frame_id", "failures", "n", case.alias("xml"))


def markdown_summary(findings: DataFrame) -> str:
    """A table of counts by severity: a few rows."""
    rows = findings.groupBy("severity").count().orderBy(F.desc("count"), "severity").collect()
    return "\n".join(["| severity | findings |", "| --- | ---: |", *(f"| {r['severity']} | {r['count']} |" for r in rows)])


def badge(score: float) -> str:
    colour = "#4c1" if score >= 8 else "#dfb317" if score >= 5 else "#e05d44"
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="120" height="20"><rect width="120" height="20" fill="{colour}"/><text x="60" y="14" fill="#fff" text-anchor="middle" font-size="11">quality {score:.1f}/10</text></svg>'


def merge_debt(before: DataFrame, now: DataFrame, key: list[str], most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Current rows replace earlier ones; the first `most` that vanished are listed as resolved."""
    gone = before.join(now.select(*key), key, "left_anti")
    return now, gone.orderBy("seq").limit(most)
