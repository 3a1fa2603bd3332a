"""SARIF 2.1.0 documents of any size: results and rules are made by the executors, and a writer joins their fragments in order.

The writer is a Python data source. Each task writes its rows as fragments beside the document; the commit puts head, rules,
results and tail together, a block of bytes at a time, and moves the whole to its name, so no process holds the rows and
a failed write leaves nothing. The folder must be one that driver and executors share.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Columns that findings can have, with their types; what a table lacks is null.
COLUMNS = {
    "seq": "long", "frame_id": "string", "frame_name": "string", "rule_id": "string", "severity": "string", "message": "string", "path": "string", "line": "int", "column": "int", "detail": "string",
    "review_required": "boolean", "review_reason": "string", "fix": "string", "fix_code": "string", "exploit_evidence": "string", "detection_source": "string", "fingerprint": "string",
    "suppressed_by": "string", "suppression_reason": "string",
}
REVIEW = "⚠️ [MANUAL REVIEW REQUIRED] "
UNSURE = "LLM verification was uncertain or skipped."
BASELINE = "Baseline technical debt — accepted in previous scan"
BLOCK = 1 << 20


def _uri(path: Column, root: str) -> Column:
    clean = F.translate(path, "\\", "/")
    top = root.rstrip("/") + "/"
    return F.when(F.startswith(clean, F.lit(top)), F.substring(clean, F.lit(len(top) + 1), F.length(clean))).otherwise(clean) if root else clean


def results(findings: DataFrame, root: str = "") -> DataFrame:
    """seq, rule_id, frame_name and `result`, a SARIF result object as JSON, for each finding that has a place and a rule.

    A rule is the finding's, else its frame's, in lower case with hyphens. `suppressed_by` (baseline or config) makes a
    result a suppressed one: of baseline debt with a milder level, of configuration with none. Paths become relative to `root`.
    """
    f = findings.select(*[(F.col(c) if c in findings.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])
    rule = F.replace(F.lower(F.coalesce("rule_id", "frame_id", F.lit("generic"))), F.lit(" "), F.lit("-"))
    severity = F.lower(F.coalesce("severity", F.lit("warning")))
    by = F.col("suppressed_by")
    level = (
        F.when(by == "config", "none")
        .when(by == "baseline", F.when(severity == "critical", "error").when(severity == "high", "warning").otherwise("note"))
        .otherwise(F.when(severity.isin("critical", "high"), "error").otherwise("warning"))
    )
    review = F.coalesce("review_required", F.lit(False))
    detail = F.when(review & F.col("detail").isNull(), F.coalesce("review_reason", F.lit(UNSURE))).when(review, F.concat(F.coalesce("review_reason", F.lit("Verification uncertain")), F.lit(" | "), "detail")).otherwise(F.col("detail"))
    said = F.coalesce("message", F.when(by == "baseline", "Baseline technical debt").when(by == "config", "Suppressed finding").otherwise("Issue detected"))
    text = F.concat(F.when(review & by.isNull(), REVIEW).otherwise(""), said, F.when(by.isNull() & (F.coalesce(detail, F.lit("")) != ""), F.concat(F.lit("\n\nDetails: "), detail)).otherwise(""))
    line = F.greatest(F.coalesce("line", F.lit(1)), F.lit(1))
    place = F.struct(_uri(F.col("path"), root).alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId"))
    region = F.struct(line.alias("startLine"), F.when(by.isNull(), F.greatest(F.coalesce("column", F.lit(1)), F.lit(1))).alias("startColumn"))
    change = F.struct(place.alias("artifactLocation"), F.array(F.struct(F.struct(line.alias("startLine")).alias("deletedRegion"), F.struct(F.col("fix_code").alias("text")).alias("insertedContent"))).alias("replacements"))
    fixes = F.when(by.isNull() & (F.coalesce("fix", F.lit("")) != ""), F.array(F.struct(F.struct(F.col("fix").alias("text")).alias("description"), F.when(F.coalesce("fix_code", F.lit("")) != "", F.array(change)).alias("artifactChanges"))))
    told = F.when(F.col("exploit_evidence").isNotNull() | F.col("detection_source").isNotNull(), F.struct(F.col("exploit_evidence").alias("exploitEvidence"), F.col("detection_source").alias("detectionSource")))
    justified = F.coalesce(F.when(by == "baseline", F.lit(BASELINE)), "suppression_reason", F.lit("Suppressed by rule"))
    body = F.struct(
        rule.alias("ruleId"), F.when(by.isNotNull(), "open").alias("kind"), level.alias("level"), F.struct(text.alias("text")).alias("message"),
        F.array(F.struct(F.struct(place.alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))).alias("locations"),
        F.when(F.col("fingerprint").isNotNull(), F.struct(F.col("fingerprint").alias("primary"))).alias("partialFingerprints"), told.alias("properties"), fixes.alias("fixes"),
        F.when(by.isNotNull(), F.array(F.struct(F.lit("inSource").alias("kind"), justified.alias("justification")))).alias("suppressions"),
    )
    sound = (F.coalesce("path", F.lit("")) != "") & (F.col("path") != "unknown") & (rule != "")
    return f.where(sound).select("seq", rule.alias("rule_id"), F.coalesce("frame_name", "frame_id").alias("frame_name"), by.isNull().alias("open"), F.to_json(body).alias("result"))


def rules(found: DataFrame) -> DataFrame:
    """seq and `rule`, a SARIF rule object as JSON, for each rule of open `results`: described by the frame that had it first."""
    first = found.where("open").groupBy("rule_id").agg(F.min_by(F.struct("seq", "frame_name"), "seq").alias("first"))
    body = F.struct(F.col("rule_id").alias("id"), F.when(F.col("first.frame_name").isNotNull(), F.struct(F.col("first.frame_name").alias("text"))).alias("shortDescription"))
    return first.select(F.col("first.seq").alias("seq"), F.to_json(body).alias("rule"))


class Fragment(WriterCommitMessage):
    def __init__(self, kind: int, first: int, name: str):
        self.kind, self.first, self.name = kind, first, name


class Fragments(WriterCommitMessage):
    def __init__(self, all_: list[Fragment]):
        self.all = all_


class DocumentWriter(DataSourceWriter):
    """Rows (kind, seq, body) of JSON objects, in order inside each partition, to one document with an array for each kind."""

    def __init__(self, path: str, head: str, between: str, tail: str):
        self.path, self.parts = path, (head, between, tail)

    def _at(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator):
        import uuid

        store, path = self._at()
        done, out, now = [], None, None
        for row in iterator:
            if row["kind"] != now:
                if out:
                    out.close()
                now = row["kind"]
                name = f"{path}.parts/{now}-{uuid.uuid4().hex}"
                store.create_dir(f"{path}.parts", recursive=True)
                out = store.open_output_stream(name)
                done.append(Fragment(now, row["seq"], name))
            else:
                out.write(b",\n")
            out.write(row["body"].encode())
        if out:
            out.close()
        return Fragments(done)

    def commit(self, messages):
        store, path = self._at()
        store.create_dir(f"{path}.parts", recursive=True)
        whole = f"{path}.parts/whole"
        found = sorted((f for m in messages if m for f in m.all), key=lambda f: (f.kind, f.first))
        with store.open_output_stream(whole) as out:
            for kind, text in enumerate(self.parts):
                out.write(text.encode())
                for i, f in enumerate(f for f in found if f.kind == kind):
                    if i:
                        out.write(b",\n")
                    with store.open_input_stream(f.name) as part:
                        while block := part.read(BLOCK):
                            out.write(block)
        store.move(whole, path)
        store.delete_dir(f"{path}.parts")

    def abort(self, messages):
        store, path = self._at()
        from pyarrow import fs

        if store.get_file_info(f"{path}.parts").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}.parts")


class SarifSource(DataSource):
    @classmethod
    def name(cls):
        return "sarif"

    def schema(self):
        return "kind int, seq long, body string"

    def writer(self, schema, overwrite):
        return DocumentWriter(self.options["path"], self.options["head"], self.options["between"], self.options["tail"])


def write_document(findings: DataFrame, path: str, *, root: str = "", tool: str = "quarry", version: str = "1.0", properties: dict | None = None, succeeded: bool = True) -> None:
    """Writes one SARIF document of the findings, ordered by `seq`, at a path that driver and executors share.

    An empty table gives a document without results. Rules come in the order of their first finding.
    """
    spark = findings.sparkSession
    spark.dataSource.register(SarifSource)
    found = results(findings, root)
    rows = rules(found).select(F.lit(0).alias("kind"), "seq", F.col("rule").alias("body")).unionByName(found.select(F.lit(1).alias("kind"), "seq", F.col("result").alias("body")))
    driver = {"name": tool, "semanticVersion": version}
    run = {"invocations": [{"executionSuccessful": succeeded, "toolExecutionNotifications": []}], "originalUriBaseIds": {"%SRCROOT%": {"uri": ""}}, "properties": properties or {}}
    head = json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"})[:-1] + ', "runs": [{"tool": {"driver": ' + json.dumps(driver)[:-1] + ', "rules": ['
    between = "]}}, " + json.dumps(run)[1:-1] + ', "results": ['
    dealt = rows.repartitionByRange("kind", "seq").sortWithinPartitions("kind", "seq")
    dealt.write.format("sarif").mode("append").option("path", path).option("head", head).option("between", between).option("tail", "]}]}").save()
