"""A SARIF document, read back and compared with one made from the rows by hand."""

import json

from quarry.operators import sarif

SCHEMA = "seq long, frame_id string, frame_name string, rule_id string, severity string, message string, path string, line int, `column` int, detail string, review_required boolean, review_reason string, fix string, fix_code string, exploit_evidence string, detection_source string, fingerprint string, suppressed_by string, suppression_reason string"
ROWS = [
    (3, "security", "Security", "SQL Injection", "critical", "bad \"query\"", "/repo/src/a.py", 7, 3, None, None, None, "use parameters", "q(%s)", "evidence", "taint", "abc", None, None),
    (1, "security", "Security", "xss", "low", None, "src/b.py", 0, None, "more", True, "unsure", "just text", None, None, None, None, None, None),
    (2, "orphan", "Orphans", None, None, "unused", "C:\\src\\c.py", None, None, None, True, None, None, None, None, "llm", None, None, None),
    (4, "orphan", None, "xss", "medium", "old", "src/d.py", 2, 9, "lost", False, None, "x", "y", None, None, None, "baseline", None),
    (5, "orphan", None, "only suppressed", "critical", None, "src/e.py", 5, None, None, None, None, None, None, None, None, None, "config", "rule off"),
    (6, "orphan", None, "r", "high", "no place", "unknown", 5, None, None, None, None, None, None, None, None, None, None, None),
    (7, "orphan", None, "r", "high", "no place", None, 5, None, None, None, None, None, None, None, None, None, None, None),
]


def place(uri, line, column=None):
    region = {"startLine": line} | ({"startColumn": column} if column else {})
    return [{"physicalLocation": {"artifactLocation": {"uri": uri, "uriBaseId": "%SRCROOT%"}, "region": region}}]


WANT = [
    {"ruleId": "xss", "level": "warning", "message": {"text": sarif.REVIEW + "Issue detected\n\nDetails: unsure | more"}, "locations": place("src/b.py", 1, 1), "fixes": [{"description": {"text": "just text"}}]},
    {"ruleId": "orphan", "level": "warning", "message": {"text": sarif.REVIEW + "unused\n\nDetails: " + sarif.UNSURE}, "locations": place("C:/src/c.py", 1, 1), "properties": {"detectionSource": "llm"}},
    {"ruleId": "sql-injection", "level": "error", "message": {"text": 'bad "query"'}, "locations": place("src/a.py", 7, 3), "partialFingerprints": {"primary": "abc"}, "properties": {"exploitEvidence": "evidence", "detectionSource": "taint"},
     "fixes": [{"description": {"text": "use parameters"}, "artifactChanges": [{"artifactLocation": {"uri": "src/a.py", "uriBaseId": "%SRCROOT%"}, "replacements": [{"deletedRegion": {"startLine": 7}, "insertedContent": {"text": "q(%s)"}}]}]}]},
    {"ruleId": "xss", "kind": "open", "level": "note", "message": {"text": "old"}, "locations": place("src/d.py", 2), "suppressions": [{"kind": "inSource", "justification": sarif.BASELINE}]},
    {"ruleId": "only-suppressed", "kind": "open", "level": "none", "message": {"text": "Suppressed finding"}, "locations": place("src/e.py", 5), "suppressions": [{"kind": "inSource", "justification": "rule off"}]},
]


def test_a_document_read_back_is_the_rows(spark, tmp_path):
    path = f"{tmp_path}/out/report.sarif"
    sarif.write_document(spark.createDataFrame(ROWS, SCHEMA).repartition(4), path, root="/repo/", properties={"totalFrames": 2})
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and run["results"] == WANT
    assert run["tool"]["driver"]["rules"] == [{"id": "xss", "shortDescription": {"text": "Security"}}, {"id": "orphan", "shortDescription": {"text": "Orphans"}}, {"id": "sql-injection", "shortDescription": {"text": "Security"}}]
    assert run["properties"] == {"totalFrames": 2} and run["invocations"][0]["executionSuccessful"] and not [p for p in (tmp_path / "out").iterdir() if p.name != "report.sarif"]


def test_many_rows_come_in_order_and_a_second_write_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/many.sarif"
    rows = spark.range(5000).selectExpr("4999 - id AS seq", "concat('r', id % 7) AS rule_id", "'f' AS frame_id", "'high' AS severity", "cast(id AS string) AS message", "'a.py' AS path", "1 AS line")
    for frame in (rows.limit(10), rows.repartition(9)):
        sarif.write_document(frame, path)
    with open(f"{tmp_path}/many.sarif", encoding="utf-8") as f:
        run = json.load(f)["runs"][0]
    assert [r["message"]["text"] for r in run["results"]] == [str(4999 - i) for i in range(5000)] and len(run["tool"]["driver"]["rules"]) == 7


def test_no_findings_give_a_document(spark, tmp_path):
    sarif.write_document(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none.sarif")
    with open(f"{tmp_path}/none.sarif", encoding="utf-8") as f:
        run = json.load(f)["runs"][0]
    assert run["results"] == [] and run["tool"]["driver"]["rules"] == []
