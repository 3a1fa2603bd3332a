"""Contexts, checks of groups, contracts, windows, statistics and flows near findings: small tables by hand, edges included."""

import hashlib

from pyspark.sql import functions as F

from quarry.functions import scores, text
from quarry.operators import contexts, contracts, detectors, findings, rules, windows
from quarry.sources import python_ast

FILES = "path string, content string"


def test_the_surest_detector_wins_and_projects_boost(spark):
    rows = [("src/a.py", "x = 1"), ("src/b.py", "def test_a(): pass"), ("lib/c.py", "from hypothesis import given"), ("tests/d.py", "# quarry-context: Vendor"), ("src/e.py", "# quarry-context: nonsense\n# Generated by x"), ("src/f.py", None), (None, "x"), ("own/g.js", "import pytest\nclass TestA:\n  assert a == b\n  self.assertTrue\n describe( it( expect(")]
    got = {r["path"]: tuple(r)[1:] for r in contexts.contexts(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {"src/a.py": ("production", 0.5, "default"), "src/b.py": ("test", 0.6, "content"), "lib/c.py": ("test", 0.85, "imports"), "tests/d.py": ("vendor", 1.0, "metadata"), "src/e.py": ("generated", 0.9, "metadata"), "src/f.py": ("production", 0.5, "default"), None: ("production", 0.5, "default"), "own/g.js": ("test", 0.95, "content")}
    project = contexts.Project(test_dirs=("own/",), vendor_dirs=("src/a",), test_framework=True)
    got = {r["path"]: tuple(r)[1:] for r in contexts.contexts(spark.createDataFrame(rows, FILES), project).collect()}
    assert got["src/b.py"] == ("test", 0.9, "content+intent_boost") and got["src/a.py"] == ("vendor", 0.9, "project_context") and got["own/g.js"][0] == "test"


def test_checks_of_groups(spark):
    rows = [("a", "def f(): pass"), ("b", "import requests\nclass A: eval(x)" + " " * 600), ("c", None)] + [("d", "flask argparse @property eval( def ")] * 6 + [("e", "def f(): os.system(x)" + "flask argparse @property eval(" * 30), ("e", "x")]
    got = {r["g"]: (r["frames"], r["confidence"], r["skip"]) for r in contexts.frames_for(spark.createDataFrame(rows, "g string, content string"), "g").collect()}
    assert got["a"] == (["orphan", "security"], 0.75, False) and got["c"] == (["security"], 0.7, False)
    assert got["b"] == (["antipattern", "orphan", "resilience", "security"], 0.82, True)
    assert got["d"] == (["antipattern", "architecture", "fuzz", "orphan", "property", "resilience", "security"], 0.9, True) and got["e"][1:] == (0.81, False)


OPS = "name string, input_type string, output_type string"


def test_contracts_by_name_and_by_stem(spark):
    asked = spark.createDataFrame([("getUser", "str", "List<int>", 1), ("FetchOrder", None, "bool", 2), ("nobody", "x", None, 3), ("saveCart", "Cart", "", 4), ("user", "int", None, 5)], OPS + ", seq long")
    offered = spark.createDataFrame([("getUser", "text", "number[]", 1), ("loadOrder", "int", "text", 2), ("createCart", None, "x", 3), ("spare", None, None, 4), ("findUser", "bool", None, 5)], OPS + ", position long")
    got = {(r["kind"], r["name"], r["seq"], r["position"]) for r in contracts.contract_gaps(asked, offered).collect()}
    assert got == {("output_type_mismatch", "FetchOrder", 2, 2), ("missing_operation", "nobody", 3, None), ("input_type_missing", "saveCart", 4, 3), ("input_type_mismatch", "user", 5, 5), ("unused_operation", "spare", None, 4)}
    assert contracts.contract_gaps(asked.limit(0), offered).count() == 5 and contracts.contract_gaps(asked, offered.limit(0)).count() == 5


def test_windows_of_small_bodies(spark):
    long = "\n".join(f"line {i}" for i in range(1, 101))
    bodies = spark.createDataFrame([(1, long, 11), (2, "", 1), (3, None, 1), (4, "x" * 900, 1), (5, "a\nb\n", 1)], "id int, text string, start int")
    targets = spark.createDataFrame([(1, 60), (1, 63), (1, 5), (5, 1), (9, 1)], "id int, line int")
    got = {r["id"]: (r["excerpt"], r["top"], r["reach"]) for r in windows.centred(bodies, targets, 45).collect()}
    assert got[2] == ("", None, None) and got[3] == ("", None, None) and got[4] == ("x" * 180, None, None) and got[5] == ("a\nb", 5, 20)
    text_, top, reach = got[1]
    assert len(text_) // 4 <= 45 and (top, reach) == (5, 3)
    assert text_ == "\n".join([*(f"line {i}" for i in range(1, 6)), "    ... [41 lines omitted] ...", *(f"line {i}" for i in range(47, 57)), "    ... [44 lines omitted] ..."])


def test_file_statistics_count_lines_as_a_reader_does(spark):
    rows = [("a", "x\ny\n"), ("b", "x\r\ny"), ("c", ""), ("d", None), ("e", "\n"), ("f", "a\0\nb")]
    got = {r["path"]: (r["line_count"], r["hash"]) for r in rules.file_metrics(spark.createDataFrame(rows, FILES)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {"a": (2, sha("x\ny\n")), "b": (2, sha("x\ny\n")), "c": (0, sha("")), "d": (0, sha("")), "e": (1, sha("\n")), "f": (0, sha("a\0\nb"))}


def test_fingerprints_outlive_lines_and_name_flows(spark):
    a, b, c, d = "Unsanitized data flow: x (line 3) -> run [CMD] (line 9)", "Unsanitized data flow: x (line 4) -> run [CMD] (line 12)", "call at line 5", "call at line 77"
    keys = [r[0] for r in spark.createDataFrame([(m,) for m in (a, b, c, d)], "m string").select(text.finding_fingerprint(F.lit("r"), F.lit("p"), F.col("m"))).collect()]
    assert keys[0] == keys[1] == hashlib.sha256(b"r:p:taint:x->run[CMD]").hexdigest() and keys[2] == keys[3] == hashlib.sha256(b"r:p:call ").hexdigest()


def test_scores_and_levels(spark):
    df = spark.createDataFrame([(0.0, "IMPROVING", 30), (5.0, "DEGRADING", 14), (99.0, "STABLE", 7), (200.0, "IMPROVING", 6)], "lost double, trend string, age int")
    got = [tuple(r) for r in df.select(scores.hundred(F.col("lost"), F.col("trend")), scores.debt_level(F.col("age"))).collect()]
    assert got == [(100.0, "critical"), (85.0, "warning"), (1.0, "info"), (0.0, None)]


def test_the_first_flow_near_a_finding(spark):
    found = spark.createDataFrame([("security-sql-injection-0", "a", 10), ("xss", "a", 13), ("r-s", "a", 0), ("r", "b", 1)], "rule_id string, path string, line int")
    flows = spark.createDataFrame([(2, "a", "in", 7, "out", 90), (1, "a", "late", 50, "end", 14), (3, "b", "in", 9, "out", 9)], "position long, path string, source string, source_line int, sink string, sink_line int")
    got = {r["rule_id"]: (r["flow"] and (r["flow"]["position"], r["flow"]["source"], r["flow"]["sink"]), r["vulnerability_class"]) for r in findings.with_first_flow(found, flows).collect()}
    assert got == {"security-sql-injection-0": ((2, "in (line 7)", "out (line 90)"), "sql-injection"), "xss": ((1, "late (line 50)", "end (line 14)"), "unknown"), "r-s": (None, None), "r": (None, None)}


def test_definitions_and_imports_of_one_file(spark):
    code = "from typing import TYPE_CHECKING\nimport os, json\nfrom x import *\nif TYPE_CHECKING:\n    import late\n__all__ = ['json']\ndef alone():\n    alone()\n@app.route('/')\ndef view(): pass\n@property\ndef prop(self): pass\nclass A:\n    def setUp(self): pass\n    def __len__(self): pass\n    def step(self): pass\n    def go(self): return self.step\ndef main(): pass\n"
    tree = python_ast.parse(spark.createDataFrame([("a.py", code), ("b.py", "alone\nA\n")], FILES))
    assert {r["detail"] for r in detectors.unused_imports(tree).collect()} == {"os"}
    assert {(r["kind"], r["name"]) for r in detectors.unreferenced_definitions(tree).where("path = 'a.py'").collect()} == {("unreferenced_function", "alone"), ("unreferenced_class", "A"), ("unreferenced_function", "go")}
