import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import scores, text
from quarry.operators import findings as O
from quarry.operators import graphs, reports, rules, taint
from quarry.sources import diffs, files, manifests, python_ast
from quarry.streaming import lifecycle

FILES = "path string, content string, language string"


def test_matches_give_byte_columns_and_first_hit_only(spark):
    df = spark.createDataFrame([("a.py", "é key=1 key=2\nnothing\nkey", "python"), ("b.go", None, "go"), ("c.go", "", "go")], FILES)
    got = rules.match_patterns(df, [rules.Rule("k", "key"), rules.Rule("g", "key", languages=("go",))]).collect()
    assert sorted((r["path"], r["line"], r["column"], r["rule_id"]) for r in got) == [("a.py", 1, 4, "k"), ("a.py", 3, 1, "k")]


def test_rules_honour_markers_and_exceptions(spark):
    df = spark.createDataFrame([("src/a.py", "eval(x)  # noqa\neval(y)", "python"), ("vendor/b.py", "eval(z)", "python")], FILES)
    got = rules.match_patterns(df, [rules.Rule("e", r"eval\(", exceptions=("vendor/*",))], honour_markers=True).collect()
    assert [(r["path"], r["line"]) for r in got] == [("src/a.py", 2)]


def test_an_entry_with_file_and_line_matches_other_files_by_line(spark):
    df = spark.createDataFrame([("r", "a.py", 1), ("r", "b.py", 7), ("r", "b.py", 8), ("r", "c/d.py", 9)], "rule_id string, path string, line int")
    m = lambda e: [r["path"] + str(r["line"]) for r in df.where(O.entry_matches(e, F.col("rule_id"), F.col("path"), F.col("line"))).collect()]
    assert m({"file": "a.py", "line": 7}) == ["a.py1", "b.py7"]
    assert m({"file": "c/*", "line": 1}) == ["c/d.py9"]
    assert m({"rules": ["x"]}) == [] and len(m({})) == 4 and m({"enabled": False}) == []


def sequential_dedup(rows):
    """(path, line, rule, class, rank, value) in order to the values that stay."""
    alive, free = [], []
    for path, line, rule, cls, rank, value in rows:
        if path is None:
            free.append(value)
            continue
        same = [x for x in alive if x["at"] == (path, line, rule)]
        if same:
            if rank > same[0]["rank"]:
                same[0].update(rank=rank, value=value)  # its place and class in the index stay
            continue
        near = [x for x in alive if x["at"][0] == path and x["cls"] == cls and abs(x["at"][1] - line) <= 3]
        if near and rank <= near[0]["rank"]:
            continue
        if near:
            alive.remove(near[0])
        alive.append({"at": (path, line, rule), "cls": cls, "rank": rank, "value": value})
    return free + [x["value"] for x in alive]


RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}  # others 1


@pytest.mark.parametrize("seed,most", [(5, 30), (6, 12), (7, 200)])
def test_greedy_dedup_equals_the_sequential_fold(spark, seed, most):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["sql-a", "sql-b", "xss-b", "style"]), rnd.choice([*RANK, "odd"]), rnd.choice(["m", "a secret"]), rnd.choice(["p", "q", None]), rnd.randint(0, most)) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, rule_id string, severity string, message string, path string, line int").repartition(5)
    of = lambda rule, message: "SQL_INJECTION" if "sql" in rule else "XSS" if "xss" in rule else "HARDCODED_SECRET" if "secret" in message else rule
    want = sorted(sequential_dedup((path, line, rule, of(rule, m), RANK.get(s, 1), seq) for seq, rule, s, m, path, line in rows))
    assert sorted(r["seq"] for r in O.dedup_findings(df).collect()) == want


def test_a_replaced_finding_stands_at_its_own_line(spark):
    rows = [(1, "sql", "low", "", "f", 10), (2, "sql-b", "high", "", "f", 13), (3, "sql-c", "low", "", "f", 16)]
    df = spark.createDataFrame(rows, "seq long, rule_id string, severity string, message string, path string, line int")
    assert [r["line"] for r in O.dedup_findings(df).collect()] == [13]


def test_unknown_files_and_line_zero_pass_the_diff_filter(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "a", 0), (4, "z", 9)], "seq long, path string, line int")
    changed = spark.createDataFrame([("a", 5), ("a", 5)], "path string, line int")
    assert sorted(r["seq"] for r in O.filter_changed_lines(df, changed).collect()) == [1, 3, 4]


def test_location_splits_at_the_last_colon(spark):
    df = spark.createDataFrame([("c:/a.py:12",), ("a.py",), ("a.py:x",), ("b:-3",)], "location string")
    p, n = O.split_location(F.col("location"))
    assert [tuple(r) for r in df.select(p, n).collect()] == [("c:/a.py", 12), ("a.py", 0), ("a.py:x", 0), ("b", -3)]


def test_class_keywords_go_in_order(spark):
    df = spark.createDataFrame([("cmd-injection", ""), ("cmd-run", ""), ("other", "A Password here"), ("other", "none")], "r string, m string")
    assert [r[0] for r in df.select(O.vulnerability_class(F.col("r"), F.col("m"))).collect()] == ["INJECTION", "COMMAND_INJECTION", "HARDCODED_SECRET", "other"]


def test_risk_text_that_is_no_number_is_five(spark):
    df = spark.createDataFrame([("80",), ("3",), ("x",), (None,), ("-4",)], "v string")
    assert [r[0] for r in df.select(scores.normalized_risk(F.col("v"))).collect()] == [8.0, 3.0, 5.0, 5.0, 0.0]


@pytest.mark.parametrize("pattern,path,hit", [("/build", "build/x", True), ("/build", "a/build", False), ("*.log", "a/b.log", True), ("docs/", "docs/a", True), ("docs/", "docs", False), ("a/**/z", "a/b/c/z", True)])
def test_ignore_patterns(pattern, path, hit):
    import re

    assert bool(re.search(text.ignore_regex(pattern), path)) == hit


def test_tree_source_reads_text_and_skips_what_is_ignored(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("import os\n")
    (tmp_path / "src/b.bin").write_bytes(b"\0\1\2")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/c.js").write_text("x")
    got = {r["path"]: r for r in files.read_tree(spark, str(tmp_path), ignore=["skip/"]).collect()}
    assert set(got) == {"src/a.py", "src/b.bin"}
    assert got["src/a.py"]["language"] == "python" and got["src/a.py"]["content"] == "import os\n" and got["src/b.bin"]["binary"] and got["src/b.bin"]["content"] is None


def test_manifests(spark):
    df = spark.createDataFrame([("p", '{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}'), ("q", "no json")], "path string, content string")
    assert sorted((r["kind"], r["name"]) for r in manifests.package_json(df).collect()) == [("dependencies", "a"), ("devDependencies", "b")]
    req = spark.createDataFrame([("r", "a==1\n# c\n-r x\nB[x,y]>=2 ; python_version > '3'\n")], "path string, content string")
    assert sorted((r["name"], r["extras"], r["spec"]) for r in manifests.requirements(req).collect()) == [("B", "x,y", ">=2"), ("a", "", "==1")]
    toml = spark.createDataFrame([("t", '[project]\ndependencies = ["a>=1"]\n'), ("u", "= broken")], "path string, content string")
    assert [(r["name"], r["spec"]) for r in manifests.pyproject(toml).collect()] == [("a", ">=1")]


def test_diff_counters_advance_by_kind(spark):
    d = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -3,3 +3,4 @@\n a\n-b\n+c\n+d\n e\n@@ -20 +21 @@\n-z\n+y"
    got = diffs.parse(spark.createDataFrame([(1, d)], "diff_id long, text string")).orderBy("line", "kind").collect()
    assert sorted((r["kind"], r["line"], r["text"]) for r in got) == sorted([("context", 3, "a"), ("deleted", 4, "b"), ("added", 4, "c"), ("added", 5, "d"), ("context", 6, "e"), ("deleted", 20, "z"), ("added", 21, "y")])


def test_trees_and_flows(spark):
    code = "import os\nx = input()\ny = x + 'a'\nos.system(y)\nz = int(x)\nos.system(z)\ndef f():\n    return 1\n    a = 2\n"
    df = spark.createDataFrame([("a.py", code, "python"), ("b.py", "def (", "python"), ("c.py", None, "python")], FILES)
    tree = python_ast.parse(df)
    assert tree.where("kind = 'error'").count() == 1 and tree.where("kind = 'dead'").first()["line"] == 9
    paths = taint.taint_paths(df)
    assert sorted((r["sink_line"], r["sanitizers"]) for r in paths.collect()) == [(4, []), (6, ["int"])]
    found = taint.taint_findings(paths).collect()
    assert [(r["line"], r["severity"], r["is_blocker"]) for r in found] == [(4, "high", True)]


def test_graph_closures_stop_and_cycles_are_found(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("d",)], "node string")
    assert sorted(r["node"] for r in graphs.transitive_impact(e, start).collect()) == ["a", "b", "c"]
    assert sorted(r["node"] for r in graphs.on_cycles(e).collect()) == ["a", "b", "c"]
    assert sorted(r["node"] for r in graphs.unreachable(e, spark.createDataFrame([("a",)], "node string")).collect()) == ["x", "y"]


def test_breaker_opens_waits_and_probes():
    b = lifecycle.Breaker(3, 10)
    steps = [(0, False), (1, False), (2, False), (5, True), (13, False), (14, True), (24, True), (25, False)]
    assert [b.step(*s) for s in steps] == [("closed", True), ("closed", True), ("open", True), ("open", False), ("open", True), ("open", False), ("closed", True), ("closed", True)]


def test_issue_stream_equals_the_batch(spark, tmp_path):
    rows = [("a", 0), ("a", 1), ("a", 3), ("b", 1), ("c", 0), ("c", 3)]
    for s in range(4):
        spark.createDataFrame([r for r in rows if r[1] == s] or [("none", s)], "code_hash string, snapshot long").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema("code_hash string, snapshot long").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    out = {}
    q = lifecycle.track_issues(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: out.update({r["code_hash"]: tuple(r)[2:] for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    want = {r["code_hash"]: tuple(r)[2:] for r in lifecycle.issue_states(spark.createDataFrame(rows, "code_hash string, snapshot long"), 3).collect()}
    assert {k: out[k] for k in want} == want


def test_partials_sink_and_reports(spark, tmp_path):
    import json

    df = spark.createDataFrame([(1, "f", "r", "high", "m", "a.py", 3, True), (2, "g", "q", "low", "n", "b.py", 0, False)], "seq long, frame_id string, rule_id string, severity string, message string, path string, line int, is_blocker boolean")
    df.write.json(f"{tmp_path}/in")
    s = spark.readStream.schema(df.schema).json(f"{tmp_path}/in")
    lifecycle.write_partials(s, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.schema(df.schema).json(f"{tmp_path}/out").count() == 2
    doc = json.loads(reports.sarif_document(df))
    assert [r["level"] for r in doc["runs"][0]["results"]] == ["error", "note"] and len(doc["runs"][0]["tool"]["driver"]["rules"]) == 2
    assert "high" in reports.markdown_summary(df) and reports.badge(9.0).startswith("<svg")


def test_flows_by_lines_in_other_languages(spark):
    rows = [
        ("a.js", "const q = req.query.id;\nconst s = 'x' + q;\ndb.query(s);\nconst n = parseInt(req.query.n);\ndb.query(n);", "javascript"),
        ("b.go", "id := c.Query(\"id\")\nexec.Command(\"sh\", id)", "go"),
        ("C.java", 'String p = request.getParameter("p");\nFile f = new File(p);', "java"),
        ("d.rb", "x", "ruby"),
    ]
    paths = taint.line_taint_paths(spark.createDataFrame(rows, FILES))
    got = sorted((r["path"], r["sink_type"], r["sink_line"], r["sink_type"] in r["labels"]) for r in paths.collect())
    assert got == [("C.java", "FILE-path", 2, True), ("a.js", "SQL-value", 3, True), ("a.js", "SQL-value", 5, False), ("b.go", "CMD-argument", 2, True)]


def test_signals_add_up(spark):
    df = spark.createDataFrame([("execute", ["sql"], "app.db"), ("execute", ["x"], "app"), ("nothing", ["sql"], "db")], "m string, p array<string>, mod string")
    kind, score = taint.inferred_sink(F.col("m"), F.col("p"), F.col("mod"))
    assert [tuple(r) for r in df.select(kind, score).collect()] == [("SQL-value", 0.8), ("SQL-value", 0.6), (None, None)]


def test_token_bucket_waits_for_tokens():
    b = lifecycle.Bucket(1.0, 2.0)
    assert [b.step(t) for t in (0, 0, 0, 1, 60)] == [0.0, 0.0, 1.0, 1.0, 0.0]


def test_web_contracts_meet_by_route(spark):
    from quarry.operators import contracts

    rows = [("s.py", '@app.get("/items/{id}")\ndef f(): pass\n@app.route("/old")', "python"), ("c.ts", "axios.get(`/items/${x}`)\nfetch('https://h/none?x=1')", "typescript")]
    found = contracts.operations(spark.createDataFrame(rows, FILES))
    assert found.count() == 4
    assert sorted(tuple(r) for r in contracts.gaps(found).collect()) == [("missing", "any", "/none"), ("unused", "any", "/old")]


@pytest.mark.parametrize("seed", range(3))
def test_cycle_groups_are_the_strong_components(spark, seed):
    from quarry.operators.graphs import cycle_groups

    rnd = random.Random(seed)
    edges = {(rnd.randint(0, 24), rnd.randint(0, 24)) for _ in range(34)}
    reach = {a: {a} for a in range(25)}
    for _ in range(25):
        for a, b in edges:
            for r in reach.values():
                if a in r:
                    r.add(b)
    want = {a: max(b for b in reach[a] if a in reach[b]) for a in range(25) if (a, a) in edges or any(b != a and a in reach[b] for b in reach[a])}
    got = cycle_groups(spark.createDataFrame([(f"{a:02}", f"{b:02}") for a, b in edges], "src string, dst string")).collect()
    assert {int(r["node"]): int(r["group"]) for r in got} == want


@pytest.mark.parametrize("block", [1024, 2])
def test_search_equals_all_pairs(spark, block):
    from quarry.operators.similarity import search

    rnd = random.Random(3)
    rows = [(i, i % 4, [rnd.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3).cache()
    rows = [tuple(r) for r in df.collect()]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = []
    for q, _, v in rows:
        if q % 10 == 0:
            near = sorted((-round(dot(v, w) / (dot(v, v) * dot(w, w)) ** 0.5, 6), i) for i, label, w in rows if label != 2)[:7]
            want += [(q, i, k + 1) for k, (_, i) in enumerate(near)]
    got = search(df, df.where("vec_id % 10 = 0"), 7, F.col("label") != 2, block=block)
    assert sorted((r["query"], r["id"], r["rank"]) for r in got.collect()) == sorted(want)
    assert search(df, df.where("false"), 7).count() == 0


def test_eviction_keeps_four_fifths_of_the_cap(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(30)], "k long, at long")
    assert O.evicted(df, "at", "k", 30).count() == 30
    assert sorted(r["k"] for r in O.evicted(df, "at", "k", 20).collect()) == list(range(14, 30))
