"""What must not grow faster than the tables: plans without broadcasts or repeated parsing, bounded slices, pairs by classes."""

from pyspark.sql import functions as F

FILES = "path string, content string"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_similar_functions_match_brute_force(spark):
    import itertools
    import random

    from quarry.operators.chunks import similar_functions

    r = random.Random(4)
    rows = [(f"f{i % 2}", i, " ".join(r.choices("abcdefgh", k=r.randint(0, 9)))) for i in range(120)]
    rows += rows[:40]  # a function that is listed twice counts once
    sets = {(f, n): {*b.split()} for f, n, b in rows}
    want = set()
    for (f, x), (g, y) in itertools.combinations(sorted(sets), 2):
        a, b = sets[f, x], sets[g, y]
        if f == g and a and b and len(a & b) / len(a | b) >= 0.8:
            want.add((f, x, y, int(len(a & b) / len(a | b) * 100)))
    got = similar_functions(spark.createDataFrame(rows, "file string, name int, body string")).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_each_line_meets_functions_once(spark):
    from quarry.operators.findings import nearest_function

    targets = spark.range(20_000).select(F.lit("a").alias("path"), (F.col("id") % 3 * 10).cast("int").alias("line"), F.col("id").alias("seq"))
    targets = targets.unionByName(spark.sql("SELECT 'a' AS path, CAST(NULL AS INT) AS line, -1L AS seq")).unionByName(spark.sql("SELECT 'b' AS path, 1 AS line, -2L AS seq"))
    functions = spark.range(5_000).select(F.lit("a").alias("path"), F.col("id").alias("number"), (F.col("id") % 2 * 15).cast("int").alias("first"), (F.col("id") % 2 * 15 + 2).cast("int").alias("last"))
    got = {(r["line"], r["number"]): r["n"] for r in nearest_function(targets, functions).groupBy("line", "number").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(0, 0): 6667, (10, 1): 6667, (20, 1): 6666, (None, 0): 1}


def test_files_are_dealt_before_they_are_parsed(spark):
    from quarry.sources import python_ast, python_flows

    files = spark.createDataFrame([(f"a{i}.py", "import os\nx = os.getcwd()") for i in range(40)], FILES).coalesce(1)
    for rows in (python_ast.parse(files), python_ast.terms(files), python_flows.imports(files)):
        assert rows.rdd.getNumPartitions() > 1
    kinds = {r["kind"] for r in python_ast.parse(files, ("import", "call")).select("kind").collect()}
    assert kinds == {"import", "call"}


def test_a_tree_is_parsed_once(spark):
    from quarry.operators import detectors as D
    from quarry.sources import python_ast

    tree = python_ast.parse(spark.createDataFrame([("a.py", "import os, re\nclass A(B):\n  def f(self):\n    try: re.x()\n    except: pass"), (None, "import q"), ("b.py", "((")], FILES))
    for df in (D.structure_findings(tree), D.unused_imports(tree), D.code_graph(tree)[1]):
        assert plan_of(df).count("MapInArrow") == 1
    assert sorted((r["path"] or "", r["detail"]) for r in D.unused_imports(tree).collect()) == [("", "q"), ("a.py", "os")]
    assert sorted(r["rule_id"] for r in D.structure_findings(tree).collect()) == ["bare-except", "empty-except", "function-name"]
    assert sorted(tuple(r) for r in D.code_graph(tree)[1].where("relation <> 'imports'").collect()) == [("a.py::A", "B", "inherits"), ("a.py::A.f", "x", "calls")]


def test_taint_steps_are_not_broadcast(spark):
    from quarry.operators import taint
    from quarry.operators.graphs import cut
    from quarry.sources import python_flows

    files = cut(spark.createDataFrame([("a.py", "import os\ndef f(x):\n    os.system(x)\nf(input())")], FILES))
    flows = cut(python_flows.flows(files, taint.SOURCES, taint.SINKS, taint.SANITIZERS))
    none = spark.createDataFrame([], "path string, alias string, symbol string, target_file string, line int")
    for df in (*taint._names(flows, none), *taint.edges_of(flows, none)):
        assert "Broadcast" not in plan_of(df)
    assert [(r["sink"], r["labels"]) for r in taint.taint_paths(files).collect()] == [("os.system", ["CMD-argument", "CODE-execution", "FILE-path", "HTML-content", "SQL-value"])]


def test_taint_leaves_only_its_result_on_disk(spark):
    import os

    from quarry.operators import taint
    from quarry.operators.graphs import cut

    files = cut(spark.range(300).select(
        F.concat(F.lit("p/m"), "id", F.lit(".py")).alias("path"),
        F.concat(F.lit("import os\nfrom p.m"), F.col("id") + 1, F.lit(" import f\ndef f(x):\n    y = x\n    os.system(y)\nf(input())\n")).alias("content"),
    ))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    stored = lambda: {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names}
    before = stored()
    out = taint.taint_paths(files)
    assert sum(os.path.getsize(f) for f in stored() - before) < 100_000
    assert out.where("confidence = 0.675 AND size(labels) = 5").count() == out.count() == 300


def test_facts_match_brute_force_and_labels_share_rows(spark):
    import random

    from quarry.operators import taint

    r = random.Random(8)
    kinds = [x for x in taint.LABELS if x != taint.ANY]
    row = lambda src, dst, i: (src, dst, r.choice([1.0, 0.75, 0.5625]), r.choice([[], [], r.sample(kinds, 2), kinds]), r.choice([[], ["int"]]), "input", f"p{i % 7}", i % 5)
    edges = [row(f"n{r.randrange(40)}", f"n{r.randrange(40)}", i) for i in range(90)] + [row(None, f"n{r.randrange(40)}", i) for i in range(6)]
    want, changed = {}, True
    while changed:
        changed = False
        for src, dst, factor, cleaned, by, source, path, line in edges:
            for label in set(taint.LABELS) - set(cleaned):
                if src is None:
                    fact = (-round(factor, 6), path, line, source, by)
                elif (src, label) in want:
                    lost, *place, old = want[src, label]
                    fact = (-round(-lost * factor, 6), *place, [*dict.fromkeys(old + by)])
                else:
                    continue
                if (dst, label) not in want or fact < want[dst, label]:
                    want[dst, label], changed = fact, True
    table = spark.createDataFrame(edges, "src string, dst string, factor double, cleaned array<string>, by array<string>, source string, path string, line int")
    known, steps = taint.fixpoint(table)
    rows = known.collect()
    steps.drop()
    assert {(k["node"], x): tuple(k["best"]) for k in rows for x, bit in taint.BITS.items() if k["labels"] & bit} == want
    assert len(rows) == len({(node, str(fact)) for (node, _), fact in want.items()}) < len(want) / 2


def test_cross_file_joins_are_not_broadcast(spark):
    from quarry.operators import projects

    files = spark.createDataFrame([("a.py", 'TOKEN = "x"\n'), ("b.py", "from a import TOKEN\nprint(TOKEN)\n")], FILES)
    found = projects.cross_file_check(files)
    assert "Broadcast" not in plan_of(found)
    assert [tuple(r) for r in found.collect()] == [("b.py", 2, "log", "TOKEN", "a.py")]


def test_words_are_told_apart_without_a_shuffle(spark):
    from quarry.operators.projects import named_elsewhere

    files = spark.createDataFrame([("a", "x y y"), ("a", "y z"), ("b", "x"), (None, "z"), (None, "z"), ("c", None)], FILES)
    names = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "z"), ("c", "q"), (None, "z")], "path string, name string")
    found = named_elsewhere(names, files)
    plan = plan_of(found)
    assert "REPARTITION_BY_NUM" in plan and "LeftSemi" not in plan
    assert sorted((r["path"] or "", r["name"], r["elsewhere"]) for r in found.collect()) == [("", "z", 2), ("a", "x", 1), ("a", "y", 0), ("b", "z", 2), ("c", "q", 0)]


def test_a_search_sorts_few_scores_at_once(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from quarry.operators import similarity

    r = np.random.default_rng(5)
    v, q = r.normal(size=(9000, 8)), r.normal(size=(300, 8))
    sizes, sort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sizes.append(len(keys[0])) or sort(keys))
    block = type("Sent", (), {"value": (list(range(300)), q)})
    batch = pa.RecordBatch.from_arrays([pa.array(range(9000)), pa.array([1] * 9000), pa.array(v.tolist())], names=["id", "label", "embedding"])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    got = pa.Table.from_batches(list(similarity._nearest(block, 5, kinds)(iter([batch, batch.slice(0, 0)])))).to_pydict()
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit(q) @ unit(v).T, 6)
    assert got["id"] == [i for s in score for i in sort((np.arange(9000), -s))[:5].tolist()]
    assert max(sizes) <= (1 << 18) + 300 * 5


def test_centred_windows_take_one_shuffle_of_texts(spark):
    from quarry.operators.windows import centred

    text = "\n".join(f"line {i}" for i in range(200))
    bodies = spark.createDataFrame([(1, 10, text), (2, 1, "x\n\n"), (3, 1, None), (4, 1, "y" * 900)], "id long, start int, text string")
    aims = spark.createDataFrame([(1, 60), (1, 60), (1, 999), (4, 1)], "id long, line int")
    found = centred(bodies, aims, 60)
    assert plan_of(found).count("Window") == 0
    got = {r["id"]: (r["excerpt"], r["top"], r["reach"]) for r in found.collect()}
    assert got[2] == ("x\n", 5, 20) and got[3] == ("", None, None) and got[4] == ("y" * 240, None, None)
    assert got[1][0].startswith("line 0\nline 1\n") and "line 50\n" in got[1][0] and len(got[1][0]) // 4 <= 60 and got[1][0].endswith("lines omitted] ...")
