"""Projects of several files, and graphs, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import graphs, projects, taint
from quarry.sources import python_flows


def all_cycles(edges):
    """Every elementary cycle from its least node, by depth-first search."""
    out = set()

    def walk(first, path):
        for s, d in edges:
            if s == path[-1]:
                if d == first:
                    out.add((*path, d))
                elif d > first and d not in path:
                    walk(first, [*path, d])

    for n in {s for s, _ in edges}:
        walk(n, [n])
    return out


def dfs_cycles(edges):
    """What one depth-first pass meets: the path back to each node that is still open."""
    found, visited, open_ = set(), set(), []

    def walk(n):
        visited.add(n)
        open_.append(n)
        for s, d in edges:
            if s == n and d not in visited:
                walk(d)
            elif s == n and d in open_:
                found.add(tuple(open_[open_.index(d) :]))
        open_.pop()

    for s, _ in edges:
        if s not in visited:
            walk(s)
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cycles_equal_brute_force_on_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = sorted({(f"n{r.randrange(9)}", f"n{r.randrange(9)}") for _ in range(16)} | {(f"m{i}", f"m{(i + 1) % 12}") for i in range(12)})
    got = {tuple(x["nodes"]) for x in graphs.cycles(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == all_cycles(edges) and any(len(c) == 13 for c in got)
    for c in dfs_cycles(edges):  # each is one of them, turned to its least node
        at = c.index(min(c))
        assert (*c[at:], *c[:at], c[at]) in got
    short = {tuple(x["nodes"]) for x in graphs.cycles(spark.createDataFrame(edges, "src string, dst string"), max_length=3).collect()}
    assert short == {c for c in got if len(c) <= 4}


def test_no_cycles_and_no_edges(spark):
    assert graphs.cycles(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")).count() == 0
    assert graphs.cycles(spark.createDataFrame([], "src string, dst string")).count() == 0


def bfs_chains(edges, start, depth):
    out, queue, visited = [], [(start, ())], set()
    while queue:
        node, path = queue.pop(0)
        if node in visited or len(path) >= depth:
            continue
        visited.add(node)
        for e in edges:
            if e[0] == node:
                out.append((*path, e[3]))
                queue.append((e[1], (*path, e[3])))
    return out


def test_chains_equal_breadth_first_search(spark):
    r = random.Random(5)
    edges = [(f"n{r.randrange(12)}", f"n{r.randrange(12)}", r.choice(["calls", "imports"]), i) for i in range(40)]
    table = spark.createDataFrame(edges, "source string, target string, relation string, position long")
    starts = spark.createDataFrame([("n0",), ("n3",), ("none",)], "node string")
    for depth in (1, 3, 12):
        got = {(x["start"], tuple(e["position"] for e in x["path"])) for x in graphs.chains(table, starts, depth).collect()}
        assert got == {(s, p) for s in ("n0", "n3") for p in bfs_chains(edges, s, depth)}
        assert all(x["depth"] == len(x["path"]) for x in graphs.chains(table, starts, depth).collect())


FILES = "path string, content string"


def test_imports_mean_files_packages_and_neighbours(spark):
    there = ["a/b.py", "a/c/__init__.py", "a/d/e.py", "a/d/near.py", "top.py", "a/both.py", "a/both/__init__.py", "__init__.py"]
    asked = [("a/d/e.py", "a.b", 0, "a/b.py"), ("a/d/e.py", "a.c", 0, "a/c/__init__.py"), ("a/d/e.py", "x.near", 0, "a/d/near.py"), ("a/d/e.py", "near", 1, "a/d/near.py"),
             ("a/d/e.py", "b", 2, "a/b.py"), ("a/d/e.py", "top", 9, "top.py"), ("a/d/e.py", "", 2, None), ("a/c/x.py", "", 1, "a/c/__init__.py"), ("a/d/e.py", "a.both", 0, "a/both.py"),
             ("top.py", "a.b", 0, "a/b.py"), ("top.py", "os", 0, None), ("top.py", "", 1, "__init__.py")]
    rows = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(asked)], "id int, path string, module string, level int")
    files = spark.createDataFrame([(p, "") for p in (*there, there[0])], FILES)
    got = {r["id"]: r["target_file"] for r in projects.resolve_modules(rows, files).collect()}
    assert got == {i: x[3] for i, x in enumerate(asked)}
    assert projects.resolve_modules(rows, files.limit(0)).where("target_file IS NOT NULL").count() == 0


def test_the_longest_whole_folder_owns_a_path(spark):
    modules = spark.createDataFrame([("core", "src", 1), ("auth", "src/auth", 2), ("again", "src/auth", 3), ("file", "src/auth/x.py", 4)], "module string, prefix string, position long")
    want = {"src/auth/x.py": "file", "src/auth/y.py": "auth", "src/auth_api/y.py": "core", "src\\auth\\z.py": "auth", "lib/a.py": "lib", "setup.py": "root", "": "unknown", "unknown": "unknown", None: "unknown", "src": "core"}
    paths = spark.createDataFrame([(p,) for p in want] * 2, "path string")
    got = [tuple(r) for r in projects.owning_modules(paths, modules).select("path", "module").collect()]
    assert len(got) == 2 * len(want) and dict(got) == want


def test_names_elsewhere_are_whole_words_of_other_files(spark):
    files = [("a.py", "def get_app(): pass"), ("b.py", "get_application() get_app"), ("c.py", None), ("d.py", "naïve x"), ("d.py", "get_app again")]
    names = [("a.py", "unreferenced_function", "get_app"), ("b.py", "unreferenced_class", "get_application"), ("z.py", "unreferenced_class", "naïve"), ("a.py", "unused_import", "get_app")]
    table = spark.createDataFrame(names, "path string, kind string, name string")
    got = {(r["path"], r["kind"], r["name"]): r["elsewhere"] for r in projects.named_elsewhere(table, spark.createDataFrame(files, FILES)).collect()}
    corpus = lambda own: "\n".join(c for p, c in files if p != own and c)
    assert got == {n: len({p for p, c in files if p != n[0] and c and re.search(rf"\b{n[2]}\b", c)}) for n in names}
    kept = {tuple(r) for r in projects.without_cross_file(table, spark.createDataFrame(files, FILES)).collect()}
    assert kept == {n for n in names if n[1] == "unused_import" or not re.search(rf"\b{n[2]}\b", corpus(n[0]))}


PROJECT = {
    "app/web.py": "from app.db import save, find\nfrom app import tools\nfrom .conf import API_KEY\n\ndef view(request):\n    name = request.args.get('n')\n    save(name)\n    tools.shell(int(name))\n    tools.shell(name)\n    logger.info(API_KEY)\n",
    "app/db.py": "def save(value):\n    row = f'insert {value}'\n    run_it(row)\n\ndef run_it(sql):\n    cur.execute(sql)\n\ndef find():\n    return input()\n",
    "app/tools.py": "import shlex\ndef shell(cmd, quiet=True):\n    os.system(cmd)\n    cmd = shlex.quote(cmd)\n    os.system(cmd)\n    cmd = 'ls'\n    os.system(cmd)\n",
    "app/conf.py": "import sys\nAPI_KEY = 'k'\nPORT = 80\nWHERE = sys.argv\n",
    "app/job.py": "from app.db import find\nfrom app.conf import WHERE\n\nclass Job:\n    def work(self):\n        what = find()\n        self.go(what)\n    def go(self, thing):\n        eval(thing)\n        open(WHERE)\n\ndef loop(x):\n    x = x + input()\n    loop(x)\n    eval(x)\n",
    "app/broken.py": "def (",
}


def test_taint_crosses_functions_returns_and_files(spark):
    files = spark.createDataFrame([*PROJECT.items(), ("app/none.py", None)], FILES)
    got = {(r["path"], r["sink_line"], r["source_path"], r["source"], r["source_line"], r["sink_type"] in r["labels"], r["confidence"]) for r in taint.taint_paths(files).collect()}
    assert got == {
        ("app/db.py", 6, "app/web.py", "request.args.get", 6, True, 0.50625),
        ("app/tools.py", 3, "app/web.py", "request.args.get", 6, True, 0.675),
        ("app/tools.py", 5, "app/web.py", "request.args.get", 6, False, 0.2025),
        ("app/job.py", 9, "app/db.py", "input", 9, True, 0.50625),
        ("app/job.py", 10, "app/conf.py", "sys.argv", 4, True, 0.675),
        ("app/job.py", 15, "app/job.py", "input", 13, True, 0.9),
    }


def test_a_use_takes_the_definition_before_it(spark):
    code = "def f():\n    a = input()\n    b = a\n    a = 'x'\n    eval(a)\n    eval(b)\n    a += b\n    eval(a)\n"
    got = {r["sink_line"] for r in taint.taint_paths(spark.createDataFrame([("a.py", code)], FILES)).collect()}
    assert got == {6, 8}


def test_imported_secrets_reach_sinks(spark):
    web = "from conf import API_KEY, PORT\nimport conf\n# print(API_KEY)\nprint(PORT)\nprint(DB_PASSWORD, API_KEY)\n\n\n\nx = mask(\n  API_KEY)\nprint(API_KEY)\n\n\n\nsession.query(API_KEY)\ndebug = False\nMY_API_KEY = 1\nprint(MY_API_KEY)\n"
    files = [("web.py", web), ("conf.py", "API_KEY = 'k'\nPORT = -1\nDB_PASSWORD = ['x']\nTOKEN = f()\n"), ("alone.py", "print(API_KEY)\n")]
    got = {tuple(r) for r in projects.cross_file_check(spark.createDataFrame(files, FILES)).collect()}
    assert got == {("web.py", 5, "log", "DB_PASSWORD", "conf.py"), ("web.py", 15, "sql", "API_KEY", "conf.py"), ("web.py", 16, "flag", "debug", None)}
    names = {(r["path"], r["name"]) for r in python_flows.constants(spark.createDataFrame(files, FILES)).collect()}
    assert names == {("conf.py", "API_KEY"), ("conf.py", "PORT"), ("conf.py", "DB_PASSWORD"), ("web.py", "MY_API_KEY")}


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], FILES)
    assert taint.taint_paths(none).count() == 0 and projects.cross_file_check(none).count() == 0
    assert projects.named_elsewhere(none.select("path", F.col("content").alias("name")), none).count() == 0
