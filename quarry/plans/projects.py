"""Queries over projects of several files: imports, modules, names elsewhere, chains, cycles, taint across functions and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import contracts
from quarry.operators import detectors as D
from quarry.operators import graphs as G
from quarry.operators import projects as P
from quarry.operators import taint
from quarry.operators import windows
from quarry.plans.base import query
from quarry.plans.carriers import CARRIERS
from quarry.sources import python_ast

# Rings of 3 to 11 symbols, some broken, some with chords.
CARRIERS["rings"] = """SELECT 'r' || CAST(block AS STRING) || '_' || CAST(i AS STRING) AS source, 'r' || CAST(block AS STRING) || '_' || CAST((i + 1) % size AS STRING) AS target,
 CASE p_size % 4 WHEN 0 THEN 'inherits' WHEN 1 THEN 'implements' WHEN 2 THEN 'imports' ELSE CASE WHEN p_size % 16 = 3 THEN 'calls' ELSE 'imports' END END AS relation, p_partkey * 2 AS position
 FROM (SELECT *, CAST(FLOOR((p_partkey - 1) / 12) AS BIGINT) AS block, (p_partkey - 1) % 12 AS i, 3 + CAST(FLOOR((p_partkey - 1) / 12) AS BIGINT) % 9 AS size FROM part) AS x WHERE i < size
 UNION ALL SELECT 'r' || CAST(block AS STRING) || '_' || CAST(i AS STRING), 'r' || CAST(block AS STRING) || '_' || CAST((i + 2) % size AS STRING), 'imports', p_partkey * 2 + 1
 FROM (SELECT *, CAST(FLOOR((p_partkey - 1) / 12) AS BIGINT) AS block, (p_partkey - 1) % 12 AS i, 3 + CAST(FLOOR((p_partkey - 1) / 12) AS BIGINT) % 9 AS size FROM part) AS x WHERE i < size AND p_size % 7 = 0"""

# Packages of five modules that import the next one; what they hold varies with the columns of the part.
_NUMBERED = "SELECT *, CAST(FLOOR(p_partkey / 5) AS BIGINT) AS b, p_partkey % 5 AS i FROM part"
CARRIERS["project"] = f"""SELECT p_partkey AS id, b, i, p_size, 'app/b' || CAST(b AS STRING) || '/m' || CAST(i AS STRING) || '.py' AS path, 'python' AS language,
 'import os' || chr(10) ||
 CASE WHEN i = 4 THEN 'import shlex' WHEN p_size % 2 = 0 THEN 'from app.b' || CAST(b AS STRING) || '.m' || CAST(i + 1 AS STRING) || ' import step' || CAST(i + 1 AS STRING) || ', TOKEN_' || CAST(i + 1 AS STRING) ELSE 'from .m' || CAST(i + 1 AS STRING) || ' import step' || CAST(i + 1 AS STRING) || ', TOKEN_' || CAST(i + 1 AS STRING) END || chr(10) ||
 'TOKEN_' || CAST(i AS STRING) || ' = "x"' || chr(10) ||
 'def step' || CAST(i AS STRING) || '(x):' || chr(10) ||
 CASE p_size % 10 WHEN 0 THEN '    y = shlex.quote(x)' WHEN 1 THEN '    y = "fixed"' ELSE '    y = x + "!"' END || chr(10) ||
 CASE WHEN i < 4 THEN '    step' || CAST(i + 1 AS STRING) || '(y)' ELSE '    os.system(y)' END || chr(10) ||
 CASE WHEN p_size % 4 = 0 THEN '    db.execute(y)' ELSE '    pass' END || chr(10) ||
 'def fetch' || CAST(i AS STRING) || '():' || chr(10) || '    return input()' || chr(10) ||
 'def main' || CAST(i AS STRING) || '():' || chr(10) ||
 CASE p_size % 3 WHEN 0 THEN '    a = input()' WHEN 1 THEN '    a = fetch' || CAST(i AS STRING) || '()' ELSE '    a = "safe"' END || chr(10) ||
 '    step' || CAST(i AS STRING) || '(a)' || chr(10) ||
 CASE WHEN i = 4 THEN '    verify_ssl = False' WHEN p_size % 5 = 0 THEN '    print(TOKEN_' || CAST(i + 1 AS STRING) || ')' WHEN p_size % 5 = 1 THEN '    print(mask(TOKEN_' || CAST(i + 1 AS STRING) || '))' WHEN p_size % 5 = 2 THEN '    cursor.execute(TOKEN_' || CAST(i + 1 AS STRING) || ')' WHEN p_size % 5 = 3 THEN '    # print(TOKEN_' || CAST(i + 1 AS STRING) || ')' ELSE '    headers["t"] = TOKEN_' || CAST(i + 1 AS STRING) END AS content
 FROM ({_NUMBERED}) AS x"""

_TAINT = """WITH RECURSIVE labels AS (SELECT unnest(['SQL-value', 'CMD-argument', '*']) AS label),
x(b, i, label, confidence, source_path, source_line) AS (
  SELECT b, i, label, CASE p_size % 3 WHEN 0 THEN 0.675::DOUBLE ELSE 0.50625::DOUBLE END, path, CASE p_size % 3 WHEN 0 THEN 11 ELSE 9 END FROM project, labels WHERE p_size % 3 < 2
  UNION ALL
  SELECT n.b, n.i, label, round(confidence * 0.75, 6), source_path, source_line FROM x JOIN project p ON p.b = x.b AND p.i = x.i JOIN project n ON n.b = p.b AND n.i = p.i + 1
  WHERE p.p_size % 10 <> 1 AND NOT (p.p_size % 10 = 0 AND label = 'CMD-argument')),
y AS (SELECT x.*, p.path, p.p_size FROM x JOIN project p ON p.b = x.b AND p.i = x.i WHERE p.p_size % 10 <> 1 AND NOT (p.p_size % 10 = 0 AND label = 'CMD-argument')),
sinks AS (SELECT b, i, 6 AS sink_line, 'os.system' AS sink, 'CMD-argument' AS sink_type FROM project WHERE i = 4 UNION ALL SELECT b, i, 7, 'db.execute', 'SQL-value' FROM project WHERE p_size % 4 = 0),
met AS (SELECT s.*, y.*, row_number() OVER (PARTITION BY s.b, s.i, sink ORDER BY CASE WHEN label = sink_type THEN 0 ELSE 1 END, confidence DESC, source_path, source_line) AS n
  FROM sinks s JOIN y ON y.b = s.b AND y.i = s.i AND label IN (sink_type, '*'))
SELECT path, sink_line, sink, sink_type, source_path, source_line, label = sink_type AS dangerous, round(CASE WHEN label = sink_type THEN confidence ELSE confidence * 0.3 END, 4) AS confidence FROM met WHERE n = 1"""


@query("c16_interprocedural_taint", _TAINT, ("project",))
def c16(project):
    """Taint from any function to any sink, through arguments, returns and imports, up to five files away."""
    out = taint.taint_paths(project.select("path", "content"))
    return out.select("path", "sink_line", "sink", "sink_type", "source_path", "source_line", F.array_contains("labels", F.col("sink_type")).alias("dangerous"), F.round("confidence", 4).alias("confidence"))


@query("c13_cross_file_secrets", """SELECT p.path, 13 AS line, CASE WHEN p.i = 4 THEN 'flag' WHEN p.p_size % 5 = 0 THEN 'log' WHEN p.p_size % 5 = 2 THEN 'sql' ELSE 'header' END AS kind,
  CASE WHEN p.i = 4 THEN 'verify_ssl' ELSE 'TOKEN_' || (p.i + 1) END AS name, CASE WHEN p.i < 4 THEN n.path END AS from_file
FROM project p LEFT JOIN project n ON n.b = p.b AND n.i = p.i + 1 WHERE p.i = 4 OR (n.path IS NOT NULL AND p.p_size % 5 IN (0, 2, 4))""", ("project",))
def c13(project):
    return P.cross_file_check(project.select("path", "content"))


_STARTS = "SELECT DISTINCT source AS start FROM rings WHERE source LIKE '%\\_0' ESCAPE '\\'"


@query("g4_dependency_chains", f"""WITH RECURSIVE s AS ({_STARTS}),
d(start, node, depth) AS (SELECT start, start, 0 FROM s UNION SELECT d.start, e.target, d.depth + 1 FROM d JOIN rings e ON e.source = d.node WHERE depth < 5),
m AS (SELECT start, node, min(depth) AS depth FROM d GROUP BY start, node),
p(start, node, depth, key, path) AS (SELECT start, start, 0, '', start FROM s UNION ALL
  SELECT p.start, e.target, p.depth + 1, p.key || lpad(e.position::VARCHAR, 12, '0'), p.path || ' ' || e.relation || ' ' || e.target FROM p JOIN rings e ON e.source = p.node JOIN m ON m.start = p.start AND m.node = e.target AND m.depth = p.depth + 1 WHERE p.depth < 5),
best AS (SELECT start, node, depth, arg_min(path, key) AS path FROM p GROUP BY start, node, depth)
SELECT b.start, (b.depth + 1)::INT AS depth, b.path || ' ' || e.relation || ' ' || e.target AS path FROM best b JOIN rings e ON e.source = b.node WHERE b.depth < 5""", ("rings",))
def g4(rings):
    starts = rings.where(F.col("source").rlike("_0$")).select(F.col("source").alias("node")).distinct()
    found = G.chains(rings, starts)
    text = F.concat(F.col("start"), F.array_join(F.transform("path", lambda e: F.concat(F.lit(" "), e["relation"], F.lit(" "), e["target"])), ""))
    return found.select("start", "depth", text.alias("path"))


@query("g5_cycles", """WITH RECURSIVE e AS (SELECT DISTINCT source AS src, target AS dst FROM rings WHERE relation <> 'calls'),
p(nodes, closed) AS (SELECT [src, dst], false FROM e WHERE src < dst UNION ALL
  SELECT list_append(nodes, dst), dst = nodes[1] FROM p JOIN e ON e.src = nodes[-1] WHERE NOT closed AND (dst = nodes[1] OR (dst > nodes[1] AND NOT list_contains(nodes, dst))))
SELECT array_to_string(nodes, ' ') AS cycle, len(nodes) - 1 AS size FROM p WHERE closed""", ("rings",))
def g5(rings):
    found = G.cycles(rings.where("relation IN ('inherits', 'implements', 'imports')").select(F.col("source").alias("src"), F.col("target").alias("dst")))
    return found.select(F.array_join("nodes", " ").alias("cycle"), (F.size("nodes") - 1).cast("long").alias("size"))


# Imports of part numbers as modules of suppliers' packages: files, packages and files beside the importing one.
CARRIERS["tree"] = "SELECT CASE WHEN p_size % 3 = 0 THEN 'lib/p' || CAST(p_partkey % 37 AS STRING) || '/m' || CAST(p_partkey AS STRING) || '.py' WHEN p_size % 3 = 1 THEN 'lib/p' || CAST(p_partkey AS STRING) || '/__init__.py' ELSE 'src/s' || CAST(p_partkey % 11 AS STRING) || '/m' || CAST(p_partkey AS STRING) || '.py' END AS path FROM part"
CARRIERS["import_rows"] = """SELECT l_orderkey AS id, l_linenumber AS n, 'src/s' || CAST(l_suppkey % 11 AS STRING) || '/deep/f' || CAST(l_orderkey % 50 AS STRING) || '.py' AS path,
 CASE l_linenumber % 4 WHEN 0 THEN 'lib.p' || CAST(l_partkey % 37 AS STRING) || '.m' || CAST(l_partkey AS STRING) WHEN 1 THEN 'lib.p' || CAST(l_partkey AS STRING) WHEN 2 THEN 'm' || CAST(l_partkey AS STRING) ELSE 'x.m' || CAST(l_partkey AS STRING) END AS module,
 CAST(CASE WHEN l_linenumber % 4 = 2 THEN 2 ELSE 0 END AS INT) AS level FROM lineitem"""


@query("j27_resolved_imports", """WITH t AS (SELECT DISTINCT path FROM tree),
c AS (SELECT id, n, path, module, level, regexp_replace(path, '/[^/]*$', '') AS folder FROM import_rows),
k AS (SELECT *, CASE WHEN level = 2 THEN regexp_replace(folder, '/[^/]*$', '') || '/' || module ELSE replace(module, '.', '/') END AS stem FROM c)
SELECT id, n, k.path, module, CASE WHEN a.path IS NOT NULL THEN a.path WHEN b.path IS NOT NULL THEN b.path ELSE s.path END AS target_file
FROM k LEFT JOIN t a ON a.path = stem || '.py' LEFT JOIN t b ON b.path = stem || '/__init__.py' LEFT JOIN t s ON s.path = folder || '/' || split_part(module, '.', -1) || '.py'""", ("tree", "import_rows"))
def j27(tree, rows):
    return P.resolve_modules(rows, tree).select("id", "n", "path", "module", "target_file")


CARRIERS["modules"] = """SELECT 'mod-' || s_name AS module, 'src/m' || CAST(s_suppkey % 9 AS STRING) || CASE WHEN s_suppkey % 3 = 0 THEN '/f' || CAST(s_suppkey AS STRING) || '.py' ELSE '' END AS prefix, s_suppkey AS position FROM supplier"""
CARRIERS["owned"] = """SELECT seq, CASE WHEN seq % 17 = 0 THEN NULL WHEN seq % 17 = 1 THEN 'unknown' WHEN seq % 17 = 2 THEN 'setup.py' WHEN seq % 17 = 3 THEN replace(path, '/', chr(92)) WHEN seq % 17 = 4 THEN replace(path, 'src/m', 'src/mx') ELSE path END AS path FROM findings_of"""
CARRIERS["findings_of"] = "SELECT l_orderkey AS seq, 'src/m' || CAST(l_partkey % 12 AS STRING) || '/f' || CAST(l_partkey % 211 AS STRING) || '.py' AS path FROM lineitem"


@query("j36_owning_modules", """WITH p AS (SELECT DISTINCT path, replace(path, chr(92), '/') AS clean FROM owned),
best AS (SELECT path, module, row_number() OVER (PARTITION BY path ORDER BY length(prefix) DESC, position) AS n FROM p JOIN modules ON clean = prefix OR starts_with(clean, prefix || '/'))
SELECT o.seq, o.path, CASE WHEN coalesce(o.path, '') IN ('', 'unknown') THEN 'unknown' WHEN b.module IS NOT NULL THEN b.module WHEN contains(replace(o.path, chr(92), '/'), '/') THEN split_part(replace(o.path, chr(92), '/'), '/', 1) ELSE 'root' END AS module
FROM owned o LEFT JOIN best b ON b.path = o.path AND b.n = 1""", ("findings_of", "owned", "modules"))
def j36(findings, owned, modules):
    return P.owning_modules(owned, modules).select("seq", "path", "module")


@query("j25_named_elsewhere", """WITH names AS (SELECT path, 'class' AS kind, 'Part' || id AS name FROM code UNION ALL SELECT path, 'function', 'load' FROM code UNION ALL SELECT path, 'module', split_part(content, ' ', 2) FROM code),
w AS (SELECT DISTINCT path, unnest(regexp_extract_all(content, '[\\pL\\pN_]+')) AS name FROM code UNION SELECT 'doc-' || doc_id, unnest(regexp_extract_all(text, '[\\pL\\pN_]+')) FROM documents),
c AS (SELECT name, count(*) AS n FROM (SELECT DISTINCT path, name FROM w) GROUP BY name)
SELECT names.path, kind, names.name, coalesce(n, 0) - (EXISTS (SELECT 1 FROM w WHERE w.path = names.path AND w.name = names.name))::INT AS elsewhere FROM names LEFT JOIN c ON c.name = names.name""", ("code",), ("documents",))
def j25(code, documents):
    asked = {"class": F.concat(F.lit("Part"), F.col("id").cast("string")), "function": F.lit("load"), "module": F.split_part("content", F.lit(" "), F.lit(2))}
    own = code.select("path", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(v, F.lit("")).alias("name")) for k, v in asked.items()])).alias("x")).select("path", "x.kind", "x.name")
    files = code.select("path", "content").unionByName(documents.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")))
    return P.named_elsewhere(own, files).select("path", "kind", "name", "elsewhere")


# Files whose imports, exports, uses and definitions vary with the columns of the part.
CARRIERS["scattered"] = """SELECT p_partkey AS id, p_size AS size, 'lib/f' || CAST(p_partkey AS STRING) || '.py' AS path,
 'from __future__ import annotations' || chr(10) || 'import os' || chr(10) ||
 CASE p_size % 4 WHEN 0 THEN 'import json as j' WHEN 1 THEN 'from typing import TYPE_CHECKING' WHEN 2 THEN 'from x import *' ELSE 'from a import b, c' END || chr(10) ||
 CASE WHEN p_size % 3 = 0 THEN 'if typing.TYPE_CHECKING:' || chr(10) || '    import late' ELSE 'import early.inner' || chr(10) || 'pass' END || chr(10) ||
 CASE p_size % 5 WHEN 0 THEN '__all__ = ["os", "b"]' WHEN 1 THEN 'os.getcwd()' WHEN 2 THEN 'j.loads(c)' WHEN 3 THEN 'early.inner.run(TYPE_CHECKING)' ELSE 'pass' END || chr(10) ||
 'def alone' || CAST(p_partkey AS STRING) || '(n):' || chr(10) || '    return alone' || CAST(p_partkey AS STRING) || '(n - 1)' || chr(10) ||
 CASE WHEN p_size % 7 = 0 THEN '@app.route("/x")' ELSE '@other' END || chr(10) || 'def view' || CAST(p_partkey AS STRING) || '():' || chr(10) || '    pass' || chr(10) ||
 'class Repo' || CAST(p_partkey AS STRING) || '(Base):' || chr(10) || '    def visit_Name(self): pass' || chr(10) || '    def go' || CAST(p_partkey AS STRING) || '(self): return self.step' || chr(10) || '    def step(self): pass' || chr(10) ||
 CASE WHEN p_size % 2 = 0 THEN 'alone' || CAST(p_partkey AS STRING) || '(1)' WHEN p_size % 3 = 0 THEN 'alone' || CAST(p_partkey + 1 AS STRING) || '(go' || CAST(p_partkey + 2 AS STRING) || ')' ELSE 'Repo' || CAST(p_partkey AS STRING) END AS content FROM part"""


@query("j23_file_unused_imports", """SELECT path, module, line FROM (
  SELECT path, 'os' AS module, 2 AS line, size % 5 NOT IN (0, 1) AS lost FROM scattered UNION ALL SELECT path, 'json', 3, size % 4 = 0 AND size % 5 <> 2 FROM scattered
  UNION ALL SELECT path, 'typing.TYPE_CHECKING', 3, size % 4 = 1 AND size % 5 <> 3 FROM scattered UNION ALL SELECT path, 'a.b', 3, size % 4 = 3 AND size % 5 <> 0 FROM scattered UNION ALL SELECT path, 'a.c', 3, size % 4 = 3 AND size % 5 <> 2 FROM scattered
  UNION ALL SELECT path, 'early.inner', 4, size % 3 <> 0 AND size % 5 <> 3 FROM scattered) WHERE lost""", ("scattered",))
def j23(scattered):
    found = D.unused_imports(python_ast.parse(scattered, ("name", "call", "export", "import")))
    return found.select("path", F.col("detail").alias("module"), F.col("line").cast("int").alias("line"))


@query("j24_project_orphans", """WITH d AS (SELECT path, 'unreferenced_function' AS kind, 'alone' || id AS name, 7 AS line FROM scattered WHERE size % 2 <> 0
  UNION ALL SELECT path, 'unreferenced_function', 'view' || id, 10 FROM scattered WHERE size % 7 <> 0 UNION ALL SELECT path, 'unreferenced_class', 'Repo' || id, 12 FROM scattered WHERE size % 2 = 0 OR size % 3 = 0
  UNION ALL SELECT path, 'unreferenced_function', 'go' || id, 14 FROM scattered),
w AS (SELECT DISTINCT path, unnest(regexp_extract_all(content, '[\\pL\\pN_]+')) AS name FROM scattered), c AS (SELECT name, count(*) AS n FROM w GROUP BY name)
SELECT d.path, kind, d.name, line FROM d JOIN c ON c.name = d.name WHERE n = 1""", ("scattered",))
def j24(scattered):
    """Definitions that neither their own file nor any other names."""
    found = D.unreferenced_definitions(python_ast.parse(scattered, ("name", "attribute", "function", "class")))
    return P.without_cross_file(found, scattered).select("path", "kind", "name", F.col("line").cast("int").alias("line"))


# Documents as bodies of one word a line, with up to three targets, some outside.
CARRIERS["bodies"] = "SELECT doc_id AS id, replace(text, ' ', chr(10)) AS text, CAST(doc_id % 50 + 1 AS INT) AS start FROM documents"
CARRIERS["aims"] = "SELECT doc_id AS id, CAST(doc_id % 50 + CASE doc_id % 4 WHEN 0 THEN 40 WHEN 1 THEN 90 WHEN 2 THEN 7 ELSE -9 END AS INT) AS line FROM documents UNION ALL SELECT doc_id, CAST(doc_id % 50 + 1 + n_chars % 300 AS INT) FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, CAST(doc_id % 50 + 44 AS INT) FROM documents WHERE doc_id % 5 < 2"


@query("w12_centred_windows", """WITH b AS (SELECT id, start, string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) AS lines, text FROM bodies WHERE text <> ''),
n AS (SELECT *, len(lines) AS total FROM b),
t AS (SELECT DISTINCT n.id, a.line - start AS aim FROM n JOIN aims a ON a.id = n.id AND a.line - start BETWEEN 0 AND total - 1),
u AS (SELECT * FROM t UNION ALL SELECT id, least(5, total - 1) FROM n WHERE id NOT IN (SELECT id FROM t)),
c AS (SELECT sig, reach, sp * 9 + rp AS place FROM (SELECT unnest([5, 3, 2, 1]) AS sig, unnest([0, 1, 2, 3]) AS sp), (SELECT unnest([20, 15, 10, 7, 5, 3, 2, 1, 0]) AS reach, unnest(range(9)) AS rp)),
s AS (SELECT DISTINCT id, place, i FROM (SELECT n.id, place, unnest(range(least(sig, total))) AS i FROM n, c UNION ALL SELECT n.id, place, unnest(range(greatest(0, aim - reach), least(total, aim + reach + 1))) FROM n JOIN u ON u.id = n.id, c)),
g AS (SELECT s.id, place, i, i - coalesce(lag(i) OVER w, i - 1) - 1 AS gap, lines[i + 1] AS line, total - 1 - max(i) OVER (PARTITION BY s.id, place) AS rest FROM s JOIN n ON n.id = s.id WINDOW w AS (PARTITION BY s.id, place ORDER BY i)),
x AS (SELECT id, place, string_agg(CASE WHEN gap > 0 THEN '    ... [' || gap || ' lines omitted] ...' || chr(10) ELSE '' END || line, chr(10) ORDER BY i) || CASE WHEN max(rest) > 0 THEN chr(10) || '    ... [' || max(rest) || ' lines omitted] ...' ELSE '' END AS excerpt FROM g GROUP BY id, place),
f AS (SELECT id, arg_min(excerpt, place) AS excerpt, min(place) AS place FROM x WHERE length(excerpt) // 4 <= 60 GROUP BY id)
SELECT bodies.id, sha256(coalesce(excerpt, CASE WHEN length(text) // 4 <= 60 THEN text ELSE text[:240] END)) AS excerpt, sig AS top, reach FROM bodies LEFT JOIN f ON f.id = bodies.id LEFT JOIN c ON c.place = f.place""", ("bodies", "aims"))
def w12(bodies, aims):
    return windows.centred(bodies, aims, 60).select("id", F.sha2("excerpt", 256).alias("excerpt"), "top", "reach")


CARRIERS["asked_ops"] = """SELECT CAST(c_custkey AS BIGINT) AS seq, CASE c_nationkey % 6 WHEN 0 THEN 'get' WHEN 1 THEN 'Fetch' WHEN 2 THEN 'create' WHEN 3 THEN 'item' ELSE 'remove' END || 'Thing' || CAST(c_custkey % 120 AS STRING) AS name,
 CASE c_nationkey % 4 WHEN 0 THEN 'String' WHEN 1 THEN 'List<int>' WHEN 2 THEN NULL ELSE 'Order?' END AS input_type, CASE c_nationkey % 5 WHEN 0 THEN 'bool' WHEN 1 THEN 'number' WHEN 2 THEN '' ELSE 'double' END AS output_type FROM customer"""
CARRIERS["offered_ops"] = """SELECT CAST(s_suppkey AS BIGINT) AS position, CASE s_nationkey % 5 WHEN 0 THEN 'get' WHEN 1 THEN 'load' WHEN 2 THEN 'item' WHEN 3 THEN 'thing' ELSE 'delete' END || CASE s_nationkey % 5 WHEN 3 THEN '' ELSE 'Thing' END || CAST(s_suppkey % 80 AS STRING) AS name,
 CASE s_nationkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'long[]' ELSE NULL END AS input_type, CASE s_nationkey % 4 WHEN 0 THEN 'Boolean' WHEN 1 THEN 'int' ELSE 'decimal' END AS output_type FROM supplier"""
_STEM = "CASE WHEN regexp_matches({0}, '(?i)^(get|fetch|load|create|delete|remove).') THEN lower(substr(regexp_replace({0}, '(?i)^(get|fetch|load|create|delete|remove)', ''), 1, 1)) || substr(regexp_replace({0}, '(?i)^(get|fetch|load|create|delete|remove)', ''), 2) ELSE {0} END"
_BARE = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '^list<(.*)>$', '\\1'), '\\[\\]$', ''), '\\?$', '')"
_GROUP = "CASE WHEN {0} IN ('string', 'str', 'text', 'varchar') THEN ['s'] WHEN {0} = 'number' THEN ['i', 'f'] WHEN {0} IN ('int', 'integer', 'long') THEN ['i'] WHEN {0} IN ('float', 'double', 'decimal') THEN ['f'] WHEN {0} IN ('bool', 'boolean') THEN ['b'] ELSE [{0}] END"
_SAME = lambda a, b: f"list_has_any({_GROUP.format(_BARE.format(a))}, {_GROUP.format(_BARE.format(b))})"


@query("j19_contract_gaps", f"""WITH k AS (SELECT key, arg_max(position, position * 2 + sub) AS position FROM (SELECT name AS key, position, 0 AS sub FROM offered_ops UNION ALL SELECT {_STEM.format('name')}, position, 1 FROM offered_ops WHERE {_STEM.format('name')} <> name) GROUP BY key),
m AS (SELECT a.*, coalesce(e.position, n.position) AS position FROM asked_ops a LEFT JOIN k e ON e.key = a.name LEFT JOIN k n ON n.key = {_STEM.format('a.name')}),
t AS (SELECT m.name, m.seq, m.position, coalesce(m.input_type, '') AS sent, coalesce(m.output_type, '') AS wanted, coalesce(o.input_type, '') AS taken, coalesce(o.output_type, '') AS given, o.name AS offer FROM m LEFT JOIN offered_ops o ON o.position = m.position)
SELECT 'missing_operation' AS kind, name, seq, NULL::BIGINT AS position FROM t WHERE position IS NULL
UNION ALL SELECT 'input_type_missing', name, seq, position FROM t WHERE position IS NOT NULL AND sent <> '' AND taken = ''
UNION ALL SELECT 'input_type_mismatch', name, seq, position FROM t WHERE position IS NOT NULL AND sent <> '' AND taken <> '' AND NOT {_SAME('sent', 'taken')}
UNION ALL SELECT 'output_type_mismatch', name, seq, position FROM t WHERE position IS NOT NULL AND wanted <> '' AND given <> '' AND NOT {_SAME('wanted', 'given')}
UNION ALL SELECT 'unused_operation', name, NULL, position FROM offered_ops WHERE name NOT IN (SELECT offer FROM t WHERE offer IS NOT NULL)""", ("asked_ops", "offered_ops"))
def j19(asked, offered):
    return contracts.contract_gaps(asked, offered)
