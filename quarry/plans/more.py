"""Further queries: chunks, similar functions, fuzzy contracts, more detectors, plug-ins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import scores, text
from quarry.operators import chunks, registry
from quarry.operators import rules as R
from quarry.plans.base import query
from quarry.plans.carriers import CARRIERS
from quarry.plans.detect import _CODE_LINES, _match_sql
from quarry.sources import python_ast


@query("j14_similar_functions", """WITH t AS (SELECT DISTINCT p_brand AS file, p_partkey AS name, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS t FROM part), n AS (SELECT file, name, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT a.file, a.name AS x, b.name AS y, count(*) AS shared FROM t a JOIN t b ON a.file = b.file AND a.t = b.t AND a.name < b.name GROUP BY ALL)
SELECT c.file, x AS name_a, y AS name_b, floor(shared * 100.0 / (p.n + q.n - shared))::BIGINT AS percent FROM c JOIN n p ON p.file = c.file AND p.name = x JOIN n q ON q.file = c.file AND q.name = y WHERE shared >= 0.8 * (p.n + q.n - shared)""", (), ("part",))
def j14(part):
    f = part.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("name"), F.concat_ws(" ", "p_name", "p_type").alias("body"))
    return chunks.similar_functions(f)


@query("j20_fuzzy_contracts", None, ("consumer_ops", "provider_ops"))
def j20(c, p):
    # 0.8 needs lengths within two thirds of each other: pairs meet by length, and lose none
    a = c.select("name").distinct().withColumn("stem", F.lower(text.operation_stem(F.col("name")))).withColumn("verb", text.verb_class(F.col("name")))
    b = p.select(F.col("name").alias("provider")).distinct().withColumn("p_stem", F.lower(text.operation_stem(F.col("provider")))).withColumn("p_verb", text.verb_class(F.col("provider")))
    met = a.withColumn("len", F.explode(F.sequence(F.expr("(2 * length(stem) + 2) div 3"), F.expr("3 * length(stem) div 2"))))
    j = met.join(b, F.col("len") == F.length("p_stem")).where(F.coalesce(F.col("verb") == F.col("p_verb"), F.lit(True)))
    scored = j.withColumn("ratio", chunks.sequence_ratio(F.col("stem"), F.col("p_stem"), 0.8)).where("ratio >= 0.8")
    w = Window.partitionBy("name").orderBy(F.desc("ratio"), "provider")
    return scored.withColumn("n", F.row_number().over(w)).where("n = 1").select("name", "provider", F.round("ratio", 6).alias("ratio"))


@query("x9_line_similarity", None, (), ("part",))
def x9(part):
    return part.select("p_partkey", F.round(chunks.sequence_ratio(F.col("p_name"), F.lower("p_type")), 6).alias("ratio"))


@query("w4_packed_chunks", None, ("code",))
def w4(code):
    units = R.lines(code).select("path", "line", text.estimated_tokens(F.col("text")).alias("tokens"))
    return chunks.packed_units(units, 20, 4, 1)


@query("w8_context_block", f"WITH lines AS ({_CODE_LINES}) SELECT path, line, md5(string_agg(text, chr(10)) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)) AS h FROM lines", ("code",))
def w8(code):
    return R.line_window(R.lines(code), 3, 2).select("path", "line", F.md5("window").alias("h"))


CARRIERS["nested"] = """SELECT p_brand || '/' || CAST(p_partkey AS STRING) AS path, 'class A {' || chr(10) || '  def f():' || chr(10) || '    x = {' || CASE p_size % 3 WHEN 0 THEN '}' ELSE ' a' END || chr(10) || chr(10) ||
 CASE p_partkey % 4 WHEN 0 THEN '    }' WHEN 1 THEN '  y } }' WHEN 2 THEN 'def g():' ELSE '      def h(): {}' END || chr(10) || '  ' || chr(10) || CASE p_size % 4 WHEN 0 THEN '  def k():' WHEN 1 THEN 'def m():' WHEN 2 THEN '}' ELSE '   z' END || chr(10) || '    q }' || chr(10) AS content FROM part"""
_NESTED = "l AS (SELECT path, generate_subscripts(string_split(content, chr(10)), 1) AS line, unnest(string_split(content, chr(10))) AS text FROM nested)"


@query("w10_indented_blocks", f"""WITH {_NESTED}, f AS (SELECT *, length(text) - length(ltrim(text)) AS indent FROM l WHERE trim(text) <> ''), h AS (SELECT * FROM f WHERE regexp_matches(text, '^ *(def|class) ')),
e AS (SELECT h.path, h.line, min(f.line) AS next FROM h LEFT JOIN f ON f.path = h.path AND f.line > h.line AND f.indent <= h.indent GROUP BY ALL)
SELECT e.path, e.line::INT AS line, max(f.line)::INT AS last FROM e JOIN f ON f.path = e.path AND (e.next IS NULL OR f.line < e.next) GROUP BY ALL""", ("nested",))
def w10(files):
    return chunks.indented_blocks(files, r"^ *(def|class) ")


@query("w11_brace_blocks", f"""WITH {_NESTED}, d AS (SELECT *, sum(o - c) OVER (PARTITION BY path ORDER BY line) AS depth FROM (SELECT *, length(text) - length(replace(text, chr(123), '')) AS o, length(text) - length(replace(text, chr(125), '')) AS c FROM l)),
h AS (SELECT path, line, depth - o + c AS base FROM d WHERE regexp_matches(text, '^ *(def|class) ')), b AS (SELECT h.path, h.line, h.base, min(d.line) FILTER (d.o > 0) AS first, max(d.line) AS total FROM h JOIN d ON d.path = h.path AND d.line >= h.line GROUP BY ALL)
SELECT b.path, b.line::INT AS line, coalesce(min(d.line), any_value(b.total))::INT AS last FROM b LEFT JOIN d ON d.path = b.path AND d.line >= b.first AND d.depth <= b.base GROUP BY b.path, b.line""", ("nested",))
def w11(files):
    return chunks.brace_blocks(files, r"^ *(def|class) ")


@query("v7_code_chunks", "SELECT path, 'Part' || CAST(id AS STRING) AS name, 'class' AS chunk_type, 3 AS start, len(string_split(content, chr(10))) AS \"end\" FROM code", ("code",))
def v7(code):
    return chunks.definitions(code, python_ast.parse(code, ("function", "class"))).select("path", "name", "chunk_type", "start", "end")


@query("v11_should_chunk", "SELECT path, length(content) // 4 > 60 AS chunk FROM code", ("code",))
def v11(code):
    return code.select("path", (text.estimated_tokens(F.col("content")) > 60).alias("chunk"))


@query("a8_linter_base", "SELECT tier, round_even(greatest(0.1, least(10, 10 * 20 / (sum(CASE WHEN NOT ok THEN 0.5 ELSE 0 END) + 0.05 * count(*) / 100 + 20))), 1)::DOUBLE AS base FROM requests GROUP BY tier", ("requests",))
def a8(requests):
    g = requests.groupBy("tier").agg((F.sum(F.when(~F.col("ok"), 0.5).otherwise(0.0)) + 0.05 * F.count(F.lit(1)) / 100).alias("p"))
    return g.select("tier", F.bround(scores.decayed(10.0, F.col("p")), 1).alias("base"))


@query("a13_module_debt", """WITH c AS (SELECT type, code_hash FROM issues WHERE snapshot = 3), b AS (SELECT DISTINCT type, code_hash FROM issues WHERE snapshot = 0), d AS (SELECT DISTINCT type, code_hash FROM issues WHERE snapshot = 2),
n AS (SELECT type, count(*) AS n FROM c WHERE (type, code_hash) NOT IN (SELECT (type, code_hash) FROM b) AND (type, code_hash) NOT IN (SELECT (type, code_hash) FROM d) GROUP BY type),
r AS (SELECT type, count(*) AS n FROM d WHERE (type, code_hash) NOT IN (SELECT (type, code_hash) FROM c) GROUP BY type), k AS (SELECT type, count(*) AS n FROM d WHERE (type, code_hash) IN (SELECT (type, code_hash) FROM c) GROUP BY type)
SELECT c.type AS module, count(*) AS findings, coalesce(any_value(n.n), 0) AS new_debt, coalesce(any_value(r.n), 0) AS resolved_debt, coalesce(any_value(k.n), 0) + coalesce(any_value(n.n), 0) AS total_debt FROM c LEFT JOIN n USING (type) LEFT JOIN r USING (type) LEFT JOIN k USING (type) GROUP BY c.type""", ("issues",))
def a13(issues):
    from quarry.operators.findings import module_debt

    part = lambda n: issues.where(F.col("snapshot") == n).select(F.col("type").alias("module"), F.col("code_hash").alias("fingerprint"))
    return module_debt(part(3), part(0), part(2))


@query("a21_project_statistics", "SELECT language, count(*) AS n, count(*) FILTER (contains(path, 'src1')) AS tests, max(len(string_split(path, '/'))) AS depth FROM files GROUP BY language", ("files",))
def a21(files):
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains("path", F.lit("src1"))).alias("tests"), F.max(F.size(F.split("path", "/"))).alias("depth"))


@query("a29_healing_counters", "SELECT tier, count(*) AS attempts, count(*) FILTER (ok) AS fixed, count(*) FILTER (error = 'timeout') AS timeouts FROM requests GROUP BY tier", ("requests",))
def a29(requests):
    return requests.groupBy("tier").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("fixed"), F.count_if(F.col("error") == "timeout").alias("timeouts"))


@query("o3_frame_priority", "SELECT frame_id, coalesce(CASE frame_id WHEN 'AF' THEN 1 WHEN 'NO' THEN 5 END, 999) AS priority FROM (SELECT DISTINCT frame_id FROM findings)", ("findings",))
def o3(findings):
    p = F.when(F.col("frame_id") == "AF", 1).when(F.col("frame_id") == "NO", 5)
    return findings.select("frame_id").distinct().select("frame_id", F.coalesce(p, F.lit(999)).alias("priority"))


@query("d5_first_chunk", "SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY ALL", (), ("documents",))
def d5(docs):
    return docs.groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"))


@query("d10_catalog_union", "SELECT p_brand AS key, p_type AS entry FROM part WHERE p_size < 10 UNION SELECT p_brand, p_name FROM part WHERE p_size > 40", (), ("part",))
def d10(part):
    a = part.where("p_size < 10").select(F.col("p_brand").alias("key"), F.col("p_type").alias("entry"))
    return a.union(part.where("p_size > 40").select("p_brand", "p_name")).distinct()


@query("x27_bare_type", "SELECT name, CASE output_type WHEN 'List<Item>' THEN 'item' ELSE lower(output_type) END AS t FROM consumer_ops", ("consumer_ops",))
def x27(ops):
    return ops.select("name", text.bare_type(F.col("output_type")).alias("t"))


@query("x35_normalized_risk", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 5.0 ELSE least(10.0, greatest(0.0, CASE WHEN v > 10 AND v <= 100 THEN v / 10 ELSE v END)) END::DOUBLE AS risk FROM (SELECT o_orderkey, (o_orderkey % 150)::DOUBLE AS v FROM orders)", (), ("orders",))
def x35(orders):
    v = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise((F.col("o_orderkey") % 150).cast("string"))
    return orders.select("o_orderkey", scores.normalized_risk(v).alias("risk"))


@query("x40_normalized_finding", "SELECT seq, lower(severity) AS severity, split_part(path || ':' || line, ':', 1) AS file, coalesce(source, 'unknown') AS source FROM findings", ("findings",))
def x40(findings):
    place = F.concat("path", F.lit(":"), F.col("line").cast("string"))
    return findings.select("seq", F.lower("severity").alias("severity"), F.split_part(place, F.lit(":"), F.lit(1)).alias("file"), F.coalesce("source", F.lit("unknown")).alias("source"))


# Patterns of the further line detectors.
DEBUG = (R.Rule("debug-call", r"\b(?:print|breakpoint|pdb\.set_trace)\s*\(|console\.log\s*\(|\bdebugger\b", "low"),)


@query("c26_debug_calls", _match_sql(DEBUG), ("code",))
def c26(code):
    return R.match_patterns(code, DEBUG).select("path", "line", "rule_id")


@query("c2_page_scripts", "SELECT page_id FROM pages WHERE regexp_matches(html, '<script>[^<]*track\\(') AND regexp_matches(html, 'ad [0-9]*5 ')", (), ("pages",))
def c2_pages(pages):
    return pages.where(F.col("html").rlike(r"<script>[^<]*track\(") & F.col("html").rlike("ad [0-9]*5 ")).select("page_id")


@query("c50_magic_numbers", "SELECT path, '2' AS value FROM code WHERE contains(content, 'y = 2')", ("code",))
def c50(code):
    ok = ("0", "1", "-1")
    return python_ast.parse(code, ("literal",)).where((F.col("kind") == "literal") & (F.col("name") == "int") & ~F.col("value").isin(*ok)).select("path", "value")


@query("c55_data_clumps", "SELECT clump, n FROM (SELECT clump, count(*) AS n FROM code, (VALUES ('a,b,c'), ('b,c,d'), ('c,d,e'), ('a,b,filename')) AS v(clump) WHERE contains(content, 'c, d, e') OR clump = 'a,b,filename' GROUP BY clump) WHERE n > 2", ("code",))
def c55(code):
    f = python_ast.parse(code, ("function",)).where("kind = 'function' and n_params >= 3")
    runs = f.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("value", ",")) - 3), lambda i: F.array_join(F.array_sort(F.slice(F.split("value", ","), i + 1, 3)), ","))).alias("clump"))
    return runs.groupBy("clump").agg(F.count(F.lit(1)).alias("n")).where("n > 2")


@query("c61_unlogged_functions", f"WITH lines AS ({_CODE_LINES}) SELECT path, line FROM lines WHERE regexp_matches(text, '^\\s*def ')", ("code",))
def c61(code):
    return chunks.next_block_lacks(R.lines(code), r"^\s*def ", r"log(?:ger|ging)?\.", 5)


@query("c62_unclosed_resources", f"WITH lines AS ({_CODE_LINES}) SELECT path, line FROM lines WHERE contains(text, 'open(') AND NOT contains(text, 'with ')", ("code",))
def c62(code):
    return R.lines(code).where(F.contains("text", F.lit("open(")) & ~F.contains("text", F.lit("with "))).select("path", "line")


@query("st2_debt_state", """WITH b AS (SELECT DISTINCT code_hash FROM issues WHERE snapshot = 0), s AS (SELECT code_hash, min(snapshot)::BIGINT AS first_seen, max(snapshot) AS last FROM issues GROUP BY code_hash)
SELECT code_hash, first_seen FROM s WHERE code_hash NOT IN (SELECT code_hash FROM b) AND last = 3""", ("issues",))
def st2(issues):
    base = issues.where("snapshot = 0").select("code_hash").distinct()
    s = issues.groupBy("code_hash").agg(F.min("snapshot").cast("long").alias("first_seen"), F.max("snapshot").alias("last"))
    return s.join(base, "code_hash", "left_anti").where("last = 3").select("code_hash", "first_seen")


@query("h3_triage_lanes", "SELECT path, CASE WHEN language = 'sql' OR length(coalesce(content, '')) < 200 THEN 'fast' ELSE 'middle' END AS lane FROM files", ("files",))
def h3(files):
    safe = (F.col("language") == "sql") | (F.length(F.coalesce("content", F.lit(""))) < 200)
    return files.select("path", F.when(safe, "fast").otherwise("middle").alias("lane"))


@query("h5_scan_plan", "SELECT count(*) AS files, count(*) * 2 * 3 AS calls FROM files", ("files",))
def h5(files):
    per = registry.model_calls(1, "deep", 3)
    return files.agg(F.count(F.lit(1)).alias("files"), (F.count(F.lit(1)) * per).alias("calls"))


@query("h7_project_confidence", "SELECT module, round(least(1.0, 0.2 + 0.2 * (count(*) > 40)::INT + 0.15 * (count(DISTINCT language) > 1)::INT + 0.05), 4)::DOUBLE AS confidence FROM files GROUP BY module", ("files",))
def h7(files):
    g = files.groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("language").alias("k"))
    total = 0.2 + 0.2 * (F.col("n") > 40).cast("int") + 0.15 * (F.col("k") > 1).cast("int") + 0.05
    return g.select("module", F.round(F.least(F.lit(1.0), total), 4).alias("confidence"))


@query("u1_registered_frames", "SELECT path, 1 AS line, 'imports-json' AS rule_id FROM code WHERE contains(content, 'import json') UNION ALL SELECT path, 1, 'wide' FROM code WHERE length(content) > 10", ("code",))
def u1(code):
    r = registry.Registry()
    r.check("imports-json", "low", lambda path, content: [(1, "json")] if "import json" in content else [], priority=1)
    r.check("wide", "low", lambda path, content: [(1, "w")] if len(content) > 10 else [], requires=("imports-json",))
    r.check("never", "low", lambda path, content: [(1, "x")], requires=("missing",))
    return r.scan(code).select("path", "line", "rule_id")
