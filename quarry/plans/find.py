"""Queries over findings: suppression, baselines, joins, de-duplication, ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import scores, text
from quarry.operators import findings as O
from quarry.plans.base import query
from quarry.plans.carriers import CARRIERS

ENTRIES = [
    {"rules": ["xss-dom"], "file": "src/m1/*", "reason": "vendored"},
    {"rules": [], "file": "src/m2/f2.py", "line": 7, "reason": "reviewed"},
    {"rules": ["weak-crypto"], "line": 12, "reason": "checksum"},
    {"rules": ["cmd-injection"], "enabled": False, "reason": "off"},
]
_ENTRY = """((rule_id = 'xss-dom' AND regexp_matches(path, '^src/m1/.*$')) OR (path = 'src/m2/f2.py' OR line = 7) OR (rule_id = 'weak-crypto' AND line = 12))"""
_FP = f"sha256(rule_id || ':' || path || ':' || CASE WHEN regexp_matches(message, '{text.TAINT_MESSAGE}') THEN regexp_replace(regexp_extract(message, '{text.TAINT_MESSAGE}'), '{text.TAINT_MESSAGE}', 'taint:\\1->\\2[\\3]') ELSE regexp_replace(message, '{text.LINE_REFERENCE}', '', 'g') END)"
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE {} END"


@query("f18_suppressed", f"SELECT seq FROM findings WHERE NOT (rule_id = 'style-naming' OR regexp_matches(path, '^src/m5/.*$') OR {_ENTRY})", ("findings",))
def f18(findings):
    return O.suppress_entries(O.suppress_globals(findings, ["style-naming"], ["src/m5/*"]), ENTRIES).select("seq")


@query("f19_suppression_reason", f"""SELECT seq, CASE WHEN rule_id = 'style-naming' THEN 'global rule' WHEN regexp_matches(path, '^src/m5/.*$') THEN 'ignored file'
 WHEN rule_id = 'xss-dom' AND regexp_matches(path, '^src/m1/.*$') THEN 'vendored' WHEN path = 'src/m2/f2.py' OR line = 7 THEN 'reviewed' WHEN rule_id = 'weak-crypto' AND line = 12 THEN 'checksum' END AS reason FROM findings""", ("findings",))
def f19(findings):
    return O.suppression_reason(findings, ["style-naming"], ["src/m5/*"], ENTRIES).select("seq", "reason")


@query("f24_rule_wildcard", "SELECT seq FROM findings WHERE rule_id IN ('xss-dom', 'sql-injection')", ("findings",))
def f24(findings):
    rules = F.array(F.lit("xss-dom"), F.lit("sql-injection"))
    return findings.where((F.size(rules) == 0) | F.array_contains(rules, F.col("rule_id"))).select("seq")


@query("f25_entry_location", "SELECT seq FROM findings WHERE path = 'src/m2/f2.py' OR line = 7", ("findings",))
def f25(findings):
    return findings.where(O.entry_matches(ENTRIES[1], F.col("rule_id"), F.col("path"), F.col("line"))).select("seq")


@query("f26_rule_file_filter", "SELECT rule_id, count(*) AS kept FROM findings WHERE NOT (regexp_matches(path, 'f1[0-9]\\.py$') AND rule_id = 'xss-dom') GROUP BY rule_id", ("findings",))
def f26(findings):
    return findings.where(~(F.col("path").rlike(r"f1[0-9]\.py$") & (F.col("rule_id") == "xss-dom"))).groupBy("rule_id").agg(F.count(F.lit(1)).alias("kept"))


@query("f27_false_positives", "SELECT seq FROM findings WHERE NOT ((rule_id = 'sql-injection' AND frame_id = 'AF') OR contains(rule_id, 'naming') OR contains(message, 'line 13'))", ("findings",))
def f27(findings):
    fp = ((F.col("rule_id") == "sql-injection") & (F.col("frame_id") == "AF")) | F.contains("rule_id", F.lit("naming")) | F.contains("message", F.lit("line 13"))
    return findings.where(~fp).select("seq")


_LEARNED = [("false_positive", "xss-dom", "src/m3", "", 0.9), ("false_positive", "", "f77.py", "secret", 0.85), ("false_positive", "weak-crypto", "", "", 0.5), ("confirmed", "sql-injection", "", "", 0.99)]


@query("f28_learned_patterns", "SELECT seq FROM findings WHERE NOT ((rule_id = 'xss-dom' AND contains(path, 'src/m3')) OR (contains(path, 'f77.py') AND contains(message, 'secret')))", ("findings",))
def f28(findings):
    patterns = findings.sparkSession.createDataFrame(_LEARNED, "kind string, rule string, path_part string, message_part string, confidence double")
    return O.suppress_learned(findings, patterns).select("seq")


@query("f29_diff_lines", "SELECT seq FROM findings f WHERE path NOT IN (SELECT path FROM changed) OR line = 0 OR EXISTS (SELECT 1 FROM changed c WHERE c.path = f.path AND c.line = f.line)", ("findings", "changed"))
def f29(findings, changed):
    return O.filter_changed_lines(findings, changed).select("seq")


@query("f30_context_suppression", "SELECT f.path FROM files f JOIN contexts c ON f.path = c.path WHERE c.context IN ('EXAMPLE', 'DOCUMENTATION') OR (c.context = 'TEST' AND f.language = 'sql')", ("files", "contexts"))
def f30(files, contexts):
    j = files.join(contexts, "path")
    return j.where(F.col("context").isin("EXAMPLE", "DOCUMENTATION") | ((F.col("context") == "TEST") & (F.col("language") == "sql"))).select("path")


@query("f31_adjusted_severity", """SELECT path, s, CASE WHEN context = 'TEST' THEN CASE s WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE 'low' END
 WHEN context = 'PRODUCTION' AND is_entry THEN CASE s WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'high' WHEN 'high' THEN 'critical' ELSE 'critical' END ELSE s END AS adjusted
 FROM contexts CROSS JOIN (VALUES ('critical'), ('high'), ('medium'), ('low')) AS t(s)""", ("contexts",))
def f31(contexts):
    levels = F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low")])
    each = contexts.withColumn("s", F.explode(levels))
    return each.select("path", "s", scores.adjusted_severity(F.col("s"), F.col("context"), F.col("is_entry")).alias("adjusted"))


@query("f32_crowded_files", "SELECT seq FROM (SELECT seq, count(*) OVER (PARTITION BY path) AS n FROM findings) WHERE n <= 50", ("findings",))
def f32(findings):
    return O.overcrowded(findings).select("seq")


# joins


@query("j1_baseline_new", f"WITH k AS (SELECT DISTINCT {_FP} AS fp FROM baseline) SELECT seq FROM findings WHERE {_FP} NOT IN (SELECT fp FROM k)", ("findings", "baseline"))
def j1(findings, baseline):
    key = lambda df: df.withColumn("fingerprint", text.finding_fingerprint(F.col("rule_id"), F.col("path"), F.col("message")))
    return O.apply_baseline(key(findings), key(baseline))[0].select("seq")


@query("j1_baseline_known", f"WITH k AS (SELECT DISTINCT {_FP} AS fp FROM baseline) SELECT seq FROM findings WHERE {_FP} IN (SELECT fp FROM k)", ("findings", "baseline"))
def j1_known(findings, baseline):
    key = lambda df: df.withColumn("fingerprint", text.finding_fingerprint(F.col("rule_id"), F.col("path"), F.col("message")))
    return O.apply_baseline(key(findings), key(baseline))[1].select("seq")


_FLOW_MESSAGE = "CASE WHEN sup % 3 = 0 THEN 'Found. Unsanitized data flow: in' || CAST(sup % 9 AS STRING) || ' (line ' || CAST(line AS STRING) || ') -> out.run [' || severity || ' use] (line ' || CAST(seq % 90 AS STRING) || ')' ELSE message END"


@query("j2_fingerprint", f"SELECT seq, {_FP} AS fp FROM (SELECT seq, rule_id, path, {_FLOW_MESSAGE} AS message FROM findings)", ("findings",))
def j2(findings):
    told = findings.withColumn("message", F.expr(_FLOW_MESSAGE))
    return told.select("seq", text.finding_fingerprint(F.col("rule_id"), F.col("path"), F.col("message")).alias("fp"))


@query("j3_snapshot_compare", """WITH a AS (SELECT DISTINCT code_hash FROM issues WHERE snapshot = 1), b AS (SELECT code_hash, max(state) AS state FROM issues WHERE snapshot = 2 GROUP BY code_hash)
SELECT coalesce(a.code_hash, b.code_hash) AS code_hash, CASE WHEN b.code_hash IS NULL THEN 'resolved' WHEN a.code_hash IS NOT NULL THEN 'persistent' WHEN b.state = 'RESOLVED' THEN 'reopened' ELSE 'new' END AS kind FROM a FULL JOIN b ON a.code_hash = b.code_hash""", ("issues",))
def j3(issues):
    a = issues.where("snapshot = 1").select(F.col("code_hash").alias("before")).distinct()
    b = issues.where("snapshot = 2").groupBy(F.col("code_hash").alias("after")).agg(F.max("state").alias("state"))
    kind = F.when(F.col("after").isNull(), "resolved").when(F.col("before").isNotNull(), "persistent").when(F.col("state") == "RESOLVED", "reopened").otherwise("new")
    return a.join(b, a["before"] == b["after"], "full_outer").select(F.coalesce("before", "after").alias("code_hash"), kind.alias("kind"))


@query("j10_dead_writes", "SELECT DISTINCT field FROM writes WHERE field NOT IN (SELECT field FROM reads)", ("writes", "reads"))
def j10(writes, reads):
    return writes.select("field").distinct().join(reads.select("field").distinct(), "field", "left_anti")


@query("j11_missing_writes", "SELECT DISTINCT field FROM reads WHERE field NOT IN (SELECT field FROM writes)", ("writes", "reads"))
def j11(writes, reads):
    return reads.select("field").distinct().join(writes.select("field").distinct(), "field", "left_anti")


@query("j12_never_populated", "SELECT field FROM inits WHERE field NOT IN (SELECT field FROM writes)", ("writes", "inits"))
def j12(writes, inits):
    return inits.join(writes.select("field").distinct(), "field", "left_anti")


@query("j13_co_writes", """WITH s AS (SELECT DISTINCT field, site FROM writes), n AS (SELECT field, count(*) AS n FROM s GROUP BY field),
p AS (SELECT a.field AS field_a, b.field AS field_b, count(*) AS common FROM s a JOIN s b ON a.site = b.site AND a.field < b.field GROUP BY ALL HAVING count(*) >= 2)
SELECT field_a, field_b, common, x.n + y.n - 2 * common AS apart FROM p JOIN n x ON x.field = field_a JOIN n y ON y.field = field_b WHERE x.n + y.n - 2 * common > 0""", ("writes",))
def j13(writes):
    from quarry.operators.similarity import co_write_candidates

    return co_write_candidates(writes)


@query("j17_typosquats", """WITH d AS (SELECT pos, replace(regexp_replace(lower(trim(name)), '^@[^/]+/', ''), '_', '-') AS norm FROM deps),
k AS (SELECT * FROM (VALUES ('ring'), ('bolt'), ('widget'), ('gasket'), ('gear')) AS t(popular)),
e AS (SELECT * FROM d WHERE norm NOT IN (SELECT popular FROM k)),
c AS (SELECT pos, norm, popular, levenshtein(norm, popular)::INT AS distance FROM e, k WHERE levenshtein(norm, popular) <= 2
 UNION ALL SELECT pos, norm, popular, 99 FROM e, k WHERE norm IN ('python-' || popular, 'py-' || popular, 'node-' || popular, 'js-' || popular, popular || '-python', popular || '-py', popular || '-node', popular || '-js', popular || '-dev', popular || '2', popular || '3'))
SELECT pos, norm, popular, distance, CASE distance WHEN 1 THEN 'critical' WHEN 2 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY distance, popular) AS n FROM c) WHERE n = 1""", ("deps",))
def j17(deps):
    from quarry.operators.similarity import typosquats

    popular = deps.sparkSession.createDataFrame([(x,) for x in ("ring", "bolt", "widget", "gasket", "gear")], "name string")
    return typosquats(deps, popular)


@query("j18_positional_zip", "SELECT p_partkey, i - 1 AS pos, a, b FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS a, generate_subscripts(string_split(p_name, ' '), 1) AS i, unnest([p_brand, p_type]) AS b FROM part)", (), ("part",))
def j18(part):
    zipped = F.arrays_zip(F.split("p_name", " ").alias("a"), F.array("p_brand", "p_type").alias("b"))
    return part.select("p_partkey", F.posexplode(zipped).alias("pos", "z")).select("p_partkey", F.col("pos").cast("long").alias("pos"), "z.a", "z.b")


@query("j19_contract_match", """WITH e AS (SELECT c.name, p.name AS provider, 'exact' AS how FROM consumer_ops c JOIN provider_ops p ON c.name = p.name),
cs AS (SELECT name, regexp_extract(name, 'Item[0-9]+$') AS stem FROM consumer_ops WHERE name NOT IN (SELECT name FROM e)),
ps AS (SELECT name, regexp_extract(name, 'Item[0-9]+$') AS stem FROM provider_ops WHERE name NOT IN (SELECT provider FROM e)),
m AS (SELECT cs.name, min(ps.name) AS provider, 'stem' AS how FROM cs JOIN ps ON cs.stem = ps.stem GROUP BY cs.name)
SELECT DISTINCT * FROM e UNION ALL SELECT * FROM m UNION ALL SELECT DISTINCT name, NULL, 'missing' FROM cs WHERE name NOT IN (SELECT name FROM m)""", ("consumer_ops", "provider_ops"))
def j19(c, p):
    cn, pn = c.select("name").distinct(), p.select(F.col("name").alias("provider")).distinct()
    exact = cn.join(pn, cn["name"] == pn["provider"]).select("name", "provider", F.lit("exact").alias("how"))
    rest_c = cn.join(pn, cn["name"] == pn["provider"], "left_anti").withColumn("stem", text.operation_stem(F.col("name")))
    rest_p = pn.join(cn, cn["name"] == pn["provider"], "left_anti").withColumn("p_stem", text.operation_stem(F.col("provider")))
    stem = rest_c.join(rest_p, rest_c["stem"] == rest_p["p_stem"]).groupBy("name").agg(F.min("provider").alias("provider")).withColumn("how", F.lit("stem"))
    missing = rest_c.join(stem.select("name"), "name", "left_anti").select("name", F.lit(None).cast("string").alias("provider"), F.lit("missing").alias("how"))
    return exact.unionByName(stem).unionByName(missing)


_SIDES = """c AS (SELECT DISTINCT p_brand AS model, split_part(p_name, ' ', 1) AS field, CASE WHEN p_size < 25 THEN 'int' ELSE 'String' END AS type, p_size % 2 = 0 AS optional FROM part WHERE p_retailprice < 1400),
p AS (SELECT p_brand AS model, split_part(p_name, ' ', 1) AS field, min(CASE WHEN p_size < 20 THEN 'int' ELSE 'String' END) AS type, bool_or(p_size % 5 = 0) AS optional FROM part WHERE p_retailprice >= 1400 GROUP BY ALL)"""


@query("j21_model_fields", f"""WITH {_SIDES} SELECT c.model, c.field, c.type, c.optional, CASE WHEN p.field IS NULL THEN 'missing' WHEN c.type <> p.type THEN 'type' WHEN p.optional AND NOT c.optional THEN 'optionality' END AS gap
FROM c LEFT JOIN p ON c.model = p.model AND c.field = p.field WHERE p.field IS NULL OR c.type <> p.type OR (p.optional AND NOT c.optional)""", (), ("part",))
def j21(part):
    """Fields that consumers of a model have, and its provider lacks, types otherwise, or may leave out."""
    name, size = F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_size")
    c = part.where("p_retailprice < 1400").select(F.col("p_brand").alias("model"), name.alias("field"), F.when(size < 25, "int").otherwise("String").alias("type"), (size % 2 == 0).alias("optional")).distinct()
    p = part.where("p_retailprice >= 1400").groupBy(F.col("p_brand").alias("model"), name.alias("field")).agg(F.min(F.when(size < 20, "int").otherwise("String")).alias("p_type"), F.bool_or(size % 5 == 0).alias("p_optional"))
    gap = F.when(F.col("p_type").isNull(), "missing").when(F.col("type") != F.col("p_type"), "type").when(F.col("p_optional") & ~F.col("optional"), "optionality")
    return c.join(p, ["model", "field"], "left").withColumn("gap", gap).where("gap is not null").select("model", "field", "type", "optional", "gap")


@query("j22_enum_gaps", """WITH a AS (SELECT p_brand AS e, list(DISTINCT p_type) AS v FROM part WHERE p_size <= 10 GROUP BY 1), b AS (SELECT p_brand AS e, list(DISTINCT p_type) AS v FROM part WHERE p_size >= 35 GROUP BY 1)
SELECT e, x AS value, 'lost' AS gap FROM (SELECT e, unnest(list_filter(a.v, lambda x: NOT list_contains(b.v, x))) AS x FROM a JOIN b USING (e)) UNION ALL SELECT e, x, 'extra' FROM (SELECT e, unnest(list_filter(b.v, lambda x: NOT list_contains(a.v, x))) AS x FROM a JOIN b USING (e))""", (), ("part",))
def j22(part):
    """Values that one side of an enum has and the other lacks; enums that only one side has are no gap."""
    a = part.where("p_size <= 10").select(F.col("p_brand").alias("e"), F.col("p_type").alias("value")).distinct()
    b = part.where("p_size >= 35").select(F.col("p_brand").alias("e"), F.col("p_type").alias("value")).distinct()
    lost = a.join(b.select("e").distinct(), "e", "left_semi").join(b, ["e", "value"], "left_anti").withColumn("gap", F.lit("lost"))
    extra = b.join(a.select("e").distinct(), "e", "left_semi").join(a, ["e", "value"], "left_anti").withColumn("gap", F.lit("extra"))
    return lost.unionByName(extra)


@query("j25_cross_file_names", "SELECT name FROM (SELECT DISTINCT n.name, split_part(n.name, ' ', 1) AS w FROM nodes n) WHERE w NOT IN (SELECT DISTINCT unnest(string_split(lower(p_type || ' small red'), ' ')) FROM part)", ("nodes",), ("part",))
def j25(nodes, part):
    words = part.select(F.explode(F.split(F.lower(F.concat("p_type", F.lit(" small red"))), " ")).alias("w")).distinct()
    return nodes.select("name").distinct().withColumn("w", F.split_part("name", F.lit(" "), F.lit(1))).join(words, "w", "left_anti").select("name")


@query("j29_nearest", """WITH f AS (SELECT 'src/m' || CAST(p_partkey % 7 AS STRING) || '/f' || CAST(p_partkey % 211 AS STRING) || '.py' AS path, p_partkey AS number, p_size AS first, p_size + p_partkey % 9 AS last FROM part)
SELECT seq, number FROM (SELECT x.seq, f.number, row_number() OVER (PARTITION BY x.seq, x.line, x.path, x.message, x.rule_id ORDER BY greatest(f.first - x.line, x.line - f.last, 0), f.number) AS n FROM (SELECT DISTINCT seq, line, path, message, rule_id FROM findings) x JOIN f ON f.path = x.path) WHERE n = 1""", ("findings",), ("part",))
def j29(findings, part):
    path = F.concat(F.lit("src/m"), (F.col("p_partkey") % 7).cast("string"), F.lit("/f"), (F.col("p_partkey") % 211).cast("string"), F.lit(".py"))
    functions = part.select(path.alias("path"), F.col("p_partkey").alias("number"), F.col("p_size").alias("first"), (F.col("p_size") + F.col("p_partkey") % 9).alias("last"))
    targets = findings.select("seq", "line", "path", "message", "rule_id").distinct()
    return O.nearest_function(targets, functions).select("seq", "number")


@query("j31_reconcile", "SELECT seq, CASE WHEN line BETWEEN 20 AND 40 THEN line WHEN line BETWEEN 1 AND 21 THEN line + 19 ELSE 20 END AS fixed FROM findings", ("findings",))
def j31(findings):
    line, start, end = F.col("line"), 20, 40
    return findings.select("seq", F.when(line.between(start, end), line).when(line.between(1, end - start + 1), line + (start - 1)).otherwise(start).alias("fixed"))


CARRIERS["flows"] = "SELECT o_orderkey AS position, 'src/m' || CAST(o_custkey % 7 AS STRING) || '/f' || CAST(o_custkey % 211 AS STRING) || '.py' AS path, CAST(o_orderkey % 50 AS INT) AS source_line, CAST(o_custkey % 61 AS INT) AS sink_line, 'in' || CAST(o_orderkey % 5 AS STRING) AS source, o_orderstatus AS sink FROM orders"


@query("j33_taint_context", """SELECT seq, line, path, message, position, source || ' (line ' || source_line || ')' AS source, sink || ' (line ' || sink_line || ')' AS sink, vulnerability_class FROM (
  SELECT f.*, t.*, CASE WHEN len(string_split(f.rule_id, '-')) >= 3 THEN array_to_string(string_split(f.rule_id, '-')[2:-2], '-') ELSE 'unknown' END AS vulnerability_class, row_number() OVER (PARTITION BY f.seq, f.line, f.path, f.message, f.rule_id ORDER BY t.position) AS n
  FROM (SELECT DISTINCT seq, line, path, message, rule_id FROM (SELECT seq, line, path, message, 'scan-' || rule_id || CASE WHEN sup % 2 = 0 THEN '-0' ELSE '' END AS rule_id FROM findings WHERE line > 0)) f JOIN (SELECT position, path AS flow_path, source_line, sink_line, source, sink FROM flows) t ON f.path = t.flow_path AND (abs(t.source_line - f.line) <= 3 OR abs(t.sink_line - f.line) <= 3)) WHERE n = 1""", ("findings", "flows"))
def j33_context(findings, flows):
    named = findings.select("seq", "line", "path", "message", F.concat(F.lit("scan-"), "rule_id", F.when(F.col("sup") % 2 == 0, "-0").otherwise("")).alias("rule_id")).distinct()
    told = O.with_first_flow(named, flows)
    return told.where("flow IS NOT NULL").select("seq", "line", "path", "message", "flow.position", "flow.source", "flow.sink", "vulnerability_class")


@query("j33_interval_first", """SELECT seq, p FROM (SELECT f.seq, c.line AS p, row_number() OVER (PARTITION BY f.seq ORDER BY c.line) AS n FROM findings f JOIN changed c ON f.path = c.path AND c.line BETWEEN f.line - 3 AND f.line + 3 WHERE f.severity = 'high') WHERE n = 1""", ("findings", "changed"))
def j33(findings, changed):
    # within 3 lines means the same or a neighbouring block of 4: an equi-join on blocks
    f = findings.where("severity = 'high'").withColumn("block", F.explode(F.array(*[F.floor(F.col("line") / 4) + k for k in (-1, 0, 1)])))
    c = changed.select("path", F.col("line").alias("p"), F.floor(F.col("line") / 4).alias("block"))
    return f.join(c, ["path", "block"]).where(F.abs(F.col("line") - F.col("p")) <= 3).groupBy("seq").agg(F.min("p").alias("p"))


@query("j34_requirements_met", "SELECT frame_id, count(DISTINCT rule_id) = 6 AS ready FROM findings WHERE line > 10 GROUP BY frame_id", ("findings",))
def j34(findings):
    need = F.array(*[F.lit(x) for x in ("sql-injection", "xss-dom", "hardcoded-password", "weak-crypto", "cmd-injection", "style-naming")])
    done = findings.where("line > 10").groupBy("frame_id").agg(F.collect_set("rule_id").alias("done"))
    return done.select("frame_id", (F.size(F.array_except(need, "done")) == 0).alias("ready"))


@query("j36_longest_prefix", """WITH m AS (SELECT * FROM (VALUES ('src', 'core'), ('src/m1', 'one'), ('src/m1/f1.py', 'file')) AS t(prefix, module))
SELECT seq, coalesce((SELECT arg_max(module, length(prefix)) FROM m WHERE path = prefix OR starts_with(path, prefix || '/')), split_part(path, '/', 1)) AS module FROM findings""", ("findings",))
def j36(findings):
    modules = {"src": "core", "src/m1": "one", "src/m1/f1.py": "file"}
    path = F.col("path")
    tries = [F.when((path == p) | F.startswith(path, F.lit(p + "/")), F.lit(m)) for p, m in sorted(modules.items(), key=lambda x: -len(x[0]))]
    return findings.select("seq", F.coalesce(*tries, F.split_part(path, F.lit("/"), F.lit(1))).alias("module"))


# de-duplication and sets


@query("d1_dedup", None, ("findings",))
def d1(findings):
    return O.dedup_findings(findings).select("seq", "path", "line", "severity")


@query("d2_vulnerability_class", """SELECT DISTINCT rule_id, CASE rule_id WHEN 'sql-injection' THEN 'SQL_INJECTION' WHEN 'xss-dom' THEN 'XSS' WHEN 'hardcoded-password' THEN 'HARDCODED_SECRET' WHEN 'cmd-injection' THEN 'INJECTION' ELSE CASE WHEN contains(message, 'secret') THEN 'HARDCODED_SECRET' ELSE rule_id END END AS cls FROM findings""", ("findings",))
def d2(findings):
    return findings.select("rule_id", O.vulnerability_class(F.col("rule_id"), F.col("message")).alias("cls")).distinct()


@query("d3_split_location", r"SELECT seq, path AS file, line AS n FROM findings", ("findings",))
def d3(findings):
    file, n = O.split_location(F.concat("path", F.lit(":"), F.col("line").cast("string")))
    return findings.select("seq", file.alias("file"), n.alias("n"))


@query("d4_first_by_id", "SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY rule_id, path, line ORDER BY seq) AS n FROM findings) WHERE n = 1", ("findings",))
def d4(findings):
    return findings.groupBy("rule_id", "path", "line").agg(F.min("seq").alias("seq")).select("seq")


@query("d7_fingerprint_union", f"SELECT DISTINCT {_FP} AS fp FROM (SELECT rule_id, path, message FROM baseline UNION ALL SELECT rule_id, path, message FROM findings WHERE severity = 'low')", ("findings", "baseline"))
def d7(findings, baseline):
    both = baseline.select("rule_id", "path", "message").unionByName(findings.where("severity = 'low'").select("rule_id", "path", "message"))
    return both.select(text.finding_fingerprint(F.col("rule_id"), F.col("path"), F.col("message")).alias("fp")).distinct()


@query("d8_debt_update", """WITH c AS (SELECT DISTINCT code_hash FROM issues WHERE snapshot = 3), b AS (SELECT DISTINCT code_hash FROM issues WHERE snapshot = 0), d AS (SELECT DISTINCT code_hash FROM issues WHERE snapshot = 2)
SELECT 'new' AS kind, count(*) AS n FROM (SELECT * FROM c EXCEPT SELECT * FROM b EXCEPT SELECT * FROM d) UNION ALL SELECT 'resolved', count(*) FROM (SELECT * FROM d EXCEPT SELECT * FROM c) UNION ALL SELECT 'kept', count(*) FROM (SELECT * FROM d INTERSECT SELECT * FROM c)""", ("issues",))
def d8(issues):
    part = lambda n: issues.where(F.col("snapshot") == n).select("code_hash").distinct()
    c, b, d = part(3), part(0), part(2)
    count = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return count(c.subtract(b).subtract(d), "new").unionByName(count(d.subtract(c), "resolved")).unionByName(count(d.intersect(c), "kept"))


@query("d9_all_fields", "SELECT field FROM writes UNION SELECT field FROM reads UNION SELECT field FROM inits", ("writes", "reads", "inits"))
def d9(writes, reads, inits):
    return writes.select("field").union(reads.select("field")).union(inits.select("field")).distinct()


@query("d11_exact_code_groups", r"""SELECT sha256(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(content, ''), '(?m)#.*$', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), '[ \t\n\x0B\f\r]*([{}()\[\],;.:<>])[ \t\n\x0B\f\r]*', '\1', 'g'), ' ')) AS h, count(*) AS n, min(doc_id) AS first FROM files WHERE language = 'python' GROUP BY 1 HAVING count(*) > 1""", ("files",))
def d11(files):
    keyed = files.where("language = 'python'").select("doc_id", text.code_hash(F.col("content"), F.col("language")).alias("h"))
    return keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("d12_changed_files", "SELECT path FROM files WHERE doc_id % 3 <> 0 OR language = 'go'", ("files",))
def d12(files):
    key = F.sha2(F.coalesce("content", F.lit("")), 256)
    stored = files.where("doc_id % 3 = 0").select("path", F.when(F.col("language") == "go", "stale").otherwise(key).alias("hash"))
    return files.withColumn("hash", key).join(stored, ["path", "hash"], "left_anti").select("path")


# order


@query("o1_risk_order", f"""WITH ch AS (SELECT path, count(*) AS churn FROM commits WHERE ts >= TIMESTAMP '1996-01-01' GROUP BY path)
SELECT seq, round(({_RANK.format(2)}) * (1 + ln(1 + coalesce(churn, 0)) * 0.2), 6) AS risk FROM findings LEFT JOIN ch USING (path)""", ("findings", "commits"))
def o1(findings, commits):
    churn = commits.where("ts >= TIMESTAMP '1996-01-01'").groupBy("path").agg(F.count(F.lit(1)).alias("churn"))
    return O.risk_ordered(findings, churn).select("seq", F.round("risk", 6).alias("risk")).orderBy(F.desc("risk"), "seq")


@query("o2_churn", "SELECT path, count(*) AS churn FROM commits WHERE ts >= (SELECT max(ts) FROM commits) - INTERVAL 90 DAY GROUP BY path", ("commits",))
def o2(commits):
    last = commits.agg(F.max("ts").alias("last"))
    return commits.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("INTERVAL 90 DAY")).groupBy("path").agg(F.count(F.lit(1)).alias("churn"))


@query("o4_priority_groups", "SELECT p_size % 7 AS priority, array_to_string(list_sort(list(p_partkey)), ',') AS members FROM part GROUP BY 1", (), ("part",))
def o4(part):
    return part.groupBy((F.col("p_size") % 7).alias("priority")).agg(F.array_join(F.array_sort(F.collect_list("p_partkey")), ",").alias("members"))


@query("o6_lru_evict", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS n, count(*) OVER () AS total FROM events) WHERE n <= CASE WHEN total > 1000 THEN 800 ELSE total END", (), ("events",))
def o6(events):
    return O.evicted(events, "ts", "event_id", 1000).select("event_id")


@query("o7_triage_evict", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS n, count(*) OVER () AS total FROM events) WHERE n <= CASE WHEN total > 5000 THEN 4000 ELSE total END", (), ("events",))
def o7(events):
    return O.evicted(events, "ts", "event_id", 5000).select("event_id")


@query("o8_top_per_file", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3", (), ("orders",))
def o8(orders):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return orders.withColumn("n", F.row_number().over(w)).where("n <= 3").select("o_custkey", "o_orderkey")
