"""Queries over code: line detectors, syntax trees, flows, diffs, reports, state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import detectors as D
from quarry.operators import reports, taint
from quarry.operators import rules as R
from quarry.plans.base import query
from quarry.plans.carriers import CARRIERS
from quarry.sources import diffs, python_ast
from quarry.streaming import lifecycle

CARRIERS["code"] = """SELECT p_partkey AS id, 'pkg/' || p_brand || '/m' || CAST(p_partkey AS STRING) || '.py' AS path, 'python' AS language,
 'import os' || chr(10) || 'import json' || chr(10) || 'class Part' || CAST(p_partkey AS STRING) || '(Base):' || chr(10) || '    def load(self, filename, a, b' || CASE WHEN p_size % 2 = 0 THEN '):' ELSE ', c, d, e):' END || chr(10) || CASE WHEN p_size % 5 = 0 THEN '        "Loads."' ELSE '        # loads' END || chr(10) ||
 CASE p_size % 6 WHEN 0 THEN '        return open(filename)' WHEN 1 THEN '        q = "SELECT * FROM t WHERE id=" + filename' || chr(10) || '        return db.execute(q)'
  WHEN 2 THEN '        # TODO: tidy ' || p_name || chr(10) || '        return redirect(next_url)' WHEN 3 THEN '        x = input()' || chr(10) || '        os.system(x)' || chr(10) || '        return 1' || chr(10) || '        y = 2' || chr(10) || '        requests.get(x)'
  WHEN 4 THEN '        try:' || chr(10) || '            el.innerHTML = filename' || chr(10) || '        except:' || chr(10) || '            pass' ELSE '        password = hashlib.md5(filename)' || chr(10) || '        self.state = password' || chr(10) || '        return os.path.basename(filename)' END AS content FROM part"""
CARRIERS["diffs"] = """SELECT s_suppkey AS diff_id, 'diff --git a/f b/f' || chr(10) || '--- a/f' || CAST(s_suppkey AS STRING) || '.py' || chr(10) || '+++ b/f' || CAST(s_suppkey AS STRING) || '.py' || chr(10) || '@@ -' || CAST(s_suppkey + 1 AS STRING) || ',2 +' || CAST(s_suppkey + 5 AS STRING) || ',3 @@' || chr(10) || ' keep' || chr(10) || '-old' || chr(10) || '+new ' || s_name || chr(10) || '+more' AS text FROM supplier"""
_CODE_LINES = "SELECT path, generate_subscripts(string_split(content, chr(10)), 1) AS line, unnest(string_split(content, chr(10))) AS text FROM code"


def _rules_sql(rules):
    return "(VALUES " + ", ".join("('{}', '{}')".format(r.id, r.pattern.replace("'", "''")) for r in rules) + ") AS r(rule_id, pattern)"


def _match_sql(rules):
    return f"WITH lines AS ({_CODE_LINES}) SELECT path, line, rule_id FROM lines JOIN {_rules_sql(rules)} ON regexp_matches(text, r.pattern)"


@query("c1_sql_injection", _match_sql(D.SQL_INJECTION), ("code",))
def c1(code):
    return R.match_patterns(code, D.SQL_INJECTION).select("path", "line", "rule_id")


@query("c2_xss", _match_sql(D.XSS), ("code",))
def c2(code):
    return R.match_patterns(code, D.XSS).select("path", "line", "rule_id")


@query("c6_weak_hash", f"""WITH lines AS ({_CODE_LINES}), w AS (SELECT path, line, text, bool_or(regexp_matches(text, '(?i)password|passwd|pwd|credential|login|auth')) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s FROM lines)
SELECT path, line FROM w WHERE s AND regexp_matches(text, 'hashlib\\.(?:md5|sha1)\\s*\\(') AND NOT regexp_matches(text, '(?i)checksum|cache|etag|fingerprint|integrity|file_hash|content_hash')""", ("code",))
def c6(code):
    return D.weak_hashes(code).select("path", "line")


def _conjunction_sql(c):
    q = lambda p: p.replace("'", "''")
    return f"""WITH lines AS ({_CODE_LINES}), w AS (SELECT path, line, text, bool_or(regexp_matches(text, '{q(c.guard)}')) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN {c.reach} PRECEDING AND {c.reach} FOLLOWING) AS g FROM lines)
SELECT path, line, '{c.id}' AS rule_id, '{c.severity}' AS severity FROM w WHERE NOT g AND regexp_matches(text, '{q(c.sink)}') AND regexp_matches(text, '{q(c.source)}') AND NOT regexp_matches(ltrim(text), '^(#|//|\\*)')"""


@query("c10_open_redirect", _conjunction_sql(D.OPEN_REDIRECT), ("code",))
def c10(code):
    return R.conjunctions(code, [D.OPEN_REDIRECT])


@query("c12_path_traversal", _conjunction_sql(D.PATH_TRAVERSAL), ("code",))
def c12(code):
    return R.conjunctions(code, [D.PATH_TRAVERSAL])


@query("c27_todo", f"WITH lines AS ({_CODE_LINES}) SELECT path, line, 'TODO: ' || substr(trim(regexp_extract(text, 'TODO\\s*:?\\s*(.*)', 1)), 1, 50) AS detail FROM lines WHERE contains(text, '# TODO')", ("code",))
def c27(code):
    return D.todo_comments(code).select("path", "line", "detail")


@query("c33_no_breaker", f"WITH lines AS ({_CODE_LINES}) SELECT path, min(line) FILTER (contains(text, 'execute')) AS line, 'no-breaker' AS rule_id, 'medium' AS severity FROM lines GROUP BY path HAVING bool_or(contains(text, 'execute')) AND NOT bool_or(contains(text, 'breaker'))", ("code",))
def c33(code):
    return D.absent_guard(code, "execute", "breaker", "no-breaker")


@query("c25_bare_handlers", "SELECT path, 'bare-except' AS rule_id FROM code WHERE contains(content, 'except:') UNION ALL SELECT path, 'empty-except' FROM code WHERE contains(content, 'except:')", ("code",))
def c25(code):
    return D.structure_findings(python_ast.parse(code, ("handler",))).where(F.col("rule_id").isin("bare-except", "empty-except")).select("path", "rule_id")


@query("c36_dead_code", "SELECT path, 8 AS line FROM code WHERE contains(content, 'y = 2')", ("code",))
def c36(code):
    tree = python_ast.parse(code, ("dead",))
    return tree.where("kind = 'dead'").select("path", (F.col("line") - 1).cast("int").alias("line"))


@query("c49_wide_functions", "SELECT path, 'load' AS name, 6 AS n_params FROM code WHERE contains(content, 'c, d, e')", ("code",))
def c49(code):
    return python_ast.parse(code, ("function",)).where("kind = 'function' and n_params > 5").select("path", "name", F.col("n_params").cast("int").alias("n_params"))


@query("x32_halstead", None, ("code",))
def x32(code):
    return python_ast.halstead(code).select("path", "vocabulary", "length", *[F.round(c, 6).alias(c) for c in ("volume", "difficulty", "effort")])


@query("c53_doc_coverage", "SELECT path, CASE WHEN contains(content, 'Loads.') THEN 50.0 ELSE 0.0 END::DOUBLE AS coverage FROM code", ("code",))
def c53(code):
    return D.documentation_coverage(python_ast.parse(code, ("function", "class", "module"))).select("path", F.col("coverage").cast("double").alias("coverage"))


@query("j23_unused_imports", "SELECT path, 'json' AS module FROM code UNION ALL SELECT path, 'os' FROM code WHERE NOT contains(content, 'os.')", ("code",))
def j23(code):
    return D.unused_imports(python_ast.parse(code, ("name", "call", "export", "import"))).select("path", F.col("detail").alias("module"))


@query("j24_unreferenced", "SELECT path, 'Part' || CAST(id AS STRING) AS name FROM code UNION ALL SELECT path, 'load' FROM code", ("code",))
def j24(code):
    return D.unreferenced(python_ast.parse(code, ("name", "call", "function", "class"))).select("path", F.col("detail").alias("name"))


@query("g8_code_graph", "SELECT relation, count(*) AS n FROM (SELECT path, 'inherits' AS relation FROM code UNION ALL SELECT path, 'imports' FROM code UNION ALL SELECT path, 'imports' FROM code) GROUP BY relation", ("code",))
def g8(code):
    return D.code_graph(python_ast.parse(code, ("function", "class", "call", "import")))[1].where("relation <> 'calls'").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("g12_data_flow", "SELECT path, 'state' AS field, 'write' AS kind FROM code WHERE contains(content, 'self.state')", ("code",))
def g12(code):
    return D.data_flow(python_ast.parse(code, ("read", "write"))).select("path", "field", "kind")


@query("c16_taint", "SELECT path, 'input' AS source, 'os.system' AS sink, 'CMD-argument' AS sink_type FROM code WHERE contains(content, 'os.system(x)')", ("code",))
def c16(code):
    return taint.taint_paths(code).select("path", "source", "sink", "sink_type")


@query("c22_taint_findings", "SELECT path, 7 AS line, 'taint-cmd-argument' AS rule_id, 'high' AS severity FROM code WHERE contains(content, 'os.system(x)')", ("code",))
def c22(code):
    return taint.taint_findings(taint.taint_paths(code)).select("path", "line", "rule_id", "severity")


@query("s16_diff_lines", "SELECT diff_id, 'f' || CAST(diff_id AS STRING) || '.py' AS path, k AS kind, (CASE k WHEN 'context' THEN diff_id + 5 WHEN 'deleted' THEN diff_id + 2 WHEN 'added' THEN diff_id + 6 ELSE 0 END)::INT AS line FROM diffs CROSS JOIN (VALUES ('context'), ('deleted'), ('added')) AS t(k) UNION ALL SELECT diff_id, 'f' || CAST(diff_id AS STRING) || '.py', 'added', (diff_id + 7)::INT FROM diffs", ("diffs",))
def s16(d):
    return diffs.parse(d).select("diff_id", "path", "kind", "line")


@query("s17_changed_ranges", "SELECT diff_id, 'f' || CAST(diff_id AS STRING) || '.py' AS path, (diff_id + 6)::INT AS first, (diff_id + 7)::INT AS last FROM diffs", ("diffs",))
def s17(d):
    return diffs.ranges(diffs.parse(d))


@query("k2_sarif_levels", "SELECT CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM findings GROUP BY 1", ("findings",))
def k2(findings):
    return reports.sarif_results(findings).groupBy(F.get_json_object("result", "$.level").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("k3_junit_cases", "SELECT frame_id, count(*) FILTER (is_blocker) AS failures, count(*) AS n FROM findings GROUP BY frame_id", ("findings",))
def k3(findings):
    return reports.junit_cases(findings).select("frame_id", "failures", "n")


@query("st1_issue_states", """WITH s AS (SELECT DISTINCT code_hash, snapshot FROM issues), g AS (SELECT *, CASE WHEN snapshot > lag(snapshot) OVER (PARTITION BY code_hash ORDER BY snapshot) + 1 THEN 1 ELSE 0 END AS again FROM s)
SELECT code_hash, CASE WHEN max(snapshot) = 3 THEN 'OPEN' ELSE 'RESOLVED' END AS state, min(snapshot)::BIGINT AS first_snapshot, max(snapshot)::BIGINT AS last_snapshot, sum(again)::BIGINT AS reopen_count FROM g GROUP BY code_hash""", ("issues",))
def st1(issues):
    return lifecycle.issue_states(issues, 3)


@query("st8_breaker_replay", None, ("requests",))
def st8(requests):
    return lifecycle.replay_breakers(requests)


@query("st5_ttl_cache", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR", (), ("events",))
def st5(events):
    return events.where("ts > TIMESTAMP_NTZ '2024-01-20 00:00:00' - INTERVAL 24 HOUR").select("event_id")


@query("st3_cache_misses", "SELECT path FROM files WHERE doc_id % 4 = 1", ("files",))
def st3(files):
    key = F.concat_ws(":", F.lit("security"), "path", F.substring(F.sha2(F.coalesce("content", F.lit("")), 256), 1, 16))
    stored = files.where("doc_id % 4 <> 1").select(key.alias("key"))
    return files.withColumn("key", key).join(stored, "key", "left_anti").select("path")


@query("ext_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL", (), ("events",))
def ext_windows(events):
    return lifecycle.windowed_errors(events)


@query("h1_signal_frames", "SELECT count(*) FILTER (contains(lower(content), 'execute')) > 0 AS security, count(*) FILTER (contains(lower(content), 'requests.')) > 0 AS resilience, count(*) FILTER (contains(lower(content), 'except')) > 0 AS antipattern FROM code", ("code",))
def h1(code):
    low = F.lower("content")
    return code.agg(F.bool_or(low.contains("execute")).alias("security"), F.bool_or(low.contains("requests.")).alias("resilience"), F.bool_or(low.contains("except")).alias("antipattern"))


@query("h6_best_context", "SELECT path, CASE WHEN id % 4 = 0 THEN 'TEST' WHEN contains(content, 'open(') THEN 'FRAMEWORK' ELSE 'PRODUCTION' END AS context FROM code", ("code",))
def h6(code):
    options = F.array(F.struct(F.when(F.col("id") % 4 == 0, 0.9).otherwise(0.0).alias("c"), F.lit(-1).alias("o"), F.lit("TEST").alias("n")), F.struct(F.when(F.contains("content", F.lit("open(")), 0.7).otherwise(0.0).alias("c"), F.lit(-2).alias("o"), F.lit("FRAMEWORK").alias("n")), F.struct(F.lit(0.5).alias("c"), F.lit(-3).alias("o"), F.lit("PRODUCTION").alias("n")))
    return code.select("path", F.array_max(options)["n"].alias("context"))


@query("h8_service_category", "SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'cache' WHEN s_suppkey % 10 = 5 THEN 'queue' ELSE 'custom' END AS category FROM supplier", (), ("supplier",))
def h8(supplier):
    name = F.concat(F.when(F.col("s_suppkey") % 10 == 0, "CacheOf").when(F.col("s_suppkey") % 10 == 5, "MyQueue").otherwise("Thing"), F.col("s_suppkey").cast("string"))
    low = F.lower(name)
    return supplier.select("s_suppkey", F.when(low.contains("cache"), "cache").when(low.contains("queue"), "queue").otherwise("custom").alias("category"))


@query("h10_status_recompute", "SELECT frame_id, CASE WHEN bool_or(is_blocker AND severity = 'critical') THEN 'failed' WHEN count(*) = 0 THEN 'passed' ELSE 'warning' END AS status FROM findings GROUP BY frame_id", ("findings",))
def h10(findings):
    g = findings.groupBy("frame_id").agg(F.bool_or(F.col("is_blocker") & (F.col("severity") == "critical")).alias("b"), F.count(F.lit(1)).alias("n"))
    return g.select("frame_id", F.when(F.col("b"), "failed").when(F.col("n") == 0, "passed").otherwise("warning").alias("status"))
