"""Queries over files and lines: sources, rules, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scores, text
from quarry.operators import rules as R
from quarry.plans.base import query

RULES = (
    R.Rule("hardcoded-token", r"\btoken\s*=\s*\"[0-9a-f]{16,}\"", "critical"),
    R.Rule("license-line", r"(?i)licensed under", "low"),
    R.Rule("card-number", r"\b[0-9]{16}\b", "high"),
    R.Rule("ip-address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "medium", languages=("python", "javascript")),
)
_RULE_SQL = "(VALUES " + ", ".join(f"('{r.id}', '{r.pattern}', '{r.severity}', {'true' if not r.languages else 'false'})" for r in RULES) + ") AS r(rule_id, pattern, severity, any_lang)"
_LINES = "SELECT path, language, generate_subscripts(string_split(coalesce(content, ''), chr(10)), 1) AS line, unnest(string_split(coalesce(content, ''), chr(10))) AS text FROM files"
_HITS = rf"""WITH lines AS ({_LINES}),
hits AS (SELECT path, line, text, r.rule_id, r.severity, r.pattern FROM lines JOIN {_RULE_SQL}
  ON regexp_matches(text, r.pattern) AND (any_lang OR language IN ('python', 'javascript')))"""


@query("f1_match_patterns", _HITS + r""" SELECT path, line, (strlen(regexp_extract(text, '^(.*?)(?:' || pattern || ')', 1)) + 1)::INT AS "column", rule_id, severity, trim(text, ' ') AS snippet FROM hits""", ("files",))
def f1(files):
    return R.match_patterns(files, RULES)


@query("f1_matches_by_rule", _HITS + " SELECT rule_id, severity, count(*) AS n, count(DISTINCT path) AS n_files FROM hits GROUP BY ALL", ("files",))
def f1_by_rule(files):
    return R.match_patterns(files, RULES).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("n_files"))


@query("f2_metric_rules", """WITH m AS (SELECT path, strlen(coalesce(content, '')) AS size_bytes, CASE WHEN coalesce(content, '') = '' THEN 0 ELSE len(string_split(content, chr(10))) - ends_with(content, chr(10))::INT END AS line_count FROM files)
SELECT path, 0 AS line, 'max-size' AS rule_id, 'medium' AS severity, size_bytes AS value FROM m WHERE size_bytes > 4000
UNION ALL SELECT path, 0, 'max-lines', 'low', line_count FROM m WHERE line_count > 20""", ("files",))
def f2(files):
    return R.validate_metrics(files, [R.MetricRule("max-size", "size_bytes", 4000), R.MetricRule("max-lines", "line_count", 20, "low")])


@query("f3_validate_batch", _HITS + """, m AS (SELECT path, strlen(coalesce(content, '')) AS size_bytes FROM files)
SELECT path, line, rule_id FROM hits UNION ALL SELECT path, 0, 'max-size' FROM m WHERE size_bytes > 4000""", ("files",))
def f3(files):
    return R.match_patterns(files, RULES).select("path", "line", "rule_id").unionByName(R.validate_metrics(files, [R.MetricRule("max-size", "size_bytes", 4000)]).select("path", "line", "rule_id"))


@query("f4_portable_rules", "SELECT * FROM (VALUES ('a(?=b)', false), ('(x)\\1', false), ('[a-z]+', true), ('(?<!q)u', false)) AS t(pattern, portable)", (), ("region",))
def f4(region):
    spark = region.sparkSession
    return spark.createDataFrame([(p, R.portable(R.Rule("r", p))) for p in ("a(?=b)", "(x)\\1", "[a-z]+", "(?<!q)u")], "pattern string, portable boolean")


@query("f5_language_match", "SELECT path FROM files WHERE language IN ('python', 'go')", ("files",))
def f5(files):
    return files.where(F.array_contains(F.array(F.lit("python"), F.lit("go")), F.col("language"))).select("path")


@query("f6_exception_globs", "SELECT path FROM files WHERE NOT regexp_matches(path, '^src/src1.*/d[0-9]*\\.py$')", ("files",))
def f6(files):
    return files.where(~F.col("path").rlike(r"^src/src1.*/d[0-9]*\.py$")).select("path")


@query("f7_secrets_unsuppressed", _HITS + " SELECT path, line, rule_id FROM hits WHERE rule_id = 'hardcoded-token' AND NOT (contains(text, 'noqa') OR contains(text, 'quarry-ignore') OR contains(text, 'nosec') OR contains(text, 'rule-ignore'))", ("files",))
def f7(files):
    return R.match_patterns(files, RULES[:1], honour_markers=True).select("path", "line", "rule_id")


@query("f8_forbidden_hosts", f"WITH lines AS ({_LINES}) SELECT path, line FROM lines WHERE regexp_matches(text, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') AND NOT contains(text, 'noqa')", ("files",))
def f8(files):
    return R.lines(files).where(F.col("text").rlike(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+") & ~F.col("text").contains("noqa")).select("path", "line")


@query("f9_key_pattern", f"""WITH lines AS ({_LINES}), keys AS (SELECT path, line, unnest(regexp_extract_all(text, 'token = "([0-9a-f]+)"', 1)) AS key FROM lines)
SELECT path, line, key FROM keys WHERE NOT regexp_matches(key, '^[0-7]')""", ("files",))
def f9(files):
    keys = R.lines(files).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit('token = "([0-9a-f]+)"'), F.lit(1))).alias("key"))
    return keys.where(~F.col("key").rlike("^[0-7]"))


@query("f10_first_pattern_per_line", f"""WITH lines AS ({_LINES}) SELECT path, line, CASE WHEN regexp_matches(text, 'token = "([0-9a-f]{{4}})') THEN regexp_extract(text, 'token = "([0-9a-f]{{4}})', 1) ELSE regexp_extract(text, '([0-9]{{16}})', 1) END AS route
FROM lines WHERE regexp_matches(text, 'token = "([0-9a-f]{{4}})') OR regexp_matches(text, '([0-9]{{16}})')""", ("files",))
def f10(files):
    return R.first_per_line(files, [(r'token = "([0-9a-f]{4})', 1), (r"([0-9]{16})", 1)], "route")


@query("f11_naming_suffix", "SELECT name FROM consumer_ops WHERE regexp_matches(name, '^get') AND NOT ends_with(name, '7')", ("consumer_ops",))
def f11(ops):
    return ops.where(F.col("name").rlike("^get") & ~F.endswith("name", F.lit("7"))).select("name")


@query("f12_inline_markers", f"WITH lines AS ({_LINES}) SELECT path, count(*) AS n FROM lines WHERE contains(text, 'noqa') OR contains(text, 'quarry-ignore') OR contains(text, 'nosec') OR contains(text, 'rule-ignore') OR contains(text, 'Licensed') GROUP BY path", ("files",))
def f12(files):
    return R.lines(files).where(R.suppressed(F.col("text")) | F.col("text").contains("Licensed")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("f16_context_filter", "SELECT f.path FROM files f LEFT JOIN contexts c ON f.path = c.path WHERE coalesce(c.context NOT IN ('TEST', 'EXAMPLE', 'DOCUMENTATION'), true)", ("files", "contexts"))
def f16(files, contexts):
    return files.join(contexts, "path", "left").where(F.coalesce(~F.col("context").isin("TEST", "EXAMPLE", "DOCUMENTATION"), F.lit(True))).select("path")


@query("f17_lane_routing", """SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE CASE WHEN l.doc_id IS NULL THEN 99 WHEN l.quality = 1 THEN 0 WHEN l.quality = 0 THEN 2 ELSE 1 END >= 1""", (), ("documents", "labels"))
def f17(docs, labels):
    rank = F.when(labels["doc_id"].isNull(), 99).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 2).otherwise(1)
    return docs.join(labels, docs["doc_id"] == labels["doc_id"], "left").where(rank >= 1).select(docs["doc_id"])


@query("f21_suppressed_lines", f"""WITH lines AS ({_LINES}) SELECT path, line, CASE WHEN regexp_matches(text, 'Licensed under CC') THEN 'cc' ELSE '' END AS rules FROM lines
WHERE contains(text, 'Licensed under') AND length(text) <= 4096""", ("files",))
def f21(files):
    rows = R.lines(files).where(F.col("text").contains("Licensed under") & (F.length("text") <= 4096))
    return rows.select("path", "line", F.when(F.col("text").rlike("Licensed under CC"), "cc").otherwise("").alias("rules"))


@query("f22_add_marker", "SELECT path, sha256(array_to_string(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x, i: CASE WHEN i = 2 THEN rtrim(x, ' ') || '  # quarry-ignore: r1' ELSE x END), chr(10))) AS h FROM files", ("files",))
def f22(files):
    marked = F.transform(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x, i: F.when(i == 1, F.concat(F.rtrim(x), F.lit("  # quarry-ignore: r1"))).otherwise(x))
    return files.select("path", F.sha2(F.array_join(marked, "\n"), 256).alias("h"))


@query("f23_remove_marker", "SELECT path, sha256(regexp_replace(coalesce(content, ''), 'token = \"[0-9a-f]+\"', '', 'g')) AS h FROM files", ("files",))
def f23(files):
    return files.select("path", F.sha2(F.regexp_replace(F.coalesce("content", F.lit("")), 'token = "[0-9a-f]+"', ""), 256).alias("h"))


def _contains_any(of: str, words) -> str:
    return "(" + " OR ".join("contains({}, {})".format(of, " || chr(10) || ".join("'" + w + "'" for w in x.split("\n"))) for x in words) + ")"


_KIND_PATH = "CASE p_size % 9 WHEN 0 THEN 'app/' || p_brand || '.MD' WHEN 1 THEN 'a/tests/' || p_brand || '.py' WHEN 2 THEN p_brand || '/setup.py' WHEN 3 THEN 'web/x.min.js' WHEN 4 THEN 'my_Config.go' ELSE 'src/' || p_brand || '.v1.py' END"
_KIND_BODY = "repeat(CASE p_partkey % 5 WHEN 0 THEN '# note ' || p_name || chr(10) WHEN 1 THEN 'x = ' || p_name || chr(10) WHEN 2 THEN '@dataclass' || chr(10) WHEN 3 THEN '    if x:' || chr(10) ELSE 'class A: ' || p_name || chr(10) END, CAST(20 + p_size * 2 AS INT))"


@query("f33_heuristic_safe", f"""WITH kinds AS (SELECT p_partkey AS id, {_KIND_PATH} AS path, {_KIND_BODY} AS content FROM part), n AS (SELECT *, lower(path) AS low, lower(string_split(path, '/')[-1]) AS name FROM kinds)
SELECT id, (regexp_extract(name, '[^./][^/]*?([.][^./]*)$', 1) IN {R.SAFE_EXTENSIONS} OR name IN {R.SAFE_NAMES} OR {' OR '.join(f"ends_with(name, '{e}')" for e in R.GENERATED_ENDINGS)} OR {_contains_any("('/' || low)", R.SAFE_FOLDERS)} OR contains(name, 'config') OR contains(name, 'settings')
 OR length(content) < 300 OR len(string_split(content, chr(10))) < 30 OR (length(content) < 2000 AND NOT {_contains_any('content', R.LOGIC)} AND ({_contains_any('lower(content)', R.BOILERPLATE)} OR len(list_filter(string_split(content, chr(10)), lambda r: NOT (trim(r) = '' OR regexp_matches(trim(r), '^(#|import|from|class |def |@)')))) = 0))) AS safe FROM n""", (), ("part",))
def f33(part):
    return part.select(F.col("p_partkey").alias("id"), R.heuristic_safe(F.expr(_KIND_PATH), F.expr(_KIND_BODY)).alias("safe"))


@query("f34_static_prefilter", """SELECT path, CASE WHEN strlen(coalesce(content, '')) > 20000 THEN NULL WHEN trim(coalesce(content, ''), ' ') = '' THEN 'orphan' WHEN regexp_matches(path, 'requirements|pyproject') THEN 'deps' WHEN contains(path, '/src2/') THEN 'orphan' WHEN length(content) < 100 THEN 'tiny' END AS decision FROM files""", ("files",))
def f34(files):
    c = F.coalesce("content", F.lit(""))
    return files.select("path", F.when(F.octet_length(c) > 20000, None).when(F.trim(c) == "", "orphan").when(F.col("path").rlike("requirements|pyproject"), "deps").when(F.contains("path", F.lit("/src2/")), "orphan").when(F.length("content") < 100, "tiny").alias("decision"))


@query("f36_line_reference", f"""WITH lines AS ({_LINES}), w AS (SELECT path, line, lower(string_agg(text, chr(10)) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS win FROM lines)
SELECT path, line FROM w WHERE contains(win, 'token') OR contains(win, 'licensed') OR trim(win, ' ') = ''""", ("files",))
def f36(files):
    w = R.line_window(R.lines(files), 3, 3)
    low = F.lower("window")
    return w.where(low.contains("token") | low.contains("licensed") | (F.trim(low) == "")).select("path", "line")


@query("f37_division_guard", f"""WITH lines AS ({_LINES}), g AS (SELECT path, line, text, lag(text, 1, '') OVER w AS p1, lag(text, 2, '') OVER w AS p2 FROM lines WINDOW w AS (PARTITION BY path ORDER BY line))
SELECT path, line FROM g WHERE contains(text, '|') AND NOT (contains(text, 'token') OR contains(p1, 'token') OR contains(p2, 'token'))""", ("files",))
def f37(files):
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("line")
    g = R.lines(files).withColumn("p1", F.lag("text", 1, "").over(w)).withColumn("p2", F.lag("text", 2, "").over(w))
    return g.where(F.contains("text", F.lit("|")) & ~(F.contains("text", F.lit("token")) | F.contains("p1", F.lit("token")) | F.contains("p2", F.lit("token")))).select("path", "line")


# scalars


@query("x1_normalized_code", r"""WITH n AS (SELECT path, language, regexp_replace(coalesce(content, ''), '\r\n?', chr(10), 'g') AS c FROM files), s AS (
SELECT path, CASE language WHEN 'python' THEN regexp_replace(c, '(?m)#.*$', '', 'g') WHEN 'sql' THEN regexp_replace(regexp_replace(c, '(?m)--.*$', '', 'g'), '(?s)/\*.*?\*/', '', 'g')
  ELSE regexp_replace(regexp_replace(c, '(?s)/\*.*?\*/', '', 'g'), '(?m)//.*$', '', 'g') END AS c FROM n)
SELECT path, sha256(trim(regexp_replace(regexp_replace(c, '[ \t\n\x0B\f\r]+', ' ', 'g'), '[ \t\n\x0B\f\r]*([{}()\[\],;.:<>])[ \t\n\x0B\f\r]*', '\1', 'g'), ' ')) AS code_hash FROM s""", ("files",))
def x1(files):
    return files.select("path", text.code_hash(F.col("content"), F.col("language")).alias("code_hash"))


@query("x2_cache_key", "SELECT 'security:' || path || ':' || substr(sha256(coalesce(content, '')), 1, 16) AS key FROM files", ("files",))
def x2(files):
    return files.select(text.cache_key(F.lit("security"), F.col("path"), F.col("content")).alias("key"))


@query("x3_chunk_id", "SELECT substr(sha256(path || ':1-5:' || content), 1, 16) AS id FROM files", ("files",))
def x3(files):
    return files.select(text.chunk_id(F.col("path"), F.lit(1), F.lit(5), F.col("content")).alias("id"))


@query("x4_levenshtein", "SELECT p_partkey, levenshtein(p_name, p_type)::INT AS d FROM part", (), ("part",))
def x4(part):
    return part.select("p_partkey", F.levenshtein("p_name", "p_type").alias("d"))


@query("x5_package_name", "SELECT pos, replace(regexp_replace(lower(trim(name)), '^@[^/]+/', ''), '_', '-') AS norm FROM deps", ("deps",))
def x5(deps):
    return deps.select("pos", text.package_name(F.col("name")).alias("norm"))


@query("x8_jaccard", "SELECT p_partkey, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))) END::DOUBLE AS j FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type) || ' ring bolt', ' ') AS b FROM part)", (), ("part",))
def x8(part):
    return part.select("p_partkey", text.jaccard(F.split("p_name", " "), F.split(F.concat(F.lower("p_type"), F.lit(" ring bolt")), " ")).cast("double").alias("j"))


@query("x10_tokens", "SELECT conv_id, turn, (length(text) // 4)::BIGINT AS tokens FROM conversations", (), ("conversations",))
def x10(conv):
    return conv.select("conv_id", "turn", text.estimated_tokens(F.col("text")).alias("tokens"))


@query("x11_truncate", """SELECT doc_id, sha256(CASE WHEN length(text) // 4 <= 200 THEN text WHEN len(l) <= 30 THEN substr(text, 1, 800) ELSE substr(array_to_string(l[1:20], chr(10)) || chr(10) || '... [truncated] ...' || chr(10) || array_to_string(l[greatest(len(l) - 9, 1):], chr(10)), 1, 800) END) AS h
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)""", (), ("documents",))
def x11(docs):
    return docs.select("doc_id", F.sha2(text.truncated(F.col("text"), 200), 256).alias("h"))


_S = "round(o_totalprice % 10, 2)"


@query("x13_grade", f"SELECT o_orderkey, CASE WHEN s >= 9.5 THEN 'A+' WHEN s >= 9 THEN 'A' WHEN s >= 8 THEN 'B+' WHEN s >= 7 THEN 'B' WHEN s >= 6 THEN 'C' WHEN s >= 5 THEN 'D' ELSE 'F' END AS grade, CASE WHEN s >= 9 THEN 'A' WHEN s >= 8 THEN 'B' WHEN s >= 7 THEN 'C' WHEN s >= 6 THEN 'D' ELSE 'F' END AS metric_grade FROM (SELECT o_orderkey, {_S} AS s FROM orders)", (), ("orders",))
def x13(orders):
    s = F.round(F.col("o_totalprice") % 10, 2)
    return orders.select("o_orderkey", scores.grade(s).alias("grade"), scores.metric_grade(s).alias("metric_grade"))


@query("x15_debt_text", "SELECT o_orderkey, CASE WHEN h < 1 THEN floor(h * 60)::BIGINT || 'm' WHEN h < 24 THEN floor(h)::BIGINT || 'h ' || floor((h - floor(h)) * 60)::BIGINT || 'm' ELSE floor(h / 8)::BIGINT || 'd ' || floor(h % 8)::BIGINT || 'h' END AS debt FROM (SELECT o_orderkey, (o_orderkey % 400) / 4.0 AS h FROM orders)", (), ("orders",))
def x15(orders):
    return orders.select("o_orderkey", scores.debt_text((F.col("o_orderkey") % 400) / 4.0).alias("debt"))


@query("x16_duration", "SELECT event_id, CASE WHEN m < 1000 THEN floor(m)::BIGINT || 'ms' WHEN m < 60000 THEN floor(m / 1000)::BIGINT || 's' ELSE floor(m / 60000)::BIGINT || 'm ' || floor(m % 60000 / 1000)::BIGINT || 's' END AS d FROM (SELECT event_id, value * 1000 AS m FROM events)", (), ("events",))
def x16(events):
    return events.select("event_id", scores.duration_text(F.col("value") * 1000).alias("d"))


@query("x17_cost", "SELECT seq, round(tokens_in * coalesce(p.a, 3.0) / 1000 + tokens_out * coalesce(p.b, 15.0) / 1000, 6) AS cost FROM requests LEFT JOIN (VALUES ('p0', 0.5, 1.5), ('p1', 1.0, 4.0)) AS p(provider, a, b) ON requests.provider = p.provider", ("requests",))
def x17(requests):
    prices = F.create_map(F.lit("p0"), F.array(F.lit(0.5), F.lit(1.5)), F.lit("p1"), F.array(F.lit(1.0), F.lit(4.0)))
    p = F.coalesce(F.try_element_at(prices, F.col("provider")), F.array(F.lit(3.0), F.lit(15.0)))
    return requests.select("seq", F.round(F.col("tokens_in") * p[0] / 1000 + F.col("tokens_out") * p[1] / 1000, 6).alias("cost"))


@query("x18_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events", (), ("events",))
def x18(events):
    return events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("x19_mask_pii", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '(?i)(api[_-]?key|token|secret)(\s*[=:]\s*)["'']?[A-Za-z0-9_\-]{20,}["'']?', '\1=***', 'g')) AS h FROM documents""", (), ("documents",))
def x19(docs):
    return docs.select("doc_id", F.sha2(text.masked_pii(F.col("text")), 256).alias("h"))


@query("x21_mask_quotes", r"""SELECT doc_id, sha256(regexp_replace(text, '(["''])[^"'']{3,}(["''])', '\1***REDACTED***\2', 'g')) AS h FROM documents""", (), ("documents",))
def x21(docs):
    return docs.select("doc_id", F.sha2(text.masked_quotes(F.col("text")), 256).alias("h"))


@query("x22_likely_password", "SELECT p_partkey, length(v) >= 3 AND NOT regexp_matches(v, 'your_password|password_here|enter_password|change_me|placeholder|example|todo|xxx|[{][{]|[}][}]|[$][{]') AS likely FROM (SELECT p_partkey, lower(CASE p_size % 7 WHEN 0 THEN 'Your_Password1' WHEN 1 THEN substr(p_name, 1, 2) WHEN 2 THEN '{{' || p_name || '}}' WHEN 3 THEN p_name || ' TODO' WHEN 4 THEN '${' || p_name || '}' ELSE p_name END) AS v FROM part)", (), ("part",))
def x22(part):
    kinds = {0: F.lit("Your_Password1"), 1: F.substring("p_name", 1, 2), 2: F.concat(F.lit("{{"), "p_name", F.lit("}}")), 3: F.concat("p_name", F.lit(" TODO")), 4: F.concat(F.lit("${"), "p_name", F.lit("}"))}
    value = F.coalesce(*[F.when(F.col("p_size") % 7 == k, v) for k, v in kinds.items()], F.col("p_name"))
    return part.select("p_partkey", text.likely_password(value).alias("likely"))


@query("x24_keywords", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda w: length(w) > 3))), ',') AS words FROM part", (), ("part",))
def x24(part):
    return part.select("p_partkey", F.array_join(F.array_sort(text.finding_keywords(F.concat_ws(" ", "p_name", "p_type"))), ",").alias("words"))


@query("x25_operation_stem", "SELECT name, CASE WHEN starts_with(name, 'get') THEN lower(substr(name, 4, 1)) || substr(name, 5) WHEN starts_with(name, 'fetch') THEN lower(substr(name, 6, 1)) || substr(name, 7) ELSE lower(substr(name, 7, 1)) || substr(name, 8) END AS stem, CASE WHEN regexp_matches(name, '^(get|fetch)') THEN 'query' WHEN starts_with(name, 'create') THEN 'create' ELSE 'delete' END AS verb FROM consumer_ops", ("consumer_ops",))
def x25(ops):
    return ops.select("name", text.operation_stem(F.col("name")).alias("stem"), text.verb_class(F.col("name")).alias("verb"))


@query("x28_type_groups", "SELECT c.name, p.name AS provider, (lower(c.output_type) = p.output_type OR (lower(c.output_type) = 'int' AND p.output_type = 'number')) AS ok FROM consumer_ops c JOIN provider_ops p ON c.name = p.name", ("consumer_ops", "provider_ops"))
def x28(c, p):
    j = c.join(p.select("name", F.col("output_type").alias("other")), "name")
    return j.select("name", F.col("name").alias("provider"), text.types_compatible(F.col("output_type"), F.col("other")).alias("ok"))


@query("x29_cvss", "SELECT p_partkey, CASE WHEN h >= 2 THEN 'critical' WHEN h = 1 THEN 'high' WHEN contains(v, '/C:L') OR contains(v, '/I:L') THEN 'medium' ELSE 'low' END AS severity FROM (SELECT p_partkey, v, contains(v, '/C:H')::INT + contains(v, '/I:H')::INT + contains(v, '/A:H')::INT AS h FROM (SELECT p_partkey, 'AV:N/C:' || substr('HLN', p_partkey % 3 + 1, 1) || '/I:' || substr('NHL', p_size % 3 + 1, 1) || '/A:' || substr('NNH', p_size % 3 + 1, 1) AS v FROM part))", (), ("part",))
def x29(part):
    pick = lambda s, c: F.substring(F.lit(s), (c % 3 + 1).cast("int"), F.lit(1))
    v = F.concat(F.lit("AV:N/C:"), pick("HLN", F.col("p_partkey")), F.lit("/I:"), pick("NHL", F.col("p_size")), F.lit("/A:"), pick("NNH", F.col("p_size")))
    return part.select("p_partkey", scores.cvss_severity(v).alias("severity"))


@query("x30_bare_version", r"SELECT pos, regexp_replace(regexp_replace(version, '^[\^~>=<! ]+', ''), '[.*]+$', '') AS v FROM deps", ("deps",))
def x30(deps):
    return deps.select("pos", text.bare_version(F.col("version")).alias("v"))


@query("x31_maintainability", "SELECT o_orderkey, round(greatest(0.0, least(100.0, 171 - 5.2 * ln(greatest(o_totalprice, 1)) - 0.23 * (o_orderkey % 20) - 16.2 * ln(greatest(o_custkey, 1)))), 4) AS mi FROM orders", (), ("orders",))
def x31(orders):
    return orders.select("o_orderkey", F.round(scores.maintainability_index(F.col("o_totalprice"), F.col("o_orderkey") % 20, F.col("o_custkey").cast("double")), 4).alias("mi"))


@query("x34_lane", "SELECT o_orderkey, CASE WHEN r <= 3.5 THEN 'fast' WHEN r <= 7.5 THEN 'middle' ELSE 'deep' END AS lane FROM (SELECT o_orderkey, least(greatest(CASE WHEN v > 10 AND v <= 100 THEN v / 10 ELSE v END, 0), 10) AS r FROM (SELECT o_orderkey, (o_orderkey % 120) - 5.0 AS v FROM orders))", (), ("orders",))
def x34(orders):
    return orders.select("o_orderkey", scores.lane(scores.normalized_risk((F.col("o_orderkey") % 120) - 5.0)).alias("lane"))


@query("x36_short_hash", "SELECT path, substr(md5(coalesce(content, '')), 1, 8) AS h FROM files", ("files",))
def x36(files):
    return files.select("path", text.short_file_hash(F.col("content")).alias("h"))


@query("x37_timeout", "SELECT path, greatest(10.0, least(strlen(coalesce(content, '')) / 5000.0, 300.0))::DOUBLE AS timeout FROM files", ("files",))
def x37(files):
    return files.select("path", scores.file_timeout(F.octet_length(F.coalesce("content", F.lit(""))).cast("double")).alias("timeout"))


# sources


@query("s2_detect_language", "SELECT path, CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'sql' THEN 'sql' ELSE 'unknown' END AS detected FROM files", ("files",))
def s2(files):
    from quarry.sources.files import language_of

    return files.select("path", language_of(F.col("path")).alias("detected"))


# whole texts, some with a last line feed, carriage returns, or nothing in them
_ENDS = "SELECT path, CASE doc_id % 5 WHEN 0 THEN content || chr(10) WHEN 1 THEN replace(content, chr(10), chr(13) || chr(10)) WHEN 2 THEN CASE WHEN doc_id % 20 = 2 THEN '' ELSE content || chr(10) || chr(10) END ELSE content END AS content FROM files"


@query("s3_file_stats", f"""WITH e AS ({_ENDS}), p AS (SELECT path, content, replace(content, chr(13) || chr(10), chr(10)) AS plain FROM e), n AS (SELECT path, content, CASE WHEN plain = '' OR ends_with(plain, chr(10)) THEN plain ELSE plain || chr(10) END AS ended FROM p)
SELECT path, strlen(content) AS size_bytes, length(ended) - length(replace(ended, chr(10), '')) AS line_count, sha256(ended) AS hash FROM n""", ("files",))
def s3(files):
    files.createOrReplaceTempView("s3_files")
    told = files.sparkSession.sql(_ENDS.replace("FROM files", "FROM s3_files"))
    return R.file_metrics(told).select("path", "size_bytes", "line_count", "hash")


@query("s6_discovery_stats", "SELECT language, count(*) AS n, sum(strlen(coalesce(content, '')))::BIGINT AS bytes FROM files GROUP BY language", ("files",))
def s6(files):
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.coalesce("content", F.lit("")))).alias("bytes"))


@query("s10_ignore_filter", "SELECT url FROM pages WHERE NOT (regexp_matches(url, '(^|/)en(/.+)') AND NOT regexp_matches(url, '(^|/)[^/]*5[^/]*(/|$)'))", (), ("pages",))
def s10(pages):
    from quarry.sources.files import ignored

    return pages.where(~ignored(F.col("url"), ["en/", "!*5*"])).select("url")


@query("s15_requirements", r"SELECT pos, regexp_extract(req, '^([A-Za-z0-9._-]+)', 1) AS name, regexp_extract(req, '\[([^\]]*)\]', 1) AS extras, regexp_extract(req, '((?:==|>=|<=|~=|!=|<|>)[^;\s]+)', 1) AS spec FROM (SELECT pos, 'pkg' || pos || '[extra]>=1.' || pos || '; python_version > \"3\"' AS req FROM deps)", ("deps",))
def s15(deps):
    from quarry.sources.manifests import requirement

    req = F.concat(F.lit("pkg"), F.col("pos").cast("string"), F.lit("[extra]>=1."), F.col("pos").cast("string"), F.lit('; python_version > "3"'))
    name, extras, spec = requirement(req)
    return deps.select("pos", name.alias("name"), extras.alias("extras"), spec.alias("spec"))
