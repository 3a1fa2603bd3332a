"""Queries that aggregate: run summaries, trends, scores, debt, request metrics; and window-shaped ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import scores
from quarry.operators import findings as O
from quarry.operators import rules as R
from quarry.plans.base import query
from quarry.plans.scan import _LINES

_PEN = "CASE severity WHEN 'critical' THEN 3.0 WHEN 'high' THEN 1.5 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.1 ELSE 0 END"


@query("a1_frame_status", "SELECT count(*) FILTER (status IN ('passed', 'warning')) AS passed, count(*) FILTER (status IN ('failed', 'error', 'timeout')) AS failed, count(*) FILTER (status = 'skipped') AS skipped, sum(n)::BIGINT AS findings FROM (SELECT frame_id, count(*) AS n, CASE WHEN frame_id = 'AF' THEN 'failed' WHEN frame_id = 'NO' THEN 'warning' ELSE 'skipped' END AS status FROM findings GROUP BY frame_id)", ("findings",))
def a1(findings):
    status = F.when(F.col("frame_id") == "AF", "failed").when(F.col("frame_id") == "NO", "warning").otherwise("skipped")
    return O.aggregate_frames(findings.groupBy("frame_id").agg(F.count(F.lit(1)).alias("findings")).withColumn("status", status))


@query("a2_capped_frames", "SELECT frame_id, severity, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY seq) AS k FROM findings) WHERE k > 1000 GROUP BY ALL", ("findings",))
def a2(findings):
    # a limit by rank is applied in every task before the shuffle, so no task holds a frame; what is over is all less these
    first = findings.withColumn("k", F.row_number().over(Window.partitionBy("frame_id").orderBy("seq"))).where("k <= 1000")
    count = lambda df, name: df.groupBy("frame_id", "severity").agg(F.count(F.lit(1)).alias(name))
    met = count(findings, "total").join(count(first, "kept"), ["frame_id", "severity"], "left")
    return met.select("frame_id", "severity", (F.col("total") - F.coalesce("kept", F.lit(0))).alias("n")).where("n > 0")


@query("a3_run_summary", "SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (is_blocker) AS blockers, count(*) AS total FROM findings", ("findings",))
def a3(findings):
    s = F.col("severity")
    return findings.agg(*[F.count_if(s == x).alias(x) for x in ("critical", "high", "medium", "low")], F.count_if("is_blocker").alias("blockers"), F.count(F.lit(1)).alias("total"))


@query("a4_frame_pivot", "SELECT frame_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM findings GROUP BY frame_id", ("findings",))
def a4(findings):
    return findings.groupBy("frame_id").pivot("severity", ["critical", "high", "medium", "low"]).count().na.fill(0)


@query("a5_issue_trends", "SELECT type, count(*) AS n, count(*) FILTER (state = 'RESOLVED') AS resolved, sum(reopen_count)::BIGINT AS reopens, CASE WHEN count(*) FILTER (state = 'RESOLVED') > 0.7 * count(*) THEN 'improving' WHEN sum(reopen_count) > 0.3 * count(*) THEN 'degrading' ELSE 'stable' END AS trend FROM issues GROUP BY type ORDER BY n DESC, type LIMIT 10", ("issues",))
def a5(issues):
    g = issues.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "RESOLVED").alias("resolved"), F.sum("reopen_count").alias("reopens"))
    trend = F.when(F.col("resolved") > 0.7 * F.col("n"), "improving").when(F.col("reopens") > 0.3 * F.col("n"), "degrading").otherwise("stable")
    return g.withColumn("trend", trend).orderBy(F.desc("n"), "type").limit(10)


@query("a6_state_counts", "SELECT s.state, count(i.state) AS n FROM (VALUES ('OPEN'), ('RESOLVED'), ('SUPPRESSED'), ('IGNORED')) AS s(state) LEFT JOIN issues i ON i.state = s.state GROUP BY s.state", ("issues",))
def a6(issues):
    states = issues.sparkSession.createDataFrame([(x,) for x in ("OPEN", "RESOLVED", "SUPPRESSED", "IGNORED")], "state string")
    return states.join(issues.groupBy("state").agg(F.count(F.lit(1)).alias("c")), "state", "left").select("state", F.coalesce("c", F.lit(0)).alias("n"))


@query("a7_quality_score", f"SELECT path, round(greatest(0.1, least(10.0, 10.0 * 20 / (sum({_PEN}) + 20))), 3)::DOUBLE AS score FROM findings GROUP BY path", ("findings",))
def a7(findings):
    return findings.groupBy("path").agg(F.round(scores.decayed(10.0, F.sum(scores.penalty(F.col("severity")))), 3).alias("score"))


@query("a9_hundred_scale", """SELECT path, line, greatest(0.0, least(100.0, 100.0 - sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 WHEN 'low' THEN 0.5 ELSE 0 END) + CASE line % 3 WHEN 0 THEN 5 WHEN 1 THEN -10 ELSE 0 END))::DOUBLE AS score FROM findings GROUP BY path, line""", ("findings",))
def a9(findings):
    trend = F.when(F.col("line") % 3 == 0, "IMPROVING").when(F.col("line") % 3 == 1, "DEGRADING").otherwise("STABLE")
    lost = findings.groupBy("path", "line").agg(F.sum(scores.deduction(F.col("severity"))).alias("lost"))
    return lost.select("path", "line", scores.hundred(F.col("lost"), trend).alias("score"))


WEIGHTS = {"complexity": 0.25, "duplication": 0.20, "maintainability": 0.20, "naming": 0.15, "documentation": 0.15, "testability": 0.05}
_W = " + ".join(f"{w} * {m}" for m, w in WEIGHTS.items())


@query("a10_overall_score", f"SELECT file_id, round(greatest(0, least(10, {_W})), 4)::DOUBLE AS overall FROM metrics", ("metrics",))
def a10(metrics):
    total = sum((F.col(m) * w for m, w in WEIGHTS.items()), F.lit(0.0))
    return metrics.select("file_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), total)), 4).alias("overall"))


@query("a11_metrics", "SELECT round(avg(complexity), 4) AS complexity, round(avg(duplication), 4) AS duplication, round(avg(maintainability), 4) AS maintainability, round(avg(documentation), 4) AS documentation, round(2 * (10 - avg(complexity)) + (10 - avg(duplication)) + 1.5 * (10 - avg(maintainability)) + 0.5 * (10 - avg(documentation)), 4) AS debt_hours FROM metrics", ("metrics",))
def a11(metrics):
    m = metrics.agg(*[F.avg(c).alias(c) for c in ("complexity", "duplication", "maintainability", "documentation")])
    debt = 2 * (10 - F.col("complexity")) + (10 - F.col("duplication")) + 1.5 * (10 - F.col("maintainability")) + 0.5 * (10 - F.col("documentation"))
    return m.select(*[F.round(c, 4).alias(c) for c in m.columns], F.round(debt, 4).alias("debt_hours"))


@query("a11_hotspots", "SELECT file_id, impact FROM metrics ORDER BY impact DESC, file_id LIMIT 10", ("metrics",))
def a11_hotspots(metrics):
    return metrics.select("file_id", "impact").orderBy(F.desc("impact"), "file_id").limit(10)


@query("a12_debt_report", """WITH g AS (SELECT type, user_hash, count(*) AS n, max(date_diff('day', ts::DATE, DATE '2024-02-01'))::INT AS age FROM (SELECT type, ts, split_part(code_hash, ':', 1) AS user_hash FROM issues) GROUP BY type, user_hash)
SELECT type, user_hash, n, age, CASE WHEN age >= 30 THEN 'critical' WHEN age >= 14 THEN 'warning' WHEN age >= 7 THEN 'info' END AS level FROM g""", ("issues",))
def a12(issues):
    age = F.max(F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts")))
    g = issues.withColumn("user_hash", F.split_part("code_hash", F.lit(":"), F.lit(1))).groupBy("type", "user_hash").agg(F.count(F.lit(1)).alias("n"), age.alias("age"))
    return g.withColumn("level", scores.debt_level(F.col("age")))


@query("a14_frame_requests", "SELECT frame, count(*) AS calls, sum(tokens_in + tokens_out)::BIGINT AS tokens, round(sum(duration_ms), 2) AS ms, count(*) FILTER (NOT ok) AS errors FROM requests GROUP BY frame", ("requests",))
def a14(requests):
    return requests.groupBy("frame").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.round(F.sum("duration_ms"), 2).alias("ms"), F.count_if(~F.col("ok")).alias("errors"))


@query("a15_tier_stats", """SELECT tier, count(*) AS calls, count(DISTINCT provider) AS providers, round(count(*) * 1.0 / (SELECT count(*) FROM requests), 6) AS share, round(avg(ok::INT), 6) AS success, count(*) FILTER (error = 'timeout') AS timeouts,
 round(avg(duration_ms) FILTER (ok), 4) AS mean_ms, arg_max(provider, seq) AS latest FROM requests GROUP BY tier""", ("requests",))
def a15(requests):
    g = requests.groupBy("tier").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("provider").alias("providers"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("success"), F.count_if(F.col("error") == "timeout").alias("timeouts"), F.round(F.avg(F.when(F.col("ok"), F.col("duration_ms"))), 4).alias("mean_ms"), F.max_by("provider", "seq").alias("latest"))
    total = requests.agg(F.count(F.lit(1)).alias("total"))
    return g.join(F.broadcast(total)).withColumn("share", F.round(F.col("calls") / F.col("total"), 6)).drop("total")


@query("a16_request_issues", "SELECT frame, count(*) FILTER (NOT ok) > 0.1 * count(*) AS failing, bool_or(coalesce(contains(error, 'rate limit'), false)) AS limited FROM requests GROUP BY frame", ("requests",))
def a16(requests):
    return requests.groupBy("frame").agg((F.count_if(~F.col("ok")) > 0.1 * F.count(F.lit(1))).alias("failing"), F.bool_or(F.coalesce(F.contains("error", F.lit("rate limit")), F.lit(False))).alias("limited"))


@query("a17_savings", "SELECT round(count(*) FILTER (tier = 'fast') * (avg(duration_ms) FILTER (tier = 'smart') - avg(duration_ms) FILTER (tier = 'fast')), 3) AS saved_ms FROM requests", ("requests",))
def a17(requests):
    fast, smart = F.col("tier") == "fast", F.col("tier") == "smart"
    return requests.agg(F.round(F.count_if(fast) * (F.avg(F.when(smart, F.col("duration_ms"))) - F.avg(F.when(fast, F.col("duration_ms")))), 3).alias("saved_ms"))


@query("a18_graph_stats", "SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM calls) AS n_edges, (SELECT count(*) FROM nodes WHERE kind = 'class') AS classes, (SELECT count(*) FROM calls WHERE relation = 'imports') AS imports", ("nodes", "calls"))
def a18(nodes, calls):
    n = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("kind") == "class").alias("classes"))
    return n.join(F.broadcast(calls.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("relation") == "imports").alias("imports"))))


@query("a19_coverage", "SELECT round(coalesce(avg((c.path IS NOT NULL)::INT), 0), 6) AS coverage FROM files f LEFT JOIN contexts c ON f.path = c.path", ("files", "contexts"))
def a19(files, contexts):
    seen = contexts.select("path", F.lit(1).alias("seen"))
    return files.join(seen, "path", "left").agg(F.round(F.coalesce(F.avg(F.coalesce("seen", F.lit(0))), F.lit(0.0)), 6).alias("coverage"))


@query("a20_flow_stats", "SELECT (SELECT count(*) FROM writes) AS writes, (SELECT count(DISTINCT field) FROM writes) AS written, (SELECT count(DISTINCT field) FROM reads) AS read, (SELECT count(*) FROM (SELECT DISTINCT field FROM writes EXCEPT SELECT field FROM reads)) AS dead", ("writes", "reads"))
def a20(writes, reads):
    w = writes.agg(F.count(F.lit(1)).alias("writes"), F.countDistinct("field").alias("written"))
    r = reads.agg(F.countDistinct("field").alias("read"))
    dead = writes.select("field").distinct().join(reads.select("field"), "field", "left_anti").agg(F.count(F.lit(1)).alias("dead"))
    return w.join(F.broadcast(r)).join(F.broadcast(dead))


@query("a22_language_share", "SELECT language, round(100.0 * sum(strlen(coalesce(content, ''))) / (SELECT sum(strlen(coalesce(content, ''))) FROM files), 3)::DOUBLE AS share FROM files GROUP BY language", ("files",))
def a22(files):
    g = files.groupBy("language").agg(F.sum(F.octet_length(F.coalesce("content", F.lit("")))).alias("bytes"))
    return g.select("language", F.round(100.0 * F.col("bytes") / F.sum("bytes").over(Window.partitionBy(F.lit(1))), 3).alias("share"))


@query("a23_context_distribution", "SELECT context, count(*) AS n, count(*) FILTER (is_entry) AS entries FROM contexts GROUP BY context", ("contexts",))
def a23(contexts):
    return contexts.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_entry").alias("entries"))


@query("a24_phase_durations", "SELECT event_id, user_id, round(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 - epoch_us(ts) / 1e6, 3) AS seconds FROM events", (), ("events",))
def a24(events):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sec = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    return events.select("event_id", "user_id", F.round(sec(F.lead("ts").over(w)) - sec(F.col("ts")), 3).alias("seconds"))


@query("a25_freshness", "SELECT o_orderkey, greatest(0, 100 - least(2 * age, 30) - floor((1 - r) * 25) - CASE WHEN o_orderkey % 7 = 0 THEN 20 ELSE 0 END)::INT AS score FROM (SELECT o_orderkey, o_orderkey % 40 AS age, (o_orderkey % 5) / 4.0 AS r FROM orders)", (), ("orders",))
def a25(orders):
    k = F.col("o_orderkey")
    score = 100 - F.least(2 * (k % 40), F.lit(30)) - F.floor((1 - (k % 5) / 4.0) * 25) - F.when(k % 7 == 0, 20).otherwise(0)
    return orders.select("o_orderkey", F.greatest(F.lit(0), score).cast("int").alias("score"))


@query("a26_index_stats", "SELECT lang, count(*) AS chunks, count(DISTINCT source) AS sources FROM documents WHERE length(text) > 0 GROUP BY lang", (), ("documents",))
def a26(docs):
    return docs.where(F.length("text") > 0).groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source").alias("sources"))


@query("a27_source_counters", "SELECT frame_id, count(*) FILTER (starts_with(source, 'llm')) AS llm, count(*) FILTER (NOT starts_with(source, 'llm')) AS det FROM findings GROUP BY frame_id", ("findings",))
def a27(findings):
    llm = F.startswith("source", F.lit("llm"))
    return findings.groupBy("frame_id").agg(F.count_if(llm).alias("llm"), F.count_if(~llm).alias("det"))


@query("a28_pass_rate", "SELECT provider, coalesce(count(*) FILTER (ok) * 100.0 / nullif(count(*), 0), 0)::DOUBLE AS rate FROM requests GROUP BY provider", ("requests",))
def a28(requests):
    return requests.groupBy("provider").agg(F.coalesce(F.try_divide(F.count_if("ok") * 100.0, F.count(F.lit(1))), F.lit(0.0)).alias("rate"))


@query("a30_clean_share", "SELECT round(100.0 * count(*) FILTER (NOT bad) / count(*), 4) AS share FROM (SELECT path, bool_or(severity IN ('critical', 'high')) AS bad FROM findings GROUP BY path)", ("findings",))
def a30(findings):
    per = findings.groupBy("path").agg(F.bool_or(F.col("severity").isin("critical", "high")).alias("bad"))
    return per.agg(F.round(100.0 * F.count_if(~F.col("bad")) / F.count(F.lit(1)), 4).alias("share"))


@query("ext_severity_cube", "SELECT frame_id, severity, count(*) AS n FROM findings GROUP BY CUBE (frame_id, severity)", ("findings",))
def cube(findings):
    return findings.cube("frame_id", "severity").agg(F.count(F.lit(1)).alias("n"))


# windows


@query("w1_trend", """WITH t AS (SELECT snapshot, count(*) AS n FROM issues GROUP BY snapshot), l AS (SELECT *, lag(n) OVER (ORDER BY snapshot) AS p FROM t)
SELECT snapshot, n, CASE WHEN p IS NULL THEN 'UNKNOWN' WHEN p = 0 THEN CASE WHEN n = 0 THEN 'STABLE' ELSE 'DEGRADING' END WHEN (n - p) * 100.0 / p < -5 THEN 'IMPROVING' WHEN (n - p) * 100.0 / p > 5 THEN 'DEGRADING' ELSE 'STABLE' END AS trend FROM l""", ("issues",))
def w1(issues):
    t = issues.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"))
    p, n = F.lag("n").over(Window.orderBy("snapshot")), F.col("n")  # one row a snapshot
    change = (n - F.col("p")) * 100.0 / F.col("p")
    trend = F.when(F.col("p").isNull(), "UNKNOWN").when(F.col("p") == 0, F.when(n == 0, "STABLE").otherwise("DEGRADING")).when(change < -5, "IMPROVING").when(change > 5, "DEGRADING").otherwise("STABLE")
    return t.withColumn("p", p).select("snapshot", "n", trend.alias("trend"))


@query("w2_latest_snapshots", "SELECT DISTINCT snapshot FROM issues ORDER BY snapshot DESC LIMIT 2", ("issues",))
def w2(issues):
    return issues.select("snapshot").distinct().orderBy(F.desc("snapshot")).limit(2)


@query("w3_budget_prefix", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER w AS used, count(*) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE used <= 1500 AND n <= 5", (), ("conversations",))
def w3(conv):
    from quarry.operators.similarity import within_budget

    return within_budget(conv, 1500, 5, "conv_id", [F.col("turn")], F.length("text")).select("conv_id", "turn")


@query("w5_line_chunks", f"WITH lines AS ({_LINES}) SELECT path, (line - 1) // 8 AS chunk, min(line) AS first, max(line) AS last, sum(length(text))::BIGINT AS chars FROM lines GROUP BY ALL", ("files",))
def w5(files):
    return R.lines(files).groupBy("path", F.floor((F.col("line") - 1) / 8).alias("chunk")).agg(F.min("line").alias("first"), F.max("line").alias("last"), F.sum(F.length("text")).alias("chars"))


@query("w6_lines_around", f"WITH lines AS ({_LINES}) SELECT path, line, md5(string_agg(text, chr(10)) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS h FROM lines", ("files",))
def w6(files):
    return R.line_window(R.lines(files), 2, 2).select("path", "line", F.md5("window").alias("h"))


@query("w7_next_lines", f"WITH lines AS ({_LINES}) SELECT path, line, length(string_agg(text, chr(10)) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS n FROM lines", ("files",))
def w7(files):
    return R.line_window(R.lines(files), 0, 4).select("path", "line", F.length("window").alias("n"))


@query("w9_quote_parity", f"""WITH lines AS ({_LINES}), q AS (SELECT path, line, text, (sum((length(text) - length(replace(text, '"', '')))) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS q FROM lines)
SELECT path, line FROM q WHERE coalesce(q, 0) % 4 = 0 AND contains(text, 'token')""", ("files",))
def w9(files):
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    return R.lines(files).withColumn("q", F.coalesce(F.sum(quotes).over(w), F.lit(0))).where((F.col("q") % 4 == 0) & F.contains("text", F.lit("token"))).select("path", "line")


@query("w13_oldest_age", "SELECT user_id, date_diff('day', min(ts)::DATE, DATE '2024-02-01')::INT AS days FROM events GROUP BY user_id", (), ("events",))
def w13(events):
    return events.groupBy("user_id").agg(F.datediff(F.lit("2024-02-01").cast("date"), F.to_date(F.min("ts"))).alias("days"))


@query("c58_repeated_lines", f"""WITH lines AS ({_LINES}), t AS (SELECT path, line, trim(text, ' ') AS t FROM lines WHERE length(trim(text, ' ')) > 20 AND NOT starts_with(trim(text, ' '), '#')), f AS (SELECT *, min(line) OVER (PARTITION BY path, t) AS first_line FROM t)
SELECT path, line, first_line FROM f WHERE line > first_line""", ("files",))
def c58(files):
    from quarry.operators.similarity import repeated_lines

    return repeated_lines(R.lines(files))


@query("j15_line_blocks", None, ("files",))
def j15(files):
    from quarry.operators.similarity import line_blocks

    return line_blocks(files)


# searches


def _search_sql(n: int, where: str = "true") -> str:
    """The n nearest of every query (each id divisible by 20), as s(query, id, label, score, rank)."""
    cos = "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"
    all_pairs = f"SELECT q.vec_id AS query, e.vec_id AS id, e.label::BIGINT AS label, {cos} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND {where}"
    return f"s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM ({all_pairs})) WHERE rank <= {n})"


def _found(e, n, where=None, least=None):
    from quarry.operators.similarity import search

    return search(e, e.where("vec_id % 20 = 0"), n, where, least)


@query("v1_cosine_top", f"WITH {_search_sql(20)} SELECT * FROM s", (), ("embeddings",))
def v1(e):
    return _found(e, 20)


@query("v5_filtered_search", f"WITH {_search_sql(10, 'e.label IN (1, 2, 3) AND e.label <> 2')} SELECT * FROM s WHERE score >= 0.05", (), ("embeddings",))
def v5(e):
    return _found(e, 10, F.col("label").isin(1, 2, 3) & (F.col("label") != 2), 0.05)


_TOKENS = "(id * 7919 % 400 + 50)"


@query("v9_retrieve", f"WITH {_search_sql(14)}, u AS (SELECT *, sum({_TOKENS}) OVER (PARTITION BY query ORDER BY rank) AS used, row_number() OVER (PARTITION BY query ORDER BY rank) AS n FROM s WHERE score >= 0.02) SELECT query, count(*) AS chunks, sum({_TOKENS})::BIGINT AS tokens, max(score) AS best FROM u WHERE used <= 1500 AND n <= 7 GROUP BY query", (), ("embeddings",))
def v9(e):
    """What a query retrieves: twice the chunks wanted are searched, the leading ones within the budget are taken."""
    from quarry.operators.similarity import within_budget

    tokens = F.expr(_TOKENS)
    taken = within_budget(_found(e, 14, least=0.02), 1500, 7, "query", [F.col("rank")], tokens)
    return taken.groupBy("query").agg(F.count(F.lit(1)).alias("chunks"), F.sum(tokens).alias("tokens"), F.max("score").alias("best"))


@query("d6_multi_query_union", f"WITH {_search_sql(10)}, g AS (SELECT query - query % 100 AS asked, * FROM s), f AS (SELECT asked, id, score, query, row_number() OVER (PARTITION BY asked, id ORDER BY query) AS n FROM g), u AS (SELECT *, sum({_TOKENS}) OVER (PARTITION BY asked ORDER BY score DESC, id) AS used FROM f WHERE n = 1) SELECT asked, id, query, score FROM u WHERE used <= 4000", (), ("embeddings",))
def d6(e):
    """Several queries' chunks as one list: of a chunk the first query's score, then the budget again."""
    from quarry.operators.similarity import within_budget

    each = _found(e, 10).withColumn("asked", F.col("query") - F.col("query") % 100)
    first = each.groupBy("asked", "id").agg(F.min(F.struct("query", "score")).alias("f")).select("asked", "id", "f.query", "f.score")
    return within_budget(first, 4000, 1 << 30, "asked", [F.desc("score"), F.col("id")], F.expr(_TOKENS)).select("asked", "id", "query", "score")
