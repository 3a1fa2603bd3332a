"""Queries of keyed state, by their batch forms, and of report rows: transitions of issues, look-ups in a cache, SARIF results."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.base import query
from quarry.streaming import state

_EPOCH, _PERIOD = 1704067200, 60


@query("st1_issue_transitions", """WITH s AS (SELECT DISTINCT code_hash, snapshot FROM issues),
w AS (SELECT *, lag(snapshot) OVER k AS before, lead(snapshot) OVER k AS after, min(snapshot) OVER (PARTITION BY code_hash) AS first FROM s WINDOW k AS (PARTITION BY code_hash ORDER BY snapshot)),
r AS (SELECT *, sum(CASE WHEN snapshot > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY code_hash ORDER BY snapshot)::BIGINT AS reopen_count FROM w)
SELECT code_hash, CASE WHEN before IS NULL THEN 'new' WHEN snapshot > before + 1 THEN 'reopened' ELSE 'persistent' END AS event, snapshot::BIGINT AS snapshot, first::BIGINT AS first, reopen_count, reopen_count * 2 AS changes FROM r
UNION ALL SELECT code_hash, 'resolved', snapshot + 1, first, reopen_count, reopen_count * 2 + 1 FROM r WHERE coalesce(after > snapshot + 1, snapshot < (SELECT max(snapshot) FROM s))""", ("issues",))
def st1(issues):
    found = state.transitions(issues.select("code_hash", F.timestamp_seconds(F.lit(_EPOCH) + F.col("snapshot") * _PERIOD).alias("at")), _PERIOD)
    number = lambda c: F.floor((F.unix_timestamp(c) - _EPOCH) / _PERIOD)
    return found.select("code_hash", "event", number("at").alias("snapshot"), number("first_detected").alias("first"), "reopen_count", "changes")


@query("st3_cache_lookups", """WITH r AS (SELECT user_id % 500 AS k, event_type AS version, date_trunc('second', ts) AS t FROM events),
w AS (SELECT k, t, lag(t) OVER own AS before, lag(version) OVER own = version AS same FROM r WINDOW own AS (PARTITION BY k ORDER BY t, version)),
h AS (SELECT k, t, coalesce(same AND date_diff('second', before, t) <= 200000, false) AS hit, date_diff('second', before, t) AS age FROM w)
SELECT k::VARCHAR AS key, epoch(t)::BIGINT AS second, hit, CASE WHEN hit THEN age END AS age FROM h""", (), ("events",))
def st3(events):
    asked = events.select((F.col("user_id") % 500).cast("string").alias("key"), F.col("event_type").alias("version"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"))
    return state.lookups(asked, 200_000).select("key", F.unix_timestamp("at").alias("second"), "hit", "age")


_RESULT = """SELECT seq, rule_id AS rule, CASE WHEN line % 7 = 1 THEN 'none' WHEN line % 7 = 0 THEN CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'warning' ELSE 'note' END WHEN severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END AS level,
CASE WHEN line % 7 > 1 AND is_blocker THEN '⚠️ [MANUAL REVIEW REQUIRED] ' ELSE '' END || message || CASE WHEN line % 7 > 1 AND (is_blocker OR sup % 5 = 0) THEN chr(10) || chr(10) || 'Details: ' || CASE WHEN is_blocker AND sup % 5 = 0 THEN 'Verification uncertain | ' || frame_id WHEN is_blocker THEN 'LLM verification was uncertain or skipped.' ELSE frame_id END ELSE '' END AS text,
substr(path, 5) AS uri, CASE WHEN line < 1 THEN 1 ELSE line END::BIGINT AS start, CASE WHEN line % 7 = 0 THEN 'Baseline technical debt — accepted in previous scan' WHEN line % 7 = 1 THEN 'Suppressed by rule' END AS justification, CASE WHEN line % 7 > 1 OR source IS NOT NULL THEN source END AS source FROM findings"""


@query("k2_sarif_results", _RESULT, ("findings",))
def k2(findings):
    from quarry.operators import sarif

    told = findings.select("seq", "frame_id", "rule_id", "severity", "message", "path", "line", F.col("is_blocker").alias("review_required"), F.when(F.col("sup") % 5 == 0, F.col("frame_id")).alias("detail"), F.col("source").alias("detection_source"), F.when(F.col("line") % 7 == 0, "baseline").when(F.col("line") % 7 == 1, "config").alias("suppressed_by"))
    of = lambda p: F.get_json_object("result", p)
    place = "$.locations[0].physicalLocation"
    return sarif.results(told, "src").select("seq", F.col("rule_id").alias("rule"), of("$.level").alias("level"), of("$.message.text").alias("text"), of(f"{place}.artifactLocation.uri").alias("uri"), of(f"{place}.region.startLine").cast("long").alias("start"), of("$.suppressions[0].justification").alias("justification"), of("$.properties.detectionSource").alias("source"))
