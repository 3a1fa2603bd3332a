"""Carrier tables: the driver's tables dressed as files, findings, edges, snapshots and request logs.

Each is one SELECT in the dialect that Spark SQL and the oracle share, so both sides read the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CARRIERS = {
    "files": """SELECT doc_id, 'src/' || source || '/d' || CAST(doc_id AS STRING) || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.go' ELSE '.sql' END AS path,
        text AS content, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'go' ELSE 'sql' END AS language, source AS module FROM documents""",
    "findings": """SELECT l_orderkey * 8 + l_linenumber AS seq, l_returnflag || l_linestatus AS frame_id,
        CASE l_linenumber WHEN 1 THEN 'sql-injection' WHEN 2 THEN 'xss-dom' WHEN 3 THEN 'hardcoded-password' WHEN 4 THEN 'weak-crypto' WHEN 5 THEN 'cmd-injection' ELSE 'style-naming' END AS rule_id,
        CASE l_suppkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
        CASE l_linenumber % 3 WHEN 0 THEN 'value reaches sink (line ' || CAST(l_partkey % 40 AS STRING) || ')' WHEN 1 THEN 'unsafe call at line ' || CAST(l_partkey % 40 AS STRING) ELSE 'secret in source' END AS message,
        'src/m' || CAST(l_partkey % 7 AS STRING) || '/f' || CAST(l_partkey % 211 AS STRING) || '.py' AS path,
        CAST(l_quantity AS INT) AS line, l_discount >= 0.09 AS is_blocker,
        CASE WHEN l_tax < 0.02 THEN NULL WHEN l_tax < 0.05 THEN 'llm-verifier' ELSE 'pattern' END AS source, l_suppkey AS sup FROM lineitem""",
    "baseline": "SELECT DISTINCT 'src/m' || CAST(p_partkey % 7 AS STRING) || '/f' || CAST(p_partkey % 211 AS STRING) || '.py' AS path, 'xss-dom' AS rule_id, 'secret in source' AS message FROM part WHERE p_size <= 10",
    "calls": "SELECT DISTINCT 'n' || CAST(l_partkey AS STRING) AS source, 'n' || CAST(l_orderkey AS STRING) AS target, CASE l_linenumber % 4 WHEN 0 THEN 'inherits' WHEN 1 THEN 'imports' WHEN 2 THEN 'calls' ELSE 'implements' END AS relation FROM lineitem",
    "nodes": "SELECT 'n' || CAST(p_partkey + CASE WHEN p_size > 45 THEN 100000000000 ELSE 0 END AS STRING) AS fqn, p_name AS name, CASE p_size % 5 WHEN 0 THEN 'mixin' WHEN 1 THEN 'interface' WHEN 2 THEN 'class' ELSE 'function' END AS kind, 'src/' || p_brand || '.py' AS file_path, p_size % 4 = 0 AS is_test FROM part",
    # a tree of imports whose links go down, up, or both ways: closures are deep, some files are out of reach
    "imports": "SELECT 'f' || CAST(CAST(FLOOR(c_custkey / 2) AS BIGINT) AS STRING) AS src, 'f' || CAST(c_custkey AS STRING) AS dst FROM customer WHERE c_custkey > 1 AND c_nationkey % 5 <> 1 UNION ALL SELECT 'f' || CAST(c_custkey AS STRING), 'f' || CAST(CAST(FLOOR(c_custkey / 2) AS BIGINT) AS STRING) FROM customer WHERE c_custkey > 1 AND c_nationkey % 5 <> 0",
    "writes": "SELECT 'fld' || CAST(l_partkey AS STRING) AS field, 'fn' || CAST(l_suppkey AS STRING) AS func_name, l_orderkey AS site, l_linenumber AS line FROM lineitem",
    "reads": "SELECT 'fld' || CAST(p_partkey + CASE WHEN p_size > 45 THEN 100000000000 ELSE 0 END AS STRING) AS field, 'rd' || CAST(p_size AS STRING) AS func_name FROM part WHERE p_size > 5",
    "inits": "SELECT DISTINCT 'fld' || CAST(p_partkey + CASE WHEN p_size > 40 THEN 100000000 ELSE 0 END AS STRING) AS field FROM part",
    "issues": """SELECT CAST(FLOOR((event_id % 1000) / 250) AS INT) AS snapshot, CAST(user_id AS STRING) || ':' || event_type AS code_hash, event_type AS type, ts,
        CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END AS severity,
        CASE user_id % 4 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'SUPPRESSED' ELSE 'OPEN' END AS state, user_id % 3 AS reopen_count FROM events""",
    "requests": """SELECT event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'fast' WHEN 'click' THEN 'fast' ELSE 'smart' END AS tier, 'p' || CAST(user_id % 4 AS STRING) AS provider,
        'fr' || CAST(user_id % 6 AS STRING) AS frame, event_type <> 'error' AS ok, value AS duration_ms, user_id AS tokens_in, event_id % 50 AS tokens_out,
        CASE WHEN event_type = 'error' AND user_id % 5 = 0 THEN 'rate limit exceeded' WHEN event_type = 'error' AND user_id % 5 = 1 THEN 'timeout' WHEN event_type = 'error' THEN 'other' END AS error FROM events""",
    "changed": "SELECT DISTINCT 'src/m' || CAST(o_custkey % 7 AS STRING) || '/f' || CAST(o_custkey % 211 AS STRING) || '.py' AS path, CAST(o_orderkey % 50 AS INT) AS line FROM orders",
    "contexts": "SELECT 'src/' || source || '/d' || CAST(doc_id AS STRING) || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.go' ELSE '.sql' END AS path, CASE doc_id % 6 WHEN 0 THEN 'TEST' WHEN 1 THEN 'EXAMPLE' WHEN 2 THEN 'DOCUMENTATION' WHEN 3 THEN 'FRAMEWORK' ELSE 'PRODUCTION' END AS context, doc_id % 4 = 0 AS is_entry FROM documents",
    "deps": "SELECT p_partkey AS pos, CASE WHEN p_size % 3 = 0 THEN 'python-' || split_part(p_name, ' ', 2) WHEN p_size % 3 = 1 THEN split_part(p_name, ' ', 2) || CAST(p_size % 10 AS STRING) ELSE '@acme/' || p_name END AS name, '^' || CAST(p_size AS STRING) || '.0.*' AS version FROM part",
    "consumer_ops": "SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'fetch' WHEN 2 THEN 'create' ELSE 'delete' END || 'Item' || CAST(c_custkey % 90 AS STRING) AS name, CASE c_nationkey % 3 WHEN 0 THEN 'String' WHEN 1 THEN 'int' ELSE 'List<Item>' END AS output_type FROM customer",
    "provider_ops": "SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'load' ELSE 'create' END || 'Item' || CAST(s_suppkey % 80 AS STRING) AS name, CASE s_nationkey % 2 WHEN 0 THEN 'string' ELSE 'number' END AS output_type FROM supplier",
    "metrics": "SELECT o_orderkey AS file_id, CAST(o_custkey % 11 AS DOUBLE) AS complexity, CAST(o_orderkey % 11 AS DOUBLE) AS duplication, CAST(o_custkey % 7 + 2 AS DOUBLE) AS maintainability, CAST(o_orderkey % 6 + 3 AS DOUBLE) AS naming, CAST(o_custkey % 10 AS DOUBLE) AS documentation, CAST(o_orderkey % 9 AS DOUBLE) AS testability, CAST(o_totalprice AS DOUBLE) AS impact FROM orders",
    "commits": "SELECT 'src/m' || CAST(o_custkey % 7 AS STRING) || '/f' || CAST(o_custkey % 211 AS STRING) || '.py' AS path, o_orderdate AS ts FROM orders",
}


def _needs(sql: str) -> list[str]:
    return [c for c in CARRIERS if re.search(rf"\b{c}\b", sql)]


def carrier(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = CARRIERS[name]
    for other in CARRIERS:  # a carrier can read another
        sql = re.sub(rf"\b(FROM|JOIN) {other}\b", lambda m, o=other: f"{m[1]} ({CARRIERS[o]}) AS {o}", sql)
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    text = re.sub(r"[{}]", lambda m: m[0] * 2, sql)
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_carriers(sql: str, *names: str) -> str:
    """The oracle's statement over named carriers."""
    ctes = [f"{n} AS ({CARRIERS[n]})" for n in names]
    body = sql.strip()
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"
