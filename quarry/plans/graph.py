"""Queries over graphs: users, gaps, closures, chains, cycles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import graphs as G
from quarry.plans.base import query


@query("j4_who_uses", "SELECT source, target, relation FROM calls LEFT JOIN nodes ON source = fqn WHERE NOT coalesce(is_test, false)", ("calls", "nodes"))
def j4(calls, nodes):
    return G.who_uses(calls, nodes).select("source", "target", "relation")


@query("j5_who_inherits", "SELECT DISTINCT target, fqn FROM calls JOIN nodes ON source = fqn WHERE relation = 'inherits'", ("calls", "nodes"))
def j5(calls, nodes):
    return calls.where("relation = 'inherits'").join(nodes, F.col("source") == F.col("fqn")).select("target", "fqn").distinct()


@query("j6_who_implements", "SELECT DISTINCT target, fqn FROM calls JOIN nodes ON source = fqn WHERE relation = 'implements'", ("calls", "nodes"))
def j6(calls, nodes):
    return calls.where("relation = 'implements'").join(nodes, F.col("source") == F.col("fqn")).select("target", "fqn").distinct()


@query("j7_broken_imports", "SELECT DISTINCT target FROM calls WHERE relation = 'imports' AND target NOT IN (SELECT fqn FROM nodes WHERE kind <> 'function')", ("calls", "nodes"))
def j7(calls, nodes):
    known = nodes.where("kind <> 'function'").select(F.col("fqn").alias("target"))
    return calls.where("relation = 'imports'").select("target").distinct().join(known, "target", "left_anti")


@query("j8_missing_implementors", "SELECT fqn FROM nodes WHERE kind IN ('mixin', 'interface') AND fqn NOT IN (SELECT target FROM calls WHERE relation = 'implements')", ("calls", "nodes"))
def j8(calls, nodes):
    done = calls.where("relation = 'implements'").select(F.col("target").alias("fqn"))
    return nodes.where(F.col("kind").isin("mixin", "interface")).join(done, "fqn", "left_anti").select("fqn")


@query("j9_test_only", "SELECT target AS fqn FROM calls JOIN nodes ON source = fqn GROUP BY target HAVING bool_and(is_test)", ("calls", "nodes"))
def j9(calls, nodes):
    return G.test_only(nodes, calls)


@query("j26_import_constants", "SELECT source, target, name FROM calls JOIN nodes ON target = fqn WHERE relation = 'imports' AND contains(name, 'red')", ("calls", "nodes"))
def j26(calls, nodes):
    return calls.where("relation = 'imports'").join(nodes.where(F.contains("name", F.lit("red"))), F.col("target") == F.col("fqn")).select("source", "target", "name")


@query("j27_resolve_module", "SELECT DISTINCT c.target, coalesce(a.fqn, b.fqn, 'none') AS file FROM calls c LEFT JOIN nodes a ON c.target = a.fqn AND a.kind = 'class' LEFT JOIN nodes b ON c.target = b.fqn AND b.kind = 'mixin'", ("calls", "nodes"))
def j27(calls, nodes):
    a = nodes.where("kind = 'class'").select(F.col("fqn").alias("a"))
    b = nodes.where("kind = 'mixin'").select(F.col("fqn").alias("b"))
    j = calls.select("target").distinct().join(a, F.col("target") == F.col("a"), "left").join(b, F.col("target") == F.col("b"), "left")
    return j.select("target", F.coalesce("a", "b", F.lit("none")).alias("file"))


@query("j30_callers", "SELECT target, source FROM (SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY source) AS n FROM (SELECT DISTINCT target, source FROM calls WHERE relation = 'calls')) WHERE n <= 3", ("calls",))
def j30(calls):
    w = Window.partitionBy("target").orderBy("source")
    return calls.where("relation = 'calls'").select("target", "source").distinct().withColumn("n", F.row_number().over(w)).where("n <= 3").drop("n")


@query("j32_file_gaps", "SELECT file_path, count(*) AS orphans FROM nodes WHERE fqn NOT IN (SELECT source FROM calls UNION SELECT target FROM calls) GROUP BY file_path", ("calls", "nodes"))
def j32(calls, nodes):
    return G.orphans(nodes, calls).groupBy("file_path").agg(F.count(F.lit(1)).alias("orphans"))


_CLOSURE = "WITH RECURSIVE r(node) AS (SELECT 'f7' UNION SELECT i.src FROM imports i JOIN r ON i.dst = r.node)"


@query("g1_transitive_impact", _CLOSURE + " SELECT node FROM r WHERE node <> 'f7'", ("imports",))
def g1(imports):
    return G.transitive_impact(imports, imports.sparkSession.createDataFrame([("f7",)], "node string"))


@query("g2_impacted_by_hash", "WITH RECURSIVE r(node) AS (SELECT DISTINCT src FROM imports WHERE src IN ('f3', 'f11') UNION SELECT i.src FROM imports i JOIN r ON i.dst = r.node) SELECT node FROM r", ("imports",))
def g2(imports):
    changed = imports.where(F.col("src").isin("f3", "f11")).select(F.col("src").alias("node")).distinct()
    back = imports.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.reachable(back, changed).select("node")


@query("g3_unreachable", "WITH RECURSIVE r(node) AS (SELECT 'f1' UNION SELECT i.dst FROM imports i JOIN r ON i.src = r.node) SELECT node FROM (SELECT src AS node FROM imports UNION SELECT dst FROM imports) WHERE node NOT IN (SELECT node FROM r)", ("imports",))
def g3(imports):
    return G.unreachable(imports, imports.sparkSession.createDataFrame([("f1",)], "node string"))


@query("g4_bounded_chain", """WITH RECURSIVE r(node, depth) AS (SELECT 'n5', 0 UNION SELECT c.target, r.depth + 1 FROM calls c JOIN r ON c.source = r.node WHERE r.depth < 3) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""", ("calls",))
def g4(calls):
    edges = calls.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return G.reachable(edges, calls.sparkSession.createDataFrame([("n5",)], "node string"), 3).select("node", F.col("depth").cast("int").alias("depth"))


@query("g5_on_cycles", "WITH RECURSIVE e AS (SELECT DISTINCT source AS src, target AS dst FROM calls WHERE relation IN ('inherits', 'implements') AND target IN (SELECT source FROM calls)), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT DISTINCT src AS node FROM r WHERE src = dst", ("calls",))
def g5(calls):
    return G.on_cycles(calls.where(F.col("relation").isin("inherits", "implements")).select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct())


@query("g6_orphan_symbols", "SELECT fqn FROM nodes WHERE fqn NOT IN (SELECT source FROM calls UNION SELECT target FROM calls)", ("calls", "nodes"))
def g6(calls, nodes):
    return G.orphans(nodes, calls).select("fqn")


@query("g7_orphan_files", "SELECT DISTINCT 'f' || CAST(c_custkey + c_nationkey * 40 AS STRING) AS file FROM customer WHERE 'f' || CAST(c_custkey + c_nationkey * 40 AS STRING) NOT IN (SELECT src FROM imports UNION SELECT dst FROM imports)", ("imports",), ("customer",))
def g7(imports, customer):
    ends = imports.select(F.col("src").alias("file")).union(imports.select(F.col("dst").alias("file"))).distinct()
    return customer.select(F.concat(F.lit("f"), (F.col("c_custkey") + F.col("c_nationkey") * 40).cast("string")).alias("file")).distinct().join(ends, "file", "left_anti")
