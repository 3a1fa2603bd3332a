"""Graph operators on edge tables: closures by iterated joins over a stored frontier, anti-joins, cycles."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one will do for executors inside this process only."""
    if spark.sparkContext.getCheckpointDir() is None:
        path, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not path:
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            path = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage in the shared checkpoint folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


class Steps:
    """Tables in the shared checkpoint folder, as compressed columns, that are dropped together once nothing reads them.

    A checkpoint is larger, being rows as they lie in memory, and stays until the folder is emptied.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{_shared(spark)}/steps-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes the tables, and lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        gc.collect()
        self.spark._jvm.System.gc()


def reachable(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): all nodes that `start` (node) reaches by edges (src, dst), with the least number of steps.

    Each round joins only the new frontier and keeps only nodes that no earlier round met.
    """
    seen = cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def transitive_impact(imports: DataFrame, changed: DataFrame) -> DataFrame:
    """Files that depend on a changed one, directly or not, without the changed ones."""
    back = imports.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(back, changed).where("depth > 0").select("node")


def unreachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.join(reachable(edges, entries).select("node"), "node", "left_anti")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) without nodes that lack a predecessor or a successor, until none does."""
    n = edges.count()
    while n:
        edges = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        n, before = edges.count(), n
        if n == before:
            break
    return edges


def cycle_groups(edges: DataFrame) -> DataFrame:
    """(node, group) for every node on a cycle; nodes that reach each other have one group, their greatest node.

    Rounds of colours: the greatest node that reaches a node is its colour; what reaches the colour's own node inside
    its colour is one group. Groups leave, the rest is trimmed and coloured again. Only counts come to the driver, and
    tables stay as narrow as the edges: no closure is built.
    """
    left = _trimmed(cut(edges.select("src", "dst").distinct()))
    found = left.select(F.col("src").alias("node"), F.col("src").alias("group")).limit(0)
    while not left.isEmpty():
        colour = cut(left.select(F.col("src").alias("node"), F.col("src").alias("c")).distinct())
        while True:
            come = left.join(colour, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "c")
            best = cut(colour.unionByName(come).groupBy("node").agg(F.max("c").alias("c")))
            changed = best.join(colour, ["node", "c"], "left_anti").isEmpty()
            colour = best
            if changed:
                break
        of = lambda k, c: colour.select(F.col("node").alias(k), F.col("c").alias(c))
        inside = left.join(of("src", "cs"), "src").join(of("dst", "cd"), "dst").where("cs = cd")
        back = cut(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        group = reachable(back, colour.where("node = c").select("node")).select("node")
        # a colour's own node reaches back only inside the colour, so each member's group is its colour
        members = cut(group.join(colour, "node").select("node", F.col("c").alias("group")))
        found = found.unionByName(members)
        gone = members.select("node")
        left = _trimmed(cut(left.join(gone, F.col("src") == gone["node"], "left_anti").join(gone, F.col("dst") == gone["node"], "left_anti")))
    return found.join(found.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "group").join(edges.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("own")).distinct(), "node", "left").where("n > 1 OR own").select("node", "group")


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle, by their groups."""
    return cycle_groups(edges).select("node")


def who_uses(edges: DataFrame, nodes: DataFrame, include_tests: bool = False) -> DataFrame:
    """Edges with their target; those from tests go, those from unknown sources stay."""
    if include_tests:
        return edges
    flags = nodes.select(F.col("fqn").alias("source"), "is_test")
    return edges.join(flags, "source", "left").where(~F.coalesce("is_test", F.lit(False))).drop("is_test")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("fqn")).union(edges.select(F.col("target").alias("fqn"))).distinct()
    return nodes.join(ends, "fqn", "left_anti")


def test_only(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that tests use and nothing else does."""
    users = edges.join(nodes.select(F.col("fqn").alias("source"), "is_test"), "source")
    return users.groupBy("target").agg(F.bool_and("is_test").alias("only")).where("only").select(F.col("target").alias("fqn"))


def chains(edges: DataFrame, starts: DataFrame, max_depth: int = 5) -> DataFrame:
    """Dependency chains (start, depth, path) from each node of `starts` (node): a path for every edge that leaves an expanded node.

    Breadth first: a node is expanded once, by the first path that reaches it, and not beyond `max_depth` edges. First
    is in the order of `position` along the path, so `edges` (source, target, relation, position) are as good as ordered.
    A path is an array of its edges; paths of one start never meet those of another.
    """
    edge = F.struct("source", "target", "relation", "position")
    steps = cut(edges.select(F.col("source").alias("from"), F.col("target").alias("to"), edge.alias("edge")))
    nothing = F.array().cast("array<struct<source:string,target:string,relation:string,position:bigint>>")
    front = cut(starts.select(F.col("node").alias("start"), "node", nothing.alias("path")).distinct())
    seen, found = front.select("start", "node"), None
    for depth in range(1, max_depth + 1):
        reached = cut(front.join(steps, F.col("node") == F.col("from")).select("start", F.col("to").alias("node"), F.concat("path", F.array("edge")).alias("path")))
        new = reached.select("start", F.lit(depth).alias("depth"), "path")
        found = new if found is None else found.unionByName(new)
        order = F.transform("path", lambda e: e["position"])
        front = cut(reached.join(seen, ["start", "node"], "left_anti").groupBy("start", "node").agg(F.min_by("path", order).alias("path")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("start", "node"))
    return found


def cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """(nodes): every elementary cycle of the edges (src, dst) once, as its nodes in order from the least one, which also ends it.

    Only edges inside a group of `cycle_groups` are walked. Paths are rows that grow by a join, over nodes greater than
    their first one only, so no cycle is met twice and a large group is spread over all tasks. A dense group has a
    number of cycles that is exponential in its size; `max_length` then bounds the nodes of a cycle.
    """
    groups = cut(cycle_groups(edges))
    of = lambda k, g: groups.select(F.col("node").alias(k), F.col("group").alias(g))
    inside = cut(edges.select("src", "dst").distinct().join(of("src", "gs"), "src").join(of("dst", "gd"), "dst").where("gs = gd").select("src", "dst"))
    found = inside.where("src = dst").select(F.array("src", "dst").alias("nodes"))
    steps = inside.where("src <> dst")
    paths, length = steps.where("dst > src").select(F.array("src", "dst").alias("nodes")), 2
    while max_length is None or length <= max_length:
        last = paths.withColumn("first", F.element_at("nodes", 1)).withColumn("last", F.element_at("nodes", -1))
        grown = cut(last.join(steps, F.col("last") == F.col("src")).where((F.col("dst") == F.col("first")) | ((F.col("dst") > F.col("first")) & ~F.array_contains("nodes", F.col("dst")))))
        whole = F.concat("nodes", F.array("dst"))
        found = found.unionByName(grown.where("dst = first").select(whole.alias("nodes")))
        paths, length = grown.where("dst <> first").select(whole.alias("nodes")), length + 1
        if paths.isEmpty():
            break
    return found
