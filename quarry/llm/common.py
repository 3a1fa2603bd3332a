"""Shared plumbing of the training-data operators: durable intermediates and distributed ranks."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, [\x20\x09-\x0D]; bytes.split() without arguments splits on exactly these.
WHITE = " \t\n\x0b\x0c\r"
#: The session's bound on the bytes of an Arrow batch, and its value where the session names none.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 21
#: So many tasks' narrow rows are written to one file.
TASKS_A_FILE = 8


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where the session names none, a temporary one will do for executors inside this process only.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark send Python workers about BATCH_BYTES of rows at once, unless the session sets a bound of its own.

    All rows are sent. A worker keeps what its largest batch took, so the default of 64 MB, or 10,000 rows, stays with
    every worker for as long as the executor runs.
    """
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """`name` with as many underscores before it as no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class Stored:
    """A DataFrame written once to the shared folder, so that lineage ends and lost executors cost nothing."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    return Stored(df, tag).df


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gathered(df: DataFrame) -> DataFrame:
    """All rows of a narrow table, in fewer partitions, to be written as fewer files.

    Without Hadoop's native library each file on a local file system starts processes (chmod), which hold the
    executor's memory a second time until they run their own program.
    """
    return df.repartition(max(1, shuffle_partitions(df.sparkSession) // TASKS_A_FILE))


def running_offset(df: DataFrame, group: list[str], sub: Column, order: list[Column], n_sub: int, weight: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `weight` over the rows before this one in its group, as a long.

    A group is cut into `n_sub` parts by `sub` (an integer from 0), so no task holds a whole group:
    part totals are summed into part offsets (one small row a part), rows are only ordered within a part.
    """
    part = df.withColumn("__sub", sub.cast("int")).withColumn("__w", weight.cast("long"))
    totals = part.groupBy(*group, "__sub").agg(F.sum("__w").alias("__t"))
    before = Window.partitionBy(*group).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__sub").alias("__s"), F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    inner = Window.partitionBy(*group, "__sub").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = part.withColumn("__r", F.coalesce(F.sum("__w").over(inner), F.lit(0)))
    match = [ranked[g].eqNullSafe(offsets[f"__g_{g}"]) for g in group] + [ranked["__sub"] == offsets["__s"]]
    joined = ranked.join(offsets, match)
    return joined.withColumn(out, F.col("__o") + F.col("__r")).drop("__sub", "__w", "__r", "__o", "__s", *[f"__g_{g}" for g in group])
