"""Exact de-duplication by content sort.

Sampled splitters range-partition the rows by a bounded prefix of the normalised text, its hash, and
then the order of preference inside a group, so copies meet but a huge group still spreads over tasks.
Each partition is sorted (Spark's external sort), neighbours are compared in full, and runs that touch
a partition's edge are joined across partitions by their digest: at most a few rows a partition.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import WHITE, bounded_batches, free_name, gathered, read_table, stored

RUNS = "row_id long, text_sha256 string, n long, best_len long, best_id long, pid int, first boolean, edge boolean"
OUT_ROWS = 4096


def normalised(text: Column) -> Column:
    """The text without ASCII white space. replace() works on bytes; translate() makes an object of every character."""
    valid = F.make_valid_utf8(F.coalesce(text, F.lit("")))
    return reduce(lambda left, white: F.replace(left, F.lit(white), F.lit("")), WHITE, valid)


def _runs(batches):
    """Sorted rows (h, norm, row_id, neg_len) to rows of RUNS; holds one hash's ids at a time."""
    import pyarrow as pa
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    schema = pa.schema([("row_id", pa.int64()), ("text_sha256", pa.string()), ("n", pa.int64()), ("best_len", pa.int64()), ("best_id", pa.int64()), ("pid", pa.int32()), ("first", pa.bool_()), ("edge", pa.bool_())])
    out: list[tuple] = []
    first_h = cur_h = norm = None
    group: list[list] = []  # runs of one hash: [digest, best_len, ids]

    def flush(last: bool):
        edge = last or cur_h == first_h
        for digest, best_len, ids in group:
            n, best = len(ids), ids[0]
            out.extend((x, digest, n, best_len, best, pid, i == 0, edge) for i, x in enumerate(ids))
        group.clear()

    def emit():
        table = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(table, schema)], schema=schema)

    for batch in batches:
        hs, norms, ids, lens = (batch.column(batch.schema.get_field_index(c)) for c in ("h", "norm", "row_id", "neg_len"))
        hs, ids, lens = hs.to_pylist(), ids.to_pylist(), lens.to_pylist()
        for i, h in enumerate(hs):
            text = norms[i].as_py()
            if h != cur_h:
                if group:
                    flush(False)
                    if len(out) >= OUT_ROWS:
                        yield emit()
                if first_h is None:
                    first_h = h
                cur_h, norm = h, None
            if text != norm:
                norm = text
                group.append([hashlib.sha256(text.encode()).hexdigest(), -lens[i], []])
            group[-1][2].append(ids[i])
    if group:
        flush(True)
    if out:
        yield emit()


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as empty. The row with most code
    points in its original text, then the smallest id, stays (a null id comes last). Of rows that repeat
    both, exactly one has kept = true. An empty table gives an empty result, other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), (-F.length(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("neg_len"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("prefix", F.substring("norm", 1, 16)).withColumn("h", F.xxhash64("norm"))
    order = [F.col("neg_len"), F.col("row_id").asc_nulls_last()]
    dealt = rows.repartitionByRange("prefix", "h", *order).sortWithinPartitions("prefix", "h", "norm", *order)
    found = dealt.select("h", "norm", "row_id", "neg_len").mapInArrow(_runs, RUNS)
    runs = stored(gathered(found), "exact-runs")  # some hundred bytes for a text
    ends = runs.where("edge and first").groupBy("text_sha256").agg(F.sum("n").alias("all_n"), F.min(F.struct((-F.col("best_len")).alias("l"), F.col("best_id").isNull().alias("z"), F.col("best_id").alias("id"), F.col("pid").alias("p"))).alias("top"))
    # only rows of runs at a partition's edge meet their run's other parts; all others are whole as they are.
    # Broadcast, for there are about two runs a partition, and all rows then pass in one scan
    ends = F.broadcast(ends.withColumnRenamed("text_sha256", "of"))
    joined = runs.join(ends, F.col("edge") & (F.col("text_sha256") == F.col("of")), "left")
    whole = lambda at_edge, inside: F.when(F.col("edge"), at_edge).otherwise(F.col(inside))
    return joined.select(F.col("row_id").alias("doc_id"), whole(F.col("top.id"), "best_id").alias("keep_id"), whole(F.col("all_n"), "n").alias("group_size"), whole(F.col("first") & (F.col("top.p") == F.col("pid")), "first").alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one of each group, with the columns they came with, whatever their names.

    Null and empty texts are one group; ids that are null come last; of rows that repeat id and text one stays;
    very long texts are compared whole; an empty table stays empty.
    """
    keep_id, sha, nth = (free_name(docs, n) for n in ("keep", "sha", "n"))
    keep = exact_groups(docs, id_col=id_col, text_col=text_col).where("kept").select(F.col("doc_id").alias(keep_id), F.col("text_sha256").alias("of"))
    tagged = docs.withColumn(sha, F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256))
    found = tagged.join(keep, tagged[id_col].cast("long").eqNullSafe(keep[keep_id]) & (tagged[sha] == keep["of"]), "left_semi")
    # rows that repeat an id and a normalised text: the longest original stays
    first = Window.partitionBy(id_col, sha).orderBy(F.length(F.coalesce(F.col(text_col), F.lit(""))).desc(), F.col(text_col))
    return found.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*docs.columns)


def op8_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts; for nulls, ties and repeats see `exact_groups`."""
    bounded_batches(spark)
    return exact_groups(read_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
