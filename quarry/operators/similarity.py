"""Similarity operators: token blocks, edit distance, vectors, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import is_affix_swap, package_name


def co_write_candidates(writes: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of fields written together at `least` sites or more, and apart at one or more."""
    sites = writes.select("field", "site").distinct()
    counts = sites.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    pairs = sites.alias("a").join(sites.alias("b"), (F.col("a.site") == F.col("b.site")) & (F.col("a.field") < F.col("b.field")))
    common = pairs.groupBy(F.col("a.field").alias("field_a"), F.col("b.field").alias("field_b")).agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= least)
    a, b = counts.select(F.col("field").alias("field_a"), F.col("n").alias("n_a")), counts.select(F.col("field").alias("field_b"), F.col("n").alias("n_b"))
    joined = common.join(a, "field_a").join(b, "field_b")
    return joined.withColumn("apart", F.col("n_a") + F.col("n_b") - 2 * F.col("common")).where("apart > 0").drop("n_a", "n_b")


def typosquats(deps: DataFrame, popular: DataFrame, most: int = 2) -> DataFrame:
    """The popular name that each dependency looks like: by edit distance (1 critical, 2 high), else by affix (medium).

    `popular` (name) is a dimension of known size. Candidates meet by length first; exact names are no match; of several the
    closest, then the first by name, is taken.
    """
    d = deps.withColumn("norm", package_name(F.col("name")))
    known = popular.select(package_name(F.col("name")).alias("popular")).distinct()
    exact = d.join(known, d["norm"] == known["popular"], "left_anti")
    lengths = known.withColumn("len", F.explode(F.sequence(F.length("popular") - most, F.length("popular") + most)))
    near = exact.join(lengths, F.length("norm") == F.col("len")).withColumn("distance", F.levenshtein("norm", "popular", most)).where("distance >= 1").select("pos", "norm", "popular", "distance", F.when(F.col("distance") == 1, "critical").otherwise("high").alias("severity"))
    swap = exact.join(known, is_affix_swap(F.col("norm"), F.col("popular"))).select("pos", "norm", "popular", F.lit(99).alias("distance"), F.lit("medium").alias("severity"))
    best = Window.partitionBy("pos").orderBy("distance", "popular")
    return near.unionByName(swap).withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Scores that a task works out at once.
SCORES = 1 << 18


def _nearest(block, n: int, kinds: list):
    """(id, label, embedding) to the n best of this task for each query of the block."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, rows = block.value
        unit = rows / np.sqrt((rows * rows).sum(1, keepdims=True))
        best = None  # columns query, id, label, score
        floor = np.full((len(ids), 1), -np.inf)  # each query's n-th best score so far
        step = max(1, SCORES // len(ids))
        for batch in (b.slice(at, step) for b in batches for at in range(0, len(b), step)):
            v = np.array([x.as_py() for x in batch.column(2)], np.float64)
            score = np.round(unit @ (v / np.sqrt((v * v).sum(1, keepdims=True))).T, 6)
            own, label = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            q, at = np.nonzero(~(score < floor))
            found = [q, own[at], label[at], score[q, at]]
            if best is not None:
                found = [np.concatenate(x) for x in zip(best, found)]
            order = np.lexsort((found[1], -found[3], found[0]))
            found = [x[order] for x in found]
            first = np.searchsorted(found[0], found[0])
            keep = np.arange(len(order)) - first < n
            best = [x[keep] for x in found]
            last = np.flatnonzero(np.r_[best[0][1:] != best[0][:-1], True])
            full = last[np.diff(np.r_[-1, last]) == n]
            floor[best[0][full], 0] = np.nan_to_num(best[3][full], nan=-np.inf)
        if best is not None:
            columns = [np.asarray(ids)[best[0]], *best[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["query", "id", "label", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, n: int, where: Column | None = None, least: float | None = None, id_col: str = "vec_id", block: int = 1024) -> DataFrame:
    """The n nearest rows by cosine of every query: query, id, label, score, rank.

    `queries` has id and embedding. They go in blocks of `block` vectors, each broadcast on its own; a task keeps the n
    best of each query, so at most tasks x block x n rows are shuffled for the ranks. `least` filters after ranks are given.
    Vectors of length zero have no score and come last.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    rows = (vectors.where(where) if where is not None else vectors).select(F.col(id_col).cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    wanted = queries.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    total = wanted.count()
    parts = max(1, -(-total // block))
    number = F.pmod(F.xxhash64("id"), F.lit(parts))
    found = None
    for k in range(parts):  # a block is about `block` vectors, whatever the input's size
        some = wanted.where(number == k).orderBy("id").collect()
        if not some:
            continue
        sent = spark.sparkContext.broadcast(([r["id"] for r in some], np.array([r["embedding"] for r in some])))
        part = rows.mapInArrow(_nearest(sent, n, [pa.int64(), pa.int64(), pa.int64(), pa.float64()]), "query long, id long, label long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query long, id long, label long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= n)
    return ranked.where(F.col("score") >= least) if least is not None else ranked


def within_budget(chunks: DataFrame, budget: int, most: int, group: str, order: list[Column], size: Column) -> DataFrame:
    """Leading rows of each group while their sizes sum to `budget` or less, `most` at most."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("used", F.sum(size).over(w)).withColumn("n", F.count(F.lit(1)).over(w)).where((F.col("used") <= budget) & (F.col("n") <= most))


def repeated_lines(lines: DataFrame, least: int = 20) -> DataFrame:
    """Repeats of an identical long line in a file, with its first occurrence."""
    t = F.trim("text")
    rows = lines.where((F.length(t) > least) & ~F.startswith(t, F.lit("#"))).withColumn("t", t)
    first = rows.withColumn("first_line", F.min("line").over(Window.partitionBy("path", "t")))
    return first.where("line > first_line").select("path", "line", "first_line")


def common_length(marks: dict[str, int], n: int, other: str) -> int:
    """The length of the longest common subsequence of `other` and a text of n characters, whose places `marks` has as bits."""
    whole = (1 << n) - 1
    left = whole
    for c in other:
        met = left & marks.get(c, 0)
        left = ((left + met) | (left - met)) & whole
    return n - left.bit_count()


def similar_lines(texts: list[str], least: float) -> set[tuple[int, int]]:
    """Ordered pairs of places in `texts` (all different) whose sequence ratio is `least` or more.

    Two texts share no more characters than both have of each, and no more in order than their longest common
    subsequence has; both bound the ratio, so these filters lose no pair, and only what passes is compared.
    """
    from difflib import SequenceMatcher

    import numpy as np

    size = np.array([len(t) for t in texts])
    counts = np.zeros((len(texts), 64), np.int32)
    for i, t in enumerate(texts):
        np.add.at(counts[i], np.fromiter((ord(c) % 64 for c in t), np.int64, len(t)), 1)
    found = {(i, i) for i in range(len(texts))}
    for i, t in enumerate(texts):
        most = np.minimum(counts[i], counts[i + 1 :]).sum(1)
        marks: dict[str, int] = {}
        for k, c in enumerate(t):
            marks[c] = marks.get(c, 0) | 1 << k
        for j in (np.flatnonzero(2.0 * most >= least * (size[i] + size[i + 1 :])) + i + 1).tolist():
            if 2.0 * common_length(marks, len(t), texts[j]) < least * (len(t) + len(texts[j])):
                continue
            for a, b in ((i, j), (j, i)):
                if SequenceMatcher(None, texts[a], texts[b]).ratio() >= least:
                    found.add((a, b))
    return found


def blocks_of(content: str | None, lines: int, least: float) -> list[tuple[int, int, int]]:
    """(first line, first line of its repeat, lines) of every repeated block of one text, numbered from 1."""
    import numpy as np

    rows = [t.strip() for t in (content or "").split("\n")]
    number: dict[str, int] = {}
    place = np.array([number.setdefault(t, len(number)) if t and not t.startswith(("#", "//")) else -1 for t in rows])
    if not number:
        return []
    names = len(number)
    codes = np.array(sorted(a * names + b for a, b in similar_lines(list(number), least)))
    out = []
    for apart in range(lines, len(rows)):
        a, b = place[:-apart], place[apart:]
        code = a * names + b
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        same = (a >= 0) & (b >= 0) & (codes[at] == code)
        if same.any():
            edges = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
            for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
                # a block ends where its repeat begins; what is left of the run is a block of its own
                out += [(k + 1, k + apart + 1, min(apart, end - k)) for k in range(start, end, apart) if min(apart, end - k) >= lines]
    return sorted(out)


def line_blocks(files: DataFrame, lines: int = 3, least: float = 0.8) -> DataFrame:
    """Blocks of `lines` or more consecutive similar lines at two places of a file: path, a, b (first lines), n.

    Every pair of places counts. Lines are similar if their sequence ratio is `least` or more, without the white space
    around them; blank and comment lines are similar to none. Work grows with the square of a file's lines; a file's
    content is one value, so it is read in one task whatever is done with it.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(path, *x) for path, content in zip(batch.column(0).to_pylist(), batch.column(1)) for x in blocks_of(content.as_py(), lines, least)]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32()))], names=["path", "a", "b", "n"])

    return files.select("path", "content").mapInArrow(run, "path string, a int, b int, n int")
