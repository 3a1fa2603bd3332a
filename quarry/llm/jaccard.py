"""Near copies: SimHash links over five-word shingles, completed to every pair of 0.8 Jaccard similarity.

Texts with the same lower-cased words are one unit. Fingerprints of a unit's shingles are linked by the SimHash
operator (bit planes, carry-save counters); each of its links is checked against the shingles themselves. Links within
three bits are those of about 0.95 and more, so a join by prefixes adds the rest: a unit's shingles are ordered from
rare to common, any two units of 0.8 or more share one among the first fifth of each, so units meet by those alone and
no pair is lost. A meeting first compares neighbours; then all its pairs that the links so far leave in different components.

Before the shingles of a pair travel, counts of them by the hash's first bits say how many two units can share at most.
Counts from a part of the units say which shingles are common: they change the work, not the pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Stored, free_name, gathered, release
from quarry.llm.components import components
from quarry.llm.passages import NO_ID, rows_of
from quarry.llm.simhash import SEED, links as simhash_links, majority

SHINGLE = 5
#: One unit in so many has its shingles counted (all, where there are few units); the most counts that are kept.
SAMPLE, FEW, COMMON = 16, 4096, 1 << 17
#: The most counts of one sketch.
COUNTS = 4096
#: Pairs that a task holds before it writes them.
PAIRS = 1 << 18
#: Texts whose shingles a task holds at once.
SLICE = 512
#: Places along a meeting that count as neighbours, and the units of a block of a large meeting.
REACH, BLOCK = 16, 4096
SKETCHES = "u long, n int, fp long, counts binary"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) words, cut at ASCII white space, with single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+", " "))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `words_of`; shorter texts are one shingle, wordless ones none."""
    from xxhash import xxh64_intdigest

    joined = text.encode("utf-8", "surrogatepass")
    words = joined.split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(SHINGLE, len(words))
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.r_[0, end[:-1] + 1]
    return np.unique(np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist())], dtype=np.uint64))


def near(n: np.ndarray, m: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles with `common` in both (or at most) reach 0.8."""
    return 9 * common >= 4 * (n + m)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Counts of the hashes by their first bits, two hashes a count on average at most; 255 stands for any more."""
    bits = min(max(0, (len(hashes) - 1).bit_length() - 1), COUNTS.bit_length() - 1)
    place = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    return np.minimum(np.bincount(place, minlength=1 << bits), 255).astype(np.uint8)


def most_common(a: np.ndarray, b: np.ndarray) -> int | None:
    """The most hashes that two sketched sets can share; None if a count does not say."""
    if a.max() == 255 or b.max() == 255:
        return None
    a, b = (x.astype(np.int64).reshape(min(len(a), len(b)), -1).sum(1) for x in (a, b))
    return int(np.minimum(a, b).sum())


def _slices(batches):
    """The batches in parts of at most SLICE rows."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


def _sketches(batches):
    """(u, words) -> (u, n, fp, counts); wordless units have no row."""
    for batch in _slices(batches):
        rows = []
        for u, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            h = shingles(t.as_py())
            if len(h):
                rows.append((u, len(h), int(np.uint64(majority(h)).view(np.int64)), sketch(h).tobytes()))
        if rows:
            yield rows_of(SKETCHES, zip(*rows))


def _possible(batches):
    """(a, b, n, m, x, y) -> the pairs (a, b) that can reach 0.8 by their sketches."""
    for batch in batches:
        a, b, n, m = (np.asarray(batch.column(i)) for i in range(4))
        keep = np.flatnonzero(near(n.astype(np.int64), m.astype(np.int64), np.minimum(n, m).astype(np.int64)))
        left, right = batch.column(4), batch.column(5)
        good = []
        for i in keep.tolist():
            most = most_common(np.frombuffer(left[i].as_py(), np.uint8), np.frombuffer(right[i].as_py(), np.uint8))
            if most is None or near(int(n[i]), int(m[i]), most):
                good.append(i)
        yield rows_of("a long, b long", (a[good], b[good]))


def _sets(batches):
    """(u, words) -> (u, shingles as bytes)."""
    import pyarrow as pa

    for batch in _slices(batches):
        out = [shingles(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["u", "shingles"])


def _hashes(batches):
    import pyarrow as pa

    for batch in _slices(batches):
        out = [shingles(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*out, np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])


def _prefixes(common: np.ndarray, counts: np.ndarray):
    """(u, words) -> (h, u, n, at): the first fifth of the n shingles, from rare to common."""

    def run(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            rows = []
            for u, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = shingles(t.as_py())
                n = len(h)
                if not n:
                    continue
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.argsort(np.where(common[at] == h, counts[at], 0), kind="stable")]
                p = n - (4 * n + 4) // 5 + 1
                rows.append((h[:p].view(np.int64), np.full(p, u, np.int64), np.full(p, n, np.int32), np.arange(p, dtype=np.int32)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["h", "u", "n", "at"])

    return run


def _runs(batches):
    """Whole runs of the first column, in blocks of columns; the last run of a batch may go on in the next."""
    held = []
    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        if not len(cols[0]):
            continue
        if held and held[-1][0][0] == cols[0][-1]:
            held.append(cols)
            continue
        cols = [np.concatenate(c) for c in zip(*held, cols)] if held else cols
        cut = int(np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])[-1])
        if cut:
            yield [c[:cut] for c in cols]
        held = [[c[cut:] for c in cols]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _met(batches):
    """The rows of sorted (h, n, u, at) whose h is one of several units; of a run only one row is held at a time."""
    import pyarrow as pa

    names = ["h", "n", "u", "at"]
    last, open_ = None, False  # the row before, and whether it still waits for another unit of its run

    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        if not len(cols[0]):
            continue
        if last is not None:
            cols = [np.r_[x, c].astype(c.dtype) for x, c in zip(last, cols)]
        h, u = cols[0], cols[2]
        new = np.r_[True, (h[1:] != h[:-1]) | (u[1:] != u[:-1])]
        waits = np.r_[open_ or last is None, np.ones(len(h) - 1, bool)]
        cols = [c[new] for c in cols]
        waits, h = waits[new], cols[0]
        same = np.r_[h[1:] == h[:-1], False]
        many = same | np.r_[False, same[:-1]]
        last, open_ = [c[-1:] for c in cols], not many[-1] and bool(waits[-1])
        keep = many & waits
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=names)


def _packed(batches):
    """(h, n) -> the columns as bytes, a row a batch."""
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(c).astype(np.int64).tobytes()], pa.binary()) for c in batch.columns], names=["h", "n"])


def _batch_of(pairs):
    import pyarrow as pa

    a, b = (np.concatenate(c) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else (a, b)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _neighbours(batches):
    """Sorted (h, n, u, at) -> pairs (a, b) that lie within REACH places of a run and may reach 0.8."""
    held = None
    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        before = len(held[0]) if held else 0
        if held:
            cols = [np.r_[x, c] for x, c in zip(held, cols)]
        h, n, u, at = cols
        found = []
        for step in range(1, min(REACH, len(h) - 1) + 1):
            i = np.arange(max(0, before - step), len(h) - step)
            j = i + step
            ok = (h[i] == h[j]) & (u[i] != u[j]) & near(n[i], n[j], np.minimum(n[i] - at[i], n[j] - at[j]))
            found.append((u[i[ok]], u[j[ok]]))
        held = [c[-REACH:] for c in cols]
        yield _batch_of(found)


def _cells(named: DataFrame) -> DataFrame:
    """(cell, side, n, u, at, label) of (h, n, u, at, label): runs as they are, large ones as blocks of BLOCK units that meet in pairs.

    A run of one label has nothing to compare and goes. A large run is ordered by label; two blocks meet only if they
    hold two labels and their sizes allow a similarity of 0.8. `side` tells the blocks of a cell apart; a block that
    meets itself has -1.
    """
    sizes = named.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("h", "size")
    rows = named.join(sizes, "h")
    small = rows.where(F.col("size") <= BLOCK).select(F.col("h").alias("cell"), F.lit(-1).alias("side"), "n", "u", "at", "label")
    place = F.row_number().over(Window.partitionBy("h").orderBy("label", "n", "u")) - 1  # sorted, not held: rows of a few numbers
    large = rows.where(F.col("size") > BLOCK).withColumn("block", F.floor(place / BLOCK).cast("int"))
    large = Stored(large.select("h", "block", "n", "u", "at", "label"), "blocks").df
    spans = large.groupBy("h", "block").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    other = spans.select("h", *[F.col(c).alias(f"{c}_") for c in ("block", "l0", "l1", "n0", "n1")])
    met = spans.join(other, "h").where("block <= block_ AND least(l0, l0_) < greatest(l1, l1_) AND 5 * cast(n1 as bigint) >= 4 * cast(n0_ as bigint) AND 5 * cast(n1_ as bigint) >= 4 * cast(n0 as bigint)")
    cell = F.xxhash64("h", "block", "block_").alias("cell")
    sides = met.select("h", cell, F.explode(F.when(F.col("block") == F.col("block_"), F.array(F.struct(F.col("block"), F.lit(-1).alias("side")))).otherwise(F.array(F.struct(F.col("block"), F.lit(0).alias("side")), F.struct(F.col("block_").alias("block"), F.lit(1).alias("side"))))).alias("s"))
    spread = large.join(sides.select("h", "cell", "s.block", "s.side"), ["h", "block"]).select("cell", "side", "n", "u", "at", "label")
    return small.unionByName(spread)


def _across(batches):
    """Sorted (cell, n, u, at, label, side) -> pairs (a, b) of a cell's different labels and sides that may reach 0.8."""
    for h, n, u, at, label, side in _runs(batches):
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[start, len(h)])
        end = np.repeat(start + size, size)
        i, step, held, found = np.arange(len(h)), 1, 0, []
        while True:
            i = i[i + step < end[i]]
            i = i[5 * n[i].astype(np.int64) >= 4 * n[i + step]]  # sizes rise along a cell
            if not len(i):
                break
            j = i + step
            ok = (label[i] != label[j]) & ((side[i] < 0) | (side[i] != side[j])) & near(n[i], n[j], np.minimum(n[i] - at[i], n[j] - at[j]))
            if ok.any():
                found.append((u[i[ok]], u[j[ok]]))
                held += int(ok.sum())
                if held > PAIRS:
                    yield _batch_of(found)
                    found, held = [], 0
            step += 1
        if found:
            yield _batch_of(found)


def _verify(batches):
    """Sorted (a, b, shingles), each a's own (b null) first, -> pairs (a, b) of 0.8 or more."""
    import pyarrow as pa

    now, own = None, None
    for batch in batches:
        left, right = [], []
        for a, b, s in zip(*(c.to_pylist() for c in batch.columns)):
            s = np.frombuffer(s, np.uint64)
            if b is None:
                now, own = a, s
            elif a == now and len(own) and near(len(own), len(s), min(len(own), len(s))):
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                if near(len(own), len(s), int((own[at] == s).sum())):
                    left.append(a)
                    right.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _links(units: DataFrame, sketches: DataFrame, pairs: DataFrame, tag: str) -> DataFrame:
    """Those of the pairs (a, b) that reach 0.8, by the shingles of their units."""
    spark = units.sparkSession
    of = lambda k, n, c: sketches.select(F.col("u").alias(k), F.col("n").alias(n), F.col("counts").alias(c))
    both = pairs.distinct().join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    possible = Stored(gathered(both.mapInArrow(_possible, "a long, b long")), f"{tag}-pairs")
    release(spark)
    # only the texts of units in such a pair travel, once
    wanted = possible.df.select(F.explode(F.array("a", "b")).alias("u")).distinct()
    texts = units.join(wanted, "u", "left_semi").dropDuplicates(["u"]).select("u", "words")
    sets = Stored(texts.mapInArrow(_sets, "u long, shingles binary"), f"{tag}-sets")
    release(spark)
    heads = sets.df.join(possible.df.select(F.col("a").alias("u")).distinct(), "u", "left_semi").select(F.col("u").alias("a"), F.lit(None).cast("long").alias("b"), "shingles")
    rest = possible.df.join(sets.df, F.col("b") == F.col("u")).select("a", "b", "shingles")
    found = Stored(gathered(heads.unionByName(rest).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first()).mapInArrow(_verify, "a long, b long")), f"{tag}-links")
    sets.drop()
    possible.drop()
    release(spark)
    return found.df


def _by_fingerprint(sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of units: of one fingerprint (each with the least unit), or of fingerprints that SimHash links."""
    heads = sketches.groupBy("fp").agg(F.min("u").alias("head"))
    same = sketches.join(heads, "fp").where("u <> head").select(F.col("u").alias("a"), F.col("head").alias("b"))
    of = lambda k, to: heads.select(F.col("fp").alias(k), F.col("head").alias(to))
    linked = simhash_links(heads.select("fp")).select(F.col("b").alias("p"), F.col("a").alias("q")).join(of("p", "a"), "p").join(of("q", "b"), "q").select("a", "b")
    return same.unionByName(linked)


def labels(units: DataFrame) -> DataFrame:
    """(node, label) for every unit (u, words) that is linked to another; label is the least of its component."""
    spark = units.sparkSession
    total = units.count()
    some = units.where(F.pmod("u", F.lit(min(SAMPLE, max(1, total // FEW)))) == 0)
    counted = some.select("words").mapInArrow(_hashes, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    top = counted.orderBy(F.desc("n"), "h").limit(COMMON).mapInArrow(_packed, "h binary, n binary").collect()  # at most COMMON pairs of numbers
    common, counts = np.frombuffer(b"".join(r["h"] for r in top), np.uint64), np.frombuffer(b"".join(r["n"] for r in top), np.int64)
    order = np.argsort(common)
    release(spark)
    prefixes = units.select("u", "words").mapInArrow(_prefixes(common[order], counts[order]), "h long, u long, n int, at int")
    columns = "h long, n int, u long, at int"
    dealt = prefixes.select("h", "n", "u", "at").repartition("h").sortWithinPartitions("h", "n", "u")
    met = Stored(dealt.mapInArrow(_met, columns), "met")
    release(spark)
    sketched = Stored(units.select("u", "words").mapInArrow(_sketches, SKETCHES).dropDuplicates(["u"]), "sketches")
    sketches = sketched.df
    near_by = met.df.repartition("h").sortWithinPartitions("h", "n", "u").mapInArrow(_neighbours, "a long, b long")
    first = _links(units, sketches, _by_fingerprint(sketches).unionByName(near_by), "near")
    label = components(first)
    release(spark)
    named = met.df.join(label, F.col("u") == label["node"], "left").select("h", "n", "u", "at", F.coalesce("label", "u").alias("label"))
    cells = _cells(Stored(named, "named").df).select("cell", "n", "u", "at", "label", "side")
    rest = cells.repartition("cell").sortWithinPartitions("cell", "n", "u").mapInArrow(_across, "a long, b long")
    second = _links(units, sketches, rest, "rest")
    met.drop()
    sketched.drop()
    return components(first.unionByName(second))


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each component of near copies, with the columns they came with.

    Texts are linked if the sets of their five-word shingles (the whole text where it has fewer words) have a Jaccard
    similarity of 0.8 or more, or their words are equal; null, empty and wordless texts are equal. The row with the
    least id stays (a null id counts as the greatest), then the one with the least hash of words, then the first by
    text. Rows of other components stay even if they repeat an id; of repeated rows one stays. Very long texts count
    whole, an empty table stays empty, columns of any other name are kept. Words and shingles are compared by 64-bit hashes.
    """
    unit, place, nth = (free_name(docs, n) for n in ("u", "place", "n"))
    words = words_of(F.col(text_col))
    tagged = docs.withColumn(unit, F.xxhash64(words)).withColumn(place, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)))
    units = docs.select(F.xxhash64(words).alias("u"), words.alias("words"))
    label = labels(units)
    least = tagged.groupBy(F.col(unit).alias("u")).agg(F.min(place).alias("least"))
    named = least.join(label, F.col("u") == label["node"], "left").select(F.coalesce("label", "u").alias("label"), F.struct("least", "u").alias("head"))
    heads = named.groupBy("label").agg(F.min("head").alias("head")).select(F.col("head.u").alias(unit), F.col("head.least").alias(place))
    kept = tagged.join(heads, [unit, place], "left_semi")
    return kept.withColumn(nth, F.row_number().over(Window.partitionBy(unit, place).orderBy(text_col))).where(F.col(nth) == 1).select(*docs.columns)
