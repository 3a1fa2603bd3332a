"""SimHash near-duplicates: 64-bit fingerprints, bit-sliced distances, components of links.

Distinct fingerprints are the unit of all later work, so copies cost one row. Six blocks of bits give twenty
tables, each keyed by three blocks: two fingerprints within 3 bits agree on at least one key. Fingerprints
that share a key are compared in bit planes with carry-save counters, and a block of comparisons is left
as soon as all its counters pass the radius. A key with very many fingerprints is keyed again on its other
bits by the same rule before it is dealt out, so no task has to hold or compare a whole hot group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Stored, read_table, release
from quarry.llm.components import components

SEED, RADIUS = 42, 3
#: (first bit, number of bits) of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: A key with more distinct fingerprints than this is keyed again.
HOT = 2048
#: Runs up to this size are compared pair by pair, longer ones query against planes.
SMALL = 48
PAIRS = 1 << 18
ABC = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a whole text: bit set where over half of the shingles' hashes set it."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(ABC).split()
    if not words:
        return 0
    if len(words) < 3:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    return majority(np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in zip(start[:-2].tolist(), end[2:].tolist())], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the unsigned hashes set."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    import pyarrow as pa

    for batch in batches:
        texts = batch.column(1)
        fps = np.fromiter((fingerprint(texts[i].as_py()) for i in range(len(texts))), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: row b holds bit b of all values."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def within(differing, shape, radius: int = RADIUS) -> np.ndarray:
    """Packed flags of the lanes whose differing planes sum to `radius` (3) or less.

    Carry-save counters: ones and twos count to 3, `over` holds lanes that passed it. The block is left
    once all lanes are over.
    """
    ones, twos, over = (np.zeros(shape, np.uint8) for _ in range(3))
    for b in range(64):
        d = differing(b)
        carry = ones & d
        ones ^= d
        over |= twos & carry
        twos ^= carry
        if b % 8 == 7 and over.min() == 255:
            break
    if radius < 3:
        over |= twos if radius < 2 else twos & ones
        if radius < 1:
            over |= ones
    return ~over


def _links(values: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked values, among values of the same run (runs are contiguous)."""
    edges = np.flatnonzero(np.r_[True, run[1:] != run[:-1], True])
    starts, sizes = edges[:-1], np.diff(edges)
    left, right = [], []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size]
        step = max(1, PAIRS // len(i))
        for k in range(0, len(at), step):
            a = (at[k : k + step, None] + i).ravel()
            b = (at[k : k + step, None] + j).ravel()
            apart = planes(values[a] ^ values[b])
            hit = np.flatnonzero(np.unpackbits(within(lambda p: apart[p], apart.shape[1:], radius), bitorder="little")[: len(a)])
            left.append(a[hit])
            right.append(b[hit])
    for at, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        mine = values[at : at + size]
        sliced = planes(mine)
        step = max(1, (PAIRS * 8) // size)
        for k in range(0, size, step):
            query = mine[k : k + step]
            tail = k // 8  # earlier values have met these queries already
            flip = np.where(np.unpackbits(query.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool), np.uint8(255), np.uint8(0))
            near = within(lambda p: sliced[p, tail:] ^ flip[:, p, None], (len(query), sliced.shape[1] - tail), radius)
            q, m = np.nonzero(np.unpackbits(near, axis=1, bitorder="little")[:, : size - tail * 8])
            m = m + tail * 8
            q = q + k
            keep = q < m
            left.append(at + q[keep])
            right.append(at + m[keep])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links: every member with its smallest member."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[other]], nodes[other]


def _keys(fps: np.ndarray, spread: bool) -> np.ndarray:
    """A column of keys for each choice of three of six blocks of bits; `spread` takes every sixth bit."""
    if spread:
        bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        order = [b for k in range(6) for b in range(k, 64, 6)]
        fps = np.ascontiguousarray(np.packbits(bits[:, order], axis=1, bitorder="little")).view("<u8").ravel()
    out = []
    for t, chosen in enumerate(combinations(range(len(BLOCKS)), 3)):
        key = np.full(len(fps), t, np.uint64)
        for k in chosen:
            at, n = BLOCKS[k]
            key = (key << np.uint64(n)) | ((fps >> np.uint64(at)) & np.uint64((1 << n) - 1))
        out.append(key)
    return np.stack(out, 1).view(np.int64)


def _keyed(batches):
    """fp -> (k1, 0, fp), twenty rows each."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, len(batch), 4096):
            fps = np.asarray(batch.column(0))[at : at + 4096]
            keys = _keys(fps.view(np.uint64), False)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.zeros(keys.size, np.int64)), pa.array(np.repeat(fps, keys.shape[1]))], names=["k1", "k2", "fp"])


def _keyed_again(batches):
    """(k1, fp) -> (k1, k2, fp), twenty rows each, from blocks that lie otherwise."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, len(batch), 4096):
            k1, fps = (np.asarray(batch.column(c))[at : at + 4096] for c in (0, 1))
            keys = _keys(fps.view(np.uint64), True)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k1, keys.shape[1])), pa.array(keys.ravel()), pa.array(np.repeat(fps, keys.shape[1]))], names=["k1", "k2", "fp"])


def _compare(radius: int, most: int | None):
    """Sorted rows (k1, k2, fp) to links (a, b, false); a key with over `most` rows gives (k1, fp, true) instead."""

    def batch_of(a, b, hot):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])

    def solve(k1, k2, fps):
        run = np.cumsum(np.r_[False, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        i, j = _links(fps.view(np.uint64), run, radius)
        return batch_of(*(forest(fps[i], fps[j]) if len(i) else (fps[:0], fps[:0])), False)

    def run(batches):
        held = None  # the last key's rows: it may go on in the next batch
        passing = None  # a hot key whose rows go straight out
        for batch in batches:
            cols = [np.asarray(batch.column(c)) for c in range(3)]
            if passing is not None:
                n = int(np.argmin(np.r_[(cols[0] == passing[0]) & (cols[1] == passing[1]), False]))
                if n:
                    yield batch_of(cols[0][:n], cols[2][:n], True)
                    cols = [c[n:] for c in cols]
                if len(cols[0]):
                    passing = None
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            edges = np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]), True])
            if most is not None:
                hot = np.repeat(np.diff(edges) > most, np.diff(edges))
                if hot.any():
                    yield batch_of(cols[0][hot], cols[2][hot], True)
                    if hot[-1]:
                        passing = (cols[0][-1], cols[1][-1])
                    cols = [c[~hot] for c in cols]
                    edges = np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]), True])
                    if not len(cols[0]):
                        held = None
                        continue
            cut = len(cols[0]) if passing is not None else int(edges[-2])
            held = [c[cut:] for c in cols] if cut < len(cols[0]) else None
            if cut:
                yield solve(*(c[:cut] for c in cols))
        if held is not None:
            yield solve(*held)

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct longs of `fp`, as stars that hold each group together.

    A key of both levels fixes at least 46 of the 64 bits, so no group that is compared whole has more than 2^18 of them.
    Any two fingerprints within `radius` (at most 3) bits end in one component of the links;
    the pairs themselves are not all listed.
    """
    schema = "a long, b long, hot boolean"

    def dealt(keyed, most):
        return keyed.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(_compare(radius, most), schema)

    first = Stored(dealt(fps.select("fp").mapInArrow(_keyed, "k1 long, k2 long, fp long"), HOT), "links").df
    again = first.where("hot").select(F.col("a").alias("k1"), F.col("b").alias("fp")).mapInArrow(_keyed_again, "k1 long, k2 long, fp long")
    return first.where("not hot").select("a", "b").unionByName(dealt(again, None).select("a", "b"))


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Every row's fingerprint and component: doc_id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased (A-Z only) and cut into words at ASCII white space; shingles are three words,
    or the whole sequence where there are fewer. Null and wordless texts have fingerprint zero and link
    like any other. component_id is the smallest id reachable by links of `radius` bits or fewer
    (null only if every id there is null). Repeated rows share all values; other columns are ignored.
    """
    spark = docs.sparkSession
    marked = Stored(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints").df
    distinct = Stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct").df
    label = components(links(distinct, radius))
    release(spark)
    named = distinct.join(label, distinct["fp"] == label["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    heads = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = named.join(heads, "label").select(F.col("fp").alias("f"), "component_id")
    return marked.join(of_fp, marked["fp"] == of_fp["f"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; for nulls, ties and repeats see `near_groups`."""
    return near_groups(read_table(spark, sf_dir, "documents"))
