"""Substring de-duplication by sparse suffix arrays.

Suffixes are kept at the windows' minimisers only. In a bucket of suffixes that begin with the same
minimiser, the words to the right are sorted and neighbours compared, and so are the words to the left, read
backwards; the lengths that neighbours have in common extend each match in both directions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import passages
from quarry.llm.common import read_table

#: Strings that one pass of the kernel takes, about: whole buckets.
BATCH = 256


def neighbours(bucket: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by bucket and words, and how many leading words each has in common with the one before."""
    order = np.lexsort([*words.T[::-1], bucket])
    same = words[order[1:]] == words[order[:-1]]
    common = np.where(same.all(1), words.shape[1], same.argmin(1))
    common[bucket[order[1:]] != bucket[order[:-1]]] = -1
    return order, np.r_[-1, common]


def classes(order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """Numbers that are equal for rows of one bucket whose first `length` words are equal."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < length)
    return out


def solve(cores: list[int], spans: list[bytes], docs: list[int], minis: list[int], strings: list[bytes], k: int, m: int):
    """Columns (cls, off, len, keeper) of whole buckets."""
    ids: dict[bytes, int] = {}
    split = [s.split() for s in strings]
    size = np.array([len(s) for s in split])
    base = np.cumsum(size) - size
    flat = np.fromiter((ids.setdefault(w, len(ids)) for s in split for w in s), np.int32, int(size.sum()))
    data = np.frombuffer(b" ".join(strings), np.uint8)
    lengths = np.array([len(s) for s in strings]) + 1
    hashes, first = passages.word_hashes(data, np.r_[0, np.cumsum(lengths)[:-1], len(data)])
    grams = passages.gram_hashes(hashes, m)
    row_of = np.repeat(np.arange(len(strings)), size)
    mini = np.array(minis, np.int64)
    anchor = np.flatnonzero(grams.view(np.int64) == mini[row_of[: len(grams)]])
    row = row_of[anchor]
    place = anchor - base[row]
    inside = place + m <= size[row]
    anchor, row, place = anchor[inside], row[inside], place[inside]
    reach = k - m  # words that a window can have before its minimiser
    pad = np.r_[flat, np.full(k, -1, np.int32)]
    ahead = np.arange(k, dtype=np.int32)
    right = np.where(place[:, None] + ahead < size[row][:, None], pad[anchor[:, None] + ahead], -1 - ahead)
    back = np.arange(1, reach + 1)
    left = np.where(place[:, None] >= back, pad[anchor[:, None] - back], np.int32(-1))
    bucket = np.unique(np.array(cores, np.int64)[row], return_inverse=True)[1]
    by_right, common_right = neighbours(bucket, right)
    by_left, common_left = neighbours(bucket, left)
    owner = np.array(docs, np.int64)[row]
    got_row, got_at, got_keep = [], [], []
    for o in range(reach + 1):
        fits = np.flatnonzero((place >= o) & (place - o + k <= size[row]))
        if not len(fits):
            continue
        key = classes(by_left, common_left, o)[fits] * (len(row) + 1) + classes(by_right, common_right, k - o)[fits]
        _, at = np.unique(key, return_inverse=True)
        least = np.full(at.max() + 1, passages.NO_ID)
        np.minimum.at(least, at, owner[fits])
        got_row.append(row[fits])
        got_at.append(place[fits] - o)
        got_keep.append(least[at])
    if not got_row:
        return
    r, a, g = (np.concatenate(x) for x in (got_row, got_at, got_keep))
    order = np.lexsort((g, a, r))
    r, a, g = r[order], a[order], g[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (a[1:] != a[:-1])]
    r, a, g = r[new], a[new], g[new]
    edge = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (a[1:] != a[:-1] + 1) | (g[1:] != g[:-1])])
    count = np.diff(np.r_[edge, len(r)])
    return [spans[i] for i in r[edge].tolist()], a[edge].astype(np.int32), count.astype(np.int32), g[edge]


def buckets(k: int, m: int):
    """The kernel of `passages.repeated`: whole buckets, some at a time."""

    def run(batches):
        held: tuple[list, ...] = ([], [], [], [], [])

        def out():
            found = solve(*held, k, m)
            for x in held:
                x.clear()
            if found is not None:
                yield passages.rows_of(passages.RUNS, found)

        for batch in batches:
            cores, docs, minis = (np.asarray(batch.column(i)).tolist() for i in (0, 3, 4))
            classes, texts = batch.column(1), batch.column(5)
            for i, core in enumerate(cores):
                if len(held[0]) >= BATCH and core != held[0][-1]:
                    yield from out()
                for x, y in zip(held, (core, classes[i].as_py(), docs[i], minis[i], texts[i].as_py())):
                    x.append(y)
        if held[0]:
            yield from out()

    return run


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words without those of windows that a smaller doc_id has; for edge cases see `passages`."""
    docs = read_table(spark, sf_dir, "documents")
    return passages.digests(docs, passages.repeated(docs, buckets))


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = passages.K) -> DataFrame:
    """`docs` with repeated passages cut out everywhere but in the smallest id, and its own columns only.

    Null and empty texts, those under `k` words, and rows of null ids among themselves stay as they are; repeated rows
    of one id lose the same words; an empty table stays empty; columns of any other name are kept.
    """
    return passages.without(docs, passages.repeated(docs, buckets, id_col=id_col, text_col=text_col, k=k), id_col=id_col, text_col=text_col)
