"""Substring de-duplication by super-k-mer partitioning.

Consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket; there
all windows of all strings are sorted, equal ones lie together, and the smallest document keeps them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import passages
from quarry.llm.common import read_table


def keepers(strings: list[bytes], docs: list[int], k: int) -> list[list[int]]:
    """For each string (by ascending document), the first document of each of its windows."""
    windows, owner = [], []
    for s, packed in enumerate(strings):
        ends = [i for i, c in enumerate(packed) if c == 32] + [len(packed)]
        starts = [0, *(e + 1 for e in ends[:-1])]
        found = [packed[a:b] for a, b in zip(starts, ends[k - 1 :])]
        windows += found
        owner += [s] * len(found)
    out: list[list[int]] = [[] for _ in strings]
    kept = [0] * len(windows)
    last, keeper = None, 0
    for i in sorted(range(len(windows)), key=windows.__getitem__):  # stable: a run begins with its first document
        if windows[i] != last:
            last, keeper = windows[i], docs[owner[i]]
        kept[i] = keeper
    for i, s in enumerate(owner):
        out[s].append(kept[i])
    return out


def buckets(k: int, m: int):
    """The kernel of `passages.repeated`: one bucket at a time, of at most BUCKET windows."""

    def run(batches):
        rows: list[tuple] = []
        bucket: list[tuple] = []  # (cls, doc, packed) of one key

        def solve():
            for (cls, _, _), kept in zip(bucket, keepers([b[2] for b in bucket], [b[1] for b in bucket], k)):
                at = 0
                for i in range(1, len(kept) + 1):
                    if i == len(kept) or kept[i] != kept[at]:
                        rows.append((cls, at, i - at, kept[at]))
                        at = i
            bucket.clear()

        now = None
        for batch in batches:
            cores, docs = (np.asarray(batch.column(i)).tolist() for i in (0, 3))
            classes, texts = batch.column(1), batch.column(5)
            for i, core in enumerate(cores):
                if core != now:
                    if bucket:
                        solve()
                    now = core
                    if len(rows) > 8192:
                        yield passages.rows_of(passages.RUNS, zip(*rows))
                        rows.clear()
                bucket.append((classes[i].as_py(), docs[i], texts[i].as_py()))
        if bucket:
            solve()
        if rows:
            yield passages.rows_of(passages.RUNS, zip(*rows))

    return run


def op4_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words without those of windows that a smaller doc_id has; for edge cases see `passages`."""
    docs = read_table(spark, sf_dir, "documents")
    return passages.digests(docs, passages.repeated(docs, buckets))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS pos, words FROM w WHERE len(words) >= 50),
windows AS (
  SELECT doc_id, pos, sha256(array_to_string(words[pos:pos + 49], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS keeper FROM windows GROUP BY h),
hits AS (SELECT doc_id, pos FROM windows JOIN firsts USING (h) WHERE keeper < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(pos, pos + 50)) AS p FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN words
         ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
"""
