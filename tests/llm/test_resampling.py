import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from quarry.llm import resampling

TARGET = ["ab cd ef again", "Same Case Words here and here", None, ""]


def words_of(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def grams_of(text, n):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, n, buckets, percent, least):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, grams_of(text, n)))
    for text in target:
        t.update(map(bucket, grams_of(text, n)))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (total_s + buckets)) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for doc_id, text in rows:
        found = [gain(bucket(g)) for g in grams_of(text, n)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(found), weight, score, len(words_of(text)) >= least))
    fit = sorted((-r[3], r[0] is None, r[0] or 0, r[1]) for r in out if r[4])
    drawn = fit[: percent * len(fit) // 100]
    ranks = {}
    for i, key in enumerate(drawn):
        ranks.setdefault(key, []).append(i + 1)
    res = Counter()
    for doc_id, k, weight, score, ok in out:
        mine = ranks.get((-score, doc_id is None, doc_id or 0, k)) if ok else None
        res[doc_id, k, weight, score, mine.pop(0) if mine else None] += 1
    return res


def got(frame):
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in frame.collect())


@pytest.mark.parametrize("n,percent,long,owned", [(1, 10, 65_536, 4_096), (1, 60, 300, 7), (2, 50, 300, 11), (3, 100, 50, 2), (3, 0, 300, 64)])
def test_weights_scores_and_ranks_equal_brute_force(spark, docs, rows, n, percent, long, owned):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    found = resampling.resample(docs, target, n=n, buckets=97, percent=percent, min_words=5, long=long, owned=owned)
    assert got(found) == brute([(r[0], r[1]) for r in rows], TARGET, n, 97, percent, 5)


def test_chunks_own_each_position_once(spark):
    text = " ".join(f"w{i}" for i in range(25)) + "."
    frame = spark.createDataFrame([(0, 1, text), (1, 2, "...")], "row long, doc_id long, text string")
    parts = resampling.chunks(frame, 3, long=2, owned=10).collect()
    mine = sorted((r["words"][0], len(r["words"]), r["owned"]) for r in parts if r["doc_id"] == 1)
    assert mine == [("w0", 12, 10), ("w10", 12, 10), ("w20", 5, 5)]
    assert [(r["words"], r["owned"]) for r in parts if r["doc_id"] == 2] == [([], 0)]


def test_drawn_rows_keep_their_columns(spark, docs):
    target = spark.createDataFrame([("ab cd",)], "text string")
    clash = docs.withColumnsRenamed({"lang": "rank", "source": "score", "shard": "drawn", "fp": "row"})
    out = resampling.drawn(clash, target, percent=50, min_words=1)
    ids = {r["doc_id"] for r in resampling.resample(docs, target, percent=50, min_words=1).collect() if r["rank"] and r["doc_id"] is not None}
    assert out.columns == clash.columns and {r["doc_id"] for r in out.collect()} == ids


def test_empty_tables(spark, docs, empty):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(empty, target).count() == 0
    assert resampling.resample(docs, target).count() == docs.count()
