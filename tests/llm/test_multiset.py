import hashlib
import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import multiset

SEED = xxhash.xxh64(multiset.SALT.encode(), seed=42).intdigest()


def features_of(paragraph):
    found = re.findall(multiset.SHINGLE, paragraph, re.ASCII)
    if len(found) < multiset.FEW:
        found = [paragraph[i : i + 3] for i in range(max(1, len(paragraph) - 2))]
    return [paragraph, *set(found)]


def lanes_of(text):
    lanes = [0] * 128
    for paragraph in (text or "").split("\n"):
        for f in features_of(paragraph):
            for k, h in enumerate((xxhash.xxh64(f.encode(), seed=42).intdigest(), xxhash.xxh64(f.encode(), seed=SEED).intdigest())):
                for j in range(32):
                    lanes[k * 32 + j] += 1 if h >> j & 1 else -1
                    lanes[64 + k * 32 + j] += 1 if h >> (j + 32) & 1 else -1
    return lanes


def text_of(lanes):
    return "".join(f"{x % 2**32:08x}" for x in lanes)


def near(a, b):
    if a == b:
        return 1.0
    size = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return min(1.0, max(0.0, sum(x * y for x, y in zip(a, b)) / size)) if size else 0.0


def brute(rows):
    """Rows in the operator's order: id descending, null last, then the hash of the text."""
    signed = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    out = []
    for k, (i, t) in enumerate(order):
        follower = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        changed = t[: len(t) - cut] + follower[:cut]
        a, b, c = lanes_of(t), lanes_of(changed), lanes_of(follower)
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), text_of(a), text_of(b), round(near(a, b), 9), round(near(a, c), 9)))
    return Counter(out)


def got(frame):
    return Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in frame.collect())


@pytest.mark.parametrize("parts", [None, 1, 2, 5, 300])
def test_fingerprints_and_edits_equal_brute_force(docs, rows, parts):
    assert got(multiset.edited(docs, parts=parts)) == brute([(r[0], r[1]) for r in rows])


def test_one_hot_id_and_rows_without_id_are_dealt_over_parts(spark):
    rows = [(7, f"text {i} of the hot id\nsame line") for i in range(60)] + [(None, f"no id {i}") for i in range(40)] + [(i, f"own {i}") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(multiset.edited(frame, parts=12)) == brute(rows)
    dealt = multiset.in_parts(frame.withColumn("h", F.xxhash64("text")), 12).groupBy("doc_id").agg(F.countDistinct("part").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in dealt if r["doc_id"] in (7, None)}.keys() == {7, None} and all(r["n"] > 3 for r in dealt if r["doc_id"] in (7, None))


def test_order_of_paragraphs_is_nothing_and_parts_can_be_added_and_removed(spark):
    texts = ["one line here\ntwo\nthree", "three\none line here\ntwo", "one line here\ntwo", "three", "one line here\ntwo\nthree\nthree"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    f = {r["doc_id"]: r["fingerprint"] for r in multiset.fingerprints(frame).collect()}
    assert f[0] == f[1] and len({f[0], f[2], f[3], f[4]}) == 4 and len(f[0]) == 1024
    both = spark.createDataFrame([(f[2], f[3], f[0])], "a string, b string, c string")
    row = both.select(multiset.added(F.col("a"), F.col("b")).alias("sum"), multiset.removed(F.col("c"), F.col("b")).alias("rest")).first()
    assert row["sum"] == f[0] and row["rest"] == f[2]


def test_edits_stay_near(spark):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ro", "sa", "te", "vi", "xo")]
    texts = [" ".join(words[(i * 7 + j * j) % 20] + str(i) for j in range(200)) for i in range(30)]
    out = multiset.edited(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r["near_edited"] > 0.4 > r["near_next"] for r in out)


def test_plan_has_no_python_and_one_shuffle_of_texts(docs):
    plan = multiset.edited(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_and_clashing_columns(empty, docs):
    assert multiset.edited(empty).count() == 0 and multiset.fingerprints(empty).count() == 0
    clash = docs.withColumnsRenamed({"lang": "part", "source": "h", "shard": "copy", "fp": "row"})
    assert got(multiset.edited(clash)) == got(multiset.edited(docs))
