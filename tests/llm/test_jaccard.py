import numpy as np
import pytest

from quarry.llm import jaccard
from tests.llm.conftest import words


def brute_labels(texts):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(texts))]


def _texts():
    """Copies with 1 to 9 of 120 words changed: similarities from 0.97 down to below 0.8, chains, shared passages, short texts."""
    rng = np.random.default_rng(5)
    texts = [None, "", " \t", "one", "One", "one two three four", "one two three four five", "one two three four five six"]
    shared = " ".join(words(60, 77))
    for i in range(10):
        last = words(120, i + 200)
        texts.append(" ".join(last))
        for _ in range(6):
            new = list(last if rng.random() < 0.5 else texts[-1].split())
            for at in rng.choice(len(new), int(rng.integers(1, 10)), replace=False).tolist():
                new[at] = f"changed{int(rng.integers(0, 10**9))}"
            texts.append(" ".join(new))
        texts.append(shared + " " + " ".join(words(150, i + 400)))
        texts.append(shared + " " + " ".join(words(14, i + 600)))
    return texts


@pytest.mark.parametrize("common,reach", [(1 << 17, 16), (4, 1)])
def test_near_dedup_matches_brute_force_jaccard(spark, monkeypatch, common, reach):
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "REACH", reach)
    texts = _texts()
    rows = [(i, t, i % 3) for i, t in enumerate(texts)]
    got = jaccard.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(3))
    assert got.columns == ["doc_id", "text", "size"]
    label = brute_labels(texts)
    assert 40 < len(set(label)) < len(texts)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(label))


def test_stage_drops_a_copy_beyond_three_bits(spark):
    import corpus_pipeline
    from quarry.llm import simhash

    base = words(120, 31)
    for seed in range(40):
        other = list(base)
        for at in (40, 80):
            other[at] = f"x{seed}{at}"
        texts = [" ".join(base), " ".join(other)]
        if (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count() > 4:
            break
    else:
        raise AssertionError("no such copy")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()] == [0]


def test_rows_that_repeat_an_id_stay_unless_near(spark):
    a, b, c, d = (" ".join(words(60, 900 + i)) for i in range(4))
    rows = [(1, a), (1, b), (1, b), (1, b.upper()), (None, c), (None, d), (2, a + " more"), (None, b + " more"), (3, d + " more")]
    got = jaccard.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(1, a), (1, b.upper()), (None, c), (3, d + " more")]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_sketches_never_say_less_than_two_sets_share():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 2**64, 30_000, dtype=np.uint64)
    for n, m in [(1, 1), (1, 900), (5, 6), (40, 50), (700, 800), (5000, 5100), (20_000, 21_000)]:
        a, b = (np.unique(rng.choice(pool, x)) for x in (n, m))
        most = jaccard.most_common(jaccard.sketch(a), jaccard.sketch(b))
        assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))
    many = np.arange(2_000, dtype=np.uint64)  # all in the first count
    assert jaccard.most_common(jaccard.sketch(many), jaccard.sketch(many)) is None


def test_near_dedup_of_an_empty_table(empty):
    assert jaccard.near_dedup(empty).count() == 0


def test_a_large_group_of_near_copies(spark):
    """One group of copies that differ in a few words of their own, and a line that every other text has."""
    base, line = words(100, 50), words(20, 51)
    rows = []
    for i in range(250):
        w = list(base)
        w[(i * 7) % 100] = f"own{i}"
        rows.append((i, " ".join(w) if i % 2 else " ".join(line + words(90, 2000 + i))))
    got = jaccard.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({1, *range(0, 250, 2)})


@pytest.mark.parametrize("block,few,batch", [(8, 4, 7), (64, 10_000, 3), (4096, 1, 10_000)])
def test_blocks_samples_and_batches_change_nothing(spark, monkeypatch, block, few, batch):
    """Many short texts around one common line, some of 0.8 and more, against all pairs."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FEW", few)
    common = words(12, 77)
    texts = []
    for i in range(160):
        tail = words(3 + i % 4, 3000 + i // 3)
        texts.append(" ".join([*common, *tail[: len(tail) - i % 2]]))
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    head = list(range(len(texts)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = jaccard.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert sorted(r["doc_id"] for r in got.collect()) == sorted({find(i) for i in head})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cells_hold_every_pair_of_two_labels_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rows = [(1, 20, u, 0, u % 3) for u in range(23)] + [(2, 20, 100 + u, 0, 9) for u in range(30)] + [(3, 20 + 20 * (u // 6), 200 + u, 0, u) for u in range(12)] + [(4, 20, 300, 0, 1), (4, 20, 301, 0, 2)]
    cells = jaccard._cells(spark.createDataFrame(rows, "h long, n int, u long, at int, label long")).collect()
    pairs = []
    for cell in {r["cell"] for r in cells}:
        own = [r for r in cells if r["cell"] == cell]
        pairs += [tuple(sorted((a["u"], b["u"]))) for i, a in enumerate(own) for b in own[:i] if (a["side"] < 0 or a["side"] != b["side"]) and a["label"] != b["label"]]
    want = {tuple(sorted((a[2], b[2]))) for i, a in enumerate(rows) for b in rows[:i] if a[0] == b[0] and a[4] != b[4]}
    assert len(pairs) == len(set(pairs)) and set(pairs) <= want
    assert {p for p in want if all(5 * min(x, y) >= 4 * max(x, y) for x, y in [[next(r[1] for r in rows if r[2] == u) for u in p]])} <= set(pairs)
    assert not any(100 <= r["u"] < 130 for r in cells)  # one label: nothing to compare


def test_a_meeting_without_possible_pairs_ends_soon():
    import time

    import pyarrow as pa

    n = 64_000
    h, size, u, at = np.ones(n, np.int64), np.full(n, 50, np.int32), np.arange(n), np.zeros(n, np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (h, size, u, at)], names=["h", "n", "u", "at"])
    began = time.time()
    out = list(jaccard._met(batch.slice(k, 1000) for k in range(0, n, 1000)))
    assert sum(b.num_rows for b in out) == n
    assert sum(b.num_rows for b in jaccard._neighbours(batch.slice(k, 1000) for k in range(0, n, 1000))) == n * jaccard.REACH - sum(range(jaccard.REACH + 1))
    assert time.time() - began < 20
