import hashlib
import re

import numpy as np
import pytest
import xxhash

from quarry.llm import passages, simhash, suffixes, superkmers
from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(values, radius=3):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [find(i) for i in range(len(values))]


def test_near_groups_match_brute_force(docs, rows, empty):
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    label = brute_components(fps)
    least = {}
    for (i, *_), c in zip(rows, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((str(r[0]), f"{f:016x}", least.get(c)) for r, f, c in zip(rows, fps, label))
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_groups(docs).collect())
    assert got == want
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("small,hot", [(48, 2048), (1, 2048), (48, 3)])
def test_links_in_blocks_match_brute_force(spark, monkeypatch, small, hot):
    rng = np.random.default_rng(3)
    values = []
    for b in rng.integers(0, 2**63, 40, dtype=np.uint64).tolist():
        values.append(b)
        for _ in range(int(rng.integers(0, 8))):
            x = values[-1] if rng.random() < 0.5 else b
            for k in rng.choice(64, int(rng.integers(1, 5)), replace=False).tolist():
                x ^= 1 << k
            values.append(x)
    values = sorted(set(values))
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "HOT", hot)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    at = {v: i for i, v in enumerate(signed)}
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        p, q = find(at[r["a"]]), find(at[r["b"]])
        root[max(p, q)] = min(p, q)
    assert [find(i) for i in range(len(values))] == brute_components(values)


def test_components_on_a_long_chain(spark):
    from quarry.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def brute_passages(rows, k=50):
    cut = [WORD.findall(t or "") for _, t, *_ in rows]
    keyed = [i if i is not None else passages.NO_ID for i, *_ in rows]
    first = {}
    for d, w in zip(keyed, cut):
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            first[g] = min(first.get(g, d), d)
    out = []
    for (i, *_), d, w in zip(rows, keyed, cut):
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < d:
                gone.update(range(p, p + k))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("kernel", [superkmers.buckets, suffixes.buckets])
@pytest.mark.parametrize("bucket", [1 << 15, 1])
def test_passages_match_brute_force(docs, rows, monkeypatch, kernel, bucket):
    monkeypatch.setattr(passages, "BUCKET", bucket)
    got = passages.digests(docs, passages.repeated(docs, kernel)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_passages(rows)


@pytest.mark.parametrize("kernel", [superkmers.buckets, suffixes.buckets])
@pytest.mark.parametrize("long", [1024, 5])
def test_a_line_and_a_passage_in_many_contexts(spark, monkeypatch, kernel, long):
    """One line and one passage stand in every document; copies differ by one word; one text repeats few words."""
    monkeypatch.setattr(passages, "BUCKET", 200)
    monkeypatch.setattr(passages, "LONG", long)
    line, passage, near = words(12, 1), words(70, 2), words(110, 3)
    rows = []
    for i in range(60):
        own = words(120, 1000 + i)
        text = own[:30] + line + own[30:60] + (passage if i % 2 else passage[:55]) + own[60:]
        if i % 3 == 0:
            text = near[: 15 + i] + [f"x{i}"] + near[15 + i :]
        rows.append((i, " ".join(text)))
    rows += [(100, "a b " * 90), (101, "b a " * 70 + "c"), (102, " ".join(line * 20)), (103, " ".join(line * 9 + ["end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = passages.digests(df, passages.repeated(df, kernel)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_passages(rows)


def test_halving_ends_at_single_places():
    for reach in (1, 5, 44):
        for depth in range(8):
            low, high = passages.halves(reach, depth)
            assert len(low) == reach + 1 and (low <= np.arange(reach + 1)).all() and (high >= np.arange(reach + 1)).all()
            assert (high - low < 1 << max(0, (reach + 1).bit_length() - depth)).all()
        low, high = passages.halves(reach, reach.bit_length())
        assert (low == high).all()


def test_one_line_over_and_over_splits_into_few_pieces():
    line = "this line comes over and over again".split()
    packed = " ".join(line * 60).encode()
    words, first = passages.word_hashes(np.frombuffer(packed, np.uint8), np.array([0, len(packed)]))
    mini = int(passages.gram_hashes(words, 6).view(np.int64)[:7].min())
    batch = passages.rows_of(passages.PACKED, ([1], [b"c" * 16], [len(words) - 49], [7], [mini], [packed]))
    pieces = [r for b in passages._split(50, 6, 1)([batch]) for r in b.to_pylist()]
    assert len(pieces) <= 2 * len(line)
    covered = sorted(at + i for r in pieces for at in r["ats"] for i in range(r["n"]))
    assert covered == list(range(len(words) - 49))


def test_cut_keeps_columns_of_any_name(spark):
    text = " ".join(words(80, 4))
    rows = [(1, text, "d", 5, None, "r"), (2, "x " + text, "d", 6, None, "r"), (None, text + " y", None, 7, 1, None), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string, u int, n_chars int, ranges string")
    got = {r["doc_id"]: r for r in suffixes.suffix_dedup(df).collect()}
    assert list(got[1].asDict()) == df.columns
    assert [got[i]["text"] for i in (1, 2, None, 3)] == [text, "x ", "y", None]
    assert got[2]["doc"] == "d" and got[2]["u"] == 6 and got[2]["n_chars"] == 2


def test_passages_of_an_empty_table(empty):
    assert passages.digests(empty, passages.repeated(empty, superkmers.buckets)).count() == 0
    assert suffixes.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_kernels_agree_on_a_small_alphabet(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(rng.choice(["a", "b"], int(rng.integers(0, 40))))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_passages(rows, 8)
    for kernel in (superkmers.buckets, suffixes.buckets):
        got = passages.digests(df, passages.repeated(df, kernel, k=8, m=3)).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want


def test_cut_text_keeps_the_rest_as_it_is(docs, rows):
    got = suffixes.suffix_dedup(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    by_id = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    originals = {i: t for i, t, *_ in rows}
    assert by_id[4]["text"] == originals[4] and by_id[16]["text"] is None
    assert len(by_id[27]["text"].split()) < len(originals[27].split())
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in by_id.values())
