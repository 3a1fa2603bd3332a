import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import packing, quality, sniffing, toxicity, unigram


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


def test_pieces_cover_every_id_once(docs, rows, tokenizer, empty):
    got = packing.pack(docs, capacity=64).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 64):
            want[(i, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 64
    assert packing.pack(empty).count() == 0


def test_plan_uses_every_count_and_fills_by_subset_sums():
    counts = {3: 5, 5: 2, 7: 4, 10: 3, 1: 1}
    used = Counter()
    for pattern, times in packing.plan(counts, 16):
        assert sum(n * k for n, k in pattern.items()) <= 16
        for n, k in pattern.items():
            used[n] += k * times
    assert used == Counter(counts)
    assert sum(n * k for n, k in packing.fill({9: 1, 6: 1, 4: 1, 3: 1}, 16).items()) == 16


@pytest.fixture(scope="module")
def pieces():
    return unigram.Pieces.load(unigram.default_model())


def brute_viterbi(text, v):
    own = {p: i for i, p in enumerate(v.pieces) if v.kind[i] in (unigram.NORMAL, unigram.USER)}
    worst = min(v.score[i] for i in own.values()) - unigram.PENALTY
    t = (" " + text).replace(" ", unigram.MARK) if text else ""
    best = [(0.0, 0, None)] + [(-np.inf, 0, None)] * len(t)
    for e in range(1, len(t) + 1):
        for s in range(max(0, e - 48), e):
            i = own.get(t[s:e].encode())
            if i is None and e - s > 1:
                continue
            score = best[s][0] + (worst if i is None else v.score[i])
            if score > best[e][0] + 1e-9:
                best[e] = (score, s, i)
    return best[len(t)][0]


def score_of(ids, v):
    worst = v.score[(v.kind == unigram.NORMAL) | (v.kind == unigram.USER)].min() - unigram.PENALTY
    total, lead = 0.0, 0
    for i in ids:
        if v.kind[i] == unigram.BYTE:
            byte = int(v.pieces[i][3:5], 16)
            lead += byte & 0xC0 != 0x80
        else:
            total += v.score[i]
    return total + worst * lead


def test_unigram_paths_are_best_and_decode_back(rows, pieces):
    encoder = unigram.Encoder(pieces)
    texts = [t or "" for _, t, *_ in rows if len(t or "") < 1200] + ["  a  b ", "tab\tand\nline", "☃ snow"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert encoder.decode(ids) == text
        assert score_of(np.frombuffer(ids, "<u4"), pieces) == pytest.approx(brute_viterbi(text, pieces), abs=1e-6)


def test_double_array_finds_exactly_its_words():
    words = [w.encode() for w in ("a", "ab", "abc", "b", "bcd", "z")]
    trie = unigram.Trie.of([(w, i) for i, w in enumerate(words)])

    def find(w):
        node = 0
        for c in w:
            child = trie.base[node] + c + 1
            if trie.check[child] != node:
                return -1
            node = child
        return trie.value[node]

    assert [find(w) for w in words] == list(range(len(words)))
    assert [find(w) for w in (b"bc", b"abcd", b"c", b"")] == [-1] * 4


def test_encode_query_edge_cases(docs, rows, empty):
    got = unigram.encode(docs).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got) and all(len(r["ids"]) == r["n_pieces"] for r in got)
    assert unigram.encode(empty).count() == 0


def png(payload=b"\0\0"):
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0\0\0\1\0\0\0\1\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(payload)) + chunk(b"IEND", b"")


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x04AB\xff\xda\0\x04ab\x01\x02\xff\x00\x03\xff\xd9"


@pytest.mark.parametrize("data,kind", [(png(), "image/png"), (GIF, "image/gif"), (JPEG, "image/jpeg"), (sniffing.wav_of(b"abcd" * 16), "audio/wav"), (b"BM" + (58).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + b"\0" * 40, "image/bmp"), (b"%PDF-1.4\nstartxref\n0\n%%EOF", "application/pdf")])
def test_formats_are_validated_measured_and_carved(data, kind):
    assert sniffing.sniff(data) == [(0, len(data), kind)]
    inside = b"noise BM RIFF \xff\xd8\xff " + data + b" tail"
    assert sniffing.sniff(inside) == [(18, len(data), kind)]
    assert sniffing.sniff(data[: len(data) // 2]) == []


def test_sniffed_column_corrects_declared_types(spark):
    rows = [(1, bytearray(png() + b"xx" + GIF), "image/gif"), (2, bytearray(b"plain"), "text/plain"), (3, None, "image/png"), (4, bytearray(b""), None)]
    got = {r["id"]: r for r in sniffing.sniff_media(spark.createDataFrame(rows, "id long, media binary, declared string"), declared_col="declared").collect()}
    assert got[1]["media_type"] == "image/png" and got[1]["declared_right"] is False and got[1]["media_length"] == len(png())
    assert [(c["media_type"], c["length"], c["sha256"]) for c in got[1]["carved"]] == [("image/gif", len(GIF), hashlib.sha256(GIF).hexdigest())]
    assert got[2]["media_type"] == sniffing.UNKNOWN and got[3]["media_type"] is None and got[4]["carved"] == []


def test_stored_texts_come_back(spark, docs, rows, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sniffing.op6_signatures(spark, f"file://{tmp_path}").collect()
    want = []
    for i, t, *_ in rows:
        data = (t or "").encode()
        padded = data + b"\0" * (-len(data) % 64 if data else 64)
        want.append((str(i), len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    by_text = defaultdict(set)
    for r in got:
        by_text[r["payload_sha256"]].add((r["feature"], r["media_sha256"]))
        assert r["feature"].startswith("audio/wav;") and r["media_bytes"] == r["payload_bytes"] + 44
    assert all(len(x) == 1 for x in by_text.values())


def test_toxicity_learns_a_lexicon_on_held_out_rows(spark, empty):
    rng = np.random.default_rng(1)
    pool = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        w = rng.choice(pool, 30).tolist()
        if toxic:
            w[5:7] = [f"nasty{'ab'[i % 2]}", "nastyc"]
        rows.append((i, " ".join(w)))
        labels.append((i, None if i % 50 == 0 else int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.with_score(docs, model, keep=["doc_id"]).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.97 and got[1000] == got[1001] and len(model.index) < 2000
    kept = toxicity.without_toxic(docs, marks, threshold=0.5)
    assert kept.columns == docs.columns and {1000, 1001} <= {r["doc_id"] for r in kept.collect()}
    nothing = toxicity.fit(docs, marks.where("false"))
    assert {r["score"] for r in toxicity.with_score(docs, nothing, keep=["doc_id"]).collect()} == {0.5}


def test_weak_labels_find_junk(spark, empty):
    rng = np.random.default_rng(2)
    pool = ["the", "river", "slowly", "carried", "stones", "toward", "a", "quiet", "valley", "where", "people", "grew", "barley", "and", "sang"]
    rows = []
    for i in range(600):
        good = " ".join((w + ("." if k % 9 == 8 else "")) for k, w in enumerate(rng.choice(pool, 60))) + "."
        kind = i % 10
        text = {0: good.upper().replace(" ", "!! "), 1: " ".join([good.split()[0]] * 40), 2: good.replace(".", "").replace(" ", " | ")}.get(kind, good)
        rows.append((i, text))
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    right = sum(got[i]["keep"] == (i % 10 > 2) for i in range(600))
    assert right / 600 > 0.97 and len(got) == 602
    assert quality.quality(empty).count() == 0


def test_label_model_trusts_the_labeller_that_is_right():
    counts = Counter()
    for good in [True] * 70 + [False] * 30:
        v = [quality.NONE] * quality.LABELLERS
        if not good:
            v[0] = v[1] = quality.BAD
        else:
            v[7] = quality.GOOD
        counts[sum(x * 3**j for j, x in enumerate(v))] += 1
    m = quality.label_model(counts)
    post = sorted(m.posterior.values())
    assert post[0] < 0.1 and post[1] > 0.9 and m.accuracies()[0] > 0.9


def brute_ftrl(rows, l1, positive, epochs=3):
    """One coordinate at a time, as published: z and n a coordinate, lazy weights, per-coordinate rates."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        lasso = 0.0 if i == "bias" else l1
        return 0.0 if abs(z[i]) <= lasso else -(z[i] - (lasso if z[i] > 0 else -lasso)) / (1.0 + n[i] ** 0.5 + 1.0)

    for _ in range(epochs):
        for label, at in rows:
            w = {i: weight(i) for i in [*at, "bias"]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            g *= positive if label else 1
            for i, x in w.items():
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) * x
                n[i] += g * g
    return {i: weight(i) for i in z}


@pytest.mark.parametrize("l1,positive", [(10.0, 2.0), (0.5, 1.0)])
def test_ftrl_matches_one_coordinate_at_a_time(l1, positive):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        at = rng.choice(60, 8, replace=False)
        rows.append((float(7 in at or rng.random() < 0.1), np.sort(at).astype("<u4")))
    m = toxicity.ftrl(rows, l1=l1, positive=positive)
    want = brute_ftrl([(y, at.tolist()) for y, at in rows], l1, positive)
    assert m.bias == pytest.approx(want.pop("bias"))
    assert dict(zip(m.index.tolist(), m.weight.tolist())) == pytest.approx({i: w for i, w in want.items() if w})


def one_text(of, text):
    data = np.frombuffer(text.encode(), np.uint8)
    return of(data, np.array([0, len(data)]))[1].tolist()


def test_toxic_scores_match_a_fit_by_hand(spark):
    texts = {i: f"word{i % 7} other{i % 5} {'vile thing' if i % 4 == 0 else 'kind thing'} end{i}" for i in range(90)}
    docs = spark.createDataFrame([*texts.items(), (5, texts[5]), (5, "another text"), (None, "no id"), (91, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] + [(0, 1), (70, None), (None, 1), (91, 0)], "doc_id long, toxic int")
    keyed = spark.createDataFrame([(i, t) for i, t in [*texts.items(), (5, "another text"), (91, "")]], "i long, t string").selectExpr("i", "xxhash64(i) AS o", "xxhash64(t) AS th", "t").collect()
    known = {i: int(i % 4 == 0) for i in range(60)} | {91: 0}
    rows = sorted((r["o"], r["th"], known[r["i"]], r["t"]) for r in keyed if r["i"] in known and zlib.crc32(str(r["i"]).encode()) % 3 != 1)
    want = brute_ftrl([(y, one_text(toxicity.features, t)) for _, _, y, t in rows], 10.0, 2.0)
    got = toxicity.with_score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 94
    for r in got:
        w = want["bias"] + sum(want.get(i, 0.0) for i in one_text(toxicity.features, r["text"] or ""))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-w)))


def test_the_bound_on_features_is_shared_by_all_texts():
    for sizes, total in [([5, 1, 9], 15), ([5, 1, 9], 9), ([5, 1, 9], 3), ([5, 1, 9], 2), ([], 4), ([7], 0)]:
        most = toxicity.level(sizes, total)
        assert sum(min(x, most) for x in sizes) <= total and (most >= max(sizes, default=0) or sum(min(x, most + 1) for x in sizes) > total)
    feature = np.arange(1000, dtype="<u4")[::-1].copy()
    some = toxicity.sampled(feature, 100)
    assert len(some) == 100 and (np.diff(some.astype(int)) < 0).all() and toxicity.sampled(feature, 1000) is feature


def test_one_long_text_does_not_end_a_fit(spark):
    texts = [(i, f"{'vile thing' if i % 4 == 0 else 'kind thing'} here w{i % 9}") for i in range(300)]
    long = [(1000 + i, " ".join(f"x{i}y{j}" for j in range(4000))) for i in range(2)]
    docs = spark.createDataFrame(texts + long, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0 and i < 1000)) for i, _ in texts + long], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, max_values=9000)
    assert len(model.index)
    got = {r["doc_id"]: r["score"] for r in toxicity.with_score(docs, model, keep=["doc_id"]).collect()}
    assert min(got[i] for i, _ in texts if i % 4 == 0) > max(got[i] for i, _ in texts if i % 4)


def test_a_repeated_id_is_bounded(spark, empty):
    docs = spark.createDataFrame([(7, f"text {i % 40} of one id") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] * 50 + [(7, 0)], "doc_id long, toxic int")
    assert zlib.crc32(b"7") % 3 != 1
    sizes = []
    real = toxicity.fitted

    def spy(sample, *a, **k):
        sizes.append(sample.count())
        return real(sample, *a, **k)

    for module in (toxicity, quality):
        module.fitted, kept = spy, module.fitted
        try:
            toxicity.fit(docs, labels, max_rows=30) if module is toxicity else quality.fit(docs, max_rows=30)
            toxicity.fit(docs, labels) if module is toxicity else quality.fit(docs)
        finally:
            module.fitted = kept
    assert sizes == [30, 80, 30, 40]
    assert toxicity.without_toxic(empty, labels).count() == 0 and toxicity.fit(empty, labels).bias == 0


def test_columns_of_any_name_stay(spark):
    names = ["label", "o", "th", "id", "score", "_score", "sha", "keep", "n", "of"]
    fields = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(i, f"some text {i % 3}", *names) for i in range(6)], fields)
    labels = spark.createDataFrame([(i, 0) for i in range(6)], "doc_id long, toxic int").withColumn("o", F.lit(1)).withColumn("text", F.lit("x"))
    from quarry.llm import exact_dedup, jaccard

    for out in (toxicity.without_toxic(docs, labels), exact_dedup.exact_dedup(docs), jaccard.near_dedup(docs.withColumn("u", F.lit(1)).withColumn("place", F.lit(2))).drop("u", "place")):
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) in (3, 6) and all([r[n] for n in names] == names for r in got)
    assert quality.quality(docs).count() == 6


def brute_label_model(patterns, rounds=100):
    """Expectation-maximisation over one document at a time."""
    post = [0.1 if v.count(quality.BAD) > v.count(quality.GOOD) else 0.95 if quality.BAD not in v else 0.5 for v in patterns]
    for _ in range(rounds):
        prior = (sum(post) + 1) / (len(post) + 2)
        mass = (len(post) - sum(post), sum(post))
        table = [[[(sum(p if y else 1 - p for p, v in zip(post, patterns) if v[j] == k) + 1) / (mass[y] + 3) for k in range(3)] for y in range(2)] for j in range(quality.LABELLERS)]
        new = []
        for v in patterns:
            a, b = 1 - prior, prior
            for j, k in enumerate(v):
                a, b = a * table[j][0][k], b * table[j][1][k]
            new.append(b / (a + b))
        done = max(abs(x - y) for x, y in zip(new, post)) < 1e-9
        post = new
        if done:
            break
    return post


def test_posteriors_and_scores_match_brute_force(spark, docs, rows):
    texts = [t or "" for _, t, *_ in rows]
    want = dict(zip(texts, brute_label_model([list(quality.votes(t)) for t in texts])))
    order = {}
    for r in docs.selectExpr("coalesce(text, '') AS t", "xxhash64(doc_id, coalesce(text, '')) AS o").distinct().collect():
        order[r["o"]] = r["t"]
    weights = brute_ftrl([(want[order[o]], one_text(quality.shapes, order[o])) for o in sorted(order)], 1.0, 1.0)
    got = quality.quality(docs).collect()
    assert len(got) == len(rows)
    by_id = {i: t or "" for i, t, *_ in rows}
    for r in got:
        assert r["posterior"] == pytest.approx(want[by_id[r["doc_id"]]], abs=1e-6)
        w = weights["bias"] + sum(weights.get(i, 0.0) for i in one_text(quality.shapes, by_id[r["doc_id"]]))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-w)), abs=1e-6)


def test_media_take_free_names_and_empty_tables(spark, empty, docs):
    media = sniffing.stored_texts(docs.withColumnsRenamed({"lang": "media", "source": "n_bytes"}))
    clash = media.withColumnsRenamed({"declared": "media_type", "n_bytes": "CARVED"})
    out = sniffing.sniff_media(clash, declared_col="media_type")
    assert out.columns == [*clash.columns, "_media_type", "media_length", "declared_right", "_carved"]
    assert {r["_media_type"] for r in out.collect()} == {"audio/wav"}
    assert sniffing.sniff_media(sniffing.stored_texts(empty)).count() == 0
