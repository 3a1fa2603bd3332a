import hashlib
from collections import Counter, defaultdict

import pytest

from quarry.llm import alignment
from quarry.llm.packing import default_vocabulary
from quarry.llm.unigram import default_model


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(default_vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=default_model())


def brute(texts, tokenizers):
    """Digests of (id, text) by whole-text encodings and all pairs of tokens."""
    a_model, sp = tokenizers
    with open(default_vocabulary(), encoding="utf-8") as f:
        a_bytes = alignment.pieces_of_a(f.read())
    pairs, docs = Counter(), []
    for doc_id, text in texts:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        spelled_a = [a_bytes[i] for i in a]
        spelled_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + text).encode() if text else b""
        if b"".join(spelled_a) != want or b"".join(spelled_b) != want:
            a = b = spelled_a = spelled_b = []
        spans = []
        for ids, spelled in ((a, spelled_a), (b, spelled_b)):
            at, found = 0, []
            for i, s in zip(ids, spelled):
                found.append((at, at + len(s), i))
                at += len(s)
            spans.append(found)
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [",".join(str(i) for s, e, i in spans[0] if lo <= s and e <= hi) + "|" + ",".join(str(i) for s, e, i in spans[1] if lo <= s and e <= hi) for lo, hi in zip([0, *both], both)]
        linked, j = [], 0
        for s, e, i in spans[0]:
            while j and spans[1][j - 1][1] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < e:
                if spans[1][j][1] > s:
                    linked.append((i, spans[1][j][2]))
                j += 1
        pairs.update(linked)
        docs.append((doc_id, len(a), len(b), groups, linked))
    best = defaultdict(int)
    for (_, b), n in pairs.items():
        best[b] = max(best[b], n)
    out = Counter()
    for doc_id, n_a, n_b, groups, linked in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out[doc_id, n_a, n_b, len(groups), len(linked), sum(pairs[p] == best[p[1]] for p in linked), sum(pairs[p] for p in linked), sha] += 1
    return out, pairs


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = ["▁ marked", "a▁b c", "  two  spaces \n\n and\tlines ", " lead", "tail ", "<s> </s> <unk> <0x0A> <|endoftext|>", "naïve Ünïcode ÿ", "日本語 text", "\x00 nul", "x" * 3000, "don't I'll 3.14 a-b", "nbsp here ", "﻿bom", "é é", "\x1c sep \x85 nel"]


def digests(got):
    return Counter(tuple(r[n] for n in NAMES) for r in got.collect())


@pytest.fixture(scope="module")
def table(docs, rows, spark):
    odd = [(1000 + i, t) for i, t in enumerate(ODD)]
    frame = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(*x, "key") for x in odd], "doc_id long, text string, lang string"))
    frame = frame.withColumnsRenamed({"lang": "key"})  # a name that the operator uses itself
    return frame, [(r[0], r[1]) for r in rows] + odd


def test_groups_links_and_counts_equal_brute_force(table, tokenizers):
    frame, texts = table
    want, pairs = brute(texts, tokenizers)
    found = alignment.Alignment(frame)
    assert digests(found.digests()) == want
    assert {(r["a"], r["b"]): r["n"] for r in found.pairs().collect()} == pairs
    assert digests(found.digests(sent=0)) == want  # joined instead of broadcast


def test_forgetting_cuts_between_blocks_changes_nothing(table, tokenizers, monkeypatch):
    grouper = alignment.Grouper(open(default_vocabulary(), encoding="utf-8").read(), open(default_model(), "rb").read())
    texts = [t for _, t in table[1]]
    once = [[grouper.keys[x] for x in g] for g in grouper.groups(texts)]
    assert all(n == (k.split("|")[0].count(",") + 1, k.split("|")[1].count(",") + 1) for k, n in zip(grouper.keys, grouper.tokens))
    again = []
    for t in texts:
        grouper.clear()
        again.append([grouper.keys[x] for x in grouper.groups([t])[0]])
    assert once == again


def test_documents_weight_counts_each_document_once(spark, tokenizers):
    frame = spark.createDataFrame([(1, "same same same"), (2, "same other")], "doc_id long, text string")
    per = {r["key"]: r["freq"] for r in alignment.Alignment(frame, weight="documents").groups().collect()}
    often = {r["key"]: r["freq"] for r in alignment.Alignment(frame).groups().collect()}
    assert max(per.values()) == 2 and max(often.values()) == 4


def test_links_are_the_overlaps_of_a_group():
    # A: lengths 2, 3, 1; B: lengths 4, 2
    assert alignment.links("0,1,2|0,1", [2, 3, 1], [4, 2]) == Counter({(0, 0): 1, (1, 0): 1, (1, 1): 1, (2, 1): 1})


def test_empty_tables(empty):
    found = alignment.Alignment(empty)
    assert found.digests().count() == 0 and found.pairs().count() == 0 and found.digests(sent=-1).count() == 0
