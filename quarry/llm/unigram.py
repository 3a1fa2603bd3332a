"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

No piece crosses the start of a run of white-space markers, so a text is cut there without loss and each
different segment is solved once per worker. All segments that are new in a slice of texts are solved together: the
trie is walked from every character in step, and the best paths are extended by one end position at a time.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read_table

MARK = "▁"
#: Kinds of piece in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character scores below the worst piece.
PENALTY = 10.0
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Segments that a worker remembers.
CACHE = 200_000
SLICE_CHARS = 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes):
    """(number, value) of a protocol-buffer message; messages and strings as bytes, 32-bit values too."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            at += n
            yield key >> 3, data[at - n : at]
        else:
            n = 8 if kind == 1 else 4
            at += n
            yield key >> 3, data[at - n : at]


@dataclass
class Trie:
    """A double array: the child of node n by byte c is base[n] + c + 1 if check there is n."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(words: list[tuple[bytes, int]]) -> Trie:
        words = sorted(words)
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        todo, free, crowd = [(0, 0, len(words), 0)], 257, 257
        while todo:
            node, lo, hi, depth = todo.pop()
            if len(words[lo][0]) == depth:
                value[node] = words[lo][1]
                lo += 1
            kids, i = [], lo
            while i < hi:
                c, j = words[i][0][depth], i
                while i < hi and words[i][0][depth] == c:
                    i += 1
                kids.append((c + 1, j, i))
            if not kids:
                continue
            if len(kids) == 1:  # any free place does
                while check[free] >= 0:
                    free += 1
                b = free - kids[0][0]
            else:  # from a mark that leaves crowded ground behind
                b, tried = crowd, 0
            while True:
                if b + 260 >= len(check):
                    grow = len(check)
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                if all(check[b + c] < 0 for c, _, _ in kids):
                    break
                b += 1
                if len(kids) > 1:
                    tried += 1
                    if tried == 64:
                        crowd, tried = b, 0
            base[node] = b
            for c, j, k in kids:
                check[b + c] = node
                todo.append((b + c, j, k, depth + 1))
        return Trie(np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32))


@dataclass
class Pieces:
    """A vocabulary: pieces, log scores, kinds, and their trie."""

    pieces: list[bytes]
    score: np.ndarray
    kind: np.ndarray
    trie: Trie
    byte_ids: np.ndarray
    unknown: int
    prefix: bool

    @staticmethod
    def load(path: str) -> Pieces:
        """Reads a model file. Merge ranks (a BPE file) become log probabilities by Zipf's law; log scores stay.

        Only files that leave characters as they are and keep all white space can be read.
        """
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        pieces, scores, kinds = [], [], []
        unigram, prefix = True, True
        for number, value in model:
            if number == 1:
                p = dict(fields(value))
                pieces.append(p[1])
                scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kinds.append(p.get(3, NORMAL))
            elif number == 2:
                unigram = dict(fields(value)).get(3, 1) == 1
            elif number == 3:
                spec = dict(fields(value))
                prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("the model normalises its texts")
        kind, score = np.array(kinds), np.array(scores)
        own = np.flatnonzero((kind == NORMAL) | (kind == USER))
        if not unigram:
            rank = np.argsort(np.argsort(-score[own], kind="stable"), kind="stable") + 1.0
            score[own] = -np.log(rank) - np.log(np.sum(1 / rank))
        score = score.astype(np.float32).astype(np.float64)
        crossing = [p for p in (pieces[i].decode() for i in own) if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError("pieces that hold a marker inside cannot be cut at markers")
        byte_ids = np.full(256, -1, np.int64)
        for i in np.flatnonzero(kind == BYTE):
            byte_ids[int(pieces[i][3:5], 16)] = i
        unknown = int(np.flatnonzero(kind == UNKNOWN)[0])
        return Pieces(pieces, score, kind, Trie.of([(pieces[i], int(i)) for i in own]), byte_ids, unknown, prefix)

    def table(self) -> list[bytes]:
        """The bytes that each id stands for; control ids for none."""
        out = []
        for p, k in zip(self.pieces, self.kind):
            out.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK.encode(), b" "))
        return out


def solve(segments: list[bytes], v: Pieces) -> list[np.ndarray]:
    """The ids of each segment's best path; equal scores take the longer last piece."""
    size = np.array([len(s) for s in segments])
    data = np.frombuffer(b"".join(segments), np.uint8)
    base = np.cumsum(size) - size
    end_of = np.repeat(base + size, size)
    seg = np.repeat(np.arange(len(segments)), size)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.diff(np.r_[lead, len(data)])
    # walk the trie from every character at once
    node, start, pos = np.zeros(len(lead), np.int64), lead, lead
    hits = []
    single = np.zeros(len(data), bool)
    width_at = np.zeros(len(data), np.int64)
    width_at[lead] = width
    while len(pos):
        child = v.trie.base[node] + data[pos].astype(np.int64) + 1
        ok = v.trie.check[child] == node
        node, start, pos = child[ok], start[ok], pos[ok] + 1
        got = v.trie.value[node] >= 0
        if got.any():
            s, e = start[got], pos[got]
            hits.append((s, e, v.trie.value[node[got]].astype(np.int64)))
            single[s[e - s == width_at[s]]] = True
        on = pos < end_of[start]
        node, start, pos = node[on], start[on], pos[on]
    bare = lead[~single[lead]]
    hits.append((bare, bare + width_at[bare], np.full(len(bare), -1)))
    s, e, piece = (np.concatenate(x) for x in zip(*hits))
    worst = v.score[(v.kind == NORMAL) | (v.kind == USER)].min() - PENALTY
    gain = np.where(piece < 0, worst, v.score[piece])
    # best[i + segment's number] is the best score up to byte i of a segment, by end position
    at = s + seg[s]
    target = e + seg[s]
    best = np.full(len(data) + len(segments), -np.inf)
    best[base + np.arange(len(segments))] = 0.0
    came = np.full(len(best), -1)
    via = np.full(len(best), -1)
    order = np.argsort(e - base[seg[s]], kind="stable")
    ends = (e - base[seg[s]])[order]
    cuts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1], True])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = order[a:b]
        score = best[at[own]] + gain[own]
        rank = np.lexsort((s[own], -score, target[own]))
        first = rank[np.r_[True, target[own][rank][1:] != target[own][rank][:-1]]]
        to = target[own[first]]
        best[to], came[to], via[to] = score[first], at[own[first]], piece[own[first]]
    # all paths back at once
    now, number = base + size + np.arange(len(segments)), np.arange(len(segments))
    origin = base + np.arange(len(segments))
    parts = []
    while len(now):
        parts.append((number, came[now], now, via[now]))
        now = came[now]
        on = now != origin[number]
        now, number = now[on], number[on]
    number, a, b, ids = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(a, kind="stable")
    number, a, b, ids = number[order], a[order], b[order], ids[order]
    times = np.where(ids < 0, b - a, 1)  # a character without a piece becomes its bytes
    out = np.repeat(ids, times)
    lost = np.flatnonzero(ids < 0)
    if len(lost):
        where = np.cumsum(times) - times
        for i in lost.tolist():
            from_byte = a[i] - number[i]
            found = v.byte_ids[data[from_byte : from_byte + times[i]]]
            out[where[i] : where[i] + times[i]] = np.where(found < 0, v.unknown, found)
    count = np.bincount(number, weights=times, minlength=len(segments)).astype(np.int64)
    return np.split(out.astype("<u4"), np.cumsum(count)[:-1])


class Encoder:
    def __init__(self, vocabulary: Pieces):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        self.bytes_of = vocabulary.table()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit bytes. An empty text has none."""
        cut = [SEGMENT.findall((" " + t if self.v.prefix else t).replace(" ", MARK)) if t else [] for t in texts]
        known = self.known
        new = list({s for c in cut for s in c if s not in known})
        if new and len(known) > CACHE:
            known.clear()
            new = list({s for c in cut for s in c})
        if new:
            known.update(zip(new, (x.tobytes() for x in solve([s.encode() for s in new], self.v))))
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        found = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return found[1:] if self.v.prefix and found.startswith(" ") else found


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(vocabulary: Pieces) -> Encoder:
    """The worker's encoder of a vocabulary; later tasks of the worker find its cache warm."""
    key = hash((len(vocabulary.pieces), vocabulary.score.tobytes(), tuple(vocabulary.pieces[:300])))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def _encoded(sent, with_ids: bool):
    def run(batches):
        import pyarrow as pa

        encoder = encoder_of(sent.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(batch):
                part, size = [], 0
                while at + len(part) < len(batch) and size < SLICE_CHARS:
                    part.append(texts[at + len(part)].as_py() or "")
                    size += len(part[-1])
                found = encoder.encode(part)
                back = [encoder.decode(x) for x in found]
                cols = [ids[at : at + len(part)], pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()), pa.array([x == y for x, y in zip(back, part)])]
                names = ["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in found], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at += len(part)

    return run


def encode(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Each whole text's pieces: doc_id, n_pieces, ids_crc32, decoded_crc32, round_trip and, if asked for, ids.

    ids_crc32 is of the ids as little-endian 32-bit numbers, decoded_crc32 of the text they decode to, in UTF-8.
    Null and empty texts have no ids and decode to the empty text; every other text decodes to itself, save that
    a white-space marker in it comes back as a space. Repeated rows stay; other columns are ignored.
    `model` is the path of a model file; only the driver reads it, and what is sent has the vocabulary's size.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Pieces.load(model or default_model()))
    schema = "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encoded(sent, with_ids), schema)


def op5_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces; for nulls, long texts and repeats see `encode`."""
    return encode(read_table(spark, sf_dir, "documents"), with_ids=False)
