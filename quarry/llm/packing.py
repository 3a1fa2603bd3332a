"""Packing token sequences by minimum bin slack.

A document's full windows stand alone; its remainder joins others. The plan is made from the histogram of
remainder lengths, at most `capacity` numbers whatever the input's size: for the largest remaining length a
bitset subset-sum finds the multiset of remaining lengths that fills the window closest to capacity, and the
pattern is repeated as often as counts allow. Pieces then find their place from their rank within a length.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Stored, read_table, running_offset

CAPACITY, END_ID = 2048, 1
END_OF_TEXT = "<|endoftext|>"
# Fixed values of the vocabulary: its special token and the pattern that splits text before the merges.
SPECIAL = {END_OF_TEXT: 50256}
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROWS_A_PART = 16_384
OUT_ROWS = 8192


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the rest from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Byte-level BPE ids of whole texts as little-endian 32-bit bytes, from a tokenizers file's vocabulary."""

    def __init__(self, vocabulary: str):
        import tiktoken

        letters = byte_letters()
        # ids follow the order of the merges, so they serve as ranks
        ranks = {bytes(letters[c] for c in piece): i for piece, i in json.loads(vocabulary)["model"]["vocab"].items() if piece not in SPECIAL}
        self.encode_ordinary = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if END_OF_TEXT not in text:
            return array("I", self.encode_ordinary(text)).tobytes()
        mark = array("I", [SPECIAL[END_OF_TEXT]]).tobytes()
        return mark.join(array("I", self.encode_ordinary(part)).tobytes() for part in text.split(END_OF_TEXT))


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(vocabulary: str) -> Encoder:
    """The worker's encoder of a vocabulary; later tasks of the worker find it ready."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def _pieces(vocabulary, capacity: int, end_id: int):
    def run(batches):
        import pyarrow as pa

        encoder = encoder_of(vocabulary.value)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
            rows.clear()
            return out

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(len(batch)):
                data = encoder.encode(texts[i].as_py() or "") + end
                n = len(data) // 4
                for at in range(0, n, capacity):
                    size = min(capacity, n - at)
                    rows.append((ids[i].as_py(), at, size, zlib.crc32(data[at * 4 : (at + size) * 4]), n))
                if len(rows) >= OUT_ROWS:
                    yield emit()
        if rows:
            yield emit()

    return run


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, the largest one included, whose sum is closest to capacity."""
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    first = lengths[0]
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for n in lengths:
        if n > room:
            continue
        trail.append((n, reach))
        most = min(counts[n] - (n == first), room // n)
        step = 1
        while most > 0:  # binary parts of the count
            k = min(step, most)
            reach |= (reach << (n * k)) & mask
            most -= k
            step *= 2
        if reach >> room:
            break
    at = reach.bit_length() - 1
    used = {first: 1}
    for n, before in reversed(trail):
        k = 0
        while not (before >> at) & 1:
            at -= n
            k += 1
        if k:
            used[n] = used.get(n, 0) + k
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> how many) with their repeats; together they use every count exactly."""
    left = {n: c for n, c in counts.items() if c}
    out = []
    while left:
        used = fill(left, capacity)
        times = min(left[n] // k for n, k in used.items())
        out.append((used, times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first sequence, pieces a sequence, first offset), by rank."""
    found: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for used, times in patterns:
        offset = 0
        for n in sorted(used, reverse=True):
            k = used[n]
            found.setdefault(n, []).append((taken.get(n, 0), sequence, k, offset))
            taken[n] = taken.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return {n: np.array(v, np.int64) for n, v in found.items()}


def _place(table):
    def run(batches):
        import pyarrow as pa

        by_length = table.value
        for batch in batches:
            cols = {n: np.asarray(batch.column(i)) for i, n in enumerate(batch.schema.names) if n in ("length", "rank")}
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for n in np.unique(cols["length"]).tolist():
                own = np.flatnonzero(cols["length"] == n)
                t, rank = by_length[n], cols["rank"][own]
                at = np.searchsorted(t[:, 0], rank, "right") - 1
                x = rank - t[at, 0]
                sequence[own] = t[at, 1] + x // t[at, 2]
                offset[own] = t[at, 3] + x % t[at, 2] * n
            keep = batch.schema.names[:5]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, *, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text (null: empty) and then `end_id`, so an empty one has length 1.
    It is cut at multiples of `capacity`; every id lies in one piece. Sequences hold at most `capacity`
    ids, their pieces lie without gaps from 0. Repeated rows are packed as often as they occur; ties
    within a length are ordered by id, start and checksum. An empty table gives an empty result.
    `vocabulary` is the path of a tokenizers file; only the driver reads it.
    """
    spark = docs.sparkSession
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        words = spark.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the input's size
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = rows.mapInArrow(_pieces(words, capacity, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = Stored(cut, "pieces").df
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    parts = max(1, -(-max(counts.values(), default=1) // ROWS_A_PART))
    ranked = running_offset(pieces, ["length"], F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)), [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], parts, F.lit(1), "rank")
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return ranked.mapInArrow(_place(table), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of CAPACITY; for nulls, ties and repeats see `pack`."""
    return pack(read_table(spark, sf_dir, "documents"))
