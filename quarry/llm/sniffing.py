"""Media columns: signature sniffing, validation and carving.

An Aho-Corasick automaton finds all magic bytes of a value in one pass; the format's validator then follows
the structure from there and gives its length, or rejects the hit. The media that begins at byte 0
sets the type, whatever was declared; valid media further on is carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import free_name, read_table

RATE = 8000
BLOCK = 64
UNKNOWN = "application/octet-stream"
FEATURE_BUCKETS = 8


# Validators: the length of the media that begins at `at`, or 0. All work on memory that is already there.


def _png(d: bytes, at: int) -> int:
    if d[at + 12 : at + 16] != b"IHDR":
        return 0
    p = at + 8
    while p + 12 <= len(d):
        n = struct.unpack_from(">I", d, p)[0]
        if n > len(d) - p - 12 or zlib.crc32(d[p + 4 : p + 8 + n]) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            return 0
        kind = d[p + 4 : p + 8]
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _jpeg(d: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(d) and d[p] == 0xFF:
        kind = d[p + 1]
        if kind == 0xD9:
            return p + 2 - at
        n = struct.unpack_from(">H", d, p + 2)[0]
        if n < 2:
            return 0
        p += 2 + n
        if kind == 0xDA:  # entropy-coded data runs to the next marker that is no restart
            while True:
                p = d.find(b"\xff", p)
                if p < 0 or p + 1 >= len(d):
                    return 0
                if d[p + 1] != 0 and not 0xD0 <= d[p + 1] <= 0xD7:
                    break
                p += 2
            if d[p + 1] == 0xD9:
                return p + 2 - at
    return 0


def _gif(d: bytes, at: int) -> int:
    if at + 13 > len(d):
        return 0
    flags = d[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(d) and d[p]:
            p += 1 + d[p]
        return p + 1

    while p < len(d):
        if d[p] == 0x3B:
            return p + 1 - at
        if d[p] == 0x21:
            p = blocks(p + 2)
        elif d[p] == 0x2C and p + 10 <= len(d):
            local = d[p + 9]
            p = blocks(p + 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1)
        else:
            return 0
    return 0


def _riff(d: bytes, at: int, form: bytes, first: tuple[bytes, ...]) -> int:
    if at + 20 > len(d) or d[at + 8 : at + 12] != form or d[at + 12 : at + 16] not in first:
        return 0
    size = struct.unpack_from("<I", d, at + 4)[0] + 8
    if at + size > len(d):
        return 0
    p, end = at + 12, at + size
    while p + 8 <= end:
        n = struct.unpack_from("<I", d, p + 4)[0]
        p += 8 + n + (n & 1)
    return size if p in (end, end + 1) else 0


def _wav(d: bytes, at: int) -> int:
    return _riff(d, at, b"WAVE", (b"fmt ", b"JUNK", b"bext", b"LIST"))


def _webp(d: bytes, at: int) -> int:
    return _riff(d, at, b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))


def _bmp(d: bytes, at: int) -> int:
    if at + 26 > len(d):
        return 0
    size, offset, header = struct.unpack_from("<I4xII", d, at + 2)
    return size if header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= offset <= size <= len(d) - at else 0


def _pdf(d: bytes, at: int) -> int:
    if d[at + 5 : at + 6] not in (b"1", b"2") or d[at + 6 : at + 7] != b".":
        return 0
    end = d.rfind(b"%%EOF", at)
    return end + 5 - at if end > 0 and d.find(b"startxref", at, end) > 0 else 0


def _zip(d: bytes, at: int) -> int:
    end = d.find(b"PK\x05\x06", at)
    while end >= 0 and end + 22 <= len(d):
        size, offset, note = struct.unpack_from("<IIH", d, end + 12)
        if offset + size == end - at and end + 22 + note <= len(d):
            return end + 22 + note - at
        end = d.find(b"PK\x05\x06", end + 4)
    return 0


def _gzip(d: bytes, at: int) -> int:
    if at + 18 > len(d) or d[at + 3] & 0xE0:
        return 0
    z = zlib.decompressobj(31)
    left = memoryview(d)[at:]
    try:
        while len(left) and not z.eof:
            z.decompress(left[: 1 << 16], 1 << 20)
            while z.unconsumed_tail:
                z.decompress(z.unconsumed_tail, 1 << 20)
            if z.eof:
                return len(d) - at - (len(left) - min(len(left), 1 << 16)) - len(z.unused_data)
            left = left[1 << 16 :]
    except zlib.error:
        pass
    return 0


def _flac(d: bytes, at: int) -> int:
    p = at + 4
    if p + 4 > len(d) or d[p] & 0x7F or struct.unpack(">I", b"\0" + d[p + 1 : p + 4])[0] != 34:
        return 0
    while p + 4 <= len(d):
        last, n = d[p] & 0x80, struct.unpack(">I", b"\0" + d[p + 1 : p + 4])[0]
        p += 4 + n
        if last:
            return len(d) - at if p <= len(d) else 0  # frames have no length: to the end
    return 0


def _ogg(d: bytes, at: int) -> int:
    p, serial = at, None
    while p + 27 <= len(d) and d[p : p + 5] == b"OggS\0":
        own = d[p + 14 : p + 18]
        if serial not in (None, own):
            break
        serial, n = own, d[p + 26]
        if p + 27 + n > len(d):
            return 0
        end = p + 27 + n + sum(d[p + 27 : p + 27 + n])
        if end > len(d):
            return 0
        last = d[p + 5] & 4
        p = end
        if last:
            break
    return p - at if p > at else 0


def _mp4(d: bytes, at: int) -> int:
    at -= 4  # the size stands before the mark
    p = at
    while 0 <= p and p + 8 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, p)
        if n < 8 or p + n > len(d) or not kind.isalnum():
            break
        p += n
    return p - at if p - at > 16 else 0


#: (magic, where the media begins before it, type, validator)
FORMATS = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"RIFF", 0, "audio/wav", _wav),
    (b"RIFF", 0, "image/webp", _webp),
    (b"BM", 0, "image/bmp", _bmp),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
)
_AUTOMATON: list = []


def automaton():
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic in {f[0] for f in FORMATS}:
            a.add_word(magic.decode("latin-1"), magic)
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the valid media in a value, in order; hits inside media found are left out."""
    by_magic: dict[bytes, list] = {}
    for f in FORMATS:
        by_magic.setdefault(f[0], []).append(f)
    found, end = [], 0
    for last, magic in automaton().iter(data.decode("latin-1")):
        at = last + 1 - len(magic)
        for _, back, kind, valid in by_magic[magic]:
            start = at - back
            if start < end:
                continue
            if n := valid(data, at):
                found.append((start, n, kind))
                end = start + n
                break
    return found


def wav_of(payload: bytes) -> bytes:
    """The payload as 8-bit mono samples of a WAV file."""
    pad = len(payload) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload + b"\0" * pad


def wav_samples(media: bytes) -> bytes:
    p = 12
    while p + 8 <= len(media):
        n = struct.unpack_from("<I", media, p + 4)[0]
        if media[p : p + 4] == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    return b""


def samples_feature(payload: bytes) -> str:
    """Zero crossings, mean, and the shares (in thousandths) of eight bands of sample values."""
    x = np.frombuffer(payload, np.uint8)
    bands = np.bincount(x >> 5, minlength=FEATURE_BUCKETS) * 1000 // max(len(x), 1)
    high = x >= 128
    return f"cross={int(np.count_nonzero(high[1:] != high[:-1]))};sum={int(x.sum(dtype=np.int64))};bands={','.join(map(str, bands.tolist()))}"


RESULTS = ("media_type", "media_length", "declared_right", "carved")


def _sniffed(keep: list[str], data_col: str, declared_col: str | None, named: list[str]):
    def run(batches):
        import pyarrow as pa

        carved_type = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("media_type", pa.string()), ("sha256", pa.string())]))
        for batch in batches:
            datas = batch.column(batch.schema.get_field_index(data_col))
            declared = batch.column(batch.schema.get_field_index(declared_col)).to_pylist() if declared_col else [None] * len(batch)
            kinds, sizes, right, carved = [], [], [], []
            for i in range(len(batch)):
                data = datas[i].as_py()
                found = sniff(data) if data else []
                own = found[0] if found and found[0][0] == 0 else None
                kinds.append(None if data is None else own[2] if own else UNKNOWN)
                sizes.append(own[1] if own else None)
                right.append(None if data is None or declared[i] is None else declared[i] == kinds[-1])
                carved.append([{"offset": a, "length": n, "media_type": k, "sha256": hashlib.sha256(data[a : a + n]).hexdigest()} for a, n, k in found if a or not own])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(kinds, pa.string()), pa.array(sizes, pa.int64()), pa.array(right, pa.bool_()), pa.array(carved, carved_type)], names=[*keep, *named])

    return run


def sniff_media(df: DataFrame, *, data_col: str = "media", declared_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """`df` with media_type, media_length, declared_right and carved (offset, length, media_type, sha256).

    media_type is what the bytes are, not what was declared; bytes of no known format are UNKNOWN and have
    no length. Null data gives a null type and nothing carved. Whole values are searched, whatever their length.
    `keep` lists the columns passed through (all by default); a result whose name one of them has gets underscores before
    it. Repeated rows repeat, an empty table stays empty.
    """
    keep = list(df.columns if keep is None else keep)
    named = [free_name(df.select(*keep), n) for n in RESULTS]
    types = ("string", "long", "boolean", "array<struct<offset:long,length:long,media_type:string,sha256:string>>")
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{n}` {t}" for n, t in zip(named, types)]
    columns = dict.fromkeys([*keep, data_col, *([declared_col] if declared_col else [])])
    return df.select(*columns).mapInArrow(_sniffed(keep, data_col, declared_col, named), ", ".join(fields))


def _stored_media(batches):
    """(doc_id, text) to the stored form: (doc_id, n_bytes, media, declared)."""
    import pyarrow as pa

    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(0, len(batch), 256):
            end = min(len(batch), at + 256)
            sizes, media = [], []
            for i in range(at, end):
                data = (texts[i].as_py() or "").encode()
                sizes.append(len(data))
                media.append(wav_of(data + b"\0" * (-len(data) % BLOCK if data else BLOCK)))
            yield pa.RecordBatch.from_arrays([ids[at:end], pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array([UNKNOWN] * (end - at))], names=["doc_id", "n_bytes", "media", "declared"])


def _digested(batches):
    import pyarrow as pa

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        size, sha, tail, m_size, m_sha, feature = [], [], [], [], [], []
        for i in range(len(batch)):
            media = col["media"][i].as_py()
            payload = wav_samples(media)
            size.append(len(payload))
            sha.append(hashlib.sha256(payload).hexdigest())
            tail.append(zlib.crc32(payload[-BLOCK:]))
            m_size.append(len(media))
            m_sha.append(hashlib.sha256(media).hexdigest())
            carved = len(col["carved"][i].as_py())
            feature.append(f"{col['media_type'][i].as_py()};length={col['media_length'][i].as_py()};declared={str(col['declared_right'][i].as_py()).lower()};carved={carved};{samples_feature(payload)}")
        yield pa.RecordBatch.from_arrays([col["doc_id"], col["n_bytes"], pa.array(size, pa.int64()), pa.array(sha), pa.array(tail, pa.int64()), pa.array(m_size, pa.int64()), pa.array(m_sha), pa.array(feature)], names=names)


def stored_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text as a media value: UTF-8 bytes, zeros up to a positive multiple of 64, in a WAV file.

    Null counts as empty, texts of any length are whole, repeated rows repeat, other columns are ignored whatever their
    names, an empty table stays empty.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_stored_media, "doc_id long, n_bytes long, media binary, declared string")


def op6_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a sniffed WAV value, read back; null texts are empty, repeated rows repeat, an empty table stays empty."""
    media = stored_texts(read_table(spark, sf_dir, "documents"))
    sniffed = sniff_media(media, declared_col="declared", keep=["doc_id", "n_bytes", "media"])
    return sniffed.mapInArrow(_digested, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
