"""What both passage operators share: minimisers of word windows, buckets, and cutting passages out.

A window is `k` consecutive words. Its minimiser is the least hash among its runs of `m` words, so equal
windows have equal minimisers wherever they stand. Consecutive windows of one minimiser form a span, which
travels as one packed string. Only spans whose minimiser occurs in several documents can repeat anything; the
rest never leave the first pass. Spans with equal words (by a 128-bit digest of them) are one row before any
text travels, and meet the minimiser's other spans in its bucket, where the operator's kernel compares words.

A bucket of more than BUCKET windows (a common line in many contexts) is split by more of the words around the
minimiser: windows that have it at their words a..b all hold the a words before it and the k - b words from it on,
so these words are the key of a smaller bucket for that half of the places, and again for the half of the half.
Consecutive windows of one key still travel as one packed string, equal strings are one row again, and a key with
one string only is decided. After log2(k) halvings a key is a whole window, so every bucket ends within the bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Stored, free_name, release

K, M = 50, 6
#: A bucket with more windows than this is split by the words around its minimiser.
BUCKET = 1 << 13
#: The most windows of one packed string.
LONG = 1024
#: Bytes of text that one numpy pass takes.
SLICE = 1 << 20
NO_ID = (1 << 63) - 1
WHITE_TABLE = np.zeros(256, bool)
WHITE_TABLE[[9, 10, 11, 12, 13, 32]] = True
SPANS = "mini long, cls binary, doc long, u long, start int, n int"
PACKED = "core long, cls binary, n int, doc long, mini long, packed binary"
PIECES = f"parent binary, ats array<int>, {PACKED}"
RUNS = "cls binary, off int, len int, keeper long"
#: Odd multipliers of the rolling hashes.
P, Q, R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_edges(data: np.ndarray, bounds: np.ndarray, table: np.ndarray = WHITE_TABLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes and sizes of all words of the texts data[bounds[i]:bounds[i + 1]], and each text's first word (and the end)."""
    white = table[data]
    before = np.empty(len(data), bool)
    before[1:] = white[:-1]
    inner = bounds[bounds < len(data)]
    before[:1] = True
    before[inner] = True
    starts = np.flatnonzero(~white & before)
    first = np.searchsorted(starts, bounds)
    after = np.empty(len(data), bool)
    after[:-1] = white[1:]
    after[-1:] = True
    after[inner[inner > 0] - 1] = True
    return starts, np.flatnonzero(~white & after) + 1 - starts, first


def hashes_at(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray = WHITE_TABLE, stem: int = 0) -> np.ndarray:
    """Hashes of the words at `starts`; with `stem`, only a word's first so many bytes count."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    solid = data[~table[data]].astype(np.uint64) + np.uint64(1)
    at = np.cumsum(sizes) - sizes
    place = np.arange(len(solid)) - np.repeat(at, sizes)
    solid *= powers(P, int(sizes.max()))[place]
    if stem:
        solid[place >= stem] = 0
        sizes = np.minimum(sizes, stem)
    return mixed(np.add.reduceat(solid, at) + sizes.astype(np.uint64))


def word_hashes(data: np.ndarray, bounds: np.ndarray, table: np.ndarray = WHITE_TABLE, stem: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[bounds[i]:bounds[i + 1]], and each text's first word (and the end).

    `table` has the bytes that part words; with `stem`, only a word's first so many bytes count.
    """
    starts, sizes, first = word_edges(data, bounds, table)
    return hashes_at(data, starts, sizes, table, stem), first


def gram_hashes(words: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the runs of m words, by first word."""
    n = len(words) - m + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, q in enumerate(powers(Q, m)):
        total += words[j : j + n] * q
    return mixed(total)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    have = 1
    out = values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def spans_of(words: np.ndarray, first: np.ndarray, k: int, m: int, long: int):
    """(mini, text's number, first word, windows) of all spans, as arrays; a span has at most `long` windows."""
    n = len(words) - k + 1
    if n <= 0:
        return None
    least = least_of(gram_hashes(words, m), k - m + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = text[:n] == text[k - 1 :]
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = (least[1:] != least[:-1]) | (text[1:n] != text[: n - 1])
    starts = np.flatnonzero(change & whole)
    if not len(starts):
        return None
    breaks = np.flatnonzero(np.r_[change, True] | np.r_[~whole, True])
    count = breaks[np.searchsorted(breaks, starts, "right")] - starts
    parts = -(-count // long)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(starts, parts) + nth * long
    count = np.minimum(np.repeat(count, parts) - nth * long, long)
    return least[starts].view(np.int64), text[starts], starts, count


def sliced(texts, size: int = SLICE):
    """Row ranges of a string array with about `size` bytes each (one row at least)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == "string" else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        end = min(end, len(texts))
        yield at, end, offsets[at : end + 1]
        at = end


def small(batches, text_at: int):
    """The batches in parts of about SLICE bytes of text, so that a task holds little beside its batch."""
    for batch in batches:
        if len(batch):
            for at, end, _ in sliced(batch.column(text_at)):
                yield batch.slice(at, end - at)


def rows_of(schema: str, columns):
    """A record batch of the columns, by a schema of plain names and types."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _scan(k: int, m: int, long: int):
    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            texts = batch.column(2)
            buffer = texts.buffers()[2]
            if not len(texts) or buffer is None:
                continue
            whole = np.frombuffer(buffer, np.uint8)
            docs, us = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for at, end, offsets in sliced(texts):
                data = whole[offsets[0] : offsets[-1]]
                starts, sizes, first = word_edges(data, offsets - offsets[0])
                found = spans_of(hashes_at(data, starts, sizes), first, k, m, long)
                if found is None:
                    continue
                mini, text, start, n = found
                raw, last = data.tobytes(), start + n + (k - 2)
                cls = [xxh3_128_digest(b" ".join(raw[i:j].split())) for i, j in zip(starts[start].tolist(), (starts[last] + sizes[last]).tolist())]
                yield rows_of(SPANS, (mini, cls, docs[at:end][text], us[at:end][text], (start - first[text]).astype(np.int32), n.astype(np.int32)))

    return run


def _pack(k: int):
    """(doc, text, spans) to the spans' packed strings, in the minimiser's bucket."""

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            docs, texts, lists = (batch.column(i) for i in range(3))
            for i in range(len(batch)):
                words, doc = texts[i].as_py().encode().split(), docs[i].as_py()
                for s in lists[i].as_py():
                    at, n = s["start"], s["n"]
                    rows.append((s["mini"], s["cls"], n, doc, s["mini"], b" ".join(words[at : at + n + k - 1])))
                if len(rows) >= 4096:
                    yield rows_of(PACKED, zip(*rows))
                    rows.clear()
        if rows:
            yield rows_of(PACKED, zip(*rows))

    return run


def halves(reach: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place 0..reach the first and the last place of its part, after `depth` halvings."""
    parts = [(0, reach)]
    for _ in range(depth):
        parts = [x for a, b in parts for x in (((a, (a + b) // 2), ((a + b) // 2 + 1, b)) if a < b else ((a, b),))]
    return tuple(np.array([p[i] for p in parts for _ in range(p[0], p[1] + 1)]) for i in range(2))


def _split(k: int, m: int, depth: int):
    """Packed strings to their different pieces: consecutive windows that have the minimiser at places of one part.

    A piece that a string holds several times (one line over and over) is one row, with all the windows it begins at.
    """
    low, high = halves(k - m, depth)

    def run(batches):
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        rows: list[tuple] = []
        for batch in batches:
            for b in range(0, len(batch), 512):
                parents, docs, minis, strings = (batch.column(i).slice(b, 512).to_pylist() for i in (1, 3, 4, 5))
                joined = b" ".join(strings)
                data = np.frombuffer(joined, np.uint8)
                lengths = np.array([len(x) for x in strings]) + 1
                starts, sizes, first = word_edges(data, np.r_[0, np.cumsum(lengths)[:-1], len(data)])
                grams = gram_hashes(hashes_at(data, starts, sizes), m).view(np.int64)
                ends = starts + sizes
                for i, (parent, doc, mini) in enumerate(zip(parents, docs, minis)):
                    n = int(first[i + 1] - first[i]) - k + 1
                    own = np.arange(first[i], first[i] + n)
                    seen = first[i] + np.flatnonzero(grams[first[i] : first[i + 1] - m + 1] == mini)
                    anchor = seen[np.searchsorted(seen, own)]  # a window's leftmost run of m words with the minimiser's hash
                    place = low[anchor - own]
                    found: dict[bytes, tuple] = {}
                    cuts = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1]), True])
                    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        at, a, z = int(anchor[x]), int(place[x]), int(high[place[x]])
                        core = xxh3_64_intdigest(joined[starts[at - a] : ends[at + k - z - 1]], a)
                        packed = joined[starts[own[x]] : ends[own[y - 1] + k - 1]]
                        cls = xxh3_128_digest(packed)
                        if cls in found:
                            found[cls][1].append(x)
                        else:
                            found[cls] = (parent, [x], core - (1 << 64) if core >> 63 else core, cls, y - x, doc, mini, packed)
                    rows += found.values()
                if len(rows) >= 4096:
                    yield rows_of(PIECES, zip(*rows))
                    rows.clear()
        if rows:
            yield rows_of(PIECES, zip(*rows))

    return run


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, u, text: a row's id (a null one counts as the greatest) and a hash that parts rows of one id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("u"), text.alias("text"))


def _marked(spans: DataFrame) -> DataFrame:
    """Different spans with their bucket's number of them, and of their windows."""
    return spans.join(spans.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("load")), "core")


def _run(off: Column, length: Column, keeper: Column) -> Column:
    return F.struct(off.alias("off"), length.alias("len"), keeper.alias("keeper"))


def _alone(marked: DataFrame) -> DataFrame:
    """Where a bucket has one span only, the span's first document keeps all its windows: cls, runs."""
    return marked.where("kinds = 1").select("cls", F.array(_run(F.lit(0), F.col("n"), F.col("doc"))).alias("runs"))


def _solved(packed: DataFrame, buckets: Callable, k: int, m: int) -> DataFrame:
    """What the kernel finds, one row a span: cls, runs."""
    found = packed.select(*[f.split()[0] for f in PACKED.split(", ")]).repartition("core").sortWithinPartitions("core", "doc", "cls").mapInArrow(buckets(k, m), RUNS)
    return found.groupBy("cls").agg(F.collect_set(_run(F.col("off"), F.col("len"), F.col("keeper"))).alias("runs"))


def _refined(large: DataFrame, buckets: Callable, k: int, m: int, depth: int, used: list[Stored]) -> DataFrame:
    """Runs of the spans of too large buckets, by smaller ones: cls, runs."""
    pieces = Stored(large.mapInArrow(_split(k, m, depth), PIECES), "pieces")
    # equal pieces are one, with the first document that has them
    kinds = pieces.df.groupBy("core", "cls").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("mini").alias("mini"), F.first("packed").alias("packed"))
    marked = Stored(_marked(kinds), "kinds")
    used += [pieces, marked]
    runs = _alone(marked.df).unionByName(_solved(marked.df.where(f"kinds > 1 AND load <= {BUCKET}"), buckets, k, m))
    again = marked.df.where(f"kinds > 1 AND load > {BUCKET}")
    if 1 << depth <= k - m and not again.isEmpty():
        runs = runs.unionByName(_refined(again.select(*[f.split()[0] for f in PACKED.split(", ")]), buckets, k, m, depth + 1, used))
    of = pieces.df.select("parent", "ats", F.col("cls").alias("piece")).join(runs, F.col("piece") == F.col("cls"))
    moved = F.flatten(F.transform("ats", lambda at: F.transform("runs", lambda r: _run(at + r["off"], r["len"], r["keeper"]))))
    return of.select(F.col("parent").alias("cls"), moved.alias("runs")).groupBy("cls").agg(F.flatten(F.collect_set("runs")).alias("runs"))


def repeated(docs: DataFrame, buckets: Callable, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M) -> DataFrame:
    """Word ranges covered by windows that also start in a document of smaller id: doc, u, ranges.

    `buckets(k, m)` is the operator's kernel: it gets rows of PACKED sorted by bucket and document, whole buckets of
    at most BUCKET windows, and gives rows of RUNS: the windows off.. off + len - 1 of a span first stand in
    document `keeper`. Null and empty texts and those under `k` words have no ranges; a null id counts as the
    greatest, and rows of one id (nulls too) take nothing from each other. Very long texts are cut into spans like
    any other; repeated rows and other columns change nothing; an empty table has no ranges.
    """
    spark = docs.sparkSession
    rows = identified(docs, id_col, text_col)
    scanned = Stored(rows.mapInArrow(_scan(k, m, LONG), SPANS), "spans")
    wide = scanned.df.groupBy("mini").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("mini")
    shared = Stored(scanned.df.join(wide, "mini", "left_semi"), "shared")
    scanned.drop()
    release(spark)
    first = shared.df.groupBy("mini", "cls").agg(F.min(F.struct("doc", "u", "start")).alias("at"), F.first("n").alias("n"))
    marked = Stored(_marked(first.select(F.col("mini").alias("core"), "cls", "at.doc", "at.u", "at.start", "n")), "distinct")
    several = marked.df.where("kinds > 1").groupBy("doc", "u").agg(F.collect_list(F.struct(F.col("core").alias("mini"), "cls", "start", "n")).alias("spans"))
    packed = Stored(rows.join(several, ["doc", "u"]).select("doc", "text", "spans").mapInArrow(_pack(k), PACKED), "packed")
    large = marked.df.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("load")).where(f"kinds > 1 AND load > {BUCKET}").select("core")
    used = [shared, marked, packed]
    runs = _solved(packed.df.join(large, "core", "left_anti"), buckets, k, m)
    if not large.isEmpty():
        runs = runs.unionByName(_refined(packed.df.join(large, "core", "left_semi"), buckets, k, m, 1, used))
    decided = _alone(marked.df).unionByName(runs)
    # one row a span, however many runs it has; its windows as one range for each run that a smaller document keeps
    lost = F.transform(F.filter("runs", lambda r: r["keeper"] < F.col("doc")), lambda r: F.struct((F.col("start") + r["off"]).alias("from"), (F.col("start") + r["off"] + r["len"] + (k - 1)).alias("to")))
    hits = shared.df.join(decided, "cls").where(F.exists("runs", lambda r: r["keeper"] < F.col("doc"))).select("doc", "u", lost.alias("lost"))
    out = Stored(hits.groupBy("doc", "u").agg(F.array_sort(F.flatten(F.collect_list("lost"))).alias("ranges")), "ranges").df
    for x in used:
        x.drop()
    release(spark)
    return out


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """Sorted, overlapping word ranges as disjoint ones."""
    out: list[tuple[int, int]] = []
    for r in ranges:
        if out and r["from"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r["to"]))
        else:
            out.append((r["from"], r["to"]))
    return out


def _digest(batches):
    import pyarrow as pa

    for batch in small(batches, 1):
        ids, texts, lists = (batch.column(i) for i in range(3))
        total, removed, shas = [], [], []
        for i in range(len(batch)):
            words = texts[i].as_py().encode().split()
            cut = merged(lists[i].as_py() or [])
            total.append(len(words))
            removed.append(sum(b - a for a, b in cut))
            for a, b in reversed(cut):
                del words[a:b]
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def digests(docs: DataFrame, ranges: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row: what is left after the ranges of `repeated` are cut out.

    Null and empty texts have no words; null ids stay null; repeated rows repeat; other columns are ignored.
    """
    rows = identified(docs, id_col, text_col).join(ranges, ["doc", "u"], "left")
    back = F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")
    return rows.select(back, "text", "ranges").mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cut(text_at: int, ranges_at: int):
    """Text without the words of its ranges; a word goes with the white space after it."""

    def run(batches):
        import re

        import pyarrow as pa

        word = re.compile(rb"[^\x20\x09-\x0D]+")
        for batch in small(batches, text_at):
            texts, lists = batch.column(text_at), batch.column(ranges_at)
            out = []
            for i in range(len(batch)):
                text, ranges = texts[i].as_py(), lists[i].as_py()
                if ranges:
                    data = text.encode()
                    starts = [x.start() for x in word.finditer(data)] + [len(data)]
                    kept, last = [], 0
                    for a, b in merged(ranges):
                        kept.append(data[last : starts[a]])
                        last = starts[b]
                    text = b"".join([*kept, data[last:]]).decode()
                out.append(text)
            columns = [pa.array(out, pa.string()) if i == text_at else batch.column(i) for i in range(ranges_at)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:ranges_at])

    return run


def without(docs: DataFrame, ranges: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the ranges cut out of `text_col`; texts without ranges stay as they are, null too.

    n_chars, where the table has it, follows the text. Columns of any other name stay as they are.
    """
    doc, u, cuts = (free_name(docs, n) for n in ("doc", "u", "ranges"))
    keyed = docs.withColumn(doc, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn(u, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    side = ranges.select(F.col("doc").alias(doc), F.col("u").alias(u), F.col("ranges").alias(cuts))
    joined = keyed.join(side, [doc, u], "left").select(*docs.columns, cuts)
    cut = joined.mapInArrow(_cut(docs.columns.index(text_col), len(docs.columns)), docs.schema)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)
