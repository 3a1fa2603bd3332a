"""Cross-tokenizer alignment by a group dictionary.

The byte offsets where tokens of both tokenizers end cut a text into groups of A-ids and B-ids. Documents are read in
blocks; a block interns its groups, so that a document becomes a list of small numbers and a group travels
once a block, with how often it stands there. In the corpus-wide dictionary, sorted by group, the links of a group
(its overlapping A-B token pairs) are expanded once and multiplied by its frequency into counts of id pairs; each
group is then valued by these counts, and its values go back to the blocks, where documents sum them.

Neither tokenizer joins what lies before a space to what lies after it where letters, digits or punctuation stand
on both sides, so texts are cut there, and each different cut is encoded and grouped once a worker.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Stored, read_table, shuffle_partitions
from quarry.llm.packing import PATTERN, SPECIAL, byte_letters, default_vocabulary
from quarry.llm.unigram import MARK, default_model

#: A space between two visible characters of ASCII, Latin-1 or the Latin extensions, and a space that is not.
CUT = re.compile(r"(?<=[!-~¡-ɏ]) (?=[!-~¡-ɏ])")
ODD = re.compile(r"^ | $|[^!-~¡-ɏ] | [^!-~¡-ɏ]")
#: Cuts that a worker remembers, how many are encoded at once, and code points of texts that are read at once.
CACHE, SLICE, SLICE_CHARS = 500_000, 20_000, 1 << 20
#: A block ends at so many documents, at so many interned numbers, or when the worker forgets its cuts, and always
#: after a whole slice of texts.
BLOCK_DOCS, BLOCK_IDS = 1 << 14, 1 << 21
#: Pair counts that a kernel gathers before it sends them on.
PAIRS_HELD = 1 << 18
#: Id pairs up to which their counts are broadcast; with more the links are joined with them.
PAIRS_SENT = 1 << 20
SALTS = 32
OUT_ROWS, DOCS_OUT = 8192, 512

BLOCKS = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, ids array<int>, times array<int>, key string, gid int, freq long"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def pieces_of_b(model: bytes) -> list[bytes]:
    """The bytes that each id of a SentencePiece model stands for."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]


def pieces_of_a(vocabulary: str) -> dict[int, bytes]:
    """The bytes that each id of a byte-level vocabulary stands for."""
    letters = byte_letters()
    return {i: bytes(letters[c] for c in piece) for piece, i in json.loads(vocabulary)["model"]["vocab"].items() if piece not in SPECIAL}


class Grouper:
    """Cuts of texts to the groups of their tokens, which are interned: numbers stand for keys like "a1,a2|b1"."""

    def __init__(self, vocabulary: str, model: bytes):
        import sentencepiece
        import tiktoken

        a_bytes = pieces_of_a(vocabulary)
        self.b_bytes = pieces_of_b(model)
        self.a_size = np.array([len(a_bytes.get(i, b"")) for i in range(max(a_bytes) + 1)])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.encode_a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={p: i for i, p in a_bytes.items()}, special_tokens={}).encode_ordinary
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.clear()

    def clear(self) -> None:
        """Forget all cuts and groups, so that numbers start anew."""
        self.known: dict[str, bytes | None] = {}
        self.numbers: dict[str, int] = {}
        self.keys: list[str] = []
        self.tokens: list[tuple[int, int]] = []  # how many A and B tokens each key has

    def intern(self, key: str, n_a: int, n_b: int) -> int:
        number = self.numbers.setdefault(key, len(self.keys))
        if number == len(self.keys):
            self.keys.append(key)
            self.tokens.append((n_a, n_b))
        return number

    def learn(self, cuts: list[str]) -> None:
        """Finds the groups of cuts, all at once: both tokenizers' ends meet as positions in the joined bytes."""
        spelled = [b" " + c.encode() for c in cuts]
        b_lists = self.sp.encode(cuts, num_threads=1)
        b = np.fromiter(chain.from_iterable(b_lists), np.int64)
        if b"".join(map(self.b_bytes.__getitem__, b.tolist())) != b"".join(spelled):
            bad = [b"".join(map(self.b_bytes.__getitem__, x)) != s for x, s in zip(b_lists, spelled)]
            self.known.update((c, None) for c, x in zip(cuts, bad) if x)
            return self.learn([c for c, x in zip(cuts, bad) if not x])
        if not cuts:
            return None
        a = np.fromiter(chain.from_iterable(self.encode_a(" " + c) for c in cuts), np.int64)
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        to_a, to_b = np.searchsorted(ends_a, common) + 1, np.searchsorted(ends_b, common) + 1
        from_a, from_b = np.r_[0, to_a[:-1]], np.r_[0, to_b[:-1]]
        n_a, n_b = to_a - from_a, to_b - from_b
        numbers = np.zeros(len(common), np.int32)
        plain = (n_a == 1) & (n_b == 1)
        codes, where = np.unique(a[from_a[plain]] << 32 | b[from_b[plain]], return_inverse=True)
        numbers[plain] = np.array([self.intern(f"{c >> 32}|{c & 0xFFFFFFFF}", 1, 1) for c in codes.tolist()], np.int32)[where]
        a, b = a.tolist(), b.tolist()
        for i in np.flatnonzero(~plain).tolist():
            mine, other = a[from_a[i] : to_a[i]], b[from_b[i] : to_b[i]]
            numbers[i] = self.intern(f"{','.join(map(str, mine))}|{','.join(map(str, other))}", len(mine), len(other))
        data = numbers.tobytes()
        at = 0
        for cut, end in zip(cuts, ((np.searchsorted(common, np.cumsum([len(x) for x in spelled])) + 1) * 4).tolist()):
            self.known[cut] = data[at:end]
            at = end

    def groups(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's groups in order, by number; none where B does not give the text's bytes back."""
        found = [(CUT.split(t) if ODD.search(t) else t.split(" ")) if t and MARK not in t else [] for t in texts]
        new = list(set(chain.from_iterable(found)).difference(self.known))
        for at in range(0, len(new), SLICE):
            self.learn(new[at : at + SLICE])
        out = []
        for f in found:
            parts = list(map(self.known.__getitem__, f))
            out.append(np.frombuffer(b"" if None in parts else b"".join(parts), np.int32))
        return out


_GROUPERS: dict[int, Grouper] = {}


def grouper_of(vocabulary: str, model: bytes) -> Grouper:
    """The worker's grouper; later tasks of the worker find its cache warm."""
    key = hash((vocabulary, model))
    if key not in _GROUPERS:
        _GROUPERS.clear()
        _GROUPERS[key] = Grouper(vocabulary, model)
    return _GROUPERS[key]


class Block:
    """One block of documents: their rows, and the dictionary of their groups, by a grouper's numbers."""

    def __init__(self, number: int, grouper: Grouper):
        self.number = number
        self.grouper = grouper
        self.rows: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id, groups: np.ndarray) -> None:
        numbers, times = np.unique(groups, return_counts=True)
        tokens = [self.grouper.tokens[x] for x in numbers.tolist()]
        n_a, n_b = (sum(t[k] * n for t, n in zip(tokens, times.tolist())) for k in range(2))
        keys = self.grouper.keys
        sha = hashlib.sha256(";".join([keys[x] for x in groups.tolist()]).encode()).hexdigest() if len(groups) else ""
        self.rows.append((doc_id, n_a, n_b, len(groups), sha))
        self.ids.append(numbers)
        self.times.append(times.astype(np.int32))
        self.held += len(numbers)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_DOCS or self.held >= BLOCK_IDS or len(self.grouper.known) >= CACHE

    def batches(self, schema, documents: bool):
        import pyarrow as pa

        ends = np.cumsum([0, *map(len, self.ids)]).astype(np.int32)
        used, ids = np.unique(np.concatenate(self.ids), return_inverse=True)
        times = np.concatenate(self.times)
        freq = np.bincount(ids, None if documents else times, len(used)).astype(np.int64)
        n, m = len(self.rows), len(used)
        columns = zip(*self.rows)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (ids, times)]
        head = dict(zip(("doc_id", "n_a", "n_b", "n_groups", "groups_sha256"), columns)) | {"ids": lists[0], "times": lists[1]}
        tail = {"key": [self.grouper.keys[x] for x in used.tolist()], "gid": np.arange(m), "freq": freq}
        for given, size, step in ((head, n, DOCS_OUT), (tail, m, OUT_ROWS)):
            given["block"] = np.full(size, self.number)
            whole = pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(size, f.type) for f in schema], schema=schema)
            for at in range(0, size, step):
                yield whole.slice(at, step)


def _blocks(vocabulary, model, documents: bool):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        lists = pa.list_(pa.int32())
        schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("ids", lists), ("times", lists), ("key", pa.string()), ("gid", pa.int32()), ("freq", pa.int64())])
        grouper = grouper_of(vocabulary.value, model.value)
        block = Block(TaskContext.get().partitionId() << 32, grouper)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                part, size = [], 0
                while at + len(part) < len(ids) and size < SLICE_CHARS:
                    part.append(texts[at + len(part)].as_py())
                    size += len(part[-1] or "")
                for doc_id, groups in zip(ids[at:], grouper.groups(part)):
                    block.add(doc_id, groups)
                at += len(part)
                if block.full():
                    yield from block.batches(schema, documents)
                    block = Block(block.number + 1, grouper)
                    if len(grouper.known) >= CACHE:
                        grouper.clear()
        if block.rows:
            yield from block.batches(schema, documents)

    return run


def links(key: str, a_size, b_size) -> Counter:
    """The overlapping pairs of a group, by id pair: how many of its token occurrences overlap."""
    a, b = ([int(x) for x in side.split(",")] for side in key.split("|"))
    found: Counter = Counter()
    i = j = 0
    end_a, end_b = a_size[a[0]], b_size[b[0]]
    while True:
        found[a[i], b[j]] += 1
        if end_a == end_b:  # both end, which is the end of the group
            return found
        if end_a < end_b:
            i += 1
            end_a += a_size[a[i]]
        else:
            j += 1
            end_b += b_size[b[j]]


def _pair_counts(sizes):
    """Dictionary rows sorted by key to partial counts of id pairs: links are expanded once a run of equal keys."""

    def run(batches):
        import pyarrow as pa

        held: Counter = Counter()
        a_size, b_size = sizes.value

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array([p[0] for p in held], pa.int32()), pa.array([p[1] for p in held], pa.int32()), pa.array(held.values(), pa.int64())], names=["a", "b", "n"])
            held.clear()
            return out

        for batch in batches:
            last, total = None, 0
            for key, freq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != last:
                    if last is not None:
                        for pair, k in links(last, a_size, b_size).items():
                            held[pair] += k * total
                    last, total = key, 0
                total += freq
            if last is not None:
                for pair, k in links(last, a_size, b_size).items():
                    held[pair] += k * total
            if len(held) >= PAIRS_HELD:
                yield emit()
        if held:
            yield emit()

    return run


VALUES = "block long, gid int, n_links long, n_best long, count_sum long"


def _values(sizes, counts):
    """Dictionary rows sorted by key to their values (links, best links, sum of counts), worked out once a run of keys."""

    def run(batches):
        import pyarrow as pa

        (a_size, b_size), (pairs, n, best) = sizes.value, counts.value
        for batch in batches:
            keys = batch.column(2).to_pylist()
            out = np.zeros((len(keys), 3), np.int64)
            starts = [i for i, key in enumerate(keys) if not i or key != keys[i - 1]]
            codes, times, owner = [], [], []
            for r, i in enumerate(starts):
                for (a, b), k in links(keys[i], a_size, b_size).items():
                    codes.append(a << 32 | b)
                    times.append(k)
                    owner.append(r)
            at = np.searchsorted(pairs, np.array(codes, np.int64))
            times, owner = np.array(times, np.int64), np.array(owner)
            per = [np.zeros(len(starts), np.int64) for _ in range(3)]
            for total, x in zip(per, (times, times * best[at], times * n[at])):
                np.add.at(total, owner, x)
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(keys)]))
            for k in range(3):
                out[:, k] = per[k][run_of]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(out[:, k]) for k in range(3))], names=["block", "gid", "n_links", "n_best", "count_sum"])

    return run


def _expanded(sizes):
    """Groups to their links: key, a, b, times."""

    def run(batches):
        import pyarrow as pa

        a_size, b_size = sizes.value
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at in range(0, len(keys), OUT_ROWS):
                rows = [(key, a, b, k) for key in keys[at : at + OUT_ROWS] for (a, b), k in links(key, a_size, b_size).items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["key", "a", "b", "times"])

    return run


def _summed(docs, values):
    """One block's documents and its groups' values to the documents' digests."""
    import pyarrow as pa

    table = np.zeros((values.num_rows, 3), np.int64)
    gid = np.asarray(values.column("gid"))
    for k, name in enumerate(("n_links", "n_best", "count_sum")):
        table[gid, k] = np.asarray(values.column(name))
    lists = docs.column("ids").combine_chunks(), docs.column("times").combine_chunks()
    ids, times = (np.asarray(x.flatten()) for x in lists)
    owner = np.repeat(np.arange(docs.num_rows), np.asarray(lists[0].value_lengths()))
    out = np.zeros((docs.num_rows, 3), np.int64)
    for k in range(3):
        np.add.at(out[:, k], owner, table[ids, k] * times)
    return pa.table([*(docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), *(pa.array(out[:, k]) for k in range(3)), docs.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


class Alignment:
    """The groups of a corpus, the counts of its id pairs, and each document's digest.

    `weight` says what a group's links are multiplied by: "links" (how often the group stands in the corpus) or
    "documents" (in how many documents). Null and empty texts, and texts that a tokenizer does not give back byte by
    byte after a leading space, have no tokens. Whole texts are read, whatever their length; rows that repeat
    count again; other columns are ignored; an empty table gives empty results. `vocabulary` and `model` are
    paths that only the driver reads.
    """

    def __init__(self, docs: DataFrame, *, vocabulary: str | None = None, model: str | None = None, weight: str = "links", id_col: str = "doc_id", text_col: str = "text"):
        if weight not in ("links", "documents"):
            raise ValueError(f"weight is links or documents, not {weight}")
        self.spark = docs.sparkSession
        with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
            words = f.read()
        with open(model or default_model(), "rb") as f:
            pieces = f.read()
        send = self.spark.sparkContext.broadcast  # vocabularies, whatever the input's size
        a, b = pieces_of_a(words), pieces_of_b(pieces)
        self.sizes = send(([len(a.get(i, b"")) for i in range(max(a) + 1)], [len(x) for x in b]))
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.blocks = Stored(rows.mapInArrow(_blocks(send(words), send(pieces), weight == "documents"), BLOCKS), "align-blocks").df
        entries = self.blocks.where("key IS NOT NULL").select("block", "gid", "key", "freq")
        self.entries = Stored(entries.repartition(shuffle_partitions(self.spark), "key").sortWithinPartitions("key"), "align-groups").df

    def groups(self) -> DataFrame:
        """The dictionary: each different group ("a1,a2|b1") and its frequency."""
        return self.entries.groupBy("key").agg(F.sum("freq").alias("freq"))

    def pairs(self) -> DataFrame:
        """Each linked id pair with its count over the corpus, and whether this is its B id's highest: a, b, n, best."""
        found = self.entries.select("key", "freq").mapInArrow(_pair_counts(self.sizes), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        pairs = Stored(found, "align-pairs").df
        top = pairs.groupBy("b").agg(F.max("n").alias("top"))
        return pairs.join(F.broadcast(top), "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))  # a row for each of B's ids at most

    def values(self, sent: int = PAIRS_SENT) -> DataFrame:
        """What each block's groups are worth: links, links whose count is their B id's highest, sum of counts.

        Up to `sent` id pairs go to the tasks as three arrays. With more the links are joined with the pairs; a pair
        can be common to very many groups, so both sides are salted.
        """
        pairs = self.pairs()
        if pairs.count() <= sent:
            table = pairs.select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("code"), "n", F.col("best").cast("long").alias("best")).sort("code").toArrow()
            counts = self.spark.sparkContext.broadcast(tuple(np.asarray(table.column(c).combine_chunks()) for c in ("code", "n", "best")))
            return self.entries.select("block", "gid", "key").mapInArrow(_values(self.sizes, counts), VALUES)
        salt = F.pmod(F.xxhash64("key"), F.lit(SALTS))
        rows = self.groups().select("key").mapInArrow(_expanded(self.sizes), "key string, a int, b int, times long").withColumn("salt", salt)
        copies = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = rows.join(copies, ["a", "b", "salt"])
        per = met.groupBy("key").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        return self.entries.join(per, "key").select("block", "gid", "n_links", "n_best", "count_sum")

    def digests(self, sent: int = PAIRS_SENT) -> DataFrame:
        """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
        docs = self.blocks.where("key IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "ids", "times")
        # a block's documents and groups are bounded, so they fit a task
        return docs.groupBy("block").cogroup(self.values(sent).groupBy("block")).applyInArrow(_summed, DIGEST)


def op12_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between the two public vocabularies; for edge cases see `Alignment`."""
    return Alignment(read_table(spark, sf_dir, "documents")).digests()
