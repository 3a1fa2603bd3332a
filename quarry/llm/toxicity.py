"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate rates and an L1 term leave few weights; these, at most 2^BITS, are all that is broadcast.
A fit is one task over a stored sample of bounded rows and values; only its weights come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm.common import Stored, free_name, read_table
from quarry.llm.passages import P, Q, R, mixed, sliced, word_hashes

BITS = 18
#: The bounds of a fit: rows, by least hash, and features in all of them.
MAX_ROWS, MAX_VALUES = 12_000, 24_000_000
#: Bytes of text whose features are worked out at once: each byte takes some hundred more.
SLICE = 1 << 18
EPOCHS = 3
THRESHOLD = 0.7
#: A word's first so many bytes are features too: one n-gram for all inflections.
STEMS = (4, 6)
#: A-Z to a-z.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Every ASCII byte but letters and digits parts words.
PARTING = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float64)
        out[self.index] = self.weight
        return out


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, feature) of each text's different features: words, their stems, word pairs, pairs over one word."""
    data = LOWER[data]
    words, first = word_hashes(data, bounds, PARTING)
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(first))
    found = [(text, mixed(words ^ P))] + [(text, mixed(word_hashes(data, bounds, PARTING, n)[0] ^ np.uint64(n))) for n in STEMS]
    for gap, factor in ((1, Q), (2, R)):
        inside = text[:-gap] == text[gap:]
        found.append((text[:-gap][inside], mixed(words[:-gap] * factor + words[gap:])[inside]))
    codes = np.unique(np.concatenate([(t << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)) for t, h in found]))
    return (codes >> np.uint64(BITS)).astype(np.int64), (codes & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _parts(texts):
    """A string array in slices: (first row, end, bytes, bounds)."""
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    for at, end, offsets in sliced(texts, SLICE):
        yield at, end, data[offsets[0] : offsets[-1]], offsets - offsets[0]


def collected(of):
    """(o, th, label, text) to (o, th, label, features as bytes), by the features `of` slices of texts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, end, data, bounds in _parts(batch.column(3)):
                text, feature = of(data, bounds)
                cut = np.searchsorted(text, np.arange(end - at + 1))
                packed = [feature[cut[i] : cut[i + 1]].astype("<u4").tobytes() for i in range(end - at)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[at:end] for i in range(3)), pa.array(packed, pa.binary())], names=["o", "th", "label", "features"])

    return run


def ftrl(rows: list[tuple[int, np.ndarray]], *, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 1.0, epochs: int = EPOCHS, positive: float = 2.0) -> Model:
    """Fits (label, features) in the order given, `epochs` times; the last coordinate is the bias, without L1."""
    n, z = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    lasso = np.full((1 << BITS) + 1, l1)
    lasso[-1] = 0

    def weights(at):
        return np.where(np.abs(z[at]) <= lasso[at], 0.0, (np.sign(z[at]) * lasso[at] - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for label, feature in rows:
            at = np.append(feature.astype(np.int64), 1 << BITS)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            if label:
                g *= positive
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / alpha * w
            n[at] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    index = np.flatnonzero(w[:-1])
    return Model(index, w[index], float(w[-1]))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def level(sizes: list[int], total: int) -> int:
    """The greatest bound that leaves at most `total` of the sizes together, each cut to the bound."""
    left, rest = total, sorted(sizes)
    for i, size in enumerate(rest):
        if size * (len(rest) - i) > left:
            return left // (len(rest) - i)
        left -= size
    return max(rest, default=0)


def sampled(feature: np.ndarray, most: int) -> np.ndarray:
    """The features, or those `most` of least hash, in their order."""
    if len(feature) <= most:
        return feature
    mixed = feature.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)
    return feature[np.sort(np.argsort(mixed, kind="stable")[:most])]


def _fit(most: int, options: dict):
    """Sorted rows (o, th, label, features) to one row: the model that FTRL finds with at most `most` features a text."""

    def run(batches):
        import pyarrow as pa

        rows = [(label, sampled(np.frombuffer(packed.as_py(), "<u4"), most)) for batch in batches for label, packed in zip(batch.column(2).to_pylist(), batch.column(3))]
        m = ftrl(rows, **options)
        yield pa.RecordBatch.from_arrays([pa.array([m.index.astype("<i8").tobytes()], pa.binary()), pa.array([m.weight.astype("<f8").tobytes()], pa.binary()), pa.array([m.bias])], names=["index", "weight", "bias"])

    return run


def fitted(sample: DataFrame, of, max_values: int, **options) -> Model:
    """FTRL's model of a bounded sample (o, th, label, text), in the order of its first three columns.

    Where the features are more than `max_values`, the longest texts keep a sample of theirs, those of least hash, so that
    every row takes part. An empty sample gives a model without weights.
    """
    found = Stored(sample.select("o", "th", F.col("label").cast("double").alias("label"), "text").mapInArrow(collected(of), "o long, th long, label double, features binary"), "sample")
    sizes = [r[0] for r in found.df.select((F.length("features") / 4).cast("int")).collect()]  # at most as many as the sample's rows
    rows = found.df.coalesce(1).sortWithinPartitions("o", "th", "label").mapInArrow(_fit(level(sizes, max_values), options), "index binary, weight binary, bias double").collect()
    found.drop()
    if not rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    return Model(np.frombuffer(rows[0]["index"], "<i8"), np.frombuffer(rows[0]["weight"], "<f8"), rows[0]["bias"])


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_values: int = MAX_VALUES) -> Model:
    """Learns from labelled rows outside the held-out third: at most `max_rows`, those of least hash of the id.

    Null labels and ids count as none, null texts as empty; rows that repeat an id, a label and a text count once,
    and different texts of one id are rows of their own. Without any row the model has no weights and scores 0.5.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).distinct().withColumn("o", F.xxhash64("id"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    # both sides that are broadcast have at most max_rows rows of a few numbers
    some = F.broadcast(known.orderBy("o", "id", "label").limit(max_rows))
    chosen = rows.select("id", "th").join(some, "id").distinct().orderBy("o", "th", "label").limit(max_rows)
    sample = rows.join(F.broadcast(chosen), ["id", "th"]).dropDuplicates(["id", "th", "label"])
    return fitted(sample, features, max_values)


def _scored(model, keep: list[int], text_at: int, names: list[str]):
    def run(batches):
        import pyarrow as pa

        m = model.value
        weight = m.dense()
        for batch in batches:
            texts = batch.column(text_at)
            if texts.null_count:
                texts = texts.fill_null("")
            score = np.zeros(len(batch))
            for at, end, data, bounds in _parts(texts):
                text, feature = features(data, bounds)
                score[at:end] = m.bias + np.bincount(text, weights=weight[feature], minlength=end - at)
            score = 1 / (1 + np.exp(-np.clip(score, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(score)], names=names)

    return run


def with_score(docs: DataFrame, model: Model, *, keep: list[str] | None = None, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` (its columns `keep`, or all) with the score of each whole text; null and empty texts get the bias's.

    Repeated rows repeat, very long texts count whole, an empty table stays empty. `out` must be no column of `keep`.
    """
    keep = list(docs.columns if keep is None else keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^BITS weights
    columns = list(dict.fromkeys([*keep, text_col]))
    chosen = docs.select(*columns)
    schema = StructType([*(chosen.schema[c] for c in keep), StructField(out, DoubleType())])
    return chosen.mapInArrow(_scored(sent, [columns.index(c) for c in keep], columns.index(text_col), [*keep, out]), schema)


def op7_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; for nulls, repeats and empty texts see `fit` and `with_score`."""
    docs = read_table(spark, sf_dir, "documents")
    scored = with_score(docs, fit(docs, read_table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score is below the threshold, with the columns they came with, whatever their names.

    Null and empty texts have the bias's score, repeated rows go or stay together, an empty table stays empty.
    """
    score = free_name(docs, "score")
    return with_score(docs, fit(docs, labels), out=score).where(F.col(score) < threshold).drop(score)
