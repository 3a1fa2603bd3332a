"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer.

Labellers vote good, bad or nothing on every document. Only the counts of vote patterns, at most 3^8 rows,
come to the driver, where expectation-maximisation finds how far each labeller can be trusted. The posterior
of a document's votes is its label; labels of a bounded sample train a scorer on hashed word shapes.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Stored, read_table
from quarry.llm.passages import WHITE_TABLE, Q, mixed, word_hashes
from quarry.llm.toxicity import BITS, MAX_ROWS, MAX_VALUES, Model, _parts, fitted

BAD, NONE, GOOD = 0, 1, 2
ROUNDS = 100
KEEP = 0.5
UPPER = bytes(range(65, 91))
LETTERS = bytes([*range(65, 91), *range(97, 123)])
SYMBOLS = b"%$#*&@!~^_=+<>|\\{}[]"
#: Letters and digits by class, everything else as it is: a word's shape.
SHAPE = np.array([65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256)], np.uint8)


MARKED = bytes(35 if bytes([c]) in [SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))] else c for c in range(256))
LABELLERS = 8


def votes(text: str | None) -> tuple[int, ...]:
    """The labellers' votes on a whole text.

    Seven know a defect each and say bad or nothing: symbols, words with symbols at their end, capitals,
    shouting, repeated words, little variety, separators. One says good or nothing: sentences.
    """
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return (NONE,) * 5 + (BAD, NONE, NONE)
    marked = data.translate(MARKED)
    symbols = (len(data) - len(data.translate(None, SYMBOLS))) / len(data)
    tails = (marked.count(b"## ") + marked.count(b"##\n")) / n
    capitals = len(data) - len(data.translate(None, UPPER))
    letters = len(data) - len(data.translate(None, LETTERS))
    repeats = sum(map(eq, words, words[1:])) / n
    variety = len(set(words)) / n
    separators = (data.count(b" | ") + data.count(b" |\n")) / n
    stops = (data.count(b". ") + data.count(b".\n") + data.count(b"? ") + (data[-1:] in (b".", b"?"))) / n
    shouts = (data.count(b"! ") + data.count(b"!\n")) / n
    return (
        BAD if symbols >= 0.03 else NONE,
        BAD if tails >= 0.1 and n >= 3 else NONE,
        BAD if letters >= 10 and capitals >= 0.3 * letters else NONE,
        BAD if shouts >= 0.1 and n >= 5 else NONE,
        BAD if repeats >= 0.15 and n >= 5 else NONE,
        BAD if variety <= 0.3 and 20 <= n <= 2000 else NONE,
        BAD if separators >= 0.08 and n >= 5 else NONE,
        GOOD if stops >= 0.03 else NONE,
    )


def _voted(batches):
    import pyarrow as pa

    for batch in batches:
        texts = batch.column(1)
        packed = [sum(v * 3**j for j, v in enumerate(votes(texts[i].as_py()))) for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.int32())], names=["row", "votes"])


def unpacked(pattern: int) -> list[int]:
    return [pattern // 3**j % 3 for j in range(LABELLERS)]


@dataclass
class LabelModel:
    """P(good), P(vote | class) for each labeller, and the posterior of every pattern seen."""

    prior: float
    table: np.ndarray
    posterior: dict[int, float]

    def accuracies(self) -> np.ndarray:
        """How often each labeller is right where it votes."""
        p = np.array([1 - self.prior, self.prior])[:, None]
        right = p[0] * self.table[:, 0, BAD] + p[1] * self.table[:, 1, GOOD]
        return right / (right + p[0] * self.table[:, 0, GOOD] + p[1] * self.table[:, 1, BAD])


def label_model(counts: dict[int, int], rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over counted vote patterns, from the majority's label."""
    patterns = sorted(counts)
    if not patterns:
        return LabelModel(0.5, np.full((LABELLERS, 2, 3), 1 / 3), {})
    v = np.array([unpacked(p) for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    post = np.where(bad > good, 0.1, np.where(bad == 0, 0.95, 0.5))
    for _ in range(rounds):
        weight = np.stack([n * (1 - post), n * post])
        prior = (weight[1].sum() + 1) / (n.sum() + 2)
        table = np.stack([[[(weight[y][v[:, j] == k].sum() + 1) / (weight[y].sum() + 3) for k in range(3)] for y in range(2)] for j in range(LABELLERS)])
        logs = np.log(np.array([1 - prior, prior]))[:, None] + sum(np.log(table[j][:, v[:, j]]) for j in range(LABELLERS))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -35, 35)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return LabelModel(float(prior), table, dict(zip(patterns, post.tolist())))


def shapes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, feature): which word shapes a text has, and by half powers of two in what share of words."""
    words, first = word_hashes(data, bounds)
    n_texts = len(bounds) - 1
    total = np.diff(first)
    text = np.repeat(np.arange(n_texts), total)
    white = WHITE_TABLE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(~white & (np.r_[True, white[:-1]] | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~white & (np.r_[white[1:], True] | edge[1:])) if len(data) else starts
    cls = SHAPE[data].astype(np.uint64) if len(data) else np.zeros(0, np.uint64)
    size = np.minimum(ends - starts, 3).astype(np.uint64)
    shape = (cls[starts] << np.uint64(32)) | (cls[ends] << np.uint64(16)) | (cls[np.maximum(ends - 1, starts)] << np.uint64(8)) | size
    again = np.flatnonzero((words[1:] == words[:-1]) & (text[1:] == text[:-1]))
    t = np.concatenate([text, text[again]])
    f = np.concatenate([shape, np.full(len(again), 1 << 40, np.uint64)])
    key = mixed(f * Q + t.astype(np.uint64))
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    share = np.floor(-2 * np.log2(count / total[t[at]])).astype(np.uint64)
    feature = (mixed(f[at] * Q + share) >> np.uint64(64 - BITS)).astype(np.int64)
    codes = np.unique(t[at].astype(np.int64) << BITS | feature)
    return codes >> BITS, codes & ((1 << BITS) - 1)


def _scored(model, posterior):
    def run(batches):
        import pyarrow as pa

        m, post = model.value, posterior.value
        weight = m.dense()
        for batch in batches:
            texts = batch.column(1)
            score, label = np.zeros(len(batch)), []
            for at, end, data, bounds in _parts(texts):
                text, feature = shapes(data, bounds)
                score[at:end] = m.bias + np.bincount(text, weights=weight[feature], minlength=end - at)
            for i in range(len(batch)):
                label.append(post.get(sum(v * 3**j for j, v in enumerate(votes(texts[i].as_py()))), 0.5))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label), pa.array(1 / (1 + np.exp(-np.clip(score, -35, 35))))], names=["doc_id", "posterior", "score"])

    return run


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_values: int = MAX_VALUES) -> tuple[LabelModel, Model]:
    """The label model of all documents' votes, and the scorer of at most `max_rows` of them, by least hash.

    Rows that repeat an id and a text are one for the scorer; null texts count as empty. An empty table gives a label
    model without patterns and a scorer without weights.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(id_col).cast("long"), text).alias("o"), text.alias("text"))
    voted = Stored(rows.mapInArrow(_voted, "row long, votes int"), "votes")
    labels = label_model({r["votes"]: r["count"] for r in voted.df.groupBy("votes").count().collect()})
    chosen = voted.df.select(F.col("row").alias("o"), "votes").distinct().orderBy("o", "votes").limit(max_rows)
    # at most max_rows rows of two numbers, and 3^LABELLERS posteriors
    sample = rows.join(F.broadcast(chosen), "o").dropDuplicates(["o", "votes"])
    posterior = docs.sparkSession.createDataFrame([(v, p) for v, p in labels.posterior.items()], "votes int, label double")
    sample = sample.join(F.broadcast(posterior), "votes").select("o", F.lit(0).cast("long").alias("th"), "label", "text")
    scorer = fitted(sample, shapes, max_values, l1=1.0, positive=1.0)
    voted.drop()
    return labels, scorer


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP) -> DataFrame:
    """doc_id, posterior (of the labellers' votes), score (of the linear scorer) and keep, for every whole text.

    Null texts count as empty; an empty text's score is the scorer's bias. No labels are read. Repeated rows
    stay, other columns are ignored, an empty table gives an empty result.
    """
    labels, scorer = fit(docs, id_col=id_col, text_col=text_col)
    context = docs.sparkSession.sparkContext
    # at most 2^BITS weights and 3^LABELLERS posteriors
    run = _scored(context.broadcast(scorer), context.broadcast(labels.posterior))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, posterior double, score double").withColumn("keep", F.col("score") >= keep_from)


def op3_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's posterior, score and decision; for nulls, repeats and empty tables see `quality`."""
    return quality(read_table(spark, sf_dir, "documents"))
