"""A training corpus from `documents`: five stages, each written and read again as the next one's input.

Toxic documents go, then all but one of equal texts, then all but one of each group of near copies, then
repeated passages, and what is left is packed into token sequences. All but the last stage return the
columns of documents. SQL cannot express the first and the last stage, so there is no ORACLE_SQL; the tests
hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import exact_dedup, jaccard, packing, suffixes, toxicity
from quarry.llm.common import Stored, bounded_batches, read_table, release

ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below the threshold, by a classifier fitted on the labels outside of the held-out third.

    Null and empty texts have the bias's score and stay; repeated rows go or stay together; whole texts are scored.
    An empty table stays empty, and columns keep their names.
    """
    bounded_batches(spark)
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside: the longest original, then the least id.

    Null and empty texts are one group; null ids come last; of rows that repeat id and text one stays; an empty table stays empty.
    """
    bounded_batches(spark)
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a five-word Jaccard similarity of 0.8 or more: the least id.

    Wordless texts are one component; null ids come last; rows of other components stay even if they repeat an id.
    """
    bounded_batches(spark)
    return jaccard.near_dedup(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words of fifty-word passages that a document of lesser id has; all rows and columns stay.

    Null texts stay null, texts of any length are whole, rows that repeat an id are told apart; an empty table stays empty.
    """
    bounded_batches(spark)
    return suffixes.suffix_dedup(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' token ids, each with its place in a sequence.

    Null and empty texts are their end id alone; repeated rows are packed as often as they occur; an empty table gives no piece.
    """
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_passages),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus: what the last stage returns."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        now = Stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            before.drop()
        release(spark)
        docs, before = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)
