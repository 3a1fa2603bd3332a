"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (what lies between line feeds). Each paragraph is hashed to a wide
vector: the paragraph as a whole and each of its different shingles add 1 or -1 to every one of 128 lanes, by the bits of two
64-bit hashes. A fingerprint is the sum of its paragraphs' vectors, each lane modulo 2^32. So the order of the
paragraphs is nothing to it, `added` and `removed` insert and delete paragraphs without the rest of the text, and the
cosine of two vectors estimates how much of their content two texts share.

Everything here is DataFrame functions. Two lanes share a long while sums are gathered; a text's features leave the
row by `explode` and meet again in a hash aggregation of the same stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import read_table, shuffle_partitions

LANES = 128
#: Shingles of three words; a paragraph with fewer than FEW has its runs of three characters instead.
FEW = 4
SHINGLE = r"(?<!\S)(?=(\S++\s++\S++\s++\S++))"
TWO = (1 << 32) + 1
#: A second hash's first argument.
SALT = "second"


def paragraphs(text: Column) -> Column:
    """What lies between line feeds; null and the empty text are one empty paragraph."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def feature_rows(rows: DataFrame, text: str) -> DataFrame:
    """A row for each feature of each paragraph of the column `text`, which goes; the others stay.

    A paragraph's features are the paragraph itself and its different shingles of three words, or of three
    characters where it has fewer than FEW of the former.
    """
    own = rows.withColumn("paragraph", F.explode(paragraphs(F.col(text)))).drop(text)
    own = own.withColumn("words", F.regexp_extract_all("paragraph", F.lit(SHINGLE), F.lit(1)))
    letters = F.transform(F.sequence(F.lit(1), F.greatest(F.length("paragraph") - 2, F.lit(1))), lambda i: F.substring("paragraph", i, F.lit(3)))
    shingles = F.array_distinct(F.when(F.size("words") >= FEW, F.col("words")).otherwise(letters))
    return own.withColumn("feature", F.explode(F.concat(F.array("paragraph"), shingles))).drop("paragraph", "words")


def lane_sums(feature: Column) -> list[Column]:
    """Aggregates: how many features set each bit of their two hashes (two bits a long), and how many there are."""
    hashes = [F.xxhash64(feature), F.xxhash64(F.lit(SALT), feature)]
    bits = [F.sum(F.shiftright(h, j).bitwiseAND(F.lit(TWO))).alias(f"s{i * 32 + j}") for i, h in enumerate(hashes) for j in range(32)]
    return [*bits, F.count(F.lit(1)).alias("n")]


def vector() -> Column:
    """The signed lanes of a row of `lane_sums`."""
    low = [F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(64)]
    high = [F.shiftrightunsigned(F.col(f"s{k}"), 32) for k in range(64)]
    return F.array(*[c * 2 - F.col("n") for c in (*low, *high)])


def as_text(lanes: Column) -> Column:
    """Lanes modulo 2^32, eight hex digits each."""
    return F.array_join(F.transform(lanes, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def lanes_of(fingerprint: Column) -> Column:
    """The signed lanes of a fingerprint."""
    half = 1 << 31
    found = F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: F.conv(F.substring(fingerprint, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.transform(found, lambda x: (x + half) % (2 * half) - half)


def added(fingerprint: Column, other: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return as_text(F.zip_with(lanes_of(fingerprint), lanes_of(other), lambda a, b: a + b))


def removed(fingerprint: Column, other: Column) -> Column:
    """The fingerprint without the paragraphs of the other."""
    return as_text(F.zip_with(lanes_of(fingerprint), lanes_of(other), lambda a, b: a - b))


def likeness(a: Column, b: Column) -> Column:
    """How alike two vectors are, from 0 to 1: 1 where they are equal, else their cosine, less than nothing being 0."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda t, z: t + z)

    size = F.sqrt(dot(a, a) * dot(b, b))
    cosine = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / size))).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(cosine)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of `docs`: doc_id and fingerprint, 1,024 hex digits.

    Texts with the same paragraphs in any order have equal fingerprints; others have not, but for a chance of
    about 2^-128. Null counts as empty; whole texts of any length are read, none is cut; repeated rows stay;
    other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = feature_rows(rows, "text")
    return found.groupBy("row", "doc_id").agg(*lane_sums(F.col("feature"))).select("doc_id", as_text(vector()).alias("fingerprint"))


def _splits(ids: DataFrame, n: int) -> list[int]:
    """About n numbers that cut the ids into equal parts, filled up to one less than a power of two."""
    found = ids.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 8 * n))).first()[0] or []
    return sorted(found) + [2**63 - 1] * ((1 << (len(found)).bit_length()) - 1 - len(found))


def _below(splits: list[int], value: Column, strictly: bool) -> Column:
    """How many splits are at most (or below) the value, by halving steps over the sorted array."""
    steps, w = [], (len(splits) + 1) // 2
    while w:
        steps.append(w)
        w //= 2
    if not steps:
        return F.lit(0)
    numbers = F.array(*[F.lit(s).cast("long") for s in splits])

    def step(at, w):
        s = F.element_at(numbers, (at + w).cast("int"))
        return F.when(s < value if strictly else s <= value, at + w).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def in_parts(rows: DataFrame, n: int) -> DataFrame:
    """Adds `part`, so that by descending (part, then id, then hash `h`) all rows stand in descending order of ids.

    Cuts are percentiles of the ids. Rows of one id that fills several parts, and rows without an id, which come
    last, are dealt over parts by the hash, so only rows that repeat id and text must lie together.
    """
    splits = _splits(rows, n)
    share = (F.shiftright("h", 12) + F.lit(1 << 51)) / F.lit(float(1 << 52))  # 0 to 1, ascending with h
    low, high = _below(splits, F.col("doc_id"), True), _below(splits, F.col("doc_id"), False)
    own = high - F.floor(share * (high - low + 1)).cast("int")
    return rows.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(-1) - F.floor(share * n).cast("int")).otherwise(own))


def edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next text's are.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the
    next document's, by descending doc_id; after the last document comes the first, so a single one follows
    itself. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty. Rows that share an id follow one another by a hash of their text; rows without
    an id come last in the same way. Long texts are whole, other columns are ignored, an empty table gives an
    empty result. The table is shuffled once, into `parts` ranges of ids (eight a shuffle partition); each part
    also gets a copy of the first row of the part after it, which is the only thing that parts tell each other.
    """
    spark = docs.sparkSession
    n = parts or 8 * shuffle_partitions(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = in_parts(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")), n)
    # the first row of each part, one small row a part
    key = F.struct(F.col("doc_id").isNull().alias("z"), (-F.col("doc_id")).alias("d"), F.col("h").alias("h"))
    firsts = rows.groupBy("part").agg(F.min(key).alias("k"))
    order = Window.orderBy(F.col("part").desc())  # over at most 2n small rows
    to = F.coalesce(F.lag("part").over(order), F.last("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = firsts.select(F.col("part").alias("of"), to.alias("to"), (-F.col("k.d")).alias("id"), F.col("k.h").alias("hh"))
    met = (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hh"))
    copies = rows.join(F.broadcast(heads), met).dropDuplicates(["of"])
    both = rows.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "text", "h", F.col("to").alias("part"), F.lit(True).alias("copy")))

    follow = Window.partitionBy("part").orderBy("copy", F.col("doc_id").desc_nulls_last(), "h", "text")
    size = F.length("text")
    kept = F.concat(F.substring("text", F.lit(1), size - F.floor(size / 3).cast("int")), F.substring("next", F.lit(1), F.floor(size / 3).cast("int")))
    pairs = both.select("*", F.lead("text").over(follow).alias("next"), F.row_number().over(follow).alias("rn"))
    pairs = pairs.select("part", "rn", "copy", "doc_id", "text", size.cast("long").alias("n_chars"), kept.alias("edited"))
    texts = pairs.select("part", "rn", "copy", "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("which", "text"))
    found = feature_rows(texts.where("which = 0 OR NOT copy"), "text")
    sums = found.groupBy("part", "rn", "which", "copy", "doc_id", "n_chars", "edited_sha256").agg(*lane_sums(F.col("feature")))
    vectors = sums.select("part", "rn", "which", "copy", "doc_id", "n_chars", "edited_sha256", vector().alias("v"))
    # a text's vector, its edited text's and the next text's stand one after the other
    beside = Window.partitionBy("part").orderBy("rn", "which")
    met = vectors.select("*", F.lead("v", 1).over(beside).alias("ve"), F.lead("v", 2).over(beside).alias("vn")).where("which = 0 AND NOT copy")
    return met.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("v")).alias("fingerprint"), as_text(F.col("ve")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("ve")).alias("near_edited"), likeness(F.col("v"), F.col("vn")).alias("near_next"),
    )


def op11_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside its edited text's and the next one's; for edge cases see `edited`."""
    return edited(read_table(spark, sf_dir, "documents"))
