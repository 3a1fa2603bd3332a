"""Target-distribution importance resampling over hashed n-grams.

Two bags of n-grams, of the corpus and of a target, are counted by bucket; a bucket's gain is the log ratio of its
smoothed shares, a document's weight the mean gain of its n-grams, and the documents with the highest weights plus
Gumbel noise are drawn. The noise hangs on the document's id alone, so a lost task gives the same draw again.

A text longer than LONG code points is split at word boundaries into chunks that overlap by n-1 words. A chunk owns
the positions that start in it, so each n-gram is counted once; chunks are dealt over the tasks like documents
of their own, and their counts and weights are summed by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import Stored, free_name, read_table, shuffle_partitions

#: Words of lower-cased texts: letters and digits of ASCII, and everything beyond it.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10_000
#: Code points from which a text is chunked, and words that a chunk owns.
LONG, OWNED = 65_536, 4_096


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def chunks(rows: DataFrame, n: int, long: int = LONG, owned: int = OWNED) -> DataFrame:
    """Rows (row, doc_id, text) to (row, doc_id, words, owned): a short text is one chunk, a long one as many as it takes.

    `owned` says how many of the words, from the first on, are starting positions of this chunk; up to n-1 words
    after them are carried so that no n-gram is lost at the edge. Chunks of long texts are dealt over all tasks.
    """
    short = rows.where(F.length("text") <= long).select("row", "doc_id", words(F.col("text")).alias("words"))
    short = short.withColumn("owned", F.size("words"))
    cut = rows.where(F.length("text") > long).select("row", "doc_id", words(F.col("text")).alias("all"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(owned))
    parts = F.transform(starts, lambda at: F.struct(F.slice("all", at + 1, F.lit(owned + n - 1)).alias("words"), F.least(F.lit(owned), F.size("all") - at).alias("owned")))
    cut = cut.select("row", "doc_id", F.explode(parts).alias("part")).select("row", "doc_id", "part.words", "part.owned")
    return short.unionByName(cut.repartition(shuffle_partitions(rows.sparkSession)))


def grams(n: int) -> Column:
    """All runs of 1 to n words that start at a chunk's own positions, joined by one space."""
    if n == 1:
        return F.col("words")

    def runs(k):
        last = F.least(F.col("owned"), F.size("words") - k + 1)
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.array_join(F.slice("words", at, F.lit(k)), " "))

    return F.concat(*[runs(k) for k in range(1, n + 1)])


def gram_rows(docs: DataFrame, n: int, buckets: int, id_col: str, text_col: str, long: int, owned: int) -> DataFrame:
    """A row for each n-gram: row, doc_id, bucket, and n_words, the words of its chunk on the chunk's first row only.

    A chunk without words has one row, with null for its bucket.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = chunks(rows, n, long, owned).select("row", "doc_id", "owned", F.posexplode_outer(grams(n)).alias("at", "gram"))
    first = F.when(F.coalesce(F.col("at"), F.lit(0)) == 0, F.col("owned")).otherwise(0)
    return found.select("row", "doc_id", (F.crc32(F.encode("gram", "UTF-8")) % buckets).alias("bucket"), first.alias("n_words"))


def counts(docs: DataFrame, name: str, **how) -> DataFrame:
    """How many n-grams of all texts fall in each bucket: at most as many rows as there are buckets."""
    return gram_rows(docs, **how).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int, **how) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln of the target's smoothed share over the corpus's)."""
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").alias("bucket"))
    source, aim = counts(docs, "s", buckets=buckets, **how), counts(target, "t", buckets=buckets, **how)
    met = Stored(every.join(source, "bucket", "left").join(aim, "bucket", "left").fillna(0, ["s", "t"]), "counts").df
    totals = met.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)).cast("double") / ((F.col("s") + 1) * (F.col("all_t") + buckets)).cast("double")
    return met.crossJoin(totals).select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))  # totals are one row


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(share)))


def weights(docs: DataFrame, target: DataFrame, *, n: int = 1, buckets: int = BUCKETS, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, owned: int = OWNED) -> DataFrame:
    """One row a document: doc_id, n_words, n_features, weight, score.

    weight is the floored mean gain of the document's n-grams (0 without any), score is weight plus noise. Null
    counts as empty. `target` has the same text column; an empty target, or an empty corpus, is smoothed like any.
    """
    how = {"n": n, "id_col": id_col, "text_col": text_col, "long": long, "owned": owned}
    table = Stored(gains(docs, target.withColumn(id_col, F.lit(None).cast("long")), buckets, **how), "gains").df
    met = gram_rows(docs, buckets=buckets, **how).join(F.broadcast(table), "bucket", "left")  # one small row a bucket
    per = met.groupBy("row", "doc_id").agg(F.count("bucket").alias("n_features"), F.sum("n_words").cast("long").alias("n_words"), F.sum("gain").alias("gain"))
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("gain") / F.col("n_features"))).otherwise(F.lit(0).cast("long"))
    return per.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, min_words: int = 20, **how) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; rank is null for what is not drawn.

    Of the N documents with at least `min_words` words, floor(percent * N / 100) with the highest scores are drawn;
    ties go to the smaller doc_id (null last), and of rows that share that too to the one with fewer n-grams. Rows that
    repeat are ranked one after the other. Other columns are ignored, an empty table gives an empty result. For
    nulls, empty and very long texts see `weights`, which takes the other arguments.

    Scores are whole thousandths, so the number of different ones is bounded by the range of gains and noise whatever
    the input's size: ranks begin with a running count over these, and only rows of one score are ordered together.
    """
    scored = Stored(weights(docs, target, **how), "scores").df
    fit = F.col("n_words") >= min_words
    table = scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("own"))
    running = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = Stored(table.select("score", (F.sum("own").over(running) - F.col("own")).alias("before"), "own"), "steps").df
    total = steps.agg(F.sum("own")).first()[0] or 0
    draw = percent * total // 100
    cut = steps.where(F.col("before") < draw).agg(F.min("score")).first()[0]
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return scored.select(*columns, none)
    high = fit & (F.col("score") >= cut)
    inside = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    ranked = scored.where(high).join(steps.select("score", "before"), "score").withColumn("rank", F.col("before") + F.row_number().over(inside))
    drawn = ranked.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.where(~high).select(*columns, none))


def drawn(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of `docs` whose document is drawn, with the columns they came with, whatever their names.

    Rows are found by their id, so rows that repeat a drawn id come along; rows without an id are left out.
    """
    key = free_name(docs, "drawn")
    keys = resample(docs, target, id_col=id_col, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(keys, docs[id_col].cast("long") == keys[key], "left_semi")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight against `benchmark`, and its rank in the draw; for edge cases see `resample`."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


# CRC-32 of each different word, by its byte table, which is made from the polynomial
OP13_SQL = r"""
WITH tab AS (
  SELECT list(list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(0, 256))::BIGINT AS n)),
dw AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
vocabulary AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
crc AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(h)::BIGINT, 2), lambda i: (instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1)),
              lambda c, b: xor(c >> 8, t[xor(c % 256, b) + 1]))) % 10000 AS bucket
  FROM vocabulary, tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM dw) AS ss, (SELECT count(*) FROM bw) AS tt),
gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (ss + 10000))::DOUBLE / ((s + 1) * (tt + 10000))::DOUBLE))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
per AS (
  SELECT documents.doc_id, coalesce(n, 0) AS n_features, coalesce(floor(g::DOUBLE / n), 0)::BIGINT AS weight
  FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, sum(gain) AS g FROM dw JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY doc_id) x ON documents.doc_id = x.doc_id),
hashed AS (SELECT *, upper(sha256('2024:' || doc_id)[1:8]) AS h FROM per),
scored AS (
  SELECT doc_id, n_features, weight,
         weight + floor(-1000 * ln(-ln((list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: instr('0123456789ABCDEF', h[i]) - 1)), lambda a, b: a * 16 + b) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM hashed),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features::BIGINT AS n_features, weight, score,
       CASE WHEN r <= (SELECT (10 * count(*)) // 100 FROM ranked) THEN r END AS rank
FROM scored LEFT JOIN ranked ON scored.doc_id = ranked.doc_id
"""
