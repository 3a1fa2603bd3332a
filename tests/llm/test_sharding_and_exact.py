import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

from pyspark.sql import functions as F

from quarry.llm.common import BATCH_BYTES, BATCH_KEY, TASKS_A_FILE, Stored
from quarry.llm.components import components
from quarry.llm.exact_dedup import exact_dedup, exact_groups, normalised, op8_content_sort
from quarry.llm.sharding import kd_shards
from tests.llm.conftest import words


def test_shards_are_even_and_gapless(docs, rows):
    got = kd_shards(docs, n_shards=4).collect()
    assert len(got) == len(rows)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert set(sizes) <= {0, 1, 2, 3}
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    largest = max(w for w, _ in want)
    assert max(sizes.values()) - min(sizes.values()) <= 4 * largest


def brute_shards(rows, dims, leaves):
    """Shards by walking the tree over the rows themselves: a cut is where the running bytes of sorted keys come nearest to their share."""
    widths = [max(r[2 + d] for r in rows) - min(r[2 + d] for r in rows) for d in range(dims)]

    def split(own, n):
        if n == 1:
            return [own]
        spans = [(max(r[2 + d] for r in own) - min(r[2 + d] for r in own)) / max(widths[d], 1.0) for d in range(dims)]
        d = spans.index(max(spans))
        low, high = min(r[2 + d] for r in own), max(r[2 + d] for r in own)
        key = lambda r: (min(max(int((r[2 + d] - low) / max(high - low, 1.0) * 65535.0), 0), 65535) << 14) | (r[1] & 16383)
        left = (n + 1) // 2
        want = sum(r[0] for r in own) * left / n
        cells = defaultdict(int)
        for r in own:
            cells[key(r)] += r[0]
        before, cut = 0, None
        for c in sorted(cells):
            if before + cells[c] >= want:
                cut = c + (before + cells[c] - want < want - before)
                break
            before += cells[c]
        return split([r for r in own if key(r) < cut], left) + split([r for r in own if key(r) >= cut], n - left)

    return split(rows, leaves)


def test_every_row_lies_in_the_shard_of_its_medians(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(3)
    table = [(i, "w" * r.randrange(400), r.choice([5, 5, 5, r.randrange(1000)])) for i in range(700)]
    docs = spark.createDataFrame(table, "doc_id long, text string, x long")
    ties = {x["doc_id"]: x["tie"] for x in docs.select("doc_id", F.xxhash64("doc_id", F.crc32(F.encode("text", "UTF-8"))).alias("tie")).collect()}
    own = [(len(t) + 1, ties[i], i, len(t), x, i) for i, t, x in table]
    for leaves in (6, 70):
        want = {row[5]: n for n, shard in enumerate(brute_shards(own, 3, leaves)) for row in shard}
        got = kd_shards(docs, n_shards=leaves, dims={"d_id": F.col("doc_id"), "d_size": F.octet_length("text"), "d_x": F.col("x")}).collect()
        assert {g["doc_id"]: g["shard"] for g in got} == want
        assert {g["doc_id"]: g["text_crc32"] for g in got} == {i: zlib.crc32(t.encode()) for i, t, _ in table}


def test_shards_split_one_hot_value_and_odd_counts(spark):
    hot = spark.createDataFrame([(i, "word " * 20, "en", "src0") for i in range(900)], "doc_id long, text string, lang string, source string")
    got = kd_shards(hot, n_shards=5).groupBy("shard").count().collect()
    assert len(got) == 5 and all(160 <= r["count"] <= 200 for r in got)


def test_target_bytes_and_empty(docs, empty, rows):
    total = sum(len((t or "").encode()) + 1 for _, t, *_ in rows)
    assert kd_shards(docs, target_bytes=total // 3).select("shard").distinct().count() <= 4
    assert kd_shards(empty, n_shards=16).count() == 0


def test_exact_groups_match_brute_force(docs, rows):
    white = str.maketrans("", "", " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(white)].append((-len(t or ""), i is None, i))
    got = exact_groups(docs).collect()
    assert len(got) == len(rows)
    want = []
    for norm, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for k, m in enumerate(members):
            want.append((m[2], members[0][2], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    key = lambda r: (r[4], r[0] is None, r[0] or 0, r[3])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_exact_dedup_keeps_one_row_of_each_group(docs, rows, empty):
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    white = str.maketrans("", "", " \t\n\x0b\x0c\r")
    norms = [(r["text"] or "").translate(white) for r in kept.collect()]
    assert len(norms) == len(set(norms)) == len({(t or "").translate(white) for _, t, *_ in rows})
    assert exact_dedup(empty).count() == 0


def test_one_huge_group_spreads_and_counts(spark):
    df = spark.createDataFrame([(i, "same text") for i in range(2000)] + [(5000 + i, f"t{i}") for i in range(500)], "doc_id long, text string").repartition(8)
    got = exact_groups(df).where("group_size > 1").collect()
    assert len(got) == 2000 and {r["keep_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1 and {r["group_size"] for r in got} == {2000}


def test_copies_of_many_tasks_are_written_to_few_files(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("exact-runs-*"))
    df = spark.createDataFrame([(i, "same  text") for i in range(1500)] + [(5000 + i, f"t {i}") for i in range(2500)], "doc_id long, text string").repartition(8)
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        found = exact_groups(df)
        (new,) = set(shared.glob("exact-runs-*")) - before
        assert len(list(new.glob("part-*"))) <= 64 // TASKS_A_FILE
        assert found.rdd.getNumPartitions() <= 64 // TASKS_A_FILE
        got = found.collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    same = [r for r in got if r["group_size"] > 1]
    assert len(got) == 4000 and len(same) == 1500 and {(r["keep_id"], r["group_size"]) for r in same} == {(0, 1500)}
    assert {r["doc_id"] for r in got if r["kept"]} == {0, *range(5000, 7500)}


def test_edges_are_written_to_few_files(spark, monkeypatch):
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was, files, plain = {k: spark.conf.get(k) for k in held}, [], Stored.__init__

    def counted(self, df, tag):
        plain(self, df, tag)
        files.append(len(list(Path(self.path.removeprefix("file://")).glob("part-*"))))

    monkeypatch.setattr(Stored, "__init__", counted)
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        got = components(spark.createDataFrame([(i, i + 1) for i in range(300) if i % 100 != 99], "a long, b long")).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert {r["node"]: r["label"] for r in got} == {i: i // 100 * 100 for i in range(300)}
    assert len(files) > 1 and max(files) <= 32 // TASKS_A_FILE


def test_copies_are_sent_to_workers_in_bounded_batches(spark, tmp_path, monkeypatch):
    texts = [" ".join(words(400, 30_000 + i)) for i in range(2500)]
    assert sum(map(len, texts)) > 2 * BATCH_BYTES
    path = f"file://{tmp_path}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"{path}/documents.parquet")
    most, plain = BATCH_BYTES + 100_000, type(docs).mapInArrow

    def watched(self, f, schema, *rest):
        def run(batches):
            def small():
                for batch in batches:
                    assert batch.nbytes <= most, batch.nbytes
                    yield batch

            return f(small())

        return plain(self, run, schema, *rest)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    spark.conf.unset(BATCH_KEY)
    try:
        # one range: all texts reach one worker
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert op8_content_sort(spark, path).where("kept").count() == len(set(texts))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset(BATCH_KEY)


def test_white_space_goes_and_nothing_else(spark):
    texts = ["a b\tc\nd\x0be\x0cf\rg", "", " \t\n\x0b\x0c\r", "é\x85\u2028\xa0\x1c\x1f日 \U0001f600", "\x00 \x00", None, "plain"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", normalised(F.col("text")).alias("n")).collect()
    white = str.maketrans("", "", " \t\n\x0b\x0c\r")
    assert {r["i"]: r["n"] for r in got} == {i: (t or "").translate(white) for i, t in enumerate(texts)}
    broken = [b"\xff a", b"a\xc3 b", b"\xf0\x9f\x98 \x80", b"\xc0\x80"]
    rows = spark.createDataFrame([(bytearray(b),) for b in broken], "b binary").select(F.col("b").cast("string").alias("text"))
    assert [r["n"] for r in rows.select(normalised(F.col("text")).alias("n")).collect()] == [b.decode(errors="replace").translate(white) for b in broken]
