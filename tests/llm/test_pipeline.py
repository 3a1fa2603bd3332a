import re

import corpus_pipeline
from quarry.llm import packing
from quarry.llm.common import BATCH_BYTES, BATCH_KEY
from tests.llm.conftest import words
from tests.llm.test_jaccard import brute_labels

WHITE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def _documents():
    """Clean texts, toxic ones (every third labelled), exact and near copies, and a passage that ten documents share."""
    vile = ["you utter scoundrel", "filthy liar go away", "scoundrel and liar"]
    rows, labels = [], []
    for i in range(600):
        w = words(90, 3000 + i)
        if i % 4 == 0:
            for at in (10, 41, 72):
                w[at:at] = vile[(i + at) % 3].split()
        rows.append((i, " ".join(w)))
        if i % 3 != 1:
            labels.append((i, 1, int(i % 4 == 0)))
    passage = " ".join(words(70, 9999))
    rows += [(1000 + i, f"{' '.join(words(40, 5000 + i))} {passage} {' '.join(words(40, 6000 + i))}") for i in range(10)]
    copy = rows[1][1]
    rows += [(2000, copy), (2001, copy.replace(" ", "\n")), (2002, copy + " more"), (2003, None), (2004, ""), (2005, None)]
    return rows, labels


def test_stages_keep_columns_and_do_their_work(spark, tmp_path):
    rows, labels = _documents()
    path = f"file://{tmp_path}"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept, d = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, path)
        assert d.columns == docs.columns, name
        d = d.checkpoint() if name != "suffix_dedup" else d
        kept.append({r["doc_id"]: r["text"] for r in d.collect()})
    texts = dict(rows)
    # toxic documents go, clean ones stay
    toxic = {i for i in range(0, 600, 4)}
    assert len(toxic - set(kept[0])) >= 0.8 * len(toxic) and set(texts) - toxic <= set(kept[0])
    # one of equal texts stays: the longest original, then the least id
    best = {}
    for i, t in kept[0].items():
        key = (t or "").translate(WHITE)
        best[key] = min(best.get(key, (0, 10**9)), (-len(t or ""), i))
    assert set(kept[1]) == {i for _, i in best.values()}
    # one of each group of 0.8 five-word Jaccard stays
    ids = sorted(kept[1])
    label = brute_labels([kept[1][i] for i in ids])
    assert set(kept[2]) == {ids[k] for k in set(label)} and 2002 not in kept[2]
    # no window of 50 words starts in two documents
    cut = {i: re.findall(r"\S+", t or "") for i, t in kept[3].items()}
    assert set(kept[3]) == set(kept[2])
    windows = [w for i in cut for w in {tuple(cut[i][p : p + 50]) for p in range(len(cut[i]) - 49)}]
    assert len(windows) == len(set(windows)) > 0
    assert cut[1000] == re.findall(r"\S+", texts[1000]) and all(len(cut[1000 + i]) == 80 for i in range(1, 10))
    packed = corpus_pipeline.run(spark, path)
    assert packed.columns == packing.pack(docs).columns and {r["doc_id"] for r in packed.select("doc_id").collect()} == set(kept[3])


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    path = f"file://{tmp_path}"
    empty.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_no_stage_sends_a_worker_more_than_the_bound_at_once(spark, tmp_path, monkeypatch):
    texts = [" ".join(words(400, 20_000 + i)) for i in range(2500)]
    assert sum(map(len, texts)) > 2 * BATCH_BYTES
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    spark.createDataFrame([(0, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
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
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(BATCH_KEY)
        try:
            assert stage(spark, docs, f"file://{tmp_path}").count() >= len(rows), name
        finally:
            spark.conf.unset(BATCH_KEY)
    # a session's own bound stays
    spark.conf.set(BATCH_KEY, "1m")
    try:
        corpus_pipeline.drop_copies(spark, docs, "")
        assert spark.conf.get(BATCH_KEY) == "1m"
    finally:
        spark.conf.unset(BATCH_KEY)
