"""Streams with timers, stopped and started again, against their batch forms."""

import datetime

import pytest

from quarry.streaming import state

BASE = datetime.datetime(2024, 1, 1)


def at(k):
    return BASE + datetime.timedelta(seconds=60 * k)


def run(spark, tmp_path, files, schema, make, mode):
    """All rows that a stream over the files gives; it is stopped after half of them and started again."""
    state.use_rocksdb(spark)
    out = []
    for part, some in enumerate((files[: len(files) // 2], files[len(files) // 2 :])):
        for i, rows in enumerate(some):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            if i + 1 < len(some) and part == 0 and i % 2:
                continue  # two files in one batch
            q = make(stream).writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            q.awaitTermination(300)
    return out


def test_transitions_of_a_stream_equal_the_batch(spark, tmp_path):
    seen = {"a": [0, 1, 2, 3, 4, 5], "b": [0, 2, 3, 5], "c": [1], "d": [0, 4], "e": [3, 5]}
    files = [[(k, at(s)) for k, times in seen.items() if s in times] or [("a", at(s))] for s in range(6)]
    files.append([("end", at(9))])
    files.append([("end", at(10))])
    got = run(spark, tmp_path, files, "code_hash string, at timestamp", lambda s: state.track_transitions(s, 60), "update")
    rows = [r for f in files for r in f]
    want = {tuple(r) for r in state.transitions(spark.createDataFrame(rows, "code_hash string, at timestamp"), 60, str(at(9))).collect() if r["code_hash"] != "end"}
    assert {r for r in got if r[0] != "end"} == want and len({r for r in got if r[0] != "end"}) == len([r for r in got if r[0] != "end"])
    assert {r[1] for r in want} == {"new", "persistent", "resolved", "reopened"}


def test_lookups_of_a_stream_equal_the_batch(spark, tmp_path):
    files = [[("k", "v1", at(0)), ("m", "v1", at(0))], [("k", "v1", at(1))], [("k", "v2", at(2)), ("m", "v1", at(4))], [("k", "v2", at(5)), ("k", "v2", at(9))], [("m", "v1", at(20))]]
    got = run(spark, tmp_path, files, "key string, version string, at timestamp", lambda s: state.cached_lookups(s, 200), "append")
    want = sorted(tuple(r) for r in state.lookups(spark.createDataFrame([r for f in files for r in f], "key string, version string, at timestamp"), 200).collect())
    assert sorted(got) == want and [r[2] for r in want] == [False, True, False, True, False, False, False, False]


@pytest.mark.parametrize("rows", [[], [("a", at(0))]])
def test_small_tables(spark, rows):
    found = state.transitions(spark.createDataFrame(rows, "code_hash string, at timestamp"), 60).collect()
    assert [r["event"] for r in found] == ["new"] * len(rows)
