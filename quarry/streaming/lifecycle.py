"""Keyed state over streams: issue lifecycles, circuit breakers, token buckets; and event-time windows.

The state functions take rows of one key in order, so the same code serves a stream (applyInPandasWithState),
a batch replay, and the tests.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ISSUE_STATE = "state string, first_snapshot long, last_snapshot long, reopen_count long"
ISSUE_OUT = f"code_hash string, {ISSUE_STATE}"


def advance_issue(state: tuple | None, snapshot: int) -> tuple:
    """An issue's state after it was seen in a snapshot: a gap since the last one means it had been resolved."""
    if state is None:
        return ("OPEN", snapshot, snapshot, 0)
    _, first, last, reopened = state
    return ("OPEN", first, snapshot, reopened + (snapshot > last + 1))


def track_issues(sightings: DataFrame) -> DataFrame:
    """Streaming lifecycle of (code_hash, snapshot) rows: an update of each key's state for every micro-batch.

    Rows of a batch may come in any order; snapshots that the state has passed are ignored.
    """
    import pandas as pd

    def run(key, frames: Iterable[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else None
        for snapshot in sorted({int(s) for f in frames for s in f["snapshot"]}):
            if state is None or snapshot > state[2]:
                state = advance_issue(state, snapshot)
        held.update(state)
        yield pd.DataFrame([(key[0], *state)], columns=["code_hash", "state", "first_snapshot", "last_snapshot", "reopen_count"])

    return sightings.groupBy("code_hash").applyInPandasWithState(run, ISSUE_OUT, ISSUE_STATE, "update", "NoTimeout")


def issue_states(sightings: DataFrame, now: int) -> DataFrame:
    """The batch form: states after snapshot `now`; what it does not hold is RESOLVED."""
    seen = sightings.select("code_hash", F.col("snapshot").cast("long").alias("snapshot")).distinct()
    gap = (F.col("snapshot") > F.lag("snapshot").over(Window.partitionBy("code_hash").orderBy("snapshot")) + 1).cast("long")
    g = seen.withColumn("again", F.coalesce(gap, F.lit(0))).groupBy("code_hash").agg(F.min("snapshot").alias("first_snapshot"), F.max("snapshot").alias("last_snapshot"), F.sum("again").alias("reopen_count"))
    return g.select("code_hash", F.when(F.col("last_snapshot") == now, "OPEN").otherwise("RESOLVED").alias("state"), "first_snapshot", "last_snapshot", "reopen_count")


class Breaker:
    """Closed until `most` failures in a row; open for `wait` seconds; then one probe decides."""

    def __init__(self, most: int = 3, wait: float = 300.0):
        self.most, self.wait = most, wait
        self.state, self.failures, self.since = "closed", 0, 0.0

    def step(self, at: float, ok: bool) -> tuple[str, bool]:
        """The state after a request at a time, and whether it was let through."""
        if self.state == "open":
            if at - self.since < self.wait:
                return self.state, False
            self.state = "half_open"
        if ok:
            self.state, self.failures = "closed", 0
        else:
            self.failures += 1
            if self.state == "half_open" or self.failures >= self.most:
                self.state, self.since = "open", at
        return self.state, True


class Bucket:
    """A token bucket: `rate` tokens a second, `size` at most; a request waits for its tokens, `longest` seconds at most."""

    def __init__(self, rate: float, size: float, longest: float = 10.0):
        self.rate, self.size, self.longest = rate, size, longest
        self.tokens, self.at = size, None

    def step(self, at: float, cost: float = 1.0) -> float:
        """Seconds that a request at a time waits."""
        if self.at is not None:
            self.tokens = min(self.size, self.tokens + max(0.0, at - self.at) * self.rate)
        self.at = at
        self.tokens -= cost
        return 0.0 if self.tokens >= 0 else min(self.longest, -self.tokens / self.rate)


def replay_buckets(requests: DataFrame, rate: float, size: float) -> DataFrame:
    """provider, seq, wait: each provider's bucket over its requests, in one sorted pass a partition."""

    def run(batches):
        import pandas as pd

        provider, bucket = None, None
        for pdf in batches:
            out = []
            for p, seq, at in pdf[["provider", "seq", "at"]].itertuples(index=False):
                if p != provider:
                    provider, bucket = p, Bucket(rate, size)
                out.append((p, seq, round(bucket.step(at), 6)))
            yield pd.DataFrame(out, columns=["provider", "seq", "wait"])

    rows = requests.select("provider", "seq", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return rows.repartition("provider").sortWithinPartitions("provider", "at", "seq").mapInPandas(run, "provider string, seq long, wait double")


def replay_breakers(requests: DataFrame, most: int = 3, wait: float = 300.0) -> DataFrame:
    """provider, seq, state, allowed: each provider's breaker over its requests, in one sorted pass a partition."""

    def run(batches):
        import pandas as pd

        provider, breaker = None, None
        for pdf in batches:
            out = []
            for p, seq, at, ok in pdf[["provider", "seq", "at", "ok"]].itertuples(index=False):
                if p != provider:
                    provider, breaker = p, Breaker(most, wait)
                out.append((p, seq, *breaker.step(at, ok)))
            yield pd.DataFrame(out, columns=["provider", "seq", "state", "allowed"])

    rows = requests.select("provider", "seq", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "ok")
    return rows.repartition("provider").sortWithinPartitions("provider", "at", "seq").mapInPandas(run, "provider string, seq long, state string, allowed boolean")


def windowed_errors(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and errors a window and type, over event time; works on streams and tables."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def write_partials(findings: DataFrame, path: str, checkpoint: str):
    """Appends a stream of findings as JSON lines; a restart goes on where the checkpoint stands."""
    return findings.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
