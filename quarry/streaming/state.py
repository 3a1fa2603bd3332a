"""Keyed state with timers: the life of an issue over snapshots, and a cache of results, as streams and as batches.

The streams keep typed state in the state store (`transformWithState`, which needs the RocksDB provider), so they go on after a
restart; what never comes is told by event-time timers. Each has a batch form over whole tables that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRANSITIONS = "code_hash string, event string, at timestamp, first_detected timestamp, reopen_count long, changes long"
LOOKUPS = "key string, at timestamp, hit boolean, age long"


def use_rocksdb(spark) -> None:
    """The state store that typed state needs; for queries that start after this."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def transitions(sightings: DataFrame, period: int, now=None) -> DataFrame:
    """Batch form of `track_transitions` up to `now` (a timestamp literal, the last sighting if not given): rows of TRANSITIONS.

    Sightings (code_hash, at) lie whole periods (seconds) apart, one snapshot each; repeated ones count once. An issue is new
    when it is first seen, persistent in the snapshot after one that had it, resolved in the first that lacks it, and
    reopened when it comes back. `changes` is the length of its history of resolutions and reopenings so far.
    """
    seen = sightings.select("code_hash", "at").distinct()
    end = F.lit(now).cast("timestamp") if now is not None else None
    if end is None:
        end = F.lit(seen.agg(F.max("at")).first()[0]).cast("timestamp")
    own = Window.partitionBy("code_hash").orderBy("at")
    step = F.make_interval(secs=F.lit(period))
    rows = seen.select("code_hash", "at", F.lag("at").over(own).alias("before"), F.lead("at").over(own).alias("after"), F.min("at").over(own).alias("first_detected"))
    back = F.col("before").isNotNull() & (F.col("at") > F.col("before") + step)
    rows = rows.withColumn("reopen_count", F.sum(back.cast("long")).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    gone = F.when(F.col("after").isNull(), F.col("at") + step <= end).otherwise(F.col("after") > F.col("at") + step)
    event = F.when(F.col("before").isNull(), "new").when(back, "reopened").otherwise("persistent")
    found = rows.select("code_hash", event.alias("event"), "at", "first_detected", "reopen_count", (F.col("reopen_count") * 2).alias("changes"))
    lost = rows.where(gone).select("code_hash", F.lit("resolved").alias("event"), (F.col("at") + step).alias("at"), "first_detected", "reopen_count", (F.col("reopen_count") * 2 + 1).alias("changes"))
    return found.unionByName(lost)


def track_transitions(sightings: DataFrame, period: int, delay: int = 0) -> DataFrame:
    """Streaming form: an update for every transition of sightings (code_hash, at), as rows of TRANSITIONS.

    An issue is resolved when the watermark (`delay` seconds behind) has passed the middle of the period after the
    snapshot that lacks it. Sightings that are no later than the last one of their issue are ignored.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    columns = [c.split()[0] for c in TRANSITIONS.split(", ")]

    class Issue(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.issue = handle.getValueState("issue", "state string, first timestamp, last timestamp, reopened long")
            self.history = handle.getListState("history", "was string, now string, at timestamp")

        def _rows(self, key, found):
            return pd.DataFrame([(key[0], *f) for f in found], columns=columns)

        def _move(self, was, now, at) -> int:
            self.history.appendValue((was, now, at))
            return sum(1 for _ in self.history.get())

        def handleInputRows(self, key, rows, timerValues):
            step = pd.Timedelta(seconds=period)
            found = []
            for at in sorted({pd.Timestamp(t) for frame in rows for t in frame["at"]}):
                held = self.issue.get() if self.issue.exists() else None
                state, first, last, reopened = held or ("NONE", at, None, 0)
                if last is not None and at <= pd.Timestamp(last):
                    continue
                changes = sum(1 for _ in self.history.get())
                if held is None:
                    event = "new"
                elif state == "RESOLVED" or at > pd.Timestamp(last) + step:
                    if state == "OPEN":  # its timer has not fired yet
                        changes = self._move("OPEN", "RESOLVED", pd.Timestamp(last) + step)
                        found.append(("resolved", pd.Timestamp(last) + step, pd.Timestamp(first), reopened, changes))
                    reopened += 1
                    changes = self._move("RESOLVED", "OPEN", at)
                    event = "reopened"
                else:
                    event = "persistent"
                found.append((event, at, pd.Timestamp(first), reopened, changes))
                self.issue.update(("OPEN", first, at, reopened))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            last = pd.Timestamp(self.issue.get()[2])
            if self.issue.get()[0] == "OPEN":
                self.handle.registerTimer(int((last + 1.5 * step).timestamp() * 1000))
            if found:
                yield self._rows(key, found)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            state, first, last, reopened = self.issue.get()
            if state == "OPEN":
                at = pd.Timestamp(last) + pd.Timedelta(seconds=period)
                self.issue.update(("RESOLVED", first, last, reopened))
                yield self._rows(key, [("resolved", at, pd.Timestamp(first), reopened, self._move("OPEN", "RESOLVED", at))])

        def close(self) -> None:
            pass

    stream = sightings.select("code_hash", "at").withWatermark("at", f"{delay} seconds")
    return stream.groupBy("code_hash").transformWithStateInPandas(Issue(), TRANSITIONS, "Update", "EventTime")


def lookups(requests: DataFrame, ttl: int) -> DataFrame:
    """Batch form of `cached_lookups`: rows of LOOKUPS for requests (key, version, at); equal times go by version.

    A request hits if its key was asked for or filled under the same version within the last `ttl` seconds, a hit being
    as good as a filling; a miss fills the entry again. `age` is the seconds since then, null for a miss.
    """
    own = Window.partitionBy("key").orderBy("at", "version")
    rows = requests.select("key", "version", "at", F.lag("at").over(own).alias("before"), F.lag("version").over(own).alias("held"))
    age = F.unix_timestamp("at") - F.unix_timestamp("before")
    hit = F.coalesce((age <= ttl) & (F.col("held") == F.col("version")), F.lit(False))
    return rows.select("key", "at", hit.alias("hit"), F.when(hit, age).alias("age"))


def cached_lookups(requests: DataFrame, ttl: int, delay: int = 0) -> DataFrame:
    """Streaming form: a row of LOOKUPS for each request (key, version, at); entries that are out of time leave the state by timers."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Entry(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.entry = handle.getValueState("entry", "version string, at timestamp")

        def handleInputRows(self, key, rows, timerValues):
            asked = sorted((pd.Timestamp(t), v) for frame in rows for t, v in zip(frame["at"], frame["version"]))
            found = []
            for at, version in asked:
                held = self.entry.get() if self.entry.exists() else None
                age = int((at - pd.Timestamp(held[1])).total_seconds()) if held else None
                hit = held is not None and age <= ttl and held[0] == version
                found.append((key[0], at, hit, age if hit else None))
                self.entry.update((version, at))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(asked[-1][0].timestamp() * 1000) + ttl * 1000 + 1)
            out = pd.DataFrame(found, columns=["key", "at", "hit", "age"])
            out["age"] = out["age"].astype("Int64")
            yield out

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.entry.clear()
            yield pd.DataFrame({"key": pd.Series([], dtype=str), "at": pd.Series([], dtype="datetime64[ns]"), "hit": pd.Series([], dtype=bool), "age": pd.Series([], dtype="Int64")})

        def close(self) -> None:
            pass

    stream = requests.select("key", "version", "at").withWatermark("at", f"{delay} seconds")
    return stream.groupBy("key").transformWithStateInPandas(Entry(), LOOKUPS, "Append", "EventTime")
