"""Custom stateful streams: counters whose life starts at the first hit, lives that every touch prolongs, both ended by timers, and the event-log fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What both timed streams give: a key's life so far (n hits from start, until its end), or that it is over.
LIFE = "key string, n long, start timestamp, until timestamp, expired boolean"


def ttl_counter(events: DataFrame, key: str, ttl_seconds: float, at: str = "ts") -> DataFrame:
    """(key, count, start): hits since the first one of the current life, per micro-batch."""
    ship(events.sparkSession)

    def update(k, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        for t in sorted(x for pdf in pdfs for x in pdf["at"]):
            if start is None or t - start >= ttl_seconds:
                start, n = t, 0
            n += 1
        state.update((start, n))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "start": [start]})

    rows = events.select(F.col(key).cast("string").alias("key"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(update, "key string, n long, start double", "start double, n long", "update", GroupStateTimeout.NoTimeout)


class Life(StatefulProcessor):
    """Hits of a key: a life of ttl from its first hit, or, if rolling, from its latest; a timer ends it when the watermark passes, without a further hit, and its state goes.

    Hits of a batch count in the order of their times; one at or after a life's end starts another.
    """

    def __init__(self, ttl_ms: int, rolling: bool):
        self.ttl, self.rolling = ttl_ms, rolling

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.life = handle, handle.getValueState("life", "start long, last long, n long")

    def _out(self, key, start: int, last: int, n: int, expired: bool) -> pd.DataFrame:
        at = lambda ms: pd.Timestamp(ms, unit="ms")
        return pd.DataFrame({"key": [key[0]], "n": [n], "start": [at(start)], "until": [at((last if self.rolling else start) + self.ttl)], "expired": [expired]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, last, n = self.life.get() if self.life.exists() else (None, None, 0)
        was = None if start is None else (last if self.rolling else start) + self.ttl
        for t in sorted(int(t) for pdf in rows for t in pdf["ms"]):
            if start is None or t >= (last if self.rolling else start) + self.ttl:
                if start is not None:
                    yield self._out(key, start, last, n, True)
                start, last, n = t, t, 0
            last, n = max(last, t), n + 1
        now = (last if self.rolling else start) + self.ttl
        if now != was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(now)
        self.life.update((start, last, n))
        yield self._out(key, start, last, n, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.life.exists():
            start, last, n = self.life.get()
            self.life.clear()
            yield self._out(key, start, last, n, True)

    def close(self) -> None:
        pass


def lives(events: DataFrame, key: str, ttl_seconds: float, at: str = "ts", delay: str = "10 minutes", rolling: bool = False) -> DataFrame:
    """LIFE rows of a stream of hits: after every batch each key's life, and each life that ends.

    State is kept in RocksDB and holds live keys only.  Hits later than the delay are left out, as with every watermark.
    """
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", delay)
    rows = rows.select(F.col(key).cast("string").alias("key"), "__at", F.unix_millis("__at").alias("ms"))
    return rows.groupBy("key").transformWithStateInPandas(Life(int(ttl_seconds * 1000), rolling), LIFE, "append", "EventTime")


def running_lives(events: DataFrame, key: str, order: list[str], at: str, ttl: float, keep: list[str]) -> DataFrame:
    """In batch: (keep…, n) with each hit's number in the life that its key's hits of `at` (seconds) make, ttl from the first.

    Keys go to tasks, hits come in order, and a task carries one life at a time, so a hot key is streamed, not held.
    """
    spark = events.sparkSession
    ship(spark)
    rows = events.repartition(key).sortWithinPartitions(key, *order).select(F.col(key).alias("__key"), F.col(at).alias("__at"), *keep)
    names = list(keep)

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, n = object(), None, 0
        for pdf in it:
            out = []
            for k, t in zip(pdf["__key"].tolist(), pdf["__at"].tolist()):
                if k != now or t - start >= ttl:
                    now, start, n = k, t, 0
                n += 1
                out.append(n)
            yield pdf[names].assign(n=out)

    types = dict(events.dtypes)
    return rows.mapInPandas(count, ", ".join(f"{c} {types[c]}" for c in names) + ", n int")


def fold_events(log: DataFrame, session: str = "session_id") -> DataFrame:
    """Replay of an event log: per session and field the last scalar, and list fields concatenated in sequence order.

    log: (session, seq, field, value, is_list).  A list field that got a scalar last is that scalar.
    """
    scalar = log.groupBy(session, "field").agg(F.max_by("value", "seq").alias("last"), F.max_by("is_list", "seq").alias("list_last"), F.max(F.when(~F.col("is_list"), F.col("seq"))).alias("reset"))
    lists = log.where("is_list").join(scalar.select(session, "field", "reset"), [session, "field"]).where("reset is null or seq > reset")
    joined = lists.groupBy(session, "field").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"]), ",").alias("items"))
    return scalar.join(joined, [session, "field"], "left").select(session, "field", F.when(F.col("list_last"), F.col("items")).otherwise(F.col("last")).alias("value"))
