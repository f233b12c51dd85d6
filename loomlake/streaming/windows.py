"""Structured Streaming: windowed summaries, session windows, running counters, first-seen ids, event-log tail; each works on batches too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, late: str | None = None, at: str = "ts") -> DataFrame:
    e = events.withWatermark(at, late) if late else events
    return e.groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("v100")).select(F.col("window.start").alias("start"), "event_type", "n", "v100")


def sliding(events: DataFrame, width: str, step: str, late: str | None = None, at: str = "ts") -> DataFrame:
    e = events.withWatermark(at, late) if late else events
    return e.groupBy(F.window(at, width, step)).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("window.start").alias("start"), "n", "errors")


def sessions(events: DataFrame, gap: str, late: str | None = None, at: str = "ts", until: bool = False) -> DataFrame:
    """(user_id, start, n) of runs of events less than a gap apart; until: also when the gap after the last one ends."""
    e = events.withWatermark(at, late) if late else events
    end = [F.col("session_window.end").alias("until")] if until else []
    return e.groupBy(F.session_window(at, gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n", *end)


def counters(events: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts; as a stream in update mode."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


def first_seen(events: DataFrame, key: str, late: str, at: str = "ts") -> DataFrame:
    """Events whose id did not come before within the watermark; events without an id pass."""
    known = events.where(F.col(key).isNotNull()).withWatermark(at, late)
    if events.isStreaming:
        return known.dropDuplicatesWithinWatermark([key])
    return known.dropDuplicates([key]).unionByName(events.where(F.col(key).isNull()))


def run_to_memory(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now and give its result table (for tests and small results)."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
