"""Streaming twins of the batch operators over the usage log.

Each job is a transformation of a streaming frame; sources and sinks are the
caller's. Times must be timestamps (watermarks refuse zone-less ones).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioscope.constants import LIMITS
from folioscope.functions.textnorm import latin_key
from folioscope.operators.spans import ngrams, word_stream


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events from a folder of Parquet files, with their times as timestamps."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by tumbling (or, with ``slide``, sliding) window and event type."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "value")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events by user and session."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def spend_by_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Spending by UTC day; with the update mode the last row of a day is its total so far."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("spent"))
    return out.select(F.col("w.start").cast("date").alias("day"), "spent")


class SlidingHour(StatefulProcessor):
    """A user's accepted times of the last hour, as a list state; a timer clears it when the hour is over."""

    def __init__(self, limit: int, seconds: float = 3600.0):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at double")

    def _timer(self, kept: list[float], now: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if kept:
            self.handle.registerTimer(max(int((kept[-1] + self.seconds) * 1000) + 1, now + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = [t for (t,) in self.times.get()] if self.times.exists() else []
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        allowed = []
        for t in (t.timestamp() for t in batch["ts"]):
            kept = [k for k in kept if t - k <= self.seconds]
            allowed.append(len(kept) < self.limit)
            if allowed[-1]:
                kept.append(t)
        kept.sort()
        self.times.clear()
        if kept:
            self.times.put([(t,) for t in kept])
        self._timer(kept, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"event_id": batch["event_id"], "user": key[0], "ts": batch["ts"], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.times.clear()
        yield from ()

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, limit: int = LIMITS.requests_per_hour, late: str = "1 hour") -> DataFrame:
    """Each request with ``allowed``: at most ``limit`` accepted ones of a user in any hour.

    State is the user's accepted times of the last hour (at most ``limit``); a timer
    clears it when the watermark passes them. Requests of a batch are taken in order
    of time; later than the watermark, they are left out. Lists and timers need
    the RocksDB state store, which the session gets where it has no other than the default.
    """
    conf = events.sparkSession.conf
    provider = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (conf.get(provider, None) or ""):
        conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = events.withWatermark("ts", late).select("event_id", F.col("user_id").alias("user"), "ts")
    return keyed.groupBy("user").transformWithStateInPandas(SlidingHour(limit), "event_id long, user long, ts timestamp, allowed boolean", "Append", "EventTime")


def known_passages(texts: DataFrame, passages: DataFrame, n: int = 3) -> DataFrame:
    """Stream-static join: each n-gram that an incoming text (id, text) shares with a passage.

    Grams come from the row itself, so the stream needs no state.
    """
    known = ngrams(word_stream(passages.select("item_id", latin_key(F.col("text")).alias("key")), "item_id", "key"), n).select(F.col("id").alias("passage_id"), "gram")
    grams = ngrams(word_stream(texts.select("id", latin_key(F.col("text")).alias("key")), "id", "key"), n)
    return grams.join(known, "gram").select(F.col("id").alias("text_id"), "passage_id", "pos", "gram")
