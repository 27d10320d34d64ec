"""Streams give what the batch operators give on the same rows."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import review
from folioscope.streaming import jobs

PATH = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    spark.read.parquet(PATH).repartitionByRange(2, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def test_windows(spark, folder):
    got = drain(jobs.window_counts(jobs.event_stream(spark, folder, 10)), "hours", "complete")
    batch = spark.read.parquet(PATH).groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert got.count() == batch.count() and got.agg(F.sum("n")).first()[0] == spark.read.parquet(PATH).count()


def test_rate_limit(spark, folder):
    got = drain(jobs.rate_limited(jobs.event_stream(spark, folder, 10), limit=1, late="40 days"), "limited", "append")
    want = review.rate_limit(spark.read.parquet(PATH), limit=1)
    assert {(r.event_id, r.allowed) for r in got.collect()} == {(r.event_id, r.allowed) for r in want.collect()}


def test_rate_limit_over_batches_restarts_and_late_rows(spark, tmp_path):
    """State and timers survive a restart between batches; rows behind the watermark are left out."""
    at = lambda m, s=0: f"2024-01-01 {8 + m // 60:02d}:{m % 60:02d}:{s:02d}"
    batches = [
        [(1, 1, at(0)), (2, 1, at(10)), (3, 1, at(20)), (4, 2, at(5))],
        [(5, 1, at(60)), (6, 1, at(60, 1)), (7, 2, at(61)), (8, 2, at(62)), (9, 2, at(63))],
        [(10, 1, at(400)), (11, 1, at(401)), (12, 1, at(402))],
        [(13, 1, at(30)), (14, 1, at(461, 1)), (15, 2, at(403))],
    ]
    rows = []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(str(tmp_path / "in"))
        out = jobs.rate_limited(stream, limit=2, late="10 minutes")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
        rows += batch
    got = {r.event_id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    kept = spark.createDataFrame([r for r in rows if r[0] != 13], "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert got == {r.event_id: r.allowed for r in review.rate_limit(kept, limit=2).collect()}
    assert got[3] is False and got[5] is False and got[6] is True and got[14] is True and 13 not in got


def test_stream_static_join(spark, folder, tmp_path):
    spark.createDataFrame([(7, "x one two three four y")], "id long, text string").write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "t"))
    passages = spark.createDataFrame([(1, "One two three, four")], "item_id long, text string")
    got = drain(jobs.known_passages(stream, passages), "known", "append")
    assert sorted((r.pos, r.gram) for r in got.collect()) == [(1, "one two three"), (2, "two three four")]


def test_sliding_session_and_daily(spark, folder):
    batch = spark.read.parquet(PATH).withColumn("ts", F.col("ts").cast("timestamp"))
    events = lambda: jobs.event_stream(spark, folder, 10)
    got = drain(jobs.window_counts(events(), "2 hours", "1 hour"), "sliding", "complete")
    want = batch.groupBy(F.window("ts", "2 hours", "1 hour"), "event_type").count()
    assert got.count() == want.count() and got.agg(F.sum("n")).first()[0] == 2 * batch.count()
    got = drain(jobs.spend_by_day(events()), "days", "complete")
    want = batch.groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("spent"))
    assert {r.day: round(r.spent, 4) for r in got.collect()} == {r.day: round(r.spent, 4) for r in want.collect()}
    got = drain(jobs.session_counts(events(), "30 minutes"), "sessions", "complete")
    want = batch.groupBy(F.session_window("ts", "30 minutes"), "user_id").count()
    assert sorted(r.n for r in got.collect()) == sorted(r["count"] for r in want.collect())
