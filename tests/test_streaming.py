"""Streams replayed from files give what the batch forms give."""

import json
import time

from pyspark.sql import functions as F

from lurewatch.sources.fixtures import fixture
from lurewatch.streaming import jobs


def run(stream, path, mode="append"):
    q = stream.writeStream.format("memory").queryName("t" + path.name.replace("-", "")).option("checkpointLocation", str(path / "c")).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.sparkSession.table(q.name) if hasattr(q, "sparkSession") else None


def collect(spark, stream, path):
    run(stream, path)
    return spark.table("t" + path.name.replace("-", "")).collect()


def polled(spark, stream, path, done, seconds=90):
    """Rows of a stream with timers, which never comes to an end by itself: as soon as they are what is waited for."""
    name = "p" + path.name.replace("-", "")
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(path / "c")).outputMode("append").start()
    try:
        end = time.time() + seconds
        while time.time() < end:
            rows = spark.table(name).collect()
            if done(rows):
                return rows
            time.sleep(1)
        raise AssertionError(f"not in {seconds} s: {rows}")
    finally:
        q.stop()


def test_daily_dedup(spark, sf, tmp_path):
    batch = fixture(spark, sf, "jobs").select(F.col("user_id").cast("string").alias("domain"), "ts")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("domain string, ts timestamp").parquet(str(tmp_path / "in"))
    got = collect(spark, jobs.daily_dedup(stream), tmp_path)
    assert len(got) == batch.select("domain", F.to_date("ts")).distinct().count()


def test_retry(spark, tmp_path):
    rows = [(1, i, f) for i, f in enumerate((True, True, True, True))] + [(2, 0, True), (2, 1, False), (2, 2, True)]
    spark.createDataFrame(rows, "job long, seq long, failed boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job long, seq long, failed boolean").parquet(str(tmp_path / "in"))
    got = sorted((r.job, r.outcome, r.retries, r.delay_s) for r in collect(spark, jobs.retries(stream), tmp_path))
    assert got == [(1, "dead", 3, 0), (1, "retry", 1, 30), (1, "retry", 1, 30), (1, "retry", 2, 120), (2, "done", 0, 0), (2, "retry", 1, 30), (2, "retry", 1, 30)]


def test_escalation(spark, tmp_path):
    rows = [("1", 0, "parked", False), ("1", 1, "lookalike", True), ("2", 0, "lookalike", True), ("3", 0, "unrelated", False), ("3", 1, "lookalike", False)]
    spark.createDataFrame(rows, "domain string, seq long, state string, credentials boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("domain string, seq long, state string, credentials boolean").parquet(str(tmp_path / "in"))
    assert [(r.domain, r.seq) for r in collect(spark, jobs.escalations(stream), tmp_path)] == [("1", 1)]


def test_certificate_names(spark):
    message = {"message_type": "certificate_update", "data": {"leaf_cert": {"all_domains": ["*.sbi-kyc.xyz", "garden.org"]}}}
    df = spark.createDataFrame([(json.dumps(message),), (json.dumps({"message_type": "heartbeat"}),)], "value string")
    assert [r.domain for r in jobs.certificate_names(df).collect()] == ["sbi-kyc.xyz"]


def test_order_across_chunks():
    import pandas as pd

    parts = iter([pd.DataFrame({"seq": [5, 3], "failed": [True, False]}), pd.DataFrame({"seq": [4, 1], "failed": [True, True]})])
    assert jobs.in_order(parts, ("seq", "failed")) == [(1, True), (3, False), (4, True), (5, True)]


def test_delayed_jobs_come_back(spark, tmp_path):
    schema = "job long, seq long, failed boolean"
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(folder))
    spark.createDataFrame([(1, 0, True), (2, 0, True), (2, 1, True), (2, 2, True), (3, 0, False)], schema).coalesce(1).write.mode("append").parquet(str(folder))
    got = polled(spark, jobs.delayed(stream, (1, 1)), tmp_path, lambda rows: {(1, "ready", 1), (2, "dead", 3)} <= {(r.job, r.outcome, r.retries) for r in rows})
    assert not any(r.job == 3 for r in got)


def test_monitoring_has_a_horizon(spark, tmp_path):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [("a", day(0), "parked", False), ("a", day(2), "lookalike", True), ("a", day(89), "unrelated", False), ("a", day(90), "lookalike", True), ("b", day(1), "lookalike", True)]
    schema = "domain string, at timestamp, state string, credentials boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = sorted((r.domain, r.checks, r.change) for r in polled(spark, jobs.monitored(stream), tmp_path, lambda rows: len(rows) >= 4))
    assert got == [("a", 1, None), ("a", 2, "Suspected->Phishing"), ("a", 3, None), ("b", 1, None)]


def test_queue_and_feed(spark, tmp_path):
    from lurewatch.operators import store

    names = spark.createDataFrame([("sbi-kyc.xyz",), ("garden.org",)], "domain string")
    store.push(store.queued(names, "ct", F.lit("2024-01-15").cast("timestamp")), str(tmp_path / "q"))
    names.select(F.col("domain").alias("value")).write.text(str(tmp_path / "f"))
    running = jobs.start_all({"jobs": (jobs.queue(spark, str(tmp_path / "q")), str(tmp_path / "o1")), "feed": (jobs.daily_feed(spark, str(tmp_path / "f")), str(tmp_path / "o2"))}, str(tmp_path / "c"))
    for q in running.values():
        q.awaitTermination()
    assert sorted((r.domain, r.retries) for r in spark.read.parquet(str(tmp_path / "o1")).collect()) == [("garden.org", 0), ("sbi-kyc.xyz", 0)]
    assert [r.domain for r in spark.read.parquet(str(tmp_path / "o2")).collect()] == ["sbi-kyc.xyz"]
