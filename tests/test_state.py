"""What streams remember falls after the horizon."""

import datetime as dt
import time

from pyspark.sql import functions as F

from lurewatch.streaming import jobs


def day(n, seconds=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, seconds=seconds)


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / "in"))


def run(stream, path, name):
    """Take in what is there; rows of state at the end, and all rows so far."""
    q = stream.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    state = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    return state, sorted(tuple(r) for r in stream.sparkSession.read.parquet(str(path / "out")).collect())


def test_jobs_are_forgotten_after_the_horizon(spark, tmp_path):
    schema = "job long, seq long, failed boolean, at timestamp"
    make = lambda: jobs.retries(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), horizon=86_400)
    put(spark, [(j, 0, True, day(0, j)) for j in range(50)] + [(j, 0, False, day(0)) for j in range(100, 150)], schema, tmp_path)
    held, out = run(make(), tmp_path, "a")
    assert held >= 50 and len(out) == 100
    put(spark, [(1, 1, True, day(0, 7200))], schema, tmp_path)
    _, out = run(make(), tmp_path, "a")
    assert (1, "retry", 2, 120) in out
    put(spark, [(200, 0, False, day(9))], schema, tmp_path)
    put(spark, [(201, 0, True, day(9))], schema, tmp_path)
    run(make(), tmp_path, "a")
    put(spark, [(1, 2, True, day(9, 1)), (202, 0, False, day(9, 1))], schema, tmp_path)
    held, out = run(make(), tmp_path, "a")
    assert held <= 4  # jobs 201 and 1, a value and a timer each; all fifty are gone
    assert out.count((1, "retry", 1, 30)) == 2 and not any(o == "dead" for _, o, *_ in out)


def test_only_states_that_matter_are_kept(spark, tmp_path):
    schema = "domain string, seq long, state string, credentials boolean, at timestamp"
    make = lambda: jobs.escalations(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), horizon=90 * 86_400)
    put(spark, [(f"d{i}", 0, ("parked", "lookalike")[i % 2], True, day(0)) for i in range(40)], schema, tmp_path)
    held, out = run(make(), tmp_path, "b")
    assert held <= 40 and out == []  # twenty values and their timers
    put(spark, [("d0", 1, "lookalike", True, day(80)), ("d1", 1, "lookalike", True, day(80))], schema, tmp_path)
    _, out = run(make(), tmp_path, "b")
    assert out == [("d0", 1, "Suspected->Phishing")]
    put(spark, [("x", 0, "other", False, day(200))], schema, tmp_path)
    run(make(), tmp_path, "b")
    put(spark, [("d2", 1, "lookalike", True, day(200, 1))], schema, tmp_path)  # beyond the horizon
    held, out = run(make(), tmp_path, "b")
    assert held == 0 and len(out) == 1


def test_without_a_horizon_ended_jobs_leave_nothing(spark, tmp_path):
    schema = "job long, seq long, failed boolean"
    put(spark, [(j, i, j % 2 == 0) for j in range(20) for i in range(3)], schema, tmp_path)  # dead after three, or done
    held, out = run(jobs.retries(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), tmp_path, "c")
    assert held == 0 and len(out) == 60


def test_delayed_jobs_have_a_time_to_live(spark, tmp_path):
    schema = "job long, seq long, failed boolean"
    put(spark, [(j, 0, True) for j in range(30)], schema, tmp_path)
    stream = jobs.delayed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), (1, 1), horizon=6)
    q = stream.writeStream.format("memory").queryName("ttl").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        most, n, end = 0, 0, time.time() + 90
        while time.time() < end:
            n += 1
            put(spark, [(1000 + n, 0, False)], schema, tmp_path)
            time.sleep(2)
            progress = q.lastProgress
            held = progress["stateOperators"][0]["numRowsTotal"] if progress and progress["stateOperators"] else 0
            most = max(most, held)
            if most >= 30 and held == 0:
                break
        assert most >= 30 and held == 0
        assert spark.table("ttl").filter(F.col("outcome") == "ready").count() == 30
    finally:
        q.stop()
