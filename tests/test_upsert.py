"""The keyed table of a stream: newest rows, whole versions, and files that do not grow with the batches."""

import random

import pytest
from pyspark.sql import functions as F

from lurewatch.streaming.upsert import Table

rng = random.Random(6)
SCHEMA = "k string, t int, v string"


def rows(df):
    return {r.k: (r.t, r.v) for r in df.collect()}


def test_newest_rows_over_many_batches(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), "k", "t", buckets=4, deltas=2)
    want, files = {}, []
    for n in range(40):
        batch = [(f"k{rng.randrange(60)}", n * 10 + i, f"v{n}-{i}") for i in range(rng.randrange(1, 4))]
        for k, t, v in batch:
            want[k] = (t, v)
        table.write(spark.createDataFrame(batch, SCHEMA).coalesce(1), n)
        if n % 10 == 9:
            files.append(len(table.read().inputFiles()))
            assert rows(table.read()) == want
    assert max(files) <= 4 * 3 and len(want) > 30
    assert table.read().columns == ["k", "t", "v"]
    some = table.rows_of(["k1", "k2", "none"])
    assert rows(some) == {k: want[k] for k in ("k1", "k2") if k in want} and len(some.inputFiles()) <= 3 * 3
    table.compact()
    assert len(table.read().inputFiles()) <= 4 and rows(table.read()) == want
    table.clean()
    assert rows(table.read()) == want and len(table._whole()) == 2


def test_batches_that_come_again_or_half(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table = Table(spark, path, "k", "t")
    with pytest.raises(ValueError):
        table.read()
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    table.write(make(("a", 1, "x"), ("a", 2, "y"), (None, 1, "n")), 0)
    before = len(table._whole())
    table.write(make(("a", 1, "x"), ("a", 2, "y"), (None, 1, "n")), 0)
    assert len(table._whole()) == before and rows(table.read()) == {"a": (2, "y"), None: (1, "n")}
    commit = Table._commit
    monkeypatch.setattr(Table, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        table.write(make(("a", 9, "lost"), ("b", 1, "z")), 1)
    assert rows(Table(spark, path, "k", "t").read()) == {"a": (2, "y"), None: (1, "n")}  # half a batch is not seen
    monkeypatch.setattr(Table, "_commit", commit)
    table.write(make(("a", 9, "again"), ("b", 1, "z")), 1)
    table.write(make(), 2)
    assert rows(table.read()) == {"a": (9, "again"), "b": (1, "z"), None: (1, "n")}
    other = Table(spark, path, "k", "t", buckets=7)  # a new checkpoint counts from 0; the buckets stay
    other.write(make(("a", 3, "old"), ("c", 1, "w")), 0)
    assert other.buckets == 64 and rows(other.read()) == {"a": (9, "again"), "b": (1, "z"), "c": (1, "w"), None: (1, "n")}
    (tmp_path / "t" / "versions" / "99").mkdir()  # a version that was not written whole
    assert rows(other.read())["c"] == (1, "w")


def test_as_a_sink(spark, tmp_path):
    spark.range(300).select((F.col("id") % 40).cast("string").alias("k"), F.col("id").cast("int").alias("t"), F.lit("v").alias("v")).repartition(3).write.parquet(str(tmp_path / "in"))
    table = Table(spark, str(tmp_path / "t"), "k", "t", buckets=3)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(table.write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert rows(table.read()) == {str(i): (max(x for x in range(300) if x % 40 == i), "v") for i in range(40)}
