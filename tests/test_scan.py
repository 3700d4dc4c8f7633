"""Ordered scans, against plain loops."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import datasets, evaluate, scan

rng = random.Random(9)


def window_specs(df):
    """The partition keys of each window in the plan; none for a window over all rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Window [" in line], plan


@pytest.mark.parametrize("ranges", [1, 2, 64])
def test_running_sums(spark, ranges):
    rows = [(rng.choice([None, *range(-50, 400)]), rng.choice([None, 0, 1, 5]), rng.choice([None, 0.5, 2.0])) for _ in range(1500)] + [(7, 1, 1.0)] * 500
    df = spark.createDataFrame(rows, "o int, a int, b double").repartition(7)
    got = collections.Counter((r.o, r.a, r.b, r.sa, round(r.sb, 6)) for r in scan.running_sums(df, "o", {"sa": "a", "sb": "b"}, ranges).collect())
    key = lambda o: -(10**9) if o is None else o
    upto = lambda o, i: sum(r[i] or 0 for r in rows if key(r[0]) <= key(o))
    cache = {o: (upto(o, 1), round(upto(o, 2), 6)) for o in {r[0] for r in rows}}
    assert got == collections.Counter((*r, *cache[r[0]]) for r in rows)


@pytest.mark.parametrize("kind", ["long", "timestamp"])
def test_last_known(spark, kind):
    at = (lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)) if kind == "timestamp" else (lambda i: i)
    rows = [(rng.choice([None, "hot", "hot", "hot", f"g{i % 300}"]), at(i), rng.choice([None, None, None, f"v{i}"])) for i in range(3000)]
    df = spark.createDataFrame(rows, f"g string, o {kind}, v string").withColumn("_own2", F.lit(1)).repartition(9)
    last, want = {}, collections.Counter()
    for g, o, v in rows:
        last[g] = v if v is not None else last.get(g)
        want[g, o, last[g], 1] += 1
    out = scan.last_known(df, "v", "o", "g", 16)
    assert out.columns == ["g", "o", "v", "_own2"] and collections.Counter(tuple(r) for r in out.collect()) == want


def test_no_window_over_all_rows(spark):
    df = spark.range(5000).select((F.col("id") % 997 / 997).alias("s"), (F.col("id") % 3 == 0).alias("y"), F.col("id").alias("o"), F.floor(F.col("id") / 100_000).alias("g"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    for out in (evaluate.precision_threshold(df, "y", "s", 0.4), datasets.forward_fill(df, "v", "o", "g")):
        windows, plan = window_specs(out)
        assert windows and "SinglePartition" not in plan.split("Window [")[-1] and all("windowspecdefinition(_range" in w or "windowspecdefinition(g" in w or "windowspecdefinition(_g" in w for w in windows)
    hot = datasets.forward_fill(df, "v", "o", "g")
    assert hot.filter("v <> o - o % 5").count() == 0 and hot.count() == 5000
    assert scan.ranged(df, "o").groupBy("_range").count().agg(F.max("count")).first()[0] < 3 * 5000 / scan.RANGES


def test_empty_and_single_rows(spark):
    df = spark.createDataFrame([], "o int, a int, g string")
    assert scan.running_sums(df, "o", {"s": "a"}).collect() == scan.last_known(df, "a", "o", "g").collect() == []
    one = spark.createDataFrame([(None, 3, None), (None, None, None)], "o int, a int, g string")
    assert {r.s for r in scan.running_sums(one, "o", {"s": "a"}).collect()} == {3}
