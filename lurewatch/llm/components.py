"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _nearest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _nearest(both).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return both.join(low, both.u == low.n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _nearest(down)
    side = down.join(low.withColumnRenamed("u", "n"), F.col("u") == F.col("n")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return side.union(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links between long keys -> (node, root): every linked node with the least node it can reach.

    Self links and repeated links are allowed; nodes without a link to another node do not appear.
    An empty input gives an empty result.
    """
    now = written(edges.select("u", "v").filter("u <> v").distinct(), "links")
    before, mark = None, _mark(now)
    while mark[0] and mark != before:
        now = written(_small(_large(now)), "links")
        before, mark = mark, _mark(now)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(now.select("v", "v").distinct())
