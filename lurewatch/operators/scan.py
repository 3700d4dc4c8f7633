"""Ordered scans without one task for all rows: ranges of the order are scanned one by one, each from what the ranges before it left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ranges that the order is cut into
RANGES = 64


def _number(df: DataFrame, order: str) -> Column:
    kind = dict(df.dtypes)[order]
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    return (F.unix_date(order) if kind == "date" else F.col(order)).cast("double")


def ranged(df: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """df plus _range: the place of a number, date or time among cuts that part the rows about evenly; equal values share a range, null has -1."""
    x = _number(df, order)
    at = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(df.agg(F.percentile_approx(x, at, 5 * ranges)).first()[0] or [])) if at else []

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= cuts[mid], place(lo, mid)).otherwise(place(mid + 1, hi))

    return df.withColumn("_range", F.when(x.isNull(), -1).otherwise(place(0, len(cuts))))


def running_sums(df: DataFrame, order: str, sums: dict[str, str], ranges: int = RANGES) -> DataFrame:
    """df plus, for each name and column of sums, the column's sum up to and with the row, in order; rows of equal order get the sum with all
    of them. Nulls add nothing, a null order comes first."""
    rows = ranged(df, order, ranges)
    totals = rows.groupBy("_range").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items())).orderBy("_range").collect()  # a row for each range
    before, so_far = [], [0] * len(sums)
    for r in totals:
        before.append((r["_range"], *so_far))
        so_far = [a + r[n] for a, n in zip(so_far, sums)]
    kinds = {n: dict(df.dtypes)[c] for n, c in sums.items()}
    wide = {n: "double" if k in ("double", "float") else "bigint" for n, k in kinds.items()}
    start = df.sparkSession.createDataFrame([(a, *(float(v) if wide[n] == "double" else int(v) for n, v in zip(sums, vs))) for a, *vs in before], "_r int, " + ", ".join(f"`_{n}` {wide[n]}" for n in sums))
    here = Window.partitionBy("_range").orderBy(order)
    within = rows.withColumns({n: F.coalesce(F.sum(c).over(here), F.lit(0)) for n, c in sums.items()})
    found = within.join(F.broadcast(start), F.col("_range") == F.col("_r"))
    return found.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", "_r", *(f"_{n}" for n in sums))


def last_known(df: DataFrame, column: str, order: str, group: str, ranges: int = RANGES) -> DataFrame:
    """df with the nulls of `column` filled by the last value before them in their group. Groups are cut into ranges, so one of any size is many
    tasks; what a range leaves to the next is one row for each group and range."""
    rows = ranged(df, order, ranges)
    here = Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    every = rows.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(order))).alias("_left"))
    along = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # at most `ranges` rows a group
    carried = every.select("_g", "_r", F.last("_left", ignorenulls=True).over(along).alias("_before")).filter("_before is not null")
    filled = rows.withColumn("_own", F.last(column, ignorenulls=True).over(here))
    found = filled.join(carried, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")), "left")
    return found.withColumn(column, F.coalesce("_own", "_before")).select(*df.columns)
