"""Frequencies, confusion counts, metrics and threshold choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import running_sums


def frequency(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share), most frequent first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total").orderBy(F.desc("n"), column)  # one row


def metrics(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, r = safe(tp, tp + fp), safe(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": safe(2 * p * r, p + r)}


def confusion(y: Column, predicted: Column) -> list[Column]:
    return [F.count_if(y & predicted).alias("tp"), F.count_if(~y & predicted).alias("fp"), F.count_if(y & ~predicted).alias("fn"), F.count_if(~y & ~predicted).alias("tn")]


def sweep(df: DataFrame, y: str, score: str, thresholds) -> DataFrame:
    """Confusion and metrics at each threshold, in one pass over df."""
    cuts = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    counted = df.groupBy(y, score).agg(F.count(F.lit(1)).alias("w")).select("*", cuts)
    hit, pos = F.col(score) >= F.col("threshold"), F.col(y)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0))
    out = counted.groupBy("threshold").agg(total(pos & hit).alias("tp"), total(~pos & hit).alias("fp"), total(pos & ~hit).alias("fn"), total(~pos & ~hit).alias("tn"))
    return out.withColumns({k: F.round(v, 6) for k, v in metrics(F.col("tp"), F.col("fp"), F.col("fn")).items()})


def precision_threshold(df: DataFrame, y: str, score: str, target: float) -> DataFrame:
    """(threshold, precision): the least score cut whose precision reaches target, else the cut of best precision.

    Scores are first counted; the running sums go over ranges of the distinct scores."""
    by = df.groupBy(F.round(score, 6).alias("threshold")).agg(F.count_if(y).alias("p"), F.count(F.lit(1)).alias("n")).withColumn("down", -F.col("threshold"))
    curve = running_sums(by, "down", {"ps": "p", "ns": "n"}).select("threshold", (F.col("ps") / F.col("ns")).alias("precision"))
    pick = F.coalesce(F.min_by(F.struct("threshold", "precision"), F.when(F.col("precision") >= target, F.col("threshold"))), F.max_by(F.struct("threshold", "precision"), F.struct("precision", "threshold")))
    return curve.agg(pick.alias("x")).select("x.threshold", F.round("x.precision", 6).alias("precision"))


def extremes(df: DataFrame, key: str, score: str, n: int, *ties: str) -> DataFrame:
    """The n lowest rows of each key by score."""
    order = Window.partitionBy(key).orderBy(F.asc(score), *ties)
    return df.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n)


def choose_threshold(curve: DataFrame, precision: float, recall: float) -> DataFrame:
    """(threshold): of the rows of a sweep that reach both targets the one of best recall, else that of best F1; the least
    threshold of equals."""
    fits = (F.col("precision") >= precision) & (F.col("recall") >= recall)
    best = F.max_by("threshold", F.when(fits, F.struct("recall", -F.col("threshold"))))
    return curve.agg(F.coalesce(best, F.max_by("threshold", F.struct("f1", -F.col("threshold")))).alias("threshold"))


def pattern_counts(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    return df.agg(*(F.count_if(c).alias(n) for n, c in flags.items()))


def leading(values: dict[str, float], n: int = 3) -> list[str]:
    """Names of the n largest values, the first in name order of equals."""
    return [k for k, _ in sorted(values.items(), key=lambda kv: (-kv[1], kv[0]))[:n]]
