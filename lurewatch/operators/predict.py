"""The batch predictor: lists of names in, ranked brand detections out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .datasets import rename_first, union_all
from .decide import SECOND_STAGE, batch_classify
from .lexical import any_of
from .rules import guarded_brand, target_and_confidence

Scorer = Callable[[DataFrame], DataFrame]


def watched(names: DataFrame) -> DataFrame:
    return names.filter(any_of(F.lower("domain"), C.WATCHLIST))


def targets(df: DataFrame) -> DataFrame:
    """df plus guarded brand, target and how sure it is."""
    df = df.withColumn("brand", guarded_brand(F.col("domain")))
    target, sure = target_and_confidence(F.col("domain"), F.col("brand"))
    return df.withColumns({"target": target, "target_confidence": sure})


def without_false_positives(df: DataFrame) -> DataFrame:
    """df without names that hold a service word and without generic financial and government targets."""
    return df.filter(~(any_of(F.lower("domain"), (*C.SERVICE_WORDS, "service")) | F.col("target").isin(*C.GENERIC_TARGETS)))


def batch_predict(parts: list[DataFrame], scored: Scorer, facts: DataFrame, stage: int = SECOND_STAGE, top: int = 1000) -> DataFrame:
    """The most confident detections with a known target.

    parts: lists whose first column holds the names; scored: adds `score`, the probability of phishing, to distinct watched
    names; facts (domain, live, shot, match, ui): what the second stage sees, one row a name, absent ones count as not live.
    The first `stage` open names by confidence go through the second stage, and the `top` most confident of those that end
    as Phishing with a known target are kept, by name among equals. A name in several lists counts once; null names go.
    """
    names = union_all([rename_first(p).select("domain") for p in parts]).filter("domain is not null").distinct()
    rows = scored(watched(names)).withColumns({"label": F.when(F.col("score") > C.BATCH_THRESHOLD, "Phishing").otherwise("Legitimate"), "confidence": F.greatest("score", 1 - F.col("score"))})
    kept = without_false_positives(targets(rows.select("domain", "label", "confidence")))
    flags = ("live", "shot", "match", "ui")
    seen = kept.join(facts.select("domain", *flags), "domain", "left").na.fill(False, list(flags))
    final = batch_classify(seen, "domain", [F.desc("confidence"), "domain"], stage)
    found = final.filter((F.col("final_label") == "Phishing") & (F.col("target") != "Unknown"))
    return found.orderBy(F.desc("confidence"), "domain").limit(top).select("domain", "target", "target_confidence", "confidence", "final_confidence", "reason")
