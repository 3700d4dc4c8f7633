"""Decision operators: scores in, verdict columns out. All are single expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def blend(first: Column, second: Column, weight: float = 0.6) -> Column:
    return weight * first + (1 - weight) * second


def content_boost(pw: Column, login: Column, obfuscated: Column, external: Column, redirected: Column, copyr: Column, favicon: Column) -> Column:
    add = lambda c, w: F.when(c, w).otherwise(0.0)
    return add(pw & login, 0.15) + add(obfuscated, 0.10) + add(external, 0.15) + add(redirected, 0.10) - add(copyr & favicon, 0.10)


def verdict(df: DataFrame, score: Column, boost: Column, visual: Column, has_shot: Column, threshold: float = C.THRESHOLD, band: tuple[float, float] = C.BAND, trigger: float = C.TRIGGER) -> DataFrame:
    """df plus status, analysis, ml_confidence and adjusted (null outside the band)."""
    inside = score.between(*band)
    adjusted = F.when(inside, F.least(F.lit(1.0), score + boost))
    case = F.when(score >= threshold, "Phishing|ML-v7-Ensemble").when(adjusted >= threshold, "Phishing|ML + Content Analysis").when((score >= trigger) & visual, "Phishing|ML + OCR Fallback").when((score >= trigger) & ~has_shot, "Suspected|ML + Reachability Check").when(score >= trigger, "Suspected|ML-v6-Full-Signal").otherwise("Clean|ML-v7-Ensemble")
    return df.withColumns({"ml_confidence": F.bround(score, 4), "adjusted": F.bround(adjusted, 4), "_v": F.split(case, "[|]")}).withColumns({"status": F.col("_v")[0], "analysis": F.col("_v")[1]}).drop("_v")


def visual_decision(text_match: Column, distance: Column, confidence: Column) -> tuple[Column, Column, Column]:
    """(score, confirmed, confidence) of text and image evidence."""
    score = F.when(text_match, 3).otherwise(0) + F.when(distance <= 20, 4).otherwise(0)
    return score, score >= 4, F.when(score >= 4, 1.0).otherwise(confidence * 0.7)


def two_stage(label: Column, confidence: Column, live: Column, shot: Column, match: Column, ui: Column) -> tuple[Column, Column]:
    open_ = label.isin("Phishing", "Suspected")
    final = F.when(~open_, "Legitimate").when(live & shot & match & ui, "Phishing").otherwise("Suspected")
    value = F.when(~open_, confidence).when(~live, confidence * 0.7).when(~shot, confidence * 0.8).when(match & ui, F.least(F.lit(1.0), confidence + 0.2)).otherwise(confidence * 0.9)
    return final, value


def matrix(content: Column, lexical: Column, age_days: Column) -> tuple[Column, Column]:
    keep = ((lexical > 0.7) & (age_days < 30)) | (lexical > 0.8)
    label = F.when(content == "Phishing", "Phishing").when((content == "Suspected") & keep, "Suspected").otherwise("Legitimate")
    value = F.when(content == "Phishing", F.greatest(lexical, F.lit(0.8))).when(content == "Legitimate Service", 0.1).when((content == "Suspected") & keep, lexical).when(content == "Suspected", 1 - lexical).otherwise(0.2)
    return label, value


def content_state(shot: Column, parked: Column, lookalike: Column, credentials: Column) -> Column:
    return F.when(~shot, "blocked").when(parked, "parked").when(lookalike & credentials, "lookalike").when(~lookalike & ~credentials, "unrelated").otherwise("unknown")


def escalated(previous: Column, now: Column, credentials: Column) -> Column:
    return previous.isin("parked", "unrelated") & (now == "lookalike") & credentials


def false_negative_kind(registered_length: Column, has_brand: Column, subdomains: Column) -> Column:
    return F.when(registered_length < 12, "a").when(~has_brand, "b").when(subdomains >= 2, "c").otherwise("d")


def cse_like_ui(login: Column, pw: Column, user: Column, submit: Column, logo: Column, n_texts: Column, is_bank: Column, bank_terms: Column) -> Column:
    support = submit.cast("int") + logo.cast("int") + (n_texts > 5).cast("int") + (is_bank & bank_terms).cast("int")
    return login & (pw | user) & (support >= 1)


def blame(first: Column, second: Column, cut: float = 0.5) -> Column:
    """Which of two models misses: the one below the cut."""
    return F.when((first < cut) & (second < cut), "Both").when(first < cut, "XGBoost").when(second < cut, "RF").otherwise("None")


#: rows that the second stage of a batch takes
SECOND_STAGE = 100


def batch_classify(df: DataFrame, key: str, order: list, n: int = SECOND_STAGE) -> DataFrame:
    """df (key, label, confidence, live, shot, match, ui) plus final_label, final_confidence and reason: the first n rows by
    order that are Phishing or Suspected go through the second stage, the others keep their label. key is unique."""
    chosen = df.filter(F.col("label").isin("Phishing", "Suspected")).orderBy(*order).limit(n).select(F.col(key).alias("_k"))
    out = df.join(F.broadcast(chosen), F.col(key) == F.col("_k"), "left").withColumn("_on", F.col("_k").isNotNull())  # n rows
    c = F.col
    label, value = two_stage(c("label"), c("confidence"), c("live"), c("shot"), c("match"), c("ui"))
    reason = F.when(~c("_on"), "Initial lexical").when(~c("live"), "No live content").when(~c("shot"), "No screenshot").when(c("match") & c("ui"), "Visual match").otherwise("No visual match")
    return out.withColumns({"final_label": F.when(c("_on"), label).otherwise(c("label")), "final_confidence": F.when(c("_on"), value).otherwise(c("confidence")), "reason": reason}).drop("_on", "_k")


def no_evidence(label: Column, confidence: Column, evidence: Column) -> tuple[Column, Column, Column]:
    """(label, confidence, note): Phishing without visual evidence is Suspected at six tenths."""
    down = (label == "Phishing") & ~F.coalesce(evidence, F.lit(False))
    return F.when(down, "Suspected").otherwise(label), F.when(down, confidence * 0.6).otherwise(confidence), F.when(down, "no visual evidence")


def health(depth: Column, seen: Column, as_of: Column, limit: int = 300) -> Column:
    """healthy, or degraded where the worker was not seen for over `limit` seconds."""
    stale = F.coalesce(F.timestamp_diff("SECOND", seen, as_of) > limit, F.lit(True))
    return F.when(stale, "degraded").otherwise("healthy")
