"""State tables: upsert, insert-if-absent, due rows, monitoring records, dead letters and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decide import escalated


def latest(rows: DataFrame, key: str, *newest: str) -> DataFrame:
    """The newest row of each key (an aggregate: combined before the shuffle)."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("x")).select(key, "x.*")


def upsert(table: DataFrame, changes: DataFrame, key: str, *newest: str) -> DataFrame:
    """Table after changes: a changed key has its newest change, new keys are added, others stay."""
    fresh = latest(changes, key, *newest)
    return table.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def start_monitoring(domains: DataFrame, now: Column) -> DataFrame:
    return domains.select("domain", (now + F.expr("INTERVAL 1 DAY")).alias("next_check"), (now + F.expr("INTERVAL 90 DAYS")).alias("end_date"), F.lit(0).cast("bigint").alias("check_count"))


def restart_monitoring(table: DataFrame, domains: DataFrame, now: Column) -> DataFrame:
    """The monitoring table after a start of `domains`: a listed domain is replaced, its checks count from 0 again."""
    fresh = start_monitoring(domains.distinct(), now)
    return table.join(fresh.select("domain"), "domain", "left_anti").unionByName(fresh, allowMissingColumns=True)


def checked(table: DataFrame, checks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(table, log) after checks (domain, state, has_credentials): state moves to previous, the count and the next check
    advance, and a parked or unrelated page that turned into a look-alike with credentials is Phishing. Every check is one
    row of the log."""
    seen = checks.select(F.col("domain").alias("_d"), F.col("state").alias("_s"), F.col("has_credentials").alias("_c"))
    both = table.join(seen, F.col("domain") == F.col("_d"), "left").withColumn("_e", F.coalesce(escalated(F.col("state"), F.col("_s"), F.col("_c")), F.lit(False)))
    hit = F.col("_d").isNotNull()
    new = {"previous": F.when(hit, F.col("state")).otherwise(F.col("previous")), "state": F.coalesce("_s", "state"), "check_count": F.col("check_count") + hit.cast("bigint"), "next_check": F.when(hit, now + F.expr("INTERVAL 1 DAY")).otherwise(F.col("next_check")), "status": F.when(F.col("_e"), "Phishing").otherwise(F.col("status"))}
    log = both.filter(hit).select("domain", now.alias("checked_at"), F.col("_s").alias("state"), F.col("_c").alias("has_credentials"), F.when(F.col("_e"), "Suspected->Phishing").alias("status_change"))
    return both.withColumns(new).select(*table.columns), log


def queued(domains: DataFrame, source: str, at: Column) -> DataFrame:
    """(value): one JSON job a row, as the queue takes it."""
    return domains.select(F.to_json(F.struct("domain", F.lit(source).alias("source"), F.lit(0).alias("retries"), at.alias("queued_at"))).alias("value"))


def push(jobs: DataFrame, folder: str) -> None:
    """Append jobs to the queue's folder, which a stream reads as text."""
    jobs.select("value").write.mode("append").text(folder)


def cleared(failed: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """The failed jobs that stay after a clear, of some domains or of all."""
    return failed.limit(0) if domains is None else failed.join(domains.select("domain").distinct(), "domain", "left_anti")


def missing(wanted: DataFrame, done: DataFrame, key: str = "domain") -> DataFrame:
    """The rows of wanted that partial results lack."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def outcomes(requests: DataFrame, table: DataFrame, key: str, hit: int, miss: int) -> DataFrame:
    """requests plus `status`: hit where the key is in the table, else miss."""
    known = table.select(F.col(key).alias("_k")).distinct()
    return requests.join(known, F.col(key) == F.col("_k"), "left").withColumn("status", F.when(F.col("_k").isNotNull(), hit).otherwise(miss)).drop("_k")


def save(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a dataset, its features or a report as Parquet or as CSV with a header."""
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def due(monitored: DataFrame, as_of: Column) -> DataFrame:
    return monitored.filter((F.col("next_check") <= as_of) & (F.col("end_date") > as_of))


def rescan(scans: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Jobs for Suspected domains whose last scan is older than `days`."""
    old = scans.filter((F.col("label") == "Suspected") & (F.col("scan_date") < as_of - F.make_interval(days=F.lit(days))))
    return old.select("domain", F.lit("rescan").alias("source"), F.lit(0).alias("retries"))


def replay_failed(failed: DataFrame) -> DataFrame:
    return failed.drop("error").withColumn("retries", F.lit(0))


def as_json(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


TABLES = {
    "domain_scans": "id BIGINT, domain STRING, target_cse STRING, source STRING, scan_date TIMESTAMP, label STRING, confidence DOUBLE, is_live BOOLEAN, analyst_verdict STRING",
    "whitelist": "id BIGINT, domain STRING, added_by STRING, added_on TIMESTAMP, reason STRING",
    "audit_logs": "id BIGINT, actor STRING, action STRING, at TIMESTAMP, detail STRING",
    "monitored_domains": "domain STRING, target_cse STRING, started TIMESTAMP, next_check TIMESTAMP, end_date TIMESTAMP, check_count BIGINT, state STRING, previous STRING, has_credentials BOOLEAN, visual_distance DOUBLE, page_title STRING, form_count BIGINT, status STRING",
    "monitoring_log": "domain STRING, checked_at TIMESTAMP, state STRING, visual_distance DOUBLE, has_credentials BOOLEAN, screenshot STRING, html STRING, status_change STRING, notes STRING",
}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
