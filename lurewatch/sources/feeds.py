"""Readers of the feeds: labelled lists, public phishing lists, rank lists, certificate and message logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import PHISHTANK_BRANDS, SOCIAL_WHITELIST
from ..operators.content import urls
from ..operators.datasets import union_all
from ..operators.lexical import any_of
from ..operators.normalize import host_or_null, host_without_port, link_host, strip_www

PHISHTANK = "phish_id STRING, url STRING, phish_detail_url STRING, submission_time STRING, verified STRING, verification_time STRING, online STRING, target STRING"
URLHAUS = "id STRING, dateadded STRING, url STRING, url_status STRING, last_online STRING, threat STRING, tags STRING, url_sha256 STRING, reporter STRING"
MAJESTIC = "GlobalRank INT, TldRank INT, Domain STRING, TLD STRING, RefSubNets BIGINT, RefIPs BIGINT, IDN_Domain STRING, IDN_TLD STRING, PrevGlobalRank INT, PrevTldRank INT, PrevRefSubNets BIGINT, PrevRefIPs BIGINT"
#: column of the training workbook (as CSV) -> name
WORKBOOK = {
    "Identified Phishing/Suspected Domain Name": "domain",
    "Critical Sector Entity Name": "cse_name",
    "Corresponding CSE Domain Name": "cse_domain",
    "Phishing/Suspected Domains (i.e. Class Label)": "label",
    "Evidence file name": "evidence_filename",
    "Source of detection": "source",
}


def workbook(spark: SparkSession, path: str, names: dict[str, str] = WORKBOOK) -> DataFrame:
    """The training list, exported as CSV with a header, with short column names."""
    return spark.read.option("header", True).csv(path).withColumnsRenamed(names)


def training_set(spark: SparkSession, path: str, source: str = "training_set") -> DataFrame:
    """(domain, label, source) of the training list."""
    return workbook(spark, path).select("domain", "label", F.lit(source).alias("source"))


def labelled_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(domain, label, source) of a CSV file with these columns, such as synthetic names."""
    return spark.read.option("header", True).csv(path).select("domain", "label", F.lit(source).alias("source"))


def host_lists(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(domain): the distinct lines of several host lists, comments left out."""
    return union_all([lines(spark, p, p).select("domain") for p in paths]).distinct()


def with_evidence(rows: DataFrame, folder: str) -> DataFrame:
    """rows plus evidence_path and evidence_exists, from a listing of the folder instead of a test for each row."""
    files = rows.sparkSession.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("_f")).distinct()
    found = rows.join(files, F.col("evidence_filename") == F.col("_f"), "left")
    return found.withColumns({"evidence_path": F.concat(F.lit(folder.rstrip("/") + "/"), "evidence_filename"), "evidence_exists": F.col("_f").isNotNull()}).drop("_f")


def flexible(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(domain, label, source) of CSV files whose columns are the first named like domain and label; a file without
    them is left out. paths: source name -> file."""
    parts = []
    for name, path in paths.items():
        df = spark.read.option("header", True).csv(path)
        found = [next((c for c in df.columns if word in c.lower()), None) for word in ("domain", "label")]
        if all(found):
            parts.append(df.select(F.col(f"`{found[0]}`").alias("domain"), F.col(f"`{found[1]}`").alias("label"), F.lit(f"mock_{name}").alias("source")))
    return union_all(parts) if parts else spark.createDataFrame([], "domain string, label string, source string")


def phishtank(spark: SparkSession, path: str) -> DataFrame:
    """Online entries whose target or URL names a watched brand, labelled Phishing."""
    rows = spark.read.option("header", True).option("multiLine", False).schema(PHISHTANK).csv(path)
    text = F.concat(F.lower(F.coalesce("target", F.lit(""))), F.lower(F.coalesce("url", F.lit(""))))
    kept = rows.filter((F.lower("online") == "yes") & any_of(text, PHISHTANK_BRANDS))
    return kept.select(host_without_port(F.col("url")).alias("domain"), F.lit("Phishing").alias("label"), F.lit("phishtank").alias("source"))


def lines(spark: SparkSession, path: str, source: str, label: str = "Phishing") -> DataFrame:
    """A list with one URL or host a line; blank lines and # comments are left out."""
    rows = spark.read.text(path).select(F.trim("value").alias("v")).filter((F.col("v") != "") & ~F.startswith("v", F.lit("#")))
    return rows.select(host_or_null(F.col("v")).alias("domain"), F.lit(label).alias("label"), F.lit(source).alias("source"))


def urlhaus(spark: SparkSession, path: str, phishing_only: bool = False) -> DataFrame:
    """Entries that are online or unknown; phishing_only: those that tags, threat or URL call phishing."""
    rows = spark.read.option("comment", "#").option("mode", "DROPMALFORMED").option("escape", '"').schema(URLHAUS).csv(path).filter(F.col("url_status").isin("online", "unknown"))
    if phishing_only:
        rows = rows.filter(F.coalesce(F.col("tags").rlike("(?i)phishing"), F.lit(False)) | (F.lower("threat") == "phishing") | F.col("url").rlike("(?i)verification|login|account|secure|update"))
    return rows.select(host_or_null(F.col("url")).alias("domain"), F.lit("Phishing").alias("label"), F.lit("urlhaus").alias("source"))


def ranked(spark: SparkSession, path: str, low: int = 1000, high: int = 101_000) -> DataFrame:
    """Rank list (rank, domain without a header): names of ranks low..high, labelled Legitimate."""
    rows = spark.read.schema("rank INT, domain STRING").csv(path).filter(F.col("rank").between(low, high))
    return rows.select("domain", F.lit("Legitimate").alias("label"), F.lit("tranco").alias("source"))


def majestic(spark: SparkSession, path: str, low: int = 1000, high: int = 51_000) -> DataFrame:
    """Names of places low (exclusive) to high by rank; the file's own order is not relied on."""
    rows = spark.read.option("header", True).schema(MAJESTIC).csv(path).filter((F.col("GlobalRank") > low) & (F.col("GlobalRank") <= high))
    return rows.select(F.col("Domain").alias("domain"), F.lit("Legitimate").alias("label"), F.lit("majestic").alias("source"))


def rank_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(domain, rank): one row a name; of repeated names the rank that stands last in the file."""
    rows = spark.read.schema("rank INT, domain STRING").csv(path)
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = rows.select(strip_www(F.col("domain")).alias("domain"), "rank", place.alias("place"))
    return rows.groupBy("domain").agg(F.max_by("rank", "place").alias("rank"))


def certificate_entries(entries: DataFrame, most: int = 50) -> DataFrame:
    """(keyword, entry, name_value) of a polled log -> (keyword, domain): the first entries of each keyword, split."""
    order = Window.partitionBy("keyword").orderBy("entry")
    first = entries.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    names = first.select("keyword", F.explode(F.split("name_value", "\n")).alias("n"))
    return names.select("keyword", F.regexp_replace(F.trim("n"), r"^\*\.", "").alias("domain")).filter("domain <> ''").distinct()


def channel_links(messages: DataFrame, text: str = "text", hrefs: str = "hrefs", whitelist=SOCIAL_WHITELIST) -> DataFrame:
    """(domain): hosts of the http links of messages, from their text and their list of hrefs, but for listed ones."""
    links = F.array_union(urls(F.coalesce(F.col(text), F.lit(""))), F.filter(F.coalesce(F.col(hrefs), F.expr("cast(array() as array<string>)")), lambda h: F.startswith(h, F.lit("http"))))
    return messages.select(F.explode(links).alias("u")).select(link_host(F.col("u")).alias("domain")).filter((F.col("domain") != "") & ~F.col("domain").isin(*whitelist)).distinct()


def brand_reference(rows: DataFrame, order: str = "row", name: str = "organisation", domain: str = "domain") -> DataFrame:
    """(domain, organisation): names filled downwards over a reference sheet, rows without a domain left out."""
    window = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # a sheet of brands
    filled = rows.withColumn("_n", F.last(name, ignorenulls=True).over(window))
    return filled.filter(F.col(domain).isNotNull()).select(F.lower(F.trim(domain)).alias("domain"), F.col("_n").alias("organisation"))


def inspect(df: DataFrame, n: int = 5) -> str:
    """Schema and first rows as text."""
    return df._jdf.schema().treeString() + df.limit(n).toPandas().to_string()
