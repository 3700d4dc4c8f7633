"""Queries over feeds: derived tables are written as the feed's files and read back by its reader; and the dataset builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import datasets as DS
from ..operators import normalize as N
from ..operators.store import queued
from ..sources import feeds as FD
from ..sources.fixtures import exported, fixture
from ..streaming.jobs import certificate_names
from . import sqltext as S
from .registry import query

FEED, D, LAB = (S.fixture(n) for n in ("feed", "domains", "labelled"))
_HOST = f"regexp_replace({S.host('trim(url)')}, ':.*$', '')"


def feed(spark, sf):
    return fixture(spark, sf, "feed")


_BRANDED = S.any_of("concat(lower(target), lower(url))", C.PHISHTANK_BRANDS)


@query("feed_phishtank", f"SELECT {_HOST} AS domain, 'Phishing' AS label, 'phishtank' AS source FROM {FEED} f WHERE online = 'yes' AND {_BRANDED}")
def feed_phishtank(spark, sf):
    blank = [F.lit("x").alias(n) for n in ("detail", "submitted", "verified", "at")]
    path = exported(feed(spark, sf).select("k", "url", *blank, "online", "target"), header=True)
    return FD.phishtank(spark, path)


@query("feed_openphish", f"SELECT {_HOST} AS domain, 'Phishing' AS label, 'openphish' AS source FROM {FEED} f")
def feed_openphish(spark, sf):
    urls = feed(spark, sf).select(F.concat(F.lit("  "), "url").alias("value"))
    odd = spark.createDataFrame([("",), ("   ",), ("# list of the day",)], "value string")
    return FD.lines(spark, exported(urls.union(odd), text=True), "openphish")


@query("feed_host_lists", f"SELECT DISTINCT domain FROM {D} d WHERE k % 3 < 2")
def feed_host_lists(spark, sf):
    names = fixture(spark, sf, "domains")
    note = spark.createDataFrame([("# hosts",)], "value string")
    return FD.host_lists(spark, [exported(names.filter(F.col("k") % 3 == i).select(F.col("domain").alias("value")).union(note), text=True) for i in (0, 1)])


def _urlhaus(spark, sf):
    rows = feed(spark, sf).select("k", F.lit("2024-01-01").alias("added"), "url", "url_status", F.lit("x").alias("last"), "threat", "tags", F.lit("s").alias("sha"), F.lit("r").alias("who"))
    return exported(rows)


_LIVE = "url_status IN ('online', 'unknown')"


@query("feed_urlhaus", f"SELECT {_HOST} AS domain, 'Phishing' AS label, 'urlhaus' AS source FROM {FEED} f WHERE {_LIVE}")
def feed_urlhaus(spark, sf):
    return FD.urlhaus(spark, _urlhaus(spark, sf))


@query("feed_urlhaus_phishing", f"SELECT {_HOST} AS domain, 'Phishing' AS label, 'urlhaus' AS source FROM {FEED} f WHERE {_LIVE} AND (contains(lower(tags), 'phishing') OR lower(threat) = 'phishing' OR {S.any_of('lower(url)', ('verification', 'login', 'account', 'secure', 'update'))})")
def feed_urlhaus_phishing(spark, sf):
    return FD.urlhaus(spark, _urlhaus(spark, sf), phishing_only=True)


@query("feed_tranco", f"SELECT domain, 'Legitimate' AS label, 'tranco' AS source FROM {D} d WHERE k + 900 BETWEEN 1000 AND 101000")
def feed_tranco(spark, sf):
    return FD.ranked(spark, exported(fixture(spark, sf, "domains").select(F.col("k") + 900, "domain")))


@query("feed_majestic", f"SELECT domain, 'Legitimate' AS label, 'majestic' AS source FROM {D} d WHERE k + 900 > 1000 AND k + 900 <= 51000")
def feed_majestic(spark, sf):
    columns = [c.split()[0] for c in FD.MAJESTIC.split(", ")]
    known = {"GlobalRank": F.col("k") + 900, "Domain": F.col("domain"), "IDN_Domain": F.col("domain"), "TLD": F.lit("x"), "IDN_TLD": F.lit("x")}
    rows = fixture(spark, sf, "domains").select(*(known.get(c, F.lit(0)).alias(c) for c in columns))
    return FD.majestic(spark, exported(rows, header=True))


@query("feed_rank_lookup", f"SELECT regexp_replace(domain, '^www\\.', '') AS domain, arg_max(CASE WHEN dup = 1 THEN k - 1 ELSE k END, k * 2 + dup) AS rank FROM {D} d, (SELECT unnest([0, 1]) AS dup) u WHERE dup = 0 OR k % 10 = 0 GROUP BY 1")
def feed_rank_lookup(spark, sf):
    names = fixture(spark, sf, "domains")
    twice = names.select("k", F.lit(0).alias("dup"), "domain").union(names.filter("k % 10 = 0").select("k", F.lit(1), "domain"))
    rows = twice.coalesce(1).sortWithinPartitions("k", "dup").select((F.col("k") - F.col("dup")).alias("rank"), "domain")
    found = FD.rank_lookup(spark, exported(rows))
    return found.select("domain", F.col("rank").cast("bigint").alias("rank"))


@query("feed_workbook", f"SELECT raw AS domain, raw_label AS label, 'training_set' AS source FROM {LAB} l WHERE k % 6 <> 1")
def feed_workbook(spark, sf):
    rows = fixture(spark, sf, "labelled").filter("k % 6 <> 1")
    columns = [F.col("raw"), F.lit("c"), F.lit("d"), F.col("raw_label"), F.lit("e"), F.col("source")]
    path = exported(rows.select(*(c.alias(n) for c, n in zip(columns, FD.WORKBOOK))).withColumn("rest", F.lit(1)), header=True)
    return FD.training_set(spark, path)


@query("feed_mock_files", f"SELECT domain, CAST(k % 2 AS VARCHAR) AS label, CASE WHEN k % 3 = 0 THEN 'mock_a' ELSE 'mock_b' END AS source FROM {D} d WHERE k % 3 < 2")
def feed_mock_files(spark, sf):
    names = fixture(spark, sf, "domains")
    part = lambda i, a, b: exported(names.filter(F.col("k") % 3 == i).select(F.lit(0).alias("n"), F.col("domain").alias(a), (F.col("k") % 2).alias(b)), header=True)
    return FD.flexible(spark, {"a": part(0, "Phishing Domain", "Class Label"), "b": part(1, "domain_name", "label"), "c": part(2, "domain", "kind")})


@query("feed_synthetic_csv", f"SELECT domain, 'Phishing' AS label, 'synthetic' AS source FROM {D} d WHERE k % 5 = 0")
def feed_synthetic_csv(spark, sf):
    rows = fixture(spark, sf, "domains").filter("k % 5 = 0").select("domain", F.lit("Phishing").alias("label"))
    return FD.labelled_csv(spark, exported(rows, header=True), "synthetic")


_NEAR = "CASE " + " ".join(f"WHEN levenshtein(first, {S.q(w)}) <= {2 if len(w) <= 5 else 3} AND length(first) < {len(w) + 3} THEN {S.q(w)}" for w in C.EDIT_KEYWORDS) + " END"


@query("feed_certificates", f"SELECT domain, hit FROM (SELECT domain, coalesce({S.first_of('lower(domain)', [(w, n) for w, n, _ in C.BRAND_ORDER])}, {_NEAR}) AS hit FROM (SELECT domain, split_part(domain, '.', 1) AS first FROM {D} d WHERE k % 4 <> 3) t) u WHERE hit IS NOT NULL")
def feed_certificates(spark, sf):
    """Messages of a certificate log (heartbeats among them), exploded and filtered."""
    kind = F.when(F.col("k") % 4 == 3, "heartbeat").otherwise("certificate_update")
    body = F.struct(F.struct(F.array(F.concat(F.when(F.col("k") % 2 == 0, "*.").otherwise(""), "domain")).alias("all_domains")).alias("leaf_cert"))
    messages = fixture(spark, sf, "domains").select(F.to_json(F.struct(kind.alias("message_type"), body.alias("data"))).alias("value"))
    return certificate_names(messages)


@query("feed_certificate_poll", f"SELECT DISTINCT keyword, unnest([domain, concat('alt.', domain)]) AS domain FROM (SELECT split_part('sbi|hdfc|icici', '|', CAST(k % 3 + 1 AS INT)) AS keyword, domain, row_number() OVER (PARTITION BY k % 3 ORDER BY k) AS r FROM {D} d) t WHERE r <= 50")
def feed_certificate_poll(spark, sf):
    word = F.element_at(F.array(F.lit("sbi"), F.lit("hdfc"), F.lit("icici")), (F.col("k") % 3 + 1).cast("int"))
    return FD.certificate_entries(fixture(spark, sf, "domains").select(word.alias("keyword"), F.col("k").alias("entry"), F.concat(F.lit("*."), "domain", F.lit("\nalt."), "domain").alias("name_value")))


_LINK = "regexp_replace(regexp_extract(lower({}), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^www\\.', '')"


@query("feed_channel", f"SELECT DISTINCT domain FROM (SELECT {_LINK.format('u')} AS domain FROM (SELECT unnest([url, concat('http://www.', domain, ':81/x')]) AS u FROM {FEED} f WHERE k % 2 = 0) t) v WHERE domain <> ''")
def feed_channel(spark, sf):
    """Links of channel messages, from text and hrefs; hosts of the network itself are listed and left out."""
    text = F.concat(F.lit("see "), "url", F.lit(" or https://t.me/x and https://youtube.com/watch"))
    hrefs = F.array(F.concat(F.lit("http://www."), "domain", F.lit(":81/x")), F.lit("mailto:a@b.c"))
    return FD.channel_links(feed(spark, sf).filter("k % 2 = 0").select(text.alias("text"), hrefs.alias("hrefs")))


@query("feed_brand_reference", f"SELECT domain, last_value(name IGNORE NULLS) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS organisation FROM (SELECT k, CASE WHEN k % 7 <> 0 THEN domain END AS domain, CASE WHEN k % 4 = 1 THEN concat('Org ', k) END AS name FROM {D} d WHERE k <= 200) t QUALIFY domain IS NOT NULL")
def feed_brand_reference(spark, sf):
    rows = fixture(spark, sf, "domains").filter("k <= 200").select(F.col("k").alias("row"), F.when(F.col("k") % 7 != 0, F.concat(F.lit(" "), F.upper("domain"))).alias("domain"), F.when(F.col("k") % 4 == 1, F.concat(F.lit("Org "), "k")).alias("organisation"))
    return FD.brand_reference(rows)


@query("queue_jobs", f"SELECT concat('{{\"domain\":\"', domain, '\",\"source\":\"ct\",\"retries\":0,\"queued_at\":\"2024-01-15T00:00:00.000Z\"}}') AS value FROM {D} d")
def queue_jobs(spark, sf):
    return queued(fixture(spark, sf, "domains"), "ct", F.lit("2024-01-15").cast("timestamp")).select(F.regexp_replace("value", r"\.000[^\"]*\"", '.000Z"').alias("value"))


# ---- versions of the data set ----

_OLD = f"SELECT domain, CASE WHEN k % 3 = 0 THEN 'Phishing' ELSE 'Legitimate' END AS label, 'old' AS source FROM {D} d WHERE k % 2 = 0"
_RANKED = f"SELECT domain, 'Legitimate' AS label, 'tranco' AS source FROM {D} d WHERE k % 3 = 1"


def _first(parts: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT domain, label, source, {i} AS p FROM ({x}) x{i}" for i, x in enumerate(parts))
    return f"SELECT domain, label, source FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY p, label, source) AS r FROM ({rows}) y WHERE domain IS NOT NULL) z WHERE r = 1"


def _old(spark, sf):
    return fixture(spark, sf, "domains").filter("k % 2 = 0").select("domain", F.when(F.col("k") % 3 == 0, "Phishing").otherwise("Legitimate").alias("label"), F.lit("old").alias("source"))


@query("dataset_v5", _first([_OLD, _RANKED]))
def dataset_v5(spark, sf):
    ranked = fixture(spark, sf, "domains").filter("k % 3 = 1").select("domain", F.lit("Legitimate").alias("label"), F.lit("tranco").alias("source"))
    return DS.version_5(_old(spark, sf), ranked)


def _clean(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(lower(trim({x})), '^www\\.', ''), '\\.+$', '')"
    return f"CASE WHEN regexp_matches({bare}, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') OR length({bare}) < 4 THEN NULL ELSE {bare} END"


_V7 = _first([f"SELECT {_clean(_HOST)} AS domain, 'Phishing' AS label, 'OpenPhish' AS source FROM {FEED} f WHERE k % 5 = 0", f"SELECT {_clean(_HOST)} AS domain, 'Phishing' AS label, 'URLhaus' AS source FROM {FEED} f WHERE {_LIVE} AND k % 5 = 1", f"SELECT {_clean('domain')} AS domain, label, source FROM ({_RANKED}) r", f"SELECT {_clean('domain')} AS domain, label, 'v5_training' AS source FROM ({_OLD}) o"])


def _version_7(spark, sf):
    rows = feed(spark, sf)
    host = N.host_or_null(F.col("url"))
    phish = lambda df, name: df.select(host.alias("domain"), F.lit("Phishing").alias("label"), F.lit(name).alias("source"))
    ranked = fixture(spark, sf, "domains").filter("k % 3 = 1").select("domain", F.lit("Legitimate").alias("label"), F.lit("tranco").alias("source"))
    live = rows.filter(F.col("url_status").isin("online", "unknown") & (F.col("k") % 5 == 1))
    return DS.version_7([phish(rows.filter("k % 5 = 0"), "OpenPhish"), phish(live, "URLhaus"), ranked, _old(spark, sf).withColumn("source", F.lit("v5_training"))], N.clean_domain)


@query("dataset_v7", _V7)
def dataset_v7(spark, sf):
    return _version_7(spark, sf)


_KEYED = f"SELECT CAST(k AS BIGINT) AS k, domain, CASE WHEN k % 5 = 0 THEN 'Phishing' WHEN k % 11 = 0 THEN 'Suspected' ELSE 'Legitimate' END AS label FROM {D} d"


@query("dataset_v8", f"SELECT k, domain, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY (k * 2654435761) % 4294967296, k) AS r, count(*) FILTER (label = 'Phishing') OVER () AS m FROM ({_KEYED}) x) t WHERE label <> 'Legitimate' OR r <= m")
def dataset_v8(spark, sf):
    label = F.when(F.col("k") % 5 == 0, "Phishing").when(F.col("k") % 11 == 0, "Suspected").otherwise("Legitimate")
    return DS.version_8(fixture(spark, sf, "domains").select("k", "domain", label.alias("label")), F.col("k"))


@query("dataset_v9", f"WITH v AS ({_V7}), n AS (SELECT DISTINCT lower({_HOST}) AS domain FROM {FEED} f WHERE k % 5 = 2 UNION SELECT lower(domain) FROM {D} d WHERE k % 7 = 0) SELECT domain, label, source FROM v UNION ALL SELECT domain, 'Phishing', 'Fresh-Feed' FROM n WHERE domain NOT IN (SELECT lower(domain) FROM v)")
def dataset_v9(spark, sf):
    rows, names = feed(spark, sf), fixture(spark, sf, "domains")
    fresh = [rows.filter("k % 5 = 2").select(N.host_or_null(F.col("url")).alias("domain")), names.filter("k % 7 = 0").select("domain")]
    return DS.version_9(_version_7(spark, sf), fresh)


@query("cv_folds", f"SELECT k, label, CAST((row_number() OVER (PARTITION BY label ORDER BY (k * 2654435761) % 4294967296, k) - 1) % 5 AS INT) AS fold FROM ({_KEYED}) x")
def cv_folds(spark, sf):
    label = F.when(F.col("k") % 5 == 0, "Phishing").when(F.col("k") % 11 == 0, "Suspected").otherwise("Legitimate")
    return DS.folds(fixture(spark, sf, "domains").select("k", label.alias("label")), "label", F.col("k"))


@query("hash_shuffle", f"SELECT k, domain FROM {D} d ORDER BY ((k + 42) * 2654435761) % 4294967296, k")
def hash_shuffle(spark, sf):
    return DS.shuffled(fixture(spark, sf, "domains").select("k", "domain"), F.col("k"))
