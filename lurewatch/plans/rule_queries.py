"""Queries of normalisation, brand mapping, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import lexical as L
from ..operators import normalize as N
from ..operators import rules as R
from ..operators.fuzzy import best_reference
from ..sources.fixtures import fixture
from . import sqltext as S
from .registry import query

D, U, LAB = S.fixture("domains"), S.fixture("urls"), S.fixture("labelled")
_HOST = f"regexp_replace({S.host('trim(raw)')}, ':.*$', '')"


@query("norm_v4", f"SELECT k, raw, {_HOST} AS host FROM {LAB} x")
def norm_v4(spark, sf):
    return fixture(spark, sf, "labelled").select("k", "raw", N.host_without_port(F.col("raw")).alias("host"))


@query("norm_v7", f"SELECT k, raw, nullif({_HOST}, '') AS host FROM {LAB} x")
def norm_v7(spark, sf):
    return fixture(spark, sf, "labelled").select("k", "raw", N.host_or_null(F.col("raw")).alias("host"))


_CLEAN = "regexp_replace(regexp_replace(lower(trim(raw)), '^www\\.', ''), '\\.+$', '')"


@query("clean_domain", f"SELECT k, raw, CASE WHEN regexp_matches({_CLEAN}, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') OR length({_CLEAN}) < 4 THEN NULL ELSE {_CLEAN} END AS clean, regexp_replace(lower(trim(raw)), '^www\\.', '') AS bare, replace(raw, 'www.', '') AS worker FROM {LAB} x")
def clean_domain(spark, sf):
    raw = F.col("raw")
    return fixture(spark, sf, "labelled").select("k", "raw", N.clean_domain(raw).alias("clean"), N.strip_www(raw).alias("bare"), N.drop_www_anywhere(raw).alias("worker"))


_LABEL = "CASE " + " ".join(f"WHEN lower(trim(raw_label)) IN ({S.words(v)}) THEN {S.q(n)}" for n, v in C.LABEL_VARIANTS) + " END"


@query("label_normalise", f"SELECT k, raw_label, {_LABEL} AS label FROM {LAB} x")
def label_normalise(spark, sf):
    return fixture(spark, sf, "labelled").select("k", "raw_label", N.label(F.col("raw_label")).alias("label"))


@query("url_host_path", f"SELECT k, url, {S.host('url')} AS host, regexp_extract({S.slashed('lower(url)')}, {S.q(S.PATH)}, 1) AS path FROM {U} x")
def url_host_path(spark, sf):
    return fixture(spark, sf, "urls").select("k", "url", N.host(F.col("url")).alias("host"), N.path(F.col("url")).alias("path"))


_NAME, _OFFICIAL = f"coalesce({S.first_of('lower(domain)', [(w, n) for w, n, _ in C.BRAND_ORDER])}, 'Unknown CSE')", f"coalesce({S.first_of('lower(domain)', [(w, o) for w, _, o in C.BRAND_ORDER])}, 'unknown')"


@query("brand_map_ordered", f"SELECT k, domain, {_NAME} AS brand, {_OFFICIAL} AS official FROM {D} d")
def brand_map_ordered(spark, sf):
    name, official = R.brand_of(F.col("domain"))
    return fixture(spark, sf, "domains").withColumns({"brand": name, "official": official})


_GUARD = f"CASE WHEN {S.any_of('lower(domain)', C.SERVICE_WORDS)} THEN 'Unknown' ELSE coalesce({S.first_of('lower(domain)', [(w, n) for n, ws in C.GUARDED_BRANDS for w in ws])}, 'Unknown') END"


@query("brand_map_legit_guard", f"SELECT k, domain, {_GUARD} AS brand FROM {D} d")
def brand_map_legit_guard(spark, sf):
    return fixture(spark, sf, "domains").withColumn("brand", R.guarded_brand(F.col("domain")))


_GENERIC = " ".join(f"WHEN {S.any_of('lower(domain)', ws)} THEN {S.q(n)}" for n, ws in C.GENERIC_WORDS)
_MEDIUM = " ".join(f"WHEN {S.any_of('lower(domain)', ws)} THEN 'Medium'" for _, ws in C.GENERIC_WORDS)
_TARGET = f"SELECT k, domain, g, CASE WHEN g <> 'Unknown' THEN g {_GENERIC} ELSE 'Unknown' END AS target, CASE WHEN g <> 'Unknown' THEN 'High' {_MEDIUM} ELSE 'Low' END AS level FROM (SELECT *, {_GUARD} AS g FROM {D} d) e"


@query("brand_generic_confidence", f"SELECT k, domain, target, level FROM ({_TARGET}) t")
def brand_generic_confidence(spark, sf):
    target, level = R.target_and_confidence(F.col("domain"), R.guarded_brand(F.col("domain")))
    return fixture(spark, sf, "domains").withColumns({"target": target, "level": level})


def _near(first: str, feed: bool) -> str:
    return "CASE " + " ".join(f"WHEN {'contains(' + first + ', ' + S.q(w) + ') OR ' if feed else ''}levenshtein({first}, {S.q(w)}) <= {2 if len(w) <= 5 else 3} AND length({first}) < {len(w) + 3} THEN {S.q(w)}" for w in C.EDIT_KEYWORDS) + " END"


@query("suspicious_ct", f"SELECT k, domain, CASE WHEN {_NAME} <> 'Unknown CSE' THEN {_NAME} ELSE {_near('string_split(domain, chr(46))[1]', False)} END AS hit FROM {D} d")
def suspicious_ct(spark, sf):
    return fixture(spark, sf, "domains").withColumn("hit", R.suspicious(F.col("domain")))


@query("suspicious_feed", f"SELECT k, domain, CASE WHEN {_NAME} <> 'Unknown CSE' THEN {_NAME} ELSE {_near('string_split(lower(domain), chr(46))[1]', True)} END AS hit FROM {D} d")
def suspicious_feed(spark, sf):
    return fixture(spark, sf, "domains").withColumn("hit", R.suspicious(F.col("domain"), feed=True))


@query("brand_token_set")
def brand_token_set(spark, sf):
    reference = spark.createDataFrame([(o, n, i) for i, (_, n, o) in enumerate(C.BRAND_ORDER)], "domain string, name string, ord int")
    return best_reference(fixture(spark, sf, "domains"), reference)


@query("watchlist_prefilter", f"SELECT k, domain FROM {D} d WHERE {S.any_of('lower(domain)', C.WATCHLIST)}")
def watchlist_prefilter(spark, sf):
    return fixture(spark, sf, "domains").filter(L.any_of(F.lower("domain"), C.WATCHLIST))


_SERVICE = (*C.SERVICE_WORDS, "service")


@query("fp_filter", f"SELECT k, domain, target FROM ({_TARGET}) t WHERE NOT {S.any_of('lower(domain)', _SERVICE)} AND target NOT IN ({S.words(C.GENERIC_TARGETS)})")
def fp_filter(spark, sf):
    target, _ = R.target_and_confidence(F.col("domain"), R.guarded_brand(F.col("domain")))
    return fixture(spark, sf, "domains").withColumn("target", target).filter(~L.any_of(F.lower("domain"), _SERVICE) & ~F.col("target").isin(*C.GENERIC_TARGETS))


_UTIL = f"regexp_matches(lower(domain), {S.q('(?i)' + '|'.join(C.UTILITY_PATTERNS))})"
_SOFT = f"regexp_matches(lower(domain), {S.q('|'.join(C.SOFT_PATTERNS))})"


@query("legit_utility", f"SELECT k, domain, {_UTIL} AS utility, {_UTIL} OR ({_SOFT} AND k > 365) AS candidate FROM {D} d")
def legit_utility(spark, sf):
    d = F.col("domain")
    return fixture(spark, sf, "domains").select("k", "domain", R.utility(d).alias("utility"), R.false_positive_candidate(d, F.col("k")).alias("candidate"))


_CAT = "CASE " + " ".join(f"WHEN regexp_matches(lower(domain), {S.q('|'.join(ps))}) THEN {S.q(n)}" for n, ps in C.UTILITY_CATEGORIES) + " ELSE 'other_legitimate' END"


@query("legit_category", f"SELECT k, domain, {_CAT} AS category FROM {D} d")
def legit_category(spark, sf):
    return fixture(spark, sf, "domains").withColumn("category", R.utility_category(F.col("domain")))


@query("sector_mask", f"SELECT k, url, {S.any_of('lower(url)', L.KEYWORDS)} OR {S.any_of('lower(url)', C.SECTOR_PATTERNS)} AS in_sector, {S.any_of('lower(url)', C.PHISHTANK_BRANDS)} AS listed FROM {U} x")
def sector_mask(spark, sf):
    u = F.lower("url")
    return fixture(spark, sf, "urls").select("k", "url", (L.any_of(u, L.KEYWORDS) | L.any_of(u, C.SECTOR_PATTERNS)).alias("in_sector"), L.any_of(u, C.PHISHTANK_BRANDS).alias("listed"))


_TUN = f"SELECT k, concat(replace(domain, '.', '-'), [{S.words(C.TUNNEL_SUFFIXES)}, '.example'][CAST(k % 10 + 1 AS INT)]) AS domain FROM {D} d"


@query("tunnel_filter", f"SELECT t.k, t.domain, b.name AS brand FROM ({_TUN}) t, (VALUES {', '.join(f'({i}, {S.q(w)}, {S.q(n)})' for i, (w, n, _) in enumerate(C.BRAND_ORDER))}) b(i, w, name) WHERE ({' OR '.join(f'ends_with(t.domain, {S.q(s)})' for s in C.TUNNEL_SUFFIXES)}) AND contains(t.domain, b.w) QUALIFY row_number() OVER (PARTITION BY t.k ORDER BY b.i) = 1")
def tunnel_filter(spark, sf):
    suffix = F.element_at(F.array(*[F.lit(s) for s in (*C.TUNNEL_SUFFIXES, ".example")]), (F.col("k") % 10 + 1).cast("int"))
    names = fixture(spark, sf, "domains").select("k", F.concat(F.replace("domain", F.lit("."), F.lit("-")), suffix).alias("domain"))
    brand = L.first_of(F.col("domain"), [(w, n) for w, n, _ in C.BRAND_ORDER])
    return names.filter(R.ends_with(F.col("domain"), C.TUNNEL_SUFFIXES)).withColumn("brand", brand).filter("brand is not null")


WH, SC = S.fixture("whois"), S.fixture("scans")


@query("join_left_age", f"SELECT d.k, d.domain, coalesce(CAST(date_diff('day', CAST(w.created AS DATE), DATE '2024-01-01') AS BIGINT), -1) AS age FROM {D} d LEFT JOIN (SELECT * FROM {WH} z WHERE registrar IS NOT NULL) w ON d.k = w.k")
def join_left_age(spark, sf):
    facts = fixture(spark, sf, "whois").filter("registrar is not null").select(F.col("k").alias("j"), "created")
    age = F.date_diff(F.lit("2024-01-01").cast("date"), F.to_date("created")).cast("bigint")
    return fixture(spark, sf, "domains").join(facts, F.col("k") == F.col("j"), "left").select("k", "domain", F.coalesce(age, F.lit(-1)).alias("age"))


_RANK = f"SELECT lower(domain) AS dom, max(k) AS rank FROM {D} y WHERE ends_with(domain, '.com') GROUP BY 1"


@query("join_rank_lookup", f"SELECT d.k, d.domain, coalesce(r.rank, -1) AS rank, CASE WHEN r.rank IS NULL THEN 0 ELSE 1 END AS ranked FROM {D} d LEFT JOIN ({_RANK}) r ON regexp_replace(lower(trim(d.domain)), '^www\\.', '') = r.dom")
def join_rank_lookup(spark, sf):
    names = fixture(spark, sf, "domains")
    ranks = names.filter(F.endswith("domain", F.lit(".com"))).groupBy(F.lower("domain").alias("dom")).agg(F.max("k").alias("rank"))
    found = names.join(ranks, N.strip_www(F.col("domain")) == F.col("dom"), "left")
    return found.select("k", "domain", F.coalesce("rank", F.lit(-1)).alias("rank"), F.when(F.col("rank").isNull(), 0).otherwise(1).alias("ranked"))


@query("anti_known", f"SELECT k, domain FROM {D} d WHERE domain NOT IN (SELECT domain FROM {SC} s WHERE label = 'Suspected')")
def anti_known(spark, sf):
    return fixture(spark, sf, "domains").join(fixture(spark, sf, "scans").filter("label = 'Suspected'").select("domain"), "domain", "left_anti").select("k", "domain")


@query("semi_missed", f"SELECT k, domain FROM {D} d WHERE domain IN (SELECT domain FROM {SC} s WHERE label = 'Suspected')")
def semi_missed(spark, sf):
    return fixture(spark, sf, "domains").join(fixture(spark, sf, "scans").filter("label = 'Suspected'").select("domain"), "domain", "left_semi").select("k", "domain")


@query("whitelist_intercept", f"SELECT k, domain, CASE WHEN w THEN 'Clean' ELSE NULL END AS status, CASE WHEN w THEN 0.01 END AS confidence FROM (SELECT *, replace(domain, 'www.', '') IN (SELECT DISTINCT domain FROM {D} y WHERE contains(domain, 'news')) AS w FROM {D} d) e")
def whitelist_intercept(spark, sf):
    names = fixture(spark, sf, "domains")
    white = names.filter(F.contains("domain", F.lit("news"))).select(F.col("domain").alias("w")).distinct()
    found = names.join(white, N.drop_www_anywhere(F.col("domain")) == F.col("w"), "left")
    return found.select("k", "domain", F.when(F.col("w").isNotNull(), "Clean").alias("status"), F.when(F.col("w").isNotNull(), 0.01).alias("confidence"))


@query("brand_theta", f"SELECT d.k, d.domain, arg_min(b.kw, b.i) AS brand FROM {D} d JOIN (VALUES {', '.join(f'({i}, {S.q(w)})' for i, w in enumerate(L.KEYWORDS))}) b(i, kw) ON contains(d.domain, b.kw) GROUP BY d.k, d.domain")
def brand_theta(spark, sf):
    """A substring join: the brand list is a literal of fixed size and its side is broadcast."""
    brands = spark.createDataFrame(list(enumerate(L.KEYWORDS)), "i int, kw string")
    names = fixture(spark, sf, "domains")
    return names.join(F.broadcast(brands), F.contains("domain", F.col("kw"))).groupBy("k", "domain").agg(F.min_by("kw", "i").alias("brand"))
