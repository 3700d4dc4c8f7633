"""Queries of facts about a name (network, page, picture), of brands, reports and the monitoring tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import content as H
from ..operators import datasets as DS
from ..operators import decide as V
from ..operators import evaluate as E
from ..operators import lexical as L
from ..operators import markup as MK
from ..operators import network as NW
from ..operators import normalize as N
from ..operators import predict as P
from ..operators import rules as R
from ..operators import store as ST
from ..operators import visual as VI
from ..sources.fixtures import fixture
from . import sqltext as S
from .registry import query

D, FEED, WH, DNS, CERT, HTML, HASH, MON, SCANS, SCORES, JOBS = (S.fixture(n) for n in ("domains", "feed", "whois", "dns", "certs", "html", "hashes", "monitored", "scans", "scores", "jobs"))
_NOW = "2024-01-01 06:00:00"
now = lambda: F.lit(_NOW).cast("timestamp")


def _days(a: str, b: str) -> str:
    return f"CAST(trunc((epoch({b}) - epoch({a})) / 86400) AS BIGINT)"


def domains(spark, sf):
    return fixture(spark, sf, "domains")


# ---- network ----

_T = f"TIMESTAMP '{_NOW}'"
_AFTER = "CASE WHEN c.k % 7 = 0 THEN NULL ELSE TIMESTAMP '2024-03-01 00:00:00' END"


@query("network_live", f"""SELECT c.k, CAST(c.k % 8 <> 0 AS BIGINT) AS has_ssl, CAST(contains(issuer, 'Let''s Encrypt') AS BIGINT) AS is_lets_encrypt, CAST(contains(lower(san), lower(c.domain)) AS BIGINT) AS cert_domain_matches,
CASE WHEN c.k % 8 = 0 THEN -1 ELSE {_days('not_before', _T)} END AS cert_age_days, coalesce({_days(_T, _AFTER)}, -1) AS cert_days_remaining, CAST(c.k % 3 = 2 AS BIGINT) AS has_mx, CAST(contains(txt, 'spf') AS BIGINT) AS has_spf,
CASE WHEN c.k % 4 = 0 THEN 0 ELSE CAST(c.k % 3 + 1 AS BIGINT) END AS a_record_count, CASE WHEN c.k % 4 = 0 THEN -1 ELSE CAST(300 AS BIGINT) END AS ttl_value FROM {CERT} c JOIN {DNS} d ON c.k = d.k""")
def network_live(spark, sf):
    c = F.col
    dns = fixture(spark, sf, "dns").select("k", F.when(c("mx") == "", F.array().cast("array<string>")).otherwise(F.split("mx", ";")).alias("mx"), F.array("txt").alias("txt"), F.when(c("k") % 4 != 0, F.array_repeat(F.lit("1.2.3.4"), (c("k") % 3 + 1).cast("int"))).alias("a"), F.when(c("k") % 4 != 0, 300).alias("ttl"))
    both = fixture(spark, sf, "certs").join(dns, "k")
    cert = {"issuer": c("issuer"), "san": c("san"), "not_before": F.when(c("k") % 8 != 0, c("not_before")), "not_after": F.when(c("k") % 7 != 0, F.lit("2024-03-01").cast("timestamp"))}
    return both.select("k", *(x.alias(n) for n, x in NW.live_features(c("domain"), cert, {n: c(n) for n in ("mx", "txt", "a", "ttl")}, now()).items()))


@query("cert_name_variant", f"SELECT k, contains(lower(cn), lower(domain)) AS holds, {_days('not_before', _T)} AS age, {_days(_T, chr(84) + 'IMESTAMP ' + S.q('2023-12-30 00:00:00'))} AS remaining FROM {CERT} c")
def cert_name_variant(spark, sf):
    return fixture(spark, sf, "certs").select("k", NW.common_name_holds(F.col("domain"), F.col("cn")).alias("holds"), NW.elapsed_days(F.col("not_before"), now()).alias("age"), NW.elapsed_days(now(), F.lit("2023-12-30").cast("timestamp")).alias("remaining"))


_RISK = "CASE " + " ".join(f"WHEN upper(registrar) = {S.q(n)} THEN {v}" for n, v in C.REGISTRAR_RISK.items()) + " ELSE 0.5 END"
_FOUND = "k % 12 <> 5"
_PRIV = " OR ".join(f"coalesce({S.any_of(f'lower({f})', C.PRIVACY_TERMS)}, false)" for f in ("org", "registrar", "country"))


@query("whois_privacy", f"SELECT k, CASE WHEN {_FOUND} THEN coalesce({_days('created', _T)}, 9999) ELSE 9999 END AS domain_age_days, CAST({_FOUND} AND coalesce({_days('created', _T)}, 9999) < 30 AS BIGINT) AS is_new_domain, CAST(CASE WHEN {_FOUND} THEN {_RISK} ELSE 0.5 END AS DOUBLE) AS registrar_risk, CASE WHEN {_FOUND} THEN CAST({_PRIV} AS BIGINT) ELSE 1 END AS has_privacy, CAST({_FOUND} AS BIGINT) AS has_whois FROM {WH} w")
def whois_privacy(spark, sf):
    c = F.col
    rows = NW.whois_row(c("created"), c("registrar"), [c("org"), c("registrar"), c("country")], c("k") % 12 != 5, now())
    return fixture(spark, sf, "whois").select("k", *(x.alias(n) for n, x in rows.items()))


@query("whois_analysis", f"SELECT k, coalesce({_days('created', _T)}, 0) AS age_days, coalesce({_days('created', _T)}, 0) <= 90 AS is_new_domain, coalesce(registrar, 'Unknown') AS registrar, coalesce(contains(lower(org), 'redacted'), false) AS has_privacy FROM {WH} w")
def whois_analysis(spark, sf):
    c = F.col
    return fixture(spark, sf, "whois").select("k", *(x.alias(n) for n, x in NW.whois_analysis(c("created"), c("registrar"), c("org"), now()).items()))


@query("whois_geo", f"SELECT k, {_days('created', _T)} AS domain_age_days, lower(coalesce(registrar, '')) AS registrar, CAST(coalesce({S.any_of('lower(registrar)', C.RISKY_REGISTRARS)}, false) AS BIGINT) AS registrar_risk, country AS ip_country, CAST(country = 'India' AS BIGINT) AS ip_in_india FROM {WH} w")
def whois_geo(spark, sf):
    c = F.col
    return fixture(spark, sf, "whois").select("k", *(x.alias(n) for n, x in NW.geo_features(c("created"), c("registrar"), c("country"), now()).items()))


@query("enrichment", f"""WITH m AS (SELECT domain, min(k) AS k FROM {D} d GROUP BY domain), w AS (SELECT m.domain, m.k, registrar, created, country FROM m JOIN {WH} w ON w.k = m.k), n AS (SELECT m.domain, CASE WHEN m.k % 6 <> 0 THEN concat('10.0.0.', m.k % 50) END AS ip, mx FROM m JOIN {DNS} d ON d.k = m.k)
SELECT w.domain, coalesce(registrar, '') AS registrar, created AS domain_creation_date, coalesce(country, '') AS registrant_country, coalesce(ip, '') AS hosting_ip, coalesce(replace(mx, ';', '; '), '') AS mx_records,
CASE WHEN ip IS NOT NULL AND w.k % 50 < 40 THEN concat('AS', w.k % 50) ELSE '' END AS asn, CASE WHEN ip IS NOT NULL AND w.k % 50 < 40 THEN 'ISP' ELSE '' END AS hosting_isp, CASE WHEN ip IS NOT NULL AND w.k % 50 < 40 THEN 'India' ELSE '' END AS hosting_country, w.k % 2 = 0 AS has_ssl FROM w JOIN n ON w.domain = n.domain""")
def enrichment(spark, sf):
    def one(name, *cols):
        return fixture(spark, sf, name).groupBy("domain").agg(F.min_by(F.struct(*cols), "k").alias("x"), F.min("k").alias("k")).select("domain", "k", "x.*")

    dns = one("dns", "mx").select("domain", F.when(F.col("k") % 6 != 0, F.concat(F.lit("10.0.0."), F.col("k") % 50)).alias("ip"), F.split("mx", ";").alias("mx"))
    geo = spark.range(40).select(F.concat(F.lit("10.0.0."), "id").alias("ip"), F.concat(F.lit("AS"), "id").alias("asn"), F.lit("ISP").alias("org"), F.lit("India").alias("country"))
    tls = one("dns", "mx").select("domain", (F.col("k") % 2 == 0).alias("has_ssl"))
    return NW.enriched(domains(spark, sf).select("domain").distinct(), one("whois", "registrar", "created", "country").drop("k"), dns, geo, tls)


_OWN = ("sbi.com", "pnb.in", "www.nic.top")


@query("whois_overlay", f"SELECT k, domain, CASE WHEN lower(domain) IN ({S.words(_OWN)}) THEN 3650 ELSE {_days('created', _T)} END AS age, lower(domain) NOT IN ({S.words(_OWN)}) AND created IS NULL AS to_query FROM {WH} w")
def whois_overlay(spark, sf):
    age = R.known_age(F.col("domain"), NW.elapsed_days(F.col("created"), now()), _OWN)
    return fixture(spark, sf, "whois").select("k", "domain", age.alias("age")).withColumn("to_query", F.col("age").isNull())


# ---- names and brands ----


@query("link_host", f"SELECT k, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^www\\.', '') AS host FROM {FEED} f")
def link_host(spark, sf):
    return fixture(spark, sf, "feed").select("k", N.link_host(F.col("url")).alias("host"))


_FILE = "CASE WHEN k % 3 = 0 THEN concat('Group_', domain, '.png') WHEN k % 3 = 1 THEN concat(domain, '.png') ELSE concat('A_B_', upper(domain), '.PNG') END"


@query("template_files", f"SELECT k, file, CASE WHEN k % 3 <> 1 THEN domain END AS domain, coalesce({S.first_of('lower(file)', C.FILE_BRANDS)}, 'Unknown') AS brand FROM (SELECT k, domain, {_FILE} AS file FROM {D} d) t")
def template_files(spark, sf):
    c = F.col
    file = F.when(c("k") % 3 == 0, F.concat(F.lit("Group_"), "domain", F.lit(".png"))).when(c("k") % 3 == 1, F.concat("domain", F.lit(".png"))).otherwise(F.concat(F.lit("A_B_"), F.upper("domain"), F.lit(".PNG")))
    return domains(spark, sf).select("k", file.alias("file")).select("k", "file", N.file_domain(c("file")).alias("domain"), R.brand_of_file(c("file")).alias("brand"))


_NAME = f"coalesce({S.first_of('lower(domain)', [(w, n) for w, n, _ in C.BRAND_ORDER])}, 'Unknown CSE')"


@query("official_domains", f"SELECT k, {_NAME} AS brand, coalesce({S.first_of('lower(domain)', [(w, o) for w, _, o in C.BRAND_ORDER])}, 'unknown') AS official, coalesce({S.first_of('lower(domain)', [(w, w) for w in L.KEYWORDS])}, 'Generic') AS keyword FROM {D} d")
def official_domains(spark, sf):
    name, _ = R.brand_of(F.col("domain"))
    return domains(spark, sf).select("k", name.alias("brand"), R.first_keyword(F.col("domain")).alias("keyword")).withColumn("official", R.official_domain(F.col("brand")))


@query("sector_mask_target", f"SELECT k, coalesce({S.any_of('lower(target)', C.SECTOR_WORDS)}, false) OR {S.any_of('lower(domain)', C.SECTOR_WORDS)} AS sector FROM (SELECT k, domain, CASE WHEN k % 6 <> 0 THEN target END AS target FROM {FEED} f) t")
def sector_mask(spark, sf):
    target = F.when(F.col("k") % 6 != 0, F.col("target"))
    return fixture(spark, sf, "feed").select("k", R.sector_mask(target, F.col("domain")).alias("sector"))


TEMPLATES = S.fixture("templates")
_BRANDS = [n for _, n, _ in C.BRAND_ORDER]
_NORM = "replace(replace(replace(replace(lower(brand), '(', ''), ')', ''), '&', 'and'), ' ', '_')"


def _best(brand: str, words, sep: str) -> str:
    """Names with their brand and its best template."""
    score = " + ".join(f"CASE WHEN contains(b, {S.q(w)}) AND contains(t, {S.q(w)}) THEN 3 ELSE 0 END" for w in words)
    score += f" + len(list_filter(string_split(b, {S.q(sep)}), lambda w: length(w) > 3 AND contains(t, w)))"
    best = f"SELECT brand, arg_max(template, s * 1000000 - i) AS template, CAST(max(s) AS BIGINT) AS score FROM (SELECT *, {score} AS s FROM (SELECT brand, {brand} AS b, template, lower(template) AS t, i FROM (SELECT unnest([{S.words(_BRANDS)}]) AS brand) x, {TEMPLATES} y) p) q GROUP BY brand"
    return f"SELECT k, n.brand, template, score FROM (SELECT k, {_NAME} AS brand FROM {D} d) n LEFT JOIN ({best}) z ON n.brand = z.brand"


def _with_template(spark, sf, norm, words, split):
    score = R.template_score(norm, F.col("template"), words, split)
    best = R.best_template(fixture(spark, sf, "templates"), _BRANDS, score)
    names = domains(spark, sf).select("k", R.brand_of(F.col("domain"))[0].alias("brand"))
    return names.join(F.broadcast(best), "brand", "left").select("k", "brand", "template", "score")  # a row for each brand of the list


@query("template_best_words", _best(_NORM, C.CENSUS_TEMPLATE_WORDS, "_"))
def template_best_words(spark, sf):
    return _with_template(spark, sf, _norm("brand"), C.CENSUS_TEMPLATE_WORDS, "_")


@query("template_by_brand", _best("lower(brand)", C.PICTURE_WORDS, " "))
def template_by_brand(spark, sf):
    return _with_template(spark, sf, F.col("brand"), C.PICTURE_WORDS, " ")


def _norm(column):
    norm = F.lower(column)
    for a, b in (("(", ""), (")", ""), ("&", "and"), (" ", "_")):
        norm = F.replace(norm, F.lit(a), F.lit(b))
    return norm


_TS = " + ".join(f"CASE WHEN contains(b, {S.q(w)}) AND contains(t, {S.q(w)}) THEN 3 ELSE 0 END" for w in C.TEMPLATE_WORDS) + " + CASE WHEN contains(t, b) THEN 4 ELSE 0 END"
_TB = f"SELECT brand, arg_max(template, s * 1000000 - i) AS template, CAST(max(s) AS BIGINT) AS score FROM (SELECT *, {_TS} AS s FROM (SELECT brand, {_NORM} AS b, template, lower(template) AS t, i FROM (SELECT unnest([{S.words(_BRANDS)}]) AS brand) x, {TEMPLATES} y) p) q GROUP BY brand"


@query("template_best", f"SELECT k, n.brand, template, score FROM (SELECT k, {_NAME} AS brand FROM {D} d) n LEFT JOIN ({_TB}) z ON n.brand = z.brand")
def template_best(spark, sf):
    """The template of each name's brand by shared words and containment."""
    b, t = _norm("brand"), F.lower("template")
    score = sum((F.when(F.contains(b, F.lit(w)) & F.contains(t, F.lit(w)), 3).otherwise(0) for w in C.TEMPLATE_WORDS), F.when(F.contains(t, b), 4).otherwise(0))
    best = R.best_template(fixture(spark, sf, "templates"), _BRANDS, score)
    return domains(spark, sf).select("k", R.brand_of(F.col("domain"))[0].alias("brand")).join(F.broadcast(best), "brand", "left").select("k", "brand", "template", "score")  # a row for each brand of the list


# ---- pages and pictures ----


@query("redirects", f"SELECT k, CAST(k % 3 = 0 AS BIGINT) AS redirected_to_different_domain, CAST(k % 4 AS BIGINT) AS redirect_count FROM {D} d")
def redirects(spark, sf):
    c = F.col
    final = F.concat(F.lit("https://www."), F.when(c("k") % 3 == 0, F.concat(F.lit("other-"), "domain")).otherwise(F.replace("domain", F.lit("www."), F.lit(""))), F.lit("/x"))
    hops = F.array_repeat(F.lit(302), (c("k") % 4).cast("int"))
    return domains(spark, sf).select("k", *(x.alias(n) for n, x in H.redirects(F.concat(F.lit("http://"), "domain"), final, hops).items()))


@query("page_analysis", f"SELECT k, contains(html, 'type=\"password\"') AS has_credentials, CAST((length(html) - length(replace(html, '<form', ''))) / 5 AS BIGINT) AS form_count, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM {HTML} h")
def page_analysis(spark, sf):
    return MK.parsed(fixture(spark, sf, "html", dealt=True)).select("k", *(x.alias(n) for n, x in MK.page_analysis(F.col("tokens")).items()))


_FAR = "CASE WHEN coalesce({0}, 0) = 0 OR coalesce({1}, 0) = 0 THEN 100 ELSE CAST(bit_count(xor(CAST({0} AS BIGINT), CAST({1} AS BIGINT))) AS BIGINT) END"
_LEAST = f"least({_FAR.format('h1', 'h2')}, {_FAR.format('h1', '(h2 * 3)')})"


@query("min_visual", f"SELECT k, CAST({_LEAST} AS DOUBLE) AS distance, {_LEAST} <= 15 AS lookalike FROM {S.fixture('hashes')} h")
def min_visual(spark, sf):
    c = F.col
    least, hit = VI.nearest(F.array(VI.hamming(c("h1"), c("h2")), VI.hamming(c("h1"), c("h2") * 3)))
    return fixture(spark, sf, "hashes").select("k", least.alias("distance"), hit.alias("lookalike"))


@query("full_enrichment", f"WITH {S.shared(D)} SELECT s.k, s.domain, {S.long('length(d)')} AS domain_length, {S.r6(S.entropy('d'))} AS domain_entropy, {_days('created', _T)} AS domain_age_days, CAST(coalesce({S.any_of('lower(registrar)', C.RISKY_REGISTRARS)}, false) AS BIGINT) AS registrar_risk, CAST(w.country = 'India' AS BIGINT) AS ip_in_india, CAST(CASE WHEN s.k % 2 = 0 THEN s.k % 10 ELSE 0 END AS DOUBLE) AS visual_complexity FROM s JOIN {WH} w ON s.k = w.k")
def full_enrichment(spark, sf):
    """Lexical, WHOIS and picture columns of every name; a name without a picture has 0."""
    c = F.col
    lex = R.enhanced_lexical(domains(spark, sf)).select("k", "domain", "domain_length", "domain_entropy")
    geo = fixture(spark, sf, "whois").select("k", *(x.alias(n) for n, x in NW.geo_features(c("created"), c("registrar"), c("country"), now()).items() if n in ("domain_age_days", "registrar_risk", "ip_in_india")))
    pictures = domains(spark, sf).filter("k % 2 = 0").select("k", (c("k") % 10).cast("double").alias("visual_complexity"))
    return lex.join(geo, "k").join(pictures, "k", "left").na.fill(0.0, ["visual_complexity"])


# ---- reports ----

_CURVE = f"SELECT t AS threshold, tp, fp, fn, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS p, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS r FROM (SELECT t, count(*) FILTER (y AND xgb >= t) AS tp, count(*) FILTER (NOT y AND xgb >= t) AS fp, count(*) FILTER (y AND xgb < t) AS fn FROM {SCORES} s, (SELECT unnest([0.35::DOUBLE, 0.45, 0.55, 0.65]) AS t) g GROUP BY t) u"


@query("threshold_choice", f"SELECT coalesce(arg_max(threshold, round(r, 6)) FILTER (round(p, 6) >= 0.2 AND round(r, 6) >= 0.4), arg_max(threshold, 2 * p * r / (p + r))) AS threshold FROM ({_CURVE}) c")
def threshold_choice(spark, sf):
    return E.choose_threshold(E.sweep(fixture(spark, sf, "scores"), "y", "xgb", C.SWEEP), 0.2, 0.4)


@query("subset_averages", f"WITH {S.shared(D)} SELECT {S.r6('avg(length(d))')} AS domain_length, {S.r6('avg(CAST(' + S.count('d', '[0-9]') + ' AS DOUBLE) / n)')} AS digit_ratio, {S.r6('avg(' + S.count('d', '-') + ')')} AS hyphens, count(*) FILTER ({S.any_of('u', L.KEYWORDS)}) AS with_brand FROM s WHERE k % 3 = 1")
def subset_averages(spark, sf):
    f = L.features(domains(spark, sf).filter("k % 3 = 1"), "domain", lambda: {**L.structural(), **L.brand()})
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return f.agg(F.round(F.avg("domain_length"), 6).alias("domain_length"), mean("digit_ratio", "digit_ratio"), mean("num_hyphens", "hyphens"), F.count_if(F.col("has_brand_keyword") == 1).alias("with_brand"))


_TOKENS = "list_filter(regexp_split_to_array(domain, '[^a-zA-Z0-9]'), lambda t: length(t) > 3)"
_OBF = f"len(list_filter({_TOKENS}, lambda t: " + " OR ".join(f"levenshtein(t, {S.q(w)}) BETWEEN 1 AND 2" for w in L.KEYWORDS) + ")) > 0"


_ADDRESS = "concat(CASE WHEN k % 7 = 3 THEN concat('10.', k % 256, '.0.', k % 100) ELSE domain END, split_part('/sbi/login|/about|/|/Help/irctc', '|', CAST(k % 4 + 1 AS INT)))"
_HOSTS = f"(SELECT *, regexp_extract(a, '^[^/]*') AS domain, regexp_extract(a, '^[^/]*/(.*)$', 1) AS p FROM (SELECT k, {_ADDRESS} AS a FROM {D} d) x)"


@query("pattern_counters", f"SELECT count(*) FILTER (concat('.', list_last(string_split(domain, '.'))) IN ({S.words(C.UNUSUAL_TLDS)})) AS unusual_tld, count(*) FILTER ({_OBF}) AS obfuscated_kw, count(*) FILTER ({S.any_of('p', L.KEYWORDS)}) AS phishing_in_path, count(*) FILTER (regexp_full_match(domain, '[0-9]+([.][0-9]+){{3}}')) AS ip_based FROM {_HOSTS} h")
def pattern_counters(spark, sf):
    name = F.expr(_ADDRESS)
    host = F.regexp_extract(name, "^[^/]*", 0)
    flags = {"unusual_tld": F.concat(F.lit("."), F.element_at(F.split(host, "[.]"), -1)).isin(*C.UNUSUAL_TLDS), "obfuscated_kw": R.obfuscation(host).isNotNull(), "phishing_in_path": L.any_of(F.regexp_extract(name, "^[^/]*/(.*)$", 1), L.KEYWORDS), "ip_based": host.rlike(r"^\d+\.\d+\.\d+\.\d+$")}
    return E.pattern_counts(domains(spark, sf), flags)


@query("aligned_columns", f"SELECT k, -1 AS tranco_rank, length(domain) AS domain_length, -1 AS in_list FROM {D} d")
def aligned_columns(spark, sf):
    """A model's columns from a table that has others and lacks some."""
    rows = domains(spark, sf).select("k", F.length("domain").alias("domain_length"), F.lit("x").alias("label"))
    return DS.aligned(rows, ("k", "tranco_rank", "domain_length", "in_list"), -1)


@query("training_columns", f"SELECT k, length(domain) AS domain_length FROM {D} d")
def training_columns(spark, sf):
    rows = domains(spark, sf).select("k", F.length("domain").alias("domain_length"), F.col("k").alias("tranco_rank"), F.lit(1).alias("is_in_tranco"), "domain")
    return DS.without(rows, (*C.RANK_FEATURES, "domain"))


@query("renamed_first", f"SELECT domain, k FROM {D} d")
def renamed_first(spark, sf):
    return DS.rename_first(domains(spark, sf).select(F.col("domain").alias("Name of site"), "k", F.lit("old").alias("domain")))


@query("first_eligible", f"SELECT id, domain, label FROM {SCANS} s WHERE label IN ('Phishing', 'Suspected') ORDER BY id LIMIT 100")
def first_eligible(spark, sf):
    return DS.first_n(fixture(spark, sf, "scans").filter(F.col("label").isin("Phishing", "Suspected")).select("id", "domain", "label"), 100, "id")


@query("row_errors", f"SELECT k, CASE WHEN k % 9 <> 0 THEN length(domain) END AS domain_length, CASE WHEN k % 9 = 0 THEN 'unusable input' END AS error FROM {D} d")
def row_errors(spark, sf):
    rows = domains(spark, sf).select("k", F.when(F.col("k") % 9 != 0, F.col("domain")).alias("domain"))
    return DS.isolated(rows, {"domain_length": F.length("domain")}, F.col("domain").isNotNull()).select("k", "domain_length", "error")


@query("top_features", f"SELECT k, list_transform(list_sort([{{'v': -(k % 7), 'n': 'a'}}, {{'v': -(k % 5), 'n': 'b'}}, {{'v': -(k % 3), 'n': 'c'}}, {{'v': -(k % 4), 'n': 'd'}}])[1:3], lambda x: x.n) AS top FROM {D} d")
def top_features(spark, sf):
    """Names of the three largest contributions of each row."""
    parts = F.array(*[F.struct((-(F.col("k") % m)).alias("v"), F.lit(n).alias("n")) for n, m in (("a", 7), ("b", 5), ("c", 3), ("d", 4))])
    return domains(spark, sf).select("k", F.transform(F.slice(F.array_sort(parts), 1, 3), lambda x: x["n"]).alias("top"))


# ---- decisions ----


@query("no_evidence", f"SELECT id, CASE WHEN bad THEN 'Suspected' ELSE label END AS label, {S.r6('CASE WHEN bad THEN confidence * 0.6 ELSE confidence END')} AS confidence, CASE WHEN bad THEN 'no visual evidence' END AS note FROM (SELECT s.*, label = 'Phishing' AND NOT coalesce(h.logo, false) AS bad FROM {SCANS} s LEFT JOIN (SELECT d.domain, bool_or(h.logo AND d.k % 3 = 0) AS logo FROM {D} d JOIN {HASH} h ON d.k = h.k GROUP BY d.domain) h ON s.domain = h.domain) t")
def no_evidence(spark, sf):
    """Scans downgraded where no picture of the name shows the brand's logo."""
    shown = domains(spark, sf).join(fixture(spark, sf, "hashes"), "k").groupBy("domain").agg(F.bool_or(F.col("logo") & (F.col("k") % 3 == 0)).alias("logo"))
    label, value, note = V.no_evidence(F.col("label"), F.col("confidence"), F.col("logo"))
    return fixture(spark, sf, "scans").join(shown, "domain", "left").select("id", label.alias("label"), F.round(value, 6).alias("confidence"), note.alias("note"))


def _flagged(spark, sf):
    k = F.col("k")
    return domains(spark, sf).groupBy("domain").agg(F.min("k").alias("k")).select("domain", "k", (k % 2 == 0).alias("live"), (k % 3 != 0).alias("shot"), (k % 5 < 3).alias("match"), (k % 7 < 5).alias("ui"), (k * 37 % 101 / 100).alias("score"))


_FACTS = f"(SELECT domain, k, k % 2 = 0 AS live, k % 3 <> 0 AS shot, k % 5 < 3 AS match, k % 7 < 5 AS ui, CAST(k * 37 % 101 AS DOUBLE) / 100 AS score FROM (SELECT domain, min(k) AS k FROM {D} d GROUP BY domain) m)"


def _staged(open_: str, conf: str) -> tuple[str, str]:
    label = f"CASE WHEN NOT {open_} THEN label WHEN live AND shot AND match AND ui THEN 'Phishing' ELSE 'Suspected' END"
    value = f"CASE WHEN NOT {open_} THEN {conf} WHEN NOT live THEN {conf} * 0.7 WHEN NOT shot THEN {conf} * 0.8 WHEN match AND ui THEN least(1.0, {conf} + 0.2) ELSE {conf} * 0.9 END"
    return label, value


_L, _VAL = _staged("chosen", "score")


@query("batch_classify", f"SELECT domain, {_L} AS final_label, {S.r6(_VAL)} AS final_confidence FROM (SELECT *, label <> 'Clean' AND row_number() OVER (PARTITION BY label <> 'Clean' ORDER BY k) <= 100 AS chosen FROM (SELECT *, CASE WHEN score > 0.8 THEN 'Phishing' WHEN score > 0.5 THEN 'Suspected' ELSE 'Clean' END AS label FROM {_FACTS} f) g) t")
def batch_classify(spark, sf):
    rows = _flagged(spark, sf).withColumns({"label": F.when(F.col("score") > 0.8, "Phishing").when(F.col("score") > 0.5, "Suspected").otherwise("Clean"), "confidence": F.col("score")})
    return V.batch_classify(rows, "domain", ["k"]).select("domain", "final_label", F.round("final_confidence", 6).alias("final_confidence"))


_GUARD = f"CASE WHEN {S.any_of('lower(domain)', C.SERVICE_WORDS)} THEN 'Unknown' ELSE coalesce({S.first_of('lower(domain)', [(w, n) for n, ws in C.GUARDED_BRANDS for w in ws])}, 'Unknown') END"
_GEN = "CASE WHEN brand <> 'Unknown' THEN brand " + " ".join(f"WHEN {S.any_of('lower(domain)', ws)} THEN {S.q(n)}" for n, ws in C.GENERIC_WORDS) + " ELSE 'Unknown' END"
_SURE = "CASE WHEN brand <> 'Unknown' THEN 'High' " + " ".join(f"WHEN {S.any_of('lower(domain)', ws)} THEN 'Medium'" for _, ws in C.GENERIC_WORDS) + " ELSE 'Low' END"
_FL, _FV = _staged("chosen", "confidence")


@query("batch_predictor", f"""WITH a AS (SELECT *, {_GUARD} AS brand, CASE WHEN score > 0.5 THEN 'Phishing' ELSE 'Legitimate' END AS label, greatest(score, 1 - score) AS confidence FROM {_FACTS} f WHERE {S.any_of('lower(domain)', C.WATCHLIST)}), b AS (SELECT *, {_GEN} AS target, {_SURE} AS target_confidence FROM a),
c AS (SELECT * FROM b WHERE NOT {S.any_of('lower(domain)', (*C.SERVICE_WORDS, 'service'))} AND target NOT IN ({S.words(C.GENERIC_TARGETS)})), d AS (SELECT *, label = 'Phishing' AND row_number() OVER (PARTITION BY label ORDER BY confidence DESC, domain) <= 100 AS chosen FROM c),
e AS (SELECT *, {_FL} AS final_label, {_FV} AS final_confidence FROM d) SELECT domain, target, target_confidence, {S.r6('confidence')} AS confidence, {S.r6('final_confidence')} AS final_confidence FROM e WHERE final_label = 'Phishing' AND target <> 'Unknown' ORDER BY confidence DESC, domain LIMIT 1000""")
def batch_predictor(spark, sf):
    """The whole chain over two lists of names, with given scores; `batch_predictor_model` scores with the trained models."""
    facts = _flagged(spark, sf)
    names = domains(spark, sf)
    parts = [names.filter("k % 2 = 0").select(F.col("domain").alias("Part 1")), names.filter("k % 2 = 1 or k % 10 = 0").select(F.col("domain").alias("Part 2"))]
    found = P.batch_predict(parts, lambda df: df.join(facts.select("domain", "score"), "domain"), facts)
    return found.select("domain", "target", "target_confidence", F.round("confidence", 6).alias("confidence"), F.round("final_confidence", 6).alias("final_confidence"))


# ---- monitoring tables and the interface ----

_START = "TIMESTAMP '2024-01-15 00:00:00'"


@query("monitoring_restart", f"SELECT domain, CAST(CASE WHEN again THEN TIMESTAMP '2024-01-16 00:00:00' ELSE TIMESTAMP '2024-01-11 00:00:00' END AS TIMESTAMP) AS next_check, CAST(CASE WHEN again THEN TIMESTAMP '2024-04-14 00:00:00' ELSE TIMESTAMP '2024-04-09 00:00:00' END AS TIMESTAMP) AS end_date, CAST(CASE WHEN again THEN 0 ELSE 5 END AS BIGINT) AS check_count FROM (SELECT domain, bool_or(k % 3 = 0) AS again FROM {D} d GROUP BY domain) t")
def monitoring_restart(spark, sf):
    names = domains(spark, sf)
    table = ST.start_monitoring(names.select("domain").distinct(), F.lit("2024-01-10").cast("timestamp")).withColumn("check_count", F.lit(5).cast("bigint"))
    return ST.restart_monitoring(table, names.filter("k % 3 = 0").select("domain"), F.lit("2024-01-15").cast("timestamp"))


_PREV = "split_part('parked|unrelated|lookalike|unknown', '|', CAST(k % 4 + 1 AS INT))"
_CUR = "split_part('lookalike|parked|unrelated', '|', CAST(k % 3 + 1 AS INT))"
_ESC = f"({_PREV} IN ('parked', 'unrelated') AND {_CUR} = 'lookalike' AND k % 2 = 0)"


def _checked(spark, sf):
    rows = fixture(spark, sf, "monitored").select(F.concat("domain", F.lit("#"), "k").alias("domain"), "k", F.col("previous").alias("state"), F.lit(None).cast("string").alias("previous"), F.lit(1).cast("bigint").alias("check_count"), "next_check", F.lit("Suspected").alias("status"), "current_state", "has_credentials")
    checks = rows.filter("k % 5 < 3").select("domain", F.col("current_state").alias("state"), "has_credentials")
    return ST.checked(rows.drop("current_state", "has_credentials"), checks, F.lit("2024-01-15").cast("timestamp"))


@query("monitoring_checked", f"SELECT k, CASE WHEN c THEN {_CUR} ELSE {_PREV} END AS state, CASE WHEN c THEN {_PREV} END AS previous, CAST(CASE WHEN c THEN 2 ELSE 1 END AS BIGINT) AS check_count, CASE WHEN c THEN TIMESTAMP '2024-01-16 00:00:00' ELSE next_check END AS next_check, CASE WHEN c AND {_ESC} THEN 'Phishing' ELSE 'Suspected' END AS status FROM (SELECT *, k % 5 < 3 AS c FROM {MON} m) t")
def monitoring_checked(spark, sf):
    table, _ = _checked(spark, sf)
    return table.select("k", "state", "previous", "check_count", "next_check", "status")


@query("monitoring_log", f"SELECT concat(domain, '#', k) AS domain, {_START} AS checked_at, {_CUR} AS state, k % 2 = 0 AS has_credentials, CASE WHEN {_ESC} THEN 'Suspected->Phishing' END AS status_change FROM {MON} m WHERE k % 5 < 3")
def monitoring_log(spark, sf):
    return _checked(spark, sf)[1]


@query("resume_missing", f"SELECT k, domain FROM {D} d WHERE domain NOT IN (SELECT domain FROM {D} x WHERE k <= 100)")
def resume_missing(spark, sf):
    names = domains(spark, sf)
    return ST.missing(names, names.filter("k <= 100").select("domain", F.lit(1).alias("age")))


@query("failed_clear", f"SELECT domain, count(*) AS n FROM {SCANS} s WHERE label = 'Clean' AND domain NOT IN (SELECT domain FROM {D} d WHERE k % 2 = 0) GROUP BY domain")
def failed_clear(spark, sf):
    failed = fixture(spark, sf, "scans").filter("label = 'Clean'").select("domain", F.lit("timeout").alias("error"))
    return ST.cleared(failed, domains(spark, sf).filter("k % 2 = 0")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


_ASKED = f"SELECT k, CASE WHEN k % 4 = 0 THEN concat('no-', domain) ELSE domain END AS domain FROM {D} d"


@query("feedback_status", f"SELECT k, domain, CASE WHEN k % 4 = 0 THEN 404 ELSE 200 END AS status FROM ({_ASKED}) a")
def feedback_status(spark, sf):
    """200 for a verdict on a known domain, 404 for others."""
    names = domains(spark, sf)
    asked = names.select("k", F.when(F.col("k") % 4 == 0, F.concat(F.lit("no-"), "domain")).otherwise(F.col("domain")).alias("domain"))
    return ST.outcomes(asked, names, "domain", 200, 404)


@query("whitelist_status", f"SELECT k, domain, CASE WHEN k % 4 = 0 THEN 201 ELSE 400 END AS status FROM ({_ASKED}) a")
def whitelist_status(spark, sf):
    """400 for an entry that is listed already, 201 for a new one."""
    names = domains(spark, sf)
    asked = names.select("k", F.when(F.col("k") % 4 == 0, F.concat(F.lit("no-"), "domain")).otherwise(F.col("domain")).alias("domain"))
    return ST.outcomes(asked, names, "domain", 400, 201)


@query("health_status", f"SELECT event_type, count(*) AS depth, CASE WHEN date_diff('second', max(ts), (SELECT max(ts) FROM {JOBS} x)) > 300 THEN 'degraded' ELSE 'healthy' END AS status FROM {JOBS} j GROUP BY event_type")
def health_status(spark, sf):
    jobs = fixture(spark, sf, "jobs")
    last = jobs.agg(F.max("ts").alias("at"))
    seen = jobs.groupBy("event_type").agg(F.count(F.lit(1)).alias("depth"), F.max("ts").alias("seen"))
    return seen.join(F.broadcast(last)).select("event_type", "depth", V.health(F.col("depth"), F.col("seen"), F.col("at")).alias("status"))  # one row
