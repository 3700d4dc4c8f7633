"""Queries of the lexical feature vector and the other lexical families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import lexical as L
from ..operators import rules as R
from ..operators.idna import to_ascii
from ..sources.fixtures import fixture
from . import sqltext as S
from .registry import query

_URLS, _DOMAINS = S.fixture("urls"), S.fixture("domains")


def _lexical(name: str, what, *groups: dict[str, str]) -> None:
    @query(name, S.lexical(_URLS, "url", "k, url", *groups))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return L.features(fixture(spark, sf, "urls").select("k", "url"), "url", what)


_lexical("lex_structural", L.structural, S.STRUCTURAL)
_lexical("lex_brand", L.brand, S.BRAND)
_lexical("lex_levenshtein", L.edit_distance, S.EDIT)
_lexical("lex_patterns", L.patterns, S.PATTERNS)
_lexical("lex_entropy", lambda: {"entropy": L.entropy(F.col("d"))}, S.ENTROPY)
_lexical("lex_keywords", L.lures, S.LURES)
_lexical("lex_ngrams", L.ngrams, S.NGRAMS)
_lexical("lex_full", L.all_features, S.STRUCTURAL, S.BRAND, S.EDIT, S.PATTERNS, S.ENTROPY, S.LURES, S.NGRAMS)

_SUFFIX = "CASE WHEN regexp_matches(domain, '[.](com|org|net|in|gov|edu)$') AND NOT regexp_matches(domain, '[.](co|gov|ac|org|net|nic)[.]in$') THEN 1 ELSE 0 END"


@query("lex_common_suffix", f"SELECT k, domain, CAST({_SUFFIX} AS BIGINT) AS is_common_suffix FROM {_DOMAINS} d")
def lex_common_suffix(spark, sf):
    return fixture(spark, sf, "domains").withColumn("is_common_suffix", L.long(R.common_suffix(F.col("domain")).cast("int")))


_RISK = "CASE " + " ".join(f"WHEN ends_with(lower(domain), {S.q(t)}) THEN 0.8" for t in C.SUFFIX_RISKY) + " " + " ".join(f"WHEN ends_with(lower(domain), {S.q(t)}) THEN 0.1" for t in C.SUFFIX_SAFE) + " ELSE 0.3 END"
_TYPO = "CASE WHEN contains(domain, '-') AND length(domain) > 15 THEN 0.7 ELSE 0.3 END"
_BRANDWORDS = [w for _, ws in C.ANALYZER_BRANDS for w in ws]
_TOKEN = "len(list_intersect(regexp_split_to_array(lower(domain), '[- ]'), [" + ", ".join(S.q(t) for t in sorted({t for w in _BRANDWORDS for t in w.split()})) + "])) > 0"
_FUZZY = f"CASE WHEN {S.any_of('lower(domain)', _BRANDWORDS)} THEN 1.0 WHEN {_TOKEN} THEN 0.9 ELSE 0.0 END"
_SCORE = f"least(1.0, 0.4 * ({_FUZZY}) + 0.2 * ({_RISK}) + 0.15 * ({_TYPO}) + 0.1 * {S.count('domain', '-')} + 0.1 * {S.entropy('domain')} + 0.05 * CAST({S.count('domain', '[0-9]')} AS DOUBLE) / greatest(length(domain), 1))"


@query("rule_tld_risk", f"SELECT k, domain, CAST({_RISK} AS DOUBLE) AS tld_risk, CAST({_TYPO} AS DOUBLE) AS typosquatting FROM {_DOMAINS} d")
def rule_tld_risk(spark, sf):
    return fixture(spark, sf, "domains").withColumns({"tld_risk": R.tld_risk(F.col("domain")), "typosquatting": R.typosquatting(F.col("domain"))})


@query("rule_lexical_score", f"SELECT k, domain, {S.r6(_FUZZY)} AS brand_score, {S.r6(_SCORE)} AS lexical_score FROM {_DOMAINS} d")
def rule_lexical_score(spark, sf):
    return R.lexical_score(fixture(spark, sf, "domains")).select("k", "domain", F.round("brand_score", 6).alias("brand_score"), F.round("lexical_score", 6).alias("lexical_score"))


@query("rule_fuzzy_ratio")
def rule_fuzzy_ratio(spark, sf):
    return R.fuzzy_scores(fixture(spark, sf, "domains"))


_CLEAN = "replace(replace(lower(domain), 'www.', ''), '-', '')"
_RULE = f"least(1.0, 0.3 * CAST({S.any_of(_CLEAN, C.EDIT_KEYWORDS)} AS INT) + 0.2 * CAST({'(' + ' OR '.join(f'ends_with(lower(domain), {S.q(t)})' for t in C.RULE_SUFFIXES) + ')'} AS INT) + 0.1 * CAST(length(domain) > 30 AS INT) + 0.1 * CAST({S.count('domain', '-')} >= 2 AS INT))"


@query("rule_suspicion", f"SELECT k, domain, {S.r6(_RULE)} AS suspicion, {S.any_of(_CLEAN, C.EDIT_KEYWORDS)} AS is_typosquatting FROM {_DOMAINS} d")
def rule_suspicion(spark, sf):
    return fixture(spark, sf, "domains").withColumns({"suspicion": F.round(R.rule_suspicion(F.col("domain")), 6), "is_typosquatting": R.is_typosquatting(F.col("domain"))})


_SUBS = "CASE WHEN len(string_split(d, '.')) > 2 THEN string_split(d, '.')[1:len(string_split(d, '.')) - 2] ELSE CAST([] AS VARCHAR[]) END"


@query("enhanced_lexical", f"""SELECT k, domain, {S.long('length(d)')} AS domain_length, {S.long(S.count('d', '[.]'))} AS num_dots, {S.long(S.count('d', '-'))} AS num_hyphens, {S.long(S.count('d', '_'))} AS num_underscores,
{S.long(S.count('d', '[^a-z0-9.-]'))} AS num_special_chars, {S.long(S.count('d', '[0-9]'))} AS num_digits, {S.PATTERNS['has_repeated_digits']} AS has_repeated_digits, {S.long('len(subs)')} AS num_subdomains,
{S.r6('coalesce(list_avg(list_transform(subs, lambda x: length(x))), 0)')} AS avg_subdomain_length, {S.long('coalesce(list_max(list_transform(subs, lambda x: length(x))), 0)')} AS max_subdomain_length, {S.r6(S.entropy('d'))} AS domain_entropy,
{S.one("starts_with(d, 'xn--')")} AS is_idn, {S.one(f"string_split(d, '.')[-1] IN ({S.words(C.THIRD_TLDS)})")} AS suspicious_tld FROM (SELECT *, {_SUBS} AS subs FROM (SELECT k, domain, lower(domain) AS d FROM {_DOMAINS} x) y) z""")
def enhanced_lexical(spark, sf):
    return R.enhanced_lexical(fixture(spark, sf, "domains"))


_PAIRS = ", ".join(f"({S.q(a)}, {S.q(b)})" for a, bs in C.CONFUSABLES.items() for b in bs)
_NAMES = f"(SELECT DISTINCT domain FROM {_DOMAINS} d)"
_VARIANTS = f"""SELECT domain, domain AS variant FROM {_NAMES} n UNION
SELECT domain, concat(substr(name, 1, i - 1), alt, substr(name, i + 1), '.', tld) FROM (SELECT domain, name, tld, CAST(unnest(range(1, length(name) + 1)) AS INT) AS i FROM (SELECT domain, regexp_replace(domain, '[.][^.]*$', '') AS name, string_split(domain, '.')[-1] AS tld FROM {_NAMES} n) a) b JOIN (VALUES {_PAIRS}) c(ch, alt) ON substr(name, i, 1) = ch"""


@query("homoglyph_variants", _VARIANTS)
def homoglyph_variants(spark, sf):
    return R.homoglyphs(fixture(spark, sf, "domains").select("domain").distinct())


@query("homoglyph_registered", f"SELECT v.domain, v.variant FROM ({_VARIANTS}) v JOIN {_NAMES} r ON v.variant = r.domain WHERE v.variant <> v.domain")
def homoglyph_registered(spark, sf):
    names = fixture(spark, sf, "domains").select("domain").distinct()
    return R.registered_homoglyphs(names, names)


@query("homoglyph_punycode")
def homoglyph_punycode(spark, sf):
    return R.homoglyphs(fixture(spark, sf, "domains").select("domain").distinct()).withColumn("ascii", to_ascii(F.col("variant")))


@query("char_encode", f"SELECT k, domain, list_transform(range(64), lambda i: CASE WHEN i = 0 THEN 2 WHEN i > length(domain) THEN 0 WHEN strpos('abcdefghijklmnopqrstuvwxyz0123456789.-_', substr(domain, CAST(i AS INT), 1)) > 0 THEN 2 + strpos('abcdefghijklmnopqrstuvwxyz0123456789.-_', substr(domain, CAST(i AS INT), 1)) ELSE 1 END) AS ids FROM {_DOMAINS} d")
def char_encode(spark, sf):
    return fixture(spark, sf, "domains").withColumn("ids", R.char_ids(F.col("domain")))


@query("count_brands", f"SELECT k, domain, CAST({' + '.join(f'CAST(contains(domain, {S.q(w)}) AS INT)' for w in L.KEYWORDS)} AS BIGINT) AS n_brands FROM {_DOMAINS} d")
def count_brands(spark, sf):
    return fixture(spark, sf, "domains").withColumn("n_brands", R.count_brands(F.col("domain")))


_TOK = "list_filter(regexp_split_to_array(domain, '[^a-z0-9]+'), lambda t: length(t) > 3)"
_KW = "[" + ", ".join(S.q(x) for x in L.KEYWORDS) + "]"
_HITS = f"list_filter(flatten(list_transform({_TOK}, lambda t: list_transform({_KW}, lambda w: CASE WHEN levenshtein(t, w) BETWEEN 1 AND 2 THEN concat(t, '~', w) END))), lambda x: x IS NOT NULL)"


@query("obfuscation_match", f"SELECT k, domain, CASE WHEN len({_HITS}) > 0 THEN {_HITS}[1] END AS hit FROM {_DOMAINS} d")
def obfuscation_match(spark, sf):
    return fixture(spark, sf, "domains").withColumn("hit", R.obfuscation(F.col("domain")))


@query("flagship_ranking", f"""WITH x AS (SELECT k, domain, {_SCORE} AS score, {S.first_of('domain', [(w, n) for w, n, _ in C.BRAND_ORDER])} AS target FROM {_DOMAINS} d)
SELECT domain, target, max({S.r6('score')}) AS score, count(*) AS n FROM x WHERE target IS NOT NULL GROUP BY domain, target ORDER BY score DESC, domain LIMIT 100""")
def flagship_ranking(spark, sf):
    # each distinct name is scored once; repeats are counted before the shuffle
    names = fixture(spark, sf, "domains").groupBy("domain").agg(F.count(F.lit(1)).alias("n")).withColumn("target", L.first_of(F.col("domain"), [(w, n) for w, n, _ in C.BRAND_ORDER]))
    ranked = R.lexical_score(names.filter(F.col("target").isNotNull())).select("domain", "target", F.round("lexical_score", 6).alias("score"), "n")
    return ranked.orderBy(F.desc("score"), "domain").limit(100)
