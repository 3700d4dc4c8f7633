"""Pieces of the DuckDB texts that check the Spark queries."""

from __future__ import annotations

from .. import constants as C
from ..operators.lexical import KEYWORDS
from ..sources.fixtures import SQL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(ws) -> str:
    return ", ".join(q(w) for w in ws)


def any_of(x: str, ws) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in ws) + ")"


def first_of(x: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {q(w)}) THEN {v if isinstance(v, int) else q(v)}" for w, v in pairs) + " ELSE NULL END"


def count(x: str, pattern: str) -> str:
    """Matches of a pattern for one character."""
    return f"(length({x}) - length(regexp_replace({x}, {q(pattern)}, '', 'g')))"


def long(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def fixture(name: str) -> str:
    return f"({SQL[name]})"


AUTHORITY = r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)"
PATH = r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*([^?#]*)"


def slashed(x: str) -> str:
    return f"CASE WHEN contains({x}, '//') THEN {x} ELSE concat('//', {x}) END"


def host(x: str) -> str:
    return f"regexp_extract({slashed(f'lower({x})')}, {q(AUTHORITY)}, 1)"


def shared(source: str, column: str = "domain") -> str:
    """Common table expressions ending in `s`: the shared parts of the lexical features."""
    return f"""a AS (SELECT *, lower(coalesce({column}, '')) AS u FROM {source} src),
b AS (SELECT *, regexp_extract({slashed('u')}, {q(AUTHORITY)}, 1) AS d, regexp_extract({slashed('u')}, {q(PATH)}, 1) AS pth FROM a),
c AS (SELECT *, string_split(d, '.') AS p, greatest(length(d), 1) AS n, list_filter(regexp_split_to_array(d, '[.-]'), lambda x: length(x) >= 3) AS tokens FROM b),
e AS (SELECT *, CASE WHEN len(p) >= 2 THEN p[len(p) - 1] ELSE d END AS sld, CASE WHEN len(p) >= 2 THEN concat(p[len(p) - 1], '.', p[len(p)]) ELSE d END AS two, CASE WHEN len(p) > 2 THEN p[1:len(p) - 2] ELSE CAST([] AS VARCHAR[]) END AS sub, CASE WHEN len(p) >= 2 THEN p[len(p)] ELSE '' END AS tld FROM c),
s AS (SELECT *, CASE WHEN length(sld) >= 3 THEN list_transform(range(1, length(sld) - 1), lambda i: substr(sld, CAST(i AS INT), 3)) ELSE CAST([] AS VARCHAR[]) END AS tri FROM e)"""


def entropy(x: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct(string_split({x}, '')), lambda ch: -(CAST(len(list_filter(string_split({x}, ''), lambda y: y = ch)) AS DOUBLE) / length({x})) * log2(CAST(len(list_filter(string_split({x}, ''), lambda y: y = ch)) AS DOUBLE) / length({x})))), 0)"


def one(x: str) -> str:
    return f"coalesce(CAST(CAST({x} AS INT) AS BIGINT), 0)"


STRUCTURAL = {
    "domain_length": long("length(d)"),
    "digit_ratio": r6(f"CAST({count('d', '[0-9]')} AS DOUBLE) / n"),
    "dot_ratio": r6(f"CAST({count('d', '[.]')} AS DOUBLE) / n"),
    "num_hyphens": long(count("d", "-")),
    "hyphen_ratio": r6(f"CAST({count('d', '-')} AS DOUBLE) / n"),
    "num_special_chars": long(count("d", "[^a-zA-Z0-9.-]")),
    "special_char_ratio": r6(f"CAST({count('d', '[^a-zA-Z0-9.-]')} AS DOUBLE) / n"),
    "subdomain_count": long("greatest(len(p) - 2, 0)"),
    "subdomain_depth": long(f"greatest({count('d', '[.]')} - 1, 0)"),
    "registered_domain_length": long("length(two)"),
    "tld_length": long("length(tld)"),
    "is_common_tld": one(f"tld IN ({words(C.COMMON_TLDS)})"),
    "is_malicious_gtld": one(f"tld IN ({words(C.RISKY_TLDS)})"),
    "has_https": one("starts_with(u, 'https://')"),
}
_IN_SUB = f"len(list_filter(sub, lambda x: {any_of('x', KEYWORDS)})) > 0"
BRAND = {
    "brand_keyword_position": f"CAST(CASE WHEN len(p) >= 2 AND {any_of('two', KEYWORDS)} THEN 1 WHEN len(p) >= 2 AND {_IN_SUB} THEN 2 ELSE 0 END AS BIGINT)",
    "has_cse_keyword_in_subdomain": one(_IN_SUB),
    "brand_to_reg_length_ratio": r6(f"CASE WHEN len(p) >= 2 THEN coalesce(CAST(coalesce({first_of('two', [(k, len(k)) for k in KEYWORDS])}, {first_of(chr(97) + 'rray_to_string(sub, chr(10))', [(k, len(k)) for k in KEYWORDS])}) AS DOUBLE) / length(two), 0) ELSE 0 END"),
    "has_brand_in_path": one(any_of("pth", KEYWORDS)),
    "has_brand_keyword": one(any_of("u", KEYWORDS)),
}
_KWS = "[" + ", ".join(q(k) for k in KEYWORDS) + "]"
EDIT = {"min_brand_levenshtein": r6(f"coalesce(list_min(list_filter(flatten(list_transform(tokens, lambda t: list_transform({_KWS}, lambda k: CASE WHEN levenshtein(t, k) BETWEEN 1 AND 3 THEN CAST(levenshtein(t, k) AS DOUBLE) / length(k) END))), lambda x: x IS NOT NULL)), 99)")}
PATTERNS = {
    "has_ip": one(r"regexp_matches(d, '^\d+\.\d+\.\d+\.\d+$')"),
    "has_repeated_digits": one("regexp_matches(d, '" + "|".join(str(k) * 3 for k in range(10)) + "')"),
    "consonant_ratio": r6(f"CAST({count('d', '[bcdfghjklmnpqrstvwxyz]')} AS DOUBLE) / n"),
    "vowel_ratio": r6(f"CAST({count('d', '[aeiou]')} AS DOUBLE) / n"),
    "longest_consonant_run": long("coalesce(list_max(list_transform(regexp_extract_all(d, '[bcdfghjklmnpqrstvwxyz]+'), lambda x: length(x))), 0)"),
    "is_punycode": one("starts_with(d, 'xn--')"),
}
ENTROPY = {"entropy": r6(entropy("d"))}
LURES = {f"has_{w}": one(f"contains(d, {q(w)})") for w in C.LURE_WORDS}
_BAD, _GOOD = f"len(list_filter(tri, lambda t: t IN ({words(C.SUSPICIOUS_TRIGRAMS)})))", f"len(list_filter(tri, lambda t: t IN ({words(C.LEGITIMATE_TRIGRAMS)})))"
NGRAMS = {
    "suspicious_trigram_count": long(_BAD),
    "legitimate_trigram_count": long(_GOOD),
    "trigram_suspicion_ratio": r6(f"CASE WHEN len(tri) > 0 THEN CAST({_BAD} AS DOUBLE) / len(tri) ELSE 0 END"),
    "unique_trigram_ratio": r6("CASE WHEN len(tri) > 0 THEN CAST(len(list_distinct(tri)) AS DOUBLE) / len(tri) ELSE 0 END"),
    "max_repeated_trigram": long("coalesce(list_max(list_transform(list_distinct(tri), lambda t: len(list_filter(tri, lambda x: x = t)))), 0)"),
}


def lexical(source: str, column: str, keep: str, *groups: dict[str, str]) -> str:
    cols = ", ".join(f"{v} AS {k}" for g in groups for k, v in g.items())
    return f"WITH {shared(source, column)} SELECT {keep}, {cols} FROM s"
