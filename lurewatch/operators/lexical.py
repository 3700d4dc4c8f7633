"""The lexical feature vector of a domain or URL, as native expressions.

`features` first materialises what many features share (host, labels, tokens, trigrams) and then projects, so the
shared parts are computed once a row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .normalize import host, path

KEYWORDS = tuple(dict.fromkeys(C.CSE_KEYWORDS))


def any_of(text: Column, words) -> Column:
    """Whether text contains one of the words (literally)."""
    return text.rlike("|".join(map(re.escape, words)))


def first_of(text: Column, pairs) -> Column:
    """Value of the first (word, value) pair whose word text contains; null without one."""
    out = F.lit(None)
    for word, value in reversed(tuple(pairs)):
        out = F.when(F.contains(text, F.lit(word)), F.lit(value)).otherwise(out)
    return out


def one(condition: Column) -> Column:
    return F.coalesce(condition.cast("bigint"), F.lit(0).cast("bigint"))


def long(value: Column) -> Column:
    return value.cast("bigint")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters of text; 0 for an empty one."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def bits(cs: Column) -> Column:
        share = lambda c: F.size(F.filter(cs, lambda x: x == c)) / F.size(cs)
        return F.aggregate(F.transform(F.array_distinct(cs), share), F.lit(0.0), lambda s, p: s - p * F.log2(p))

    return F.get(F.transform(F.array(chars), bits), 0)  # the outer transform binds the characters once


def shared(df: DataFrame, column: str = "domain") -> DataFrame:
    """Adds _url, d (host), p (labels), n (length, 1 at least), tokens, tri (trigrams of the second-level label)."""
    df = df.withColumn("_url", F.lower(F.coalesce(F.col(column), F.lit(""))))
    df = df.withColumns({"d": host(F.col("_url")), "_path": path(F.col("_url"))})
    df = df.withColumns({"p": F.split("d", "[.]"), "n": F.greatest(F.length("d"), F.lit(1)), "tokens": F.filter(F.split("d", "[.-]"), lambda t: F.length(t) >= 3)})
    df = df.withColumns({"_sld": F.when(F.size("p") >= 2, F.element_at("p", -2)).otherwise(F.col("d")), "_two": F.when(F.size("p") >= 2, F.concat_ws(".", F.slice("p", -2, 2))).otherwise(F.col("d")), "_sub": F.when(F.size("p") > 2, F.slice("p", 1, F.size("p") - 2)).otherwise(F.expr("cast(array() as array<string>)")), "_tld": F.when(F.size("p") >= 2, F.element_at("p", -1)).otherwise("")})
    tri = F.when(F.length("_sld") >= 3, F.transform(F.sequence(F.lit(1), F.length("_sld") - 2), lambda i: F.substring(F.col("_sld"), i, F.lit(3)))).otherwise(F.expr("cast(array() as array<string>)"))
    return df.withColumn("tri", tri)


def structural() -> dict[str, Column]:
    d, n = F.col("d"), F.col("n")
    return {
        "domain_length": long(F.length(d)),
        "digit_ratio": F.regexp_count(d, F.lit(r"(?U)\d")) / n,
        "dot_ratio": F.regexp_count(d, F.lit("[.]")) / n,
        "num_hyphens": long(F.regexp_count(d, F.lit("-"))),
        "hyphen_ratio": F.regexp_count(d, F.lit("-")) / n,
        "num_special_chars": long(F.regexp_count(d, F.lit("[^a-zA-Z0-9.-]"))),
        "special_char_ratio": F.regexp_count(d, F.lit("[^a-zA-Z0-9.-]")) / n,
        "subdomain_count": long(F.greatest(F.size("p") - 2, F.lit(0))),
        "subdomain_depth": long(F.greatest(F.regexp_count(d, F.lit("[.]")) - 1, F.lit(0))),
        "registered_domain_length": long(F.length("_two")),
        "tld_length": long(F.length("_tld")),
        "is_common_tld": one(F.col("_tld").isin(*C.COMMON_TLDS)),
        "is_malicious_gtld": one(F.col("_tld").isin(*C.RISKY_TLDS)),
        "has_https": one(F.startswith("_url", F.lit("https://"))),
    }


def brand() -> dict[str, Column]:
    several = F.size("p") >= 2
    in_two, in_sub = any_of(F.col("_two"), KEYWORDS), F.exists("_sub", lambda x: any_of(x, KEYWORDS))
    length = first_of(F.col("_two"), [(k, len(k)) for k in KEYWORDS])
    sub = F.flatten(F.transform("_sub", lambda x: F.array(*[F.when(F.contains(x, F.lit(k)), F.struct(F.lit(i).alias("i"), F.lit(len(k)).alias("n"))) for i, k in enumerate(KEYWORDS)])))
    in_sub_length = F.array_min(F.filter(sub, lambda x: x.isNotNull()))["n"]
    return {
        "brand_keyword_position": F.when(several & in_two, 1).when(several & in_sub, 2).otherwise(0).cast("bigint"),
        "has_cse_keyword_in_subdomain": one(in_sub),
        "brand_to_reg_length_ratio": F.when(several, F.coalesce(F.coalesce(length, in_sub_length) / F.length("_two"), F.lit(0.0))).otherwise(0.0),
        "has_brand_in_path": one(any_of(F.col("_path"), KEYWORDS)),
        "has_brand_keyword": one(any_of(F.col("_url"), KEYWORDS)),
    }


def edit_distance() -> dict[str, Column]:
    """Least normalised edit distance (1 to 3) between a token and a keyword; 99 without one."""
    lengths = F.array(*[F.lit(len(k)) for k in KEYWORDS])
    scaled = lambda d, i: F.when(d.between(1, 3), d / F.get(lengths, i))
    near = F.transform("tokens", lambda t: F.array_min(F.transform(F.array(*[F.levenshtein(t, F.lit(k)) for k in KEYWORDS]), scaled)))
    return {"min_brand_levenshtein": F.coalesce(F.array_min(near), F.lit(99.0))}


def patterns() -> dict[str, Column]:
    d, n = F.col("d"), F.col("n")
    runs = F.transform(F.regexp_extract_all(d, F.lit("([bcdfghjklmnpqrstvwxyz]+)"), F.lit(1)), lambda x: F.length(x))
    return {
        "has_ip": one(d.rlike(r"^\d+\.\d+\.\d+\.\d+$")),
        "has_repeated_digits": one(d.rlike(r"(\d)\1{2,}")),
        "consonant_ratio": F.regexp_count(d, F.lit("[bcdfghjklmnpqrstvwxyz]")) / n,
        "vowel_ratio": F.regexp_count(d, F.lit("[aeiou]")) / n,
        "longest_consonant_run": long(F.coalesce(F.array_max(runs), F.lit(0))),
        "is_punycode": one(F.startswith(d, F.lit("xn--"))),
    }


def lures() -> dict[str, Column]:
    return {f"has_{w}": one(F.contains("d", F.lit(w))) for w in C.LURE_WORDS}


def ngrams() -> dict[str, Column]:
    tri, size = F.col("tri"), F.size("tri")
    distinct = F.array_distinct(tri)
    share = lambda x: F.when(size > 0, x / size).otherwise(0.0)
    bad = F.size(F.filter(tri, lambda t: t.isin(*C.SUSPICIOUS_TRIGRAMS)))
    return {
        "suspicious_trigram_count": long(bad),
        "legitimate_trigram_count": long(F.size(F.filter(tri, lambda t: t.isin(*C.LEGITIMATE_TRIGRAMS)))),
        "trigram_suspicion_ratio": share(bad),
        "unique_trigram_ratio": share(F.size(distinct)),
        "max_repeated_trigram": long(F.coalesce(F.array_max(F.transform(distinct, lambda t: F.size(F.filter(tri, lambda x: x == t)))), F.lit(0))),
    }


def all_features() -> dict[str, Column]:
    return {**structural(), **brand(), **edit_distance(), **patterns(), "entropy": entropy(F.col("d")), **lures(), **ngrams()}


FEATURES = (
    "domain_length digit_ratio dot_ratio num_hyphens hyphen_ratio num_special_chars special_char_ratio subdomain_count subdomain_depth registered_domain_length tld_length is_common_tld is_malicious_gtld has_https "
    "brand_keyword_position has_cse_keyword_in_subdomain brand_to_reg_length_ratio has_brand_in_path has_brand_keyword min_brand_levenshtein "
    "has_ip has_repeated_digits consonant_ratio vowel_ratio longest_consonant_run is_punycode entropy " + " ".join(f"has_{w}" for w in C.LURE_WORDS) + " suspicious_trigram_count legitimate_trigram_count trigram_suspicion_ratio unique_trigram_ratio max_repeated_trigram"
).split()


def features(df: DataFrame, column: str = "domain", what=all_features) -> DataFrame:
    """df plus the features of `what`; ratios are rounded to 6 places."""
    made = shared(df, column)
    cols = {k: v for k, v in what().items()}
    kept = [c for c in df.columns if c not in cols]
    out = made.select(*kept, *(v.alias(k) for k, v in cols.items()))
    return out.select(*kept, *(F.round(k, 6).alias(k) if dict(out.dtypes)[k] == "double" else F.col(k) for k in cols))
