"""Rule scores, homoglyphs, filters and brand mapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .fuzzy import text_pairs
from .lexical import KEYWORDS, any_of, entropy, first_of, long, one
from .spread import spread


def _alternatives(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def ends_with(text: Column, suffixes) -> Column:
    return _alternatives([F.endswith(text, F.lit(s)) for s in suffixes])


def common_suffix(domain: Column) -> Column:
    """Whether the public suffix is a common one; two-level suffixes under .in are not."""
    return domain.rlike(r"[.](" + "|".join(C.COMMON_SUFFIXES) + ")$") & ~domain.rlike(r"[.](co|gov|ac|org|net|nic)[.]in$")


def tld_risk(domain: Column) -> Column:
    low = F.lower(domain)
    return F.when(ends_with(low, C.SUFFIX_RISKY), 0.8).when(ends_with(low, C.SUFFIX_SAFE), 0.1).otherwise(0.3)


def typosquatting(domain: Column) -> Column:
    return F.when(F.contains(domain, F.lit("-")) & (F.length(domain) > 15), 0.7).otherwise(0.3)


_BRAND_WORDS = tuple(w for _, ws in C.ANALYZER_BRANDS for w in ws)


def brand_score(domain: Column) -> Column:
    """1 for a contained keyword, 0.9 for a shared token, else 0 (the sequence ratio is fuzzy_scores')."""
    low = F.lower(domain)
    tokens = sorted({t for w in _BRAND_WORDS for t in w.split()})
    shared = F.arrays_overlap(F.split(low, "[- ]"), F.array(*[F.lit(t) for t in tokens]))
    return F.when(any_of(low, _BRAND_WORDS), 1.0).when(shared, 0.9).otherwise(0.0)


def lexical_score(df: DataFrame, domain: str = "domain", brand: Column | None = None) -> DataFrame:
    """df plus brand_score and lexical_score (weighted, capped at 1)."""
    d = F.col(domain)
    df = df.withColumn("brand_score", brand_score(d) if brand is None else brand)
    digits = F.regexp_count(d, F.lit("[0-9]")) / F.greatest(F.length(d), F.lit(1))
    total = 0.4 * F.col("brand_score") + 0.2 * tld_risk(d) + 0.15 * typosquatting(d) + 0.1 * F.regexp_count(d, F.lit("-")) + 0.1 * entropy(d) + 0.05 * digits
    return df.withColumn("lexical_score", F.least(F.lit(1.0), total))


def fuzzy_scores(df: DataFrame, domain: str = "domain", threshold: float = 0.8) -> DataFrame:
    """df plus fuzzy_score: brand_score, and where this is 0 the best ratio of a keyword and the name that reaches threshold.

    The ratios come from a join of the keywords with the distinct names that the native tests left open."""
    scored = df.withColumn("_b", brand_score(F.col(domain)))
    open_ = scored.filter("_b = 0").select(F.col(domain).alias("l")).distinct()
    words = df.sparkSession.createDataFrame([(w,) for w in _BRAND_WORDS], "r string")
    best = text_pairs(open_, words, threshold).groupBy(F.col("l").alias("_n")).agg(F.max("ratio").alias("_r"))
    return scored.join(best, F.col(domain) == F.col("_n"), "left").withColumn("fuzzy_score", F.greatest("_b", F.coalesce("_r", F.lit(0.0)))).drop("_b", "_n", "_r")


def is_typosquatting(domain: Column, keywords=C.EDIT_KEYWORDS) -> Column:
    bare = F.replace(F.replace(F.lower(domain), F.lit("www."), F.lit("")), F.lit("-"), F.lit(""))
    return any_of(bare, [k for k in keywords if len(k) > 2])


def rule_suspicion(domain: Column) -> Column:
    low = F.lower(domain)
    parts = ((0.3, is_typosquatting(domain)), (0.2, ends_with(low, C.RULE_SUFFIXES)), (0.1, F.length(domain) > 30), (0.1, F.regexp_count(domain, F.lit("-")) >= 2))
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0.0) for w, c in parts]))


def enhanced_lexical(df: DataFrame, domain: str = "domain") -> DataFrame:
    """The third lexical family."""
    kept = df.columns
    df = df.withColumn("_d", F.lower(domain)).withColumn("_p", F.split("_d", "[.]"))
    df = df.withColumn("_s", F.when(F.size("_p") > 2, F.slice("_p", 1, F.size("_p") - 2)).otherwise(F.expr("cast(array() as array<string>)"))).withColumn("_l", F.transform("_s", lambda x: F.length(x)))
    n = lambda pattern: long(F.regexp_count("_d", F.lit(pattern)))
    mean = F.when(F.size("_l") > 0, F.aggregate("_l", F.lit(0.0), lambda a, x: a + x) / F.size("_l")).otherwise(0.0)
    cols = {"domain_length": long(F.length("_d")), "num_dots": n("[.]"), "num_hyphens": n("-"), "num_underscores": n("_"), "num_special_chars": n("[^a-z0-9.-]"), "num_digits": n("[0-9]"), "has_repeated_digits": one(F.col("_d").rlike(r"(\d)\1{2,}")), "num_subdomains": long(F.size("_s")), "avg_subdomain_length": F.round(mean, 6), "max_subdomain_length": long(F.coalesce(F.array_max("_l"), F.lit(0))), "domain_entropy": F.round(entropy(F.col("_d")), 6), "is_idn": one(F.startswith("_d", F.lit("xn--"))), "suspicious_tld": one(F.element_at("_p", -1).isin(*C.THIRD_TLDS))}
    return df.select(*kept, *(c.alias(k) for k, c in cols.items()))


def homoglyphs(names: DataFrame, domain: str = "domain") -> DataFrame:
    """(domain, variant): the name itself and every one-character look-alike of all but its last label. A name's rows stay in one task,
    and names are dealt over all: each makes many rows (an outer explode, as Spark tests the size of a plain one's list before)."""
    table = F.create_map(*[x for k, v in C.CONFUSABLES.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    d, none = F.col("domain"), F.array().cast("array<string>")
    bare = spread(names.select(F.col(domain).alias("domain")), "domain").distinct().select(d, F.regexp_replace(d, "[.][^.]*$", "").alias("name"), F.element_at(F.split(d, "[.]"), -1).alias("tld"))
    with_ = lambda i, alt: F.concat(F.substr("name", F.lit(1), i), alt, F.substr("name", i + 2), F.lit("."), F.col("tld"))
    made = F.flatten(F.transform(F.split("name", ""), lambda ch, i: F.transform(F.coalesce(F.try_element_at(table, ch), none), lambda alt: with_(i, alt))))
    return bare.select("domain", F.explode_outer(F.array_distinct(F.concat(F.array(d), F.coalesce(made, none)))).alias("variant"))


def registered_homoglyphs(names: DataFrame, resolved: DataFrame) -> DataFrame:
    """Variants other than the name itself that resolve."""
    variants = homoglyphs(names).filter("variant <> domain")
    return variants.join(resolved.select(F.col("domain").alias("_r")).distinct(), F.col("variant") == F.col("_r"), "left_semi")


ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789.-_"


def char_ids(domain: Column, length: int = 64) -> Column:
    """Start mark (2) and the first characters as ids; 1 unknown, 0 padding."""
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(domain, i, F.lit(1)))
    ids = F.transform(F.sequence(F.lit(1), F.lit(length - 1)), lambda i: F.when(i > F.length(domain), 0).otherwise(F.when(at(i) > 0, 2 + at(i)).otherwise(1)))
    return F.concat(F.array(F.lit(2)), ids).cast("array<bigint>")


def count_brands(domain: Column) -> Column:
    return reduce(lambda a, b: a + b, [one(F.contains(domain, F.lit(w))) for w in KEYWORDS])


def obfuscation(domain: Column) -> Column:
    """First token~keyword pair at edit distance 1 or 2, tokens of over 3 characters, in order."""
    tokens = F.filter(F.split(domain, "[^a-z0-9]+"), lambda t: F.length(t) > 3)
    pairs = F.flatten(F.transform(tokens, lambda t: F.array(*[F.when(F.levenshtein(t, F.lit(w)).between(1, 2), F.concat(t, F.lit(f"~{w}"))) for w in KEYWORDS])))
    return F.get(F.filter(pairs, lambda x: x.isNotNull()), 0)


def brand_of(domain: Column) -> tuple[Column, Column]:
    """(name, official domain) of the first keyword in order; Unknown CSE without one."""
    low = F.lower(domain)
    return F.coalesce(first_of(low, [(w, n) for w, n, _ in C.BRAND_ORDER]), F.lit("Unknown CSE")), F.coalesce(first_of(low, [(w, o) for w, _, o in C.BRAND_ORDER]), F.lit("unknown"))


def guarded_brand(domain: Column) -> Column:
    """Brand by the guarded map: none where a service word stands in the name."""
    low = F.lower(domain)
    found = first_of(low, [(w, n) for n, ws in C.GUARDED_BRANDS for w in ws])
    return F.when(any_of(low, C.SERVICE_WORDS), "Unknown").otherwise(F.coalesce(found, F.lit("Unknown")))


def target_and_confidence(domain: Column, guarded: Column) -> tuple[Column, Column]:
    low = F.lower(domain)
    generic = F.lit("Unknown")
    level = F.lit("Low")
    for name, ws in reversed(C.GENERIC_WORDS):
        generic = F.when(any_of(low, ws), name).otherwise(generic)
        level = F.when(any_of(low, ws), "Medium").otherwise(level)
    return F.when(guarded != "Unknown", guarded).otherwise(generic), F.when(guarded != "Unknown", "High").otherwise(level)


def suspicious(domain: Column, feed: bool = False) -> Column:
    """Brand name or keyword that makes a new name suspicious, else null. feed: the daily feed's rule, which also
    looks for keywords in the lower-cased first label."""
    name, _ = brand_of(domain)
    first = F.split(F.lower(domain) if feed else domain, "[.]")[0]
    near = F.lit(None)
    for w in reversed(C.EDIT_KEYWORDS):
        hit = (F.levenshtein(first, F.lit(w)) <= (2 if len(w) <= 5 else 3)) & (F.length(first) < len(w) + 3)
        near = F.when(F.contains(first, F.lit(w)) | hit if feed else hit, w).otherwise(near)
    return F.when(name != "Unknown CSE", name).otherwise(near)


def utility(domain: Column) -> Column:
    return F.lower(domain).rlike("(?i)" + "|".join(C.UTILITY_PATTERNS))


def false_positive_candidate(domain: Column, age_days: Column) -> Column:
    return utility(domain) | (F.lower(domain).rlike("|".join(C.SOFT_PATTERNS)) & F.coalesce(age_days > 365, F.lit(False)))


def utility_category(domain: Column) -> Column:
    out = F.lit("other_legitimate")
    for name, ps in reversed(C.UTILITY_CATEGORIES):
        out = F.when(F.lower(domain).rlike("|".join(ps)), name).otherwise(out)
    return out


def official_domain(brand: Column) -> Column:
    """Official domain of a brand's name, by the first entry of that name; 'unknown' without one."""
    out = F.lit("unknown")
    for _, name, official in reversed(C.BRAND_ORDER):
        out = F.when(brand == name, official).otherwise(out)
    return out


def first_keyword(domain: Column) -> Column:
    """First keyword in list order that the name holds, else Generic."""
    return F.coalesce(first_of(F.lower(domain), [(w, w) for w in KEYWORDS]), F.lit("Generic"))


def brand_of_file(name: Column) -> Column:
    """Brand by the first of nine keys in the name of a template file, else Unknown."""
    return F.coalesce(first_of(F.lower(name), C.FILE_BRANDS), F.lit("Unknown"))


def sector_mask(target: Column, domain: Column, words=C.SECTOR_WORDS) -> Column:
    """Whether target or name holds a word of the sector list, in any case; null counts as no."""
    pattern = "(?i)" + "|".join(words)
    return F.coalesce(target.rlike(pattern), F.lit(False)) | F.coalesce(domain.rlike(pattern), F.lit(False))


def known_age(domain: Column, known: Column, brands) -> Column:
    """Age in days of brands' own names by estimate, of others as known; null where it must be asked for."""
    return F.when(F.lower(domain).isin(*brands), C.BRAND_AGE_DAYS).otherwise(known)


def template_score(brand: Column, template: Column, words, split: str) -> Column:
    """3 for each word that both names hold, 1 for each part of over three letters of the brand in the template."""
    b, t = F.lower(brand), F.lower(template)
    both = reduce(lambda x, y: x + y, [F.when(F.contains(b, F.lit(w)) & F.contains(t, F.lit(w)), 3).otherwise(0) for w in words])
    parts = F.size(F.filter(F.split(b, split), lambda w: (F.length(w) > 3) & F.contains(t, w)))
    return both + parts


def best_template(templates: DataFrame, brands: list[str], score: Column) -> DataFrame:
    """(brand, template, score) for each of a short list of brands: of templates (i, template) the one of the best score, the first of equals; a
    score of 0 counts. `score` is over brand and template. Combined before the shuffle, so a list of any length of templates is
    read once."""
    pairs = templates.withColumn("brand", F.explode(F.array(*[F.lit(b) for b in brands]))).withColumn("s", score)
    return pairs.groupBy("brand").agg(F.max_by("template", F.struct("s", -F.col("i"))).alias("template"), F.max("s").cast("bigint").alias("score"))


def synthetic(brands: DataFrame, suffixes, subs, tlds, n: int) -> DataFrame:
    """(domain): made-up phishing names of the distinct brands, n of brand, suffix and tld, and n with brand as a subdomain; those of
    least hash."""
    each = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    made = brands.select("brand").distinct().withColumn("tld", each(tlds)).withColumn("suffix", each(suffixes))
    plain = made.select(F.concat("brand", "suffix", "tld").alias("domain"))
    under = made.withColumn("sub", each(subs)).select(F.concat("brand", F.lit("."), "sub", "suffix", "tld").alias("domain"))
    least = lambda df: df.distinct().orderBy(F.md5("domain"), "domain").limit(n)
    return least(plain).unionByName(least(under)).distinct()
