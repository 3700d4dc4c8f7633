"""WHOIS, DNS and certificate features over fact tables. Ages take the time they are asked at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .lexical import any_of


def elapsed_days(since: Column, as_of: Column) -> Column:
    """Whole days between two times."""
    return F.timestamp_diff("DAY", since, as_of).cast("bigint")


def registrar_risk(registrar: Column) -> Column:
    table = F.create_map(*[x for k, v in C.REGISTRAR_RISK.items() for x in (F.lit(k), F.lit(v))])
    return F.when(registrar.isNull(), C.REGISTRAR_DEFAULT).otherwise(F.coalesce(F.try_element_at(table, F.upper(registrar)), F.lit(C.REGISTRAR_DEFAULT)))


def has_privacy(*fields: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(any_of(F.lower(f), C.PRIVACY_TERMS), F.lit(False)) for f in fields])


def risky_registrar(registrar: Column) -> Column:
    return F.coalesce(any_of(F.lower(registrar), C.RISKY_REGISTRARS), F.lit(False))


def whois_text_age(text: Column, as_of: Column) -> Column:
    """Age by the first pattern of the raw text that gives a date; -1 without one."""
    dates = [F.try_to_date(F.replace(F.substring(F.regexp_extract(text, f"(?i){p}", 1), 1, 10), F.lit("/"), F.lit("-")), "yyyy-MM-dd") for p in C.WHOIS_DATE_PATTERNS]
    return F.coalesce(elapsed_days(F.coalesce(*dates).cast("timestamp"), as_of), F.lit(-1).cast("bigint"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), F.lit(2))
    return 2 * C.EARTH_KM * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)))


def home_distance(country: Column) -> Column:
    code = F.upper(F.substring(F.coalesce(country, F.lit("")), 1, 2))
    table = lambda k: F.create_map(*[x for c, v in C.COUNTRY_COORDS.items() for x in (F.lit(c), F.lit(v[k]))])
    lat, lon = (F.coalesce(F.try_element_at(table(k), code), F.lit(0.0)) for k in (0, 1))
    return haversine(F.lit(C.HOME[0]), F.lit(C.HOME[1]), lat, lon)


def certificate_matches(domain: Column, cn: Column, san: Column) -> Column:
    d, c = F.lower(domain), F.lower(cn)
    base = F.substring(c, 3, 1000)
    wild = F.startswith(c, F.lit("*.")) & ((d == base) | F.endswith(d, F.concat(F.lit("."), base)))
    return (d == c) | (d == F.lower(san)) | wild


def live_features(domain: Column, cert: dict[str, Column], dns: dict[str, Column], as_of: Column) -> dict[str, Column]:
    """Features of a name's certificate (issuer, san, not_before, not_after) and DNS facts (mx, txt and a: arrays, ttl). A
    null column is a probe that failed and gives the default."""
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0)).cast("bigint")
    days = lambda a, b: F.coalesce(elapsed_days(a, b), F.lit(-1).cast("bigint"))
    return {
        "has_ssl": flag(cert["not_before"].isNotNull()),
        "is_lets_encrypt": flag(F.contains(cert["issuer"], F.lit("Let's Encrypt"))),
        "cert_domain_matches": flag(F.contains(F.lower(cert["san"]), F.lower(domain))),
        "cert_age_days": days(cert["not_before"], as_of),
        "cert_days_remaining": days(as_of, cert["not_after"]),
        "has_mx": flag(F.size(dns["mx"]) > 0),
        "has_spf": flag(F.exists(dns["txt"], lambda t: F.contains(F.lower(t), F.lit("spf")))),
        "a_record_count": F.when(dns["a"].isNull(), 0).otherwise(F.size(dns["a"])).cast("bigint"),
        "ttl_value": F.coalesce(dns["ttl"].cast("bigint"), F.lit(-1).cast("bigint")),
    }


def common_name_holds(domain: Column, cn: Column) -> Column:
    """The validation variant of the certificate test: the common name contains the domain."""
    return F.coalesce(F.contains(F.lower(cn), F.lower(domain)), F.lit(False))


def whois_row(created: Column, registrar: Column, fields: list[Column], found: Column, as_of: Column) -> dict[str, Column]:
    """WHOIS features; privacy looks at all given fields. A failed query (not found) has age 9999, neutral risk and privacy."""
    age = F.coalesce(elapsed_days(created, as_of), F.lit(9999).cast("bigint"))
    return {
        "domain_age_days": F.when(found, age).otherwise(9999).cast("bigint"),
        "is_new_domain": (found & (age < 30)).cast("bigint"),
        "registrar_risk": F.when(found, registrar_risk(registrar)).otherwise(C.REGISTRAR_DEFAULT),
        "has_privacy": F.when(found, has_privacy(*fields)).otherwise(True).cast("bigint"),
        "has_whois": found.cast("bigint"),
    }


def whois_analysis(created: Column, registrar: Column, name: Column, as_of: Column, most: int = 90) -> dict[str, Column]:
    """The analyser's variant: an unknown age is 0 and so new."""
    age = F.coalesce(elapsed_days(created, as_of), F.lit(0).cast("bigint"))
    return {"age_days": age, "is_new_domain": age <= most, "registrar": F.coalesce(registrar, F.lit("Unknown")), "has_privacy": F.coalesce(F.contains(F.lower(name), F.lit("redacted")), F.lit(False))}


def geo_features(created: Column, registrar: Column, country: Column, as_of: Column) -> dict[str, Column]:
    """Age (null if unknown), lower-cased registrar and its risk flag, country of the address and whether it is India."""
    place = F.coalesce(country, F.lit(""))
    return {"domain_age_days": elapsed_days(created, as_of), "registrar": F.lower(F.coalesce(registrar, F.lit(""))), "registrar_risk": risky_registrar(registrar).cast("bigint"), "ip_country": place, "ip_in_india": (F.lower(place) == "india").cast("bigint")}


def enriched(rows, whois, dns, geo, tls):
    """rows (domain, ...) with the facts of four tables keyed by domain, geo by the address (ip) that DNS gave. A domain
    without a fact has empty values; a table has one row a key."""
    out = rows.join(whois.select("domain", "registrar", F.col("created").alias("domain_creation_date"), F.col("country").alias("registrant_country")), "domain", "left")
    out = out.join(dns.select("domain", F.col("ip").alias("hosting_ip"), F.array_join("mx", "; ").alias("mx_records")), "domain", "left")
    out = out.join(geo.select(F.col("ip").alias("hosting_ip"), "asn", F.col("org").alias("hosting_isp"), F.col("country").alias("hosting_country")), "hosting_ip", "left")
    out = out.join(tls.select("domain", "has_ssl"), "domain", "left")
    return out.na.fill("", ["registrar", "registrant_country", "hosting_ip", "mx_records", "asn", "hosting_isp", "hosting_country"]).withColumn("has_ssl", F.coalesce("has_ssl", F.lit(False)))
