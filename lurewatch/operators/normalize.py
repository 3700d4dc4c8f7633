"""Host and label normalisation. The variants differ on purpose: each belongs to another feed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import LABEL_VARIANTS

AUTHORITY = r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)"
PATH = r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*([^?#]*)"


def with_slashes(url: Column) -> Column:
    """url with a leading // if it has none anywhere."""
    return F.when(F.contains(url, F.lit("//")), url).otherwise(F.concat(F.lit("//"), url))


def host(url: Column) -> Column:
    """Network location of a lower-cased URL or bare name, user info and port included."""
    return F.regexp_extract(with_slashes(F.lower(url)), AUTHORITY, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(with_slashes(F.lower(url)), PATH, 1)


def host_without_port(url: Column) -> Column:
    """Trimmed, lower-cased location without port; '' for an empty input."""
    return F.regexp_replace(host(F.trim(F.coalesce(url, F.lit("")))), ":.*$", "")


def host_or_null(url: Column) -> Column:
    """As host_without_port, but null where there is no location."""
    return F.nullif(host_without_port(url), F.lit(""))


def clean_domain(name: Column) -> Column:
    """Lower-cased, trimmed, without leading www. and trailing dots; null for IPv4 and names under 4 characters."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"^www\.", ""), r"\.+$", "")
    return F.when(bare.rlike(r"^\d+\.\d+\.\d+\.\d+$") | (F.length(bare) < 4), None).otherwise(bare)


def strip_www(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"^www\.", "")


def drop_www_anywhere(name: Column) -> Column:
    return F.replace(name, F.lit("www."), F.lit(""))


def label(raw: Column) -> Column:
    """One of the three labels, or null."""
    out = F.lit(None).cast("string")
    for name, variants in reversed(LABEL_VARIANTS):
        out = F.when(F.lower(F.trim(raw)).isin(*variants), name).otherwise(out)
    return out


def link_host(url: Column) -> Column:
    """Location of a message's link: lower-cased, without a leading www., with its port; '' without a scheme."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def file_domain(name: Column) -> Column:
    """Domain in the name of a template image (its last part before .png that holds a dot); null without one."""
    return F.nullif(F.lower(F.regexp_extract(name, r"(?i)_([a-z0-9.-]+\.[a-z]{2,})\.png$", 1)), F.lit(""))
