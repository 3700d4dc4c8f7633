"""Page-content features from HTML text, with native expressions (marks and texts of pages: `markup`)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexical import any_of

def live(html: Column, status: Column) -> Column:
    low = F.lower(html)
    return (status == 200) & (F.length(html) > 1000) & any_of(low, ("<html", "<body", "<div", "<form", "<input", "<button"))


def urls(text: Column) -> Column:
    """Distinct http links of a message."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"""(https?://[^\s"'<>]+)"""), F.lit(1)))


def plain_text(html: Column) -> Column:
    """Text of a page without scripts, styles and tags, by patterns alone; character references stay as they are written."""
    for pattern in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        html = F.regexp_replace(html, pattern, "")
    return html


def redirects(asked: Column, final: Column, hops: Column) -> dict[str, Column]:
    """Whether a fetch ended on another host (www. aside), and how many hops it took."""
    host = lambda u: F.replace(F.regexp_extract(F.lower(u), r"^https?://([^/?#]*)", 1), F.lit("www."), F.lit(""))
    return {"redirected_to_different_domain": (host(asked) != host(final)).cast("bigint"), "redirect_count": F.coalesce(F.size(hops), F.lit(0)).cast("bigint")}
