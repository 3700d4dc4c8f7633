"""Pages as token streams: one linear pass over the markup in Arrow batches, then columns by folds over the tokens.

A token is a start tag with its attributes, an end tag, or a text. A quoted attribute may hold any character; scripts and styles end at
their own end tag alone; comments, declarations and broken ends are no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .lexical import KEYWORDS, any_of

TOKENS = "array<struct<tag:string,ends:boolean,attrs:map<string,string>,text:string>>"
#: characters of pages whose tokens are held as Python values at once
SLICE = 1 << 19
#: elements whose content is no markup; elements whose text is not shown
RAW, UNSEEN = ("script", "style"), ("script", "style", "template")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/=>]*)(?:\s*=+\s*(?:"([^"]*)"|'([^']*)'|(?!["'])([^\s>]*)))?""")
_GAP = re.compile(r"[\s/]*")


def tokens(page: str | None, decode: Callable[[str], str] = unescape) -> Iterator[tuple[str | None, bool, dict[str, str], str]]:
    """(tag, whether it ends, attributes, text) of a page in order; of attributes that repeat the last counts. A tag that the page's
    end cuts off is left out; a lone less-than sign is text. `decode` reads character references in texts and attributes."""
    page = page or ""
    size, at, text = len(page), 0, []

    def so_far() -> Iterator[tuple]:
        if whole := "".join(text):
            yield None, False, {}, decode(whole)
        text.clear()

    while at < size:
        start = page.find("<", at)
        if start < 0:
            text.append(page[at:])
            break
        text.append(page[at:start])
        if page.startswith("<!--", start):
            ends = [m for m in (_closing(page, start + 4), size) if m >= 0]
            yield from so_far()
            at = ends[0]
        elif (name := _NAME.match(page, start + 1)) is not None:
            yield from so_far()
            tag = name.group().lower()
            at, attributes = name.end(), {}
            while at < size:
                at = _GAP.match(page, at).end()
                if at >= size or page[at] == ">":
                    break
                found = _ATTRIBUTE.match(page, at)
                values = [v for v in found.groups()[1:] if v is not None]
                attributes[found.group(1).lower()] = decode(values[0]) if values else ""
                at = found.end()
            if at >= size:
                break  # cut off
            at += 1
            yield tag, False, attributes, ""
            if tag in RAW:
                closed = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
                end = closed.start() if closed else size
                if end > at:
                    yield None, False, {}, page[at:end]
                at = end
        elif page.startswith("</", start) and (name := _NAME.match(page, start + 2)) is not None:
            yield from so_far()
            end = page.find(">", name.end())
            if end < 0:
                break
            yield name.group().lower(), True, {}, ""
            at = end + 1
        elif page[start + 1 : start + 2] in ("!", "?", "/"):
            yield from so_far()
            end = page.find(">", start)
            at = end + 1 if end >= 0 else size
        else:
            text.append("<")
            at = start + 1
    yield from so_far()


#: the references that `closed` reads, in this order
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def closed(text: str) -> str:
    """text with its common references read, those that end with a semicolon alone: a text cut within one keeps what is left of it."""
    for written, sign in REFERENCES:
        text = text.replace(written, sign)
    return text


def _closing(page: str, at: int) -> int:
    """Where a comment ends; -1 if it does not."""
    found = re.compile(r"--!?>|(?<=<!--)-?>").search(page, at)
    return found.end() if found else -1


def parsed(pages: DataFrame, html: str = "html", decode: Callable[[str], str] = unescape) -> DataFrame:
    """pages plus tokens; a null page has none."""

    @F.arrow_udf(TOKENS)
    def read(html: pa.Array) -> pa.Array:
        parts, some, size = [], [], 0
        for p in html:
            some.append(p.as_py())
            size += len(some[-1] or "")
            if size >= SLICE:
                parts.append(_streams(some, decode))
                some, size = [], 0
        return pa.concat_arrays([*parts, _streams(some, decode)])

    return pages.withColumn("tokens", read(F.col(f"`{html}`")))


def _streams(pages: list[str | None], decode: Callable[[str], str]) -> pa.Array:
    """The tokens of pages as one array, column by column."""
    ends, tags, closing, attributes, keys, values, texts = [0], [], [], [0], [], [], []
    for page in pages:
        for tag, end, attrs, text in tokens(page, decode):
            tags.append(tag)
            closing.append(end)
            keys += attrs
            values += attrs.values()
            attributes.append(len(keys))
            texts.append(text)
        ends.append(len(tags))
    string = pa.string()
    marks = pa.MapArray.from_arrays(pa.array(attributes, pa.int32()), pa.array(keys, string), pa.array(values, string))
    rows = pa.StructArray.from_arrays([pa.array(tags, string), pa.array(closing, pa.bool_()), marks, pa.array(texts, string)], ["tag", "ends", "attrs", "text"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


# ---- columns ----


def _starts(stream: Column, *tags: str) -> Column:
    return F.filter(stream, lambda t: t["tag"].isin(*tags) & ~t["ends"])


def _n(found: Column) -> Column:
    return F.size(found).cast("bigint")


def depth_at(stream: Column, tag: str, hit) -> Column:
    """Whether a token for which `hit` holds stands inside an element of the tag."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("hit"))

    def step(s: Column, t: Column) -> Column:
        own = F.coalesce(t["tag"] == tag, F.lit(False))
        depth = F.when(own & ~t["ends"], s["depth"] + 1).when(own, F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), (s["hit"] | ((s["depth"] > 0) & F.coalesce(hit(t), F.lit(False)))).alias("hit"))

    return F.aggregate(stream, start, step, lambda s: s["hit"])


def text(stream: Column, unseen: tuple[str, ...] = UNSEEN) -> Column:
    """The shown text of a page."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        own = F.coalesce(t["tag"].isin(*unseen), F.lit(False))
        depth = F.when(own & ~t["ends"], s["depth"] + 1).when(own, F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), F.when(t["tag"].isNull() & (s["depth"] == 0), F.concat(s["out"], F.array(t["text"]))).otherwise(s["out"]).alias("out"))

    return F.aggregate(stream, start, step, lambda s: F.array_join(s["out"], ""))


def title(stream: Column) -> Column:
    """The text of the first title; empty without one."""
    start = F.struct(F.lit(0).alias("state"), F.lit("").alias("out"))  # 0 before, 1 inside, 2 after

    def step(s: Column, t: Column) -> Column:
        own = F.coalesce(t["tag"] == "title", F.lit(False))
        state = F.when(own & ~t["ends"] & (s["state"] == 0), 1).when(own & t["ends"] & (s["state"] == 1), 2).otherwise(s["state"])
        return F.struct(state.alias("state"), F.when((s["state"] == 1) & t["tag"].isNull(), F.concat(s["out"], t["text"])).otherwise(s["out"]).alias("out"))

    return F.aggregate(stream, start, step, lambda s: s["out"])


def _host(url: Column) -> Column:
    return F.replace(F.regexp_extract(F.lower(url), r"^https?://([^/?#]*)", 1), F.lit("www."), F.lit(""))


def _elsewhere(url: Column, domain: Column) -> Column:
    own = F.replace(F.lower(domain), F.lit("www."), F.lit(""))
    return F.coalesce(F.startswith(url, F.lit("http")) & (_host(url) != "") & (_host(url) != own), F.lit(False))


def forms(stream: Column, domain: Column) -> dict[str, Column]:
    """Password input inside a form, and a form that posts to another host."""
    return {
        "has_password_field": depth_at(stream, "form", lambda t: (t["tag"] == "input") & ~t["ends"] & (F.lower(t["attrs"]["type"]) == "password")),
        "form_action_external": F.exists(_starts(stream, "form"), lambda t: _elsewhere(t["attrs"]["action"], domain)),
    }


def counts(stream: Column) -> dict[str, Column]:
    hidden = F.filter(stream, lambda t: F.coalesce(any_of(F.lower(t["attrs"]["style"]), C.HIDDEN_STYLES), F.lit(False)))
    return {"num_forms": _n(_starts(stream, "form")), "iframe_count": _n(_starts(stream, "iframe")), "hidden_element_count": _n(hidden)}


def external_ratio(stream: Column, domain: Column) -> Column:
    """Share of scripts and images whose source is another host's URL."""
    found = _starts(stream, "script", "img")
    return F.when(F.size(found) > 0, F.size(F.filter(found, lambda t: _elsewhere(t["attrs"]["src"], domain))) / F.size(found)).otherwise(0.0)


def flags(stream: Column, html: Column) -> dict[str, Column]:
    html = F.coalesce(html, F.lit(""))
    return {
        "has_favicon": F.exists(_starts(stream, "link"), lambda t: F.coalesce(F.contains(F.lower(t["attrs"]["rel"]), F.lit("icon")), F.lit(False))),
        "has_copyright": F.contains(html, F.lit("©")) | F.contains(F.lower(text(stream)), F.lit("copyright")),
        "title_has_brand": any_of(F.lower(title(stream)), KEYWORDS),
        "has_eval_js": F.contains(html, F.lit("eval(")),
        "has_obfuscated_js": F.contains(html, F.lit("fromCharCode")) | F.contains(html, F.lit("unescape")),
        "is_parked": any_of(F.lower(html), C.PARKED),
    }


def page_analysis(stream: Column) -> dict[str, Column]:
    """Credential flag (a password input anywhere), number of forms, title."""
    password = F.exists(_starts(stream, "input"), lambda t: F.coalesce(F.lower(t["attrs"]["type"]) == "password", F.lit(False)))
    return {"has_credentials": password, "form_count": _n(_starts(stream, "form")), "title": title(stream)}
