"""Main text of web pages through wrappers: union-free regular expressions inferred from pages of a host.

A page is read as a stream of block tags and text and folded into a tree (`alignment`). The distinct trees of a host are
aligned one after another: mismatches become optional groups, repeats fold into repeated groups, text is a slot. The
wrapper is a table; every tree is aligned with it, which gives each block of text its place. A text that stands at one
place on nearly all pages of the host is the template's. The article is the group of the wrapper with most slot text;
tags, roles and class words break ties, and tell navigation and the like inside of it. A host of fewer than FEWEST
distinct pages has no wrapper: there the marks alone decide.

Trees are made distinct before they are shuffled and merged in buckets of about FAN rows that are read one by one, in as
many rounds as that takes; texts are counted by (host, place, text), combined before the shuffle. A host with a third of
all pages is no group of any task. Reading a page is iterative and takes time in proportion to its length, however deep
or broken it is.

`infer` and `expression` give a quick view of a host by counts of places (path and left neighbour), without alignment.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import Skeleton, flat, grown, matched, merge, region
from .common import looked_up, slices, table, written

#: share of a host's distinct pages on which the text of a template stands, and their least number
NEARLY_ALL, FEWEST = 0.9, 3
#: trees that are merged in one go, about
FAN = 256
#: tags that begin and end blocks, fixed values
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: tags whose content is no text of the page
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "math", "audio", "video", "canvas")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: what an opening tag closes when it stands directly inside
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
CHROME_TAGS = frozenset("nav aside footer form button select option optgroup label legend head dialog menu search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: words in a class or id that mark what is no article
CHROME_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)|\b(hidden)\b")
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
CHROME, ARTICLE, OTHER = 0, 1, 2


@lru_cache(10_000)
def _signature(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """tag, then its classes and id with digits as one sign, its role, and a mark if hidden; whether it is an article
    or main element, no part of an article, or none where it stands outside of one."""
    names, role, hidden = [], "", False
    if attrs and tag not in ("html", "body"):
        for key, value, flag in _ATTR.findall(attrs):
            key, value = key.lower(), html.unescape(value.strip("\"'")).lower()
            if flag or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
            elif key in ("class", "id"):
                names += [re.sub(r"\d+", "0", re.sub(r"[^\w-]", "", x)) for x in value.split()]
            elif key == "role":
                role = re.sub(r"\W", "", value)
    names = sorted({n for n in names if n})
    sig = tag + "".join(f".{n}" for n in names) + (f"@{role}" if role else "") + ("!" if hidden else "")
    said = set(re.findall(r"[a-z]+", " ".join(names)))
    main = tag in ("article", "main") or role in ("article", "main")
    plain = tag in ("html", "body", "article", "main")
    chrome = hidden or not plain and (tag in CHROME_TAGS or role in CHROME_ROLES or bool(said & CHROME_WORDS))
    return sig, main, chrome, not plain and (tag == "header" or "header" in said)


def _place(parent: int, sig: str, before: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent}\n{sig}\n{before}") - (1 << 63)


def parse(page: str | None, tree: Skeleton | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, int]]]:
    """(blocks, nodes). blocks: (node, kind, text) in page order; kind is CHROME, ARTICLE or OTHER. nodes: (node, its
    parent, signature, the most times one element of the parent holds it). tree, if given, is told of all elements.

    A tag that no `>` closes outside of its quoted values ends at the next `>`, and so do all tags after it; without
    any the rest is text."""
    page = page or ""
    blocks: list[tuple[int, int, str]] = []
    nodes: dict[int, list] = {}
    # of the open elements: tag, node, kind, the last child's signature, and what stood before its run
    tags, places, kinds, last, before, runs = ["^"], [0], [OTHER], [""], [""], [Counter()]
    open_, held, strict, at, size = Counter(), [], True, 0, len(page)

    def flush() -> None:
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                blocks.append((places[-1], kinds[-1], text))
                if tree is not None:
                    tree.text()
            held.clear()

    def close() -> None:
        open_[tags.pop()] -= 1
        for stack in (places, kinds, last, before, runs):
            stack.pop()
        if tree is not None:
            tree.close()

    while (i := page.find("<", at)) >= 0:
        held.append(page[at:i])
        after = page[i + 1 : i + 2]
        if after in ("!", "?") and after:
            comment = page.startswith("<!--", i)
            end = page.find("-->" if comment else ">", i + 2)
            if end < 0 and not comment:
                at = i
                break
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        if not (after.isascii() and after.isalpha()) and not (after == "/" and page[i + 2 : i + 3].isascii() and page[i + 2 : i + 3].isalpha()):
            held.append("<")
            at = i + 1
            continue
        m = _TAG.match(page, i) if strict else None
        if m:
            slash, tag, attrs, at = m[1], m[2].lower(), m[3], m.end()
        else:
            strict, end = False, page.find(">", i)
            if end < 0:
                at = i
                break
            inner = page[i + 1 : end]
            slash, inner, at = "/" * inner.startswith("/"), inner.removeprefix("/"), end + 1
            tag = re.match(r"[^\s/]*", inner)[0].lower()
            attrs = inner[len(tag) :]
        if tag in RAW:
            if not slash and not attrs.rstrip().endswith("/"):
                end = _END[tag].search(page, at)
                at = end.end() if end else size
        elif tag == "br":
            held.append(" ")
        elif tag in BLOCKS:
            flush()
            if slash:
                if open_[tag]:
                    while tags[-1] != tag:
                        close()
                    close()
                continue
            while tags[-1] == "p" or tags[-1] in CLOSES.get(tag, ()):
                close()
            sig, main, chrome, head = _signature(tag, attrs)
            if sig != last[-1]:
                before[-1], last[-1] = last[-1], sig
            place = _place(places[-1], sig, before[-1])
            runs[-1][place] += 1
            if place in nodes:
                nodes[place][3] = max(nodes[place][3], runs[-1][place])
            else:
                nodes[place] = [place, places[-1], sig, runs[-1][place]]
            if tag not in VOID:
                kind = kinds[-1]
                if kind != CHROME:
                    kind = CHROME if chrome or head and kind == OTHER and not main else ARTICLE if main else kind
                open_[tag] += 1
                tags.append(tag), places.append(place), kinds.append(kind), last.append(""), before.append(""), runs.append(Counter())
                if tree is not None:
                    tree.open(sig, kind)
    held.append(page[at:])
    flush()
    return blocks, [tuple(n) for n in nodes.values()]


def parsed(pages: DataFrame, page: str = "html", with_nodes: bool = False) -> DataFrame:
    """pages without `html`, plus blocks (array of node, kind and text) and, if asked for, nodes."""
    keep = [c for c in pages.columns if c not in (page, "blocks", "nodes")]
    kind = pa.list_(pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("text", pa.string())]))
    place = pa.list_(pa.struct([("node", pa.int64()), ("parent", pa.int64()), ("sig", pa.string()), ("times", pa.int32())]))
    head = pages.select(*keep).schema
    named = lambda rows, names: [[dict(zip(names, r)) for r in x] for x in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__h"):
            made = [parse(x) for x in part.column("__h").to_pylist()]
            new = [pa.array(named([m[0] for m in made], ("node", "kind", "text")), kind)]
            if with_nodes:
                new.append(pa.array(named([m[1] for m in made], ("node", "parent", "sig", "times")), place))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new], names=[*keep, "blocks", *["nodes"] * with_nodes])

    added = ["blocks array<struct<node:bigint,kind:int,text:string>>", *["nodes array<struct<node:bigint,parent:bigint,sig:string,times:int>>"] * with_nodes]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in head), *added])
    return pages.select(*keep, F.col(page).alias("__h")).mapInArrow(run, schema)


def host_of(url) -> F.Column:
    """Lower-case host of a URL; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def infer(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, node, parent, sig, optional, repeated, slot): the wrapper of every host, a row a node; slot is null for a
    node without text, true where its text differs between pages or elements. Copies of a page count like one page."""
    rows = parsed(pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(page).alias("content"), F.col(page).alias("html")), with_nodes=True)
    each = written(rows.select("host", "content", "blocks", "nodes"), "wrapper-pages")
    nodes = each.select("host", "content", F.explode("nodes").alias("n")).select("host", "content", "n.*").distinct()
    count = nodes.groupBy("host", "node").agg(F.count(F.lit(1)).alias("n"), F.first("parent").alias("parent"), F.first("sig").alias("sig"), F.max("times").alias("times"))
    above = count.select("host", F.col("node").alias("parent"), F.col("n").alias("above"))
    whole = each.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("above")).select("host", F.lit(0).cast("long").alias("parent"), "above")
    said = each.select("host", F.explode("blocks").alias("b")).groupBy("host", F.col("b.node").alias("node")).agg((F.min(F.xxhash64("b.text")) != F.max(F.xxhash64("b.text"))).alias("slot"))
    out = count.join(above.union(whole), ["host", "parent"]).join(said, ["host", "node"], "left")
    return out.select("host", "node", "parent", "sig", (F.col("n") < F.col("above")).alias("optional"), (F.col("times") > 1).alias("repeated"), "slot")


def expression(nodes: list) -> str:
    """The regular expression of one host's rows of `infer` (siblings in order of signature): `?` marks an optional
    group, `+` a repeated one, `*` both, `#text` a slot and `"text"` fixed text."""
    kids: dict[int, list] = {}
    for n in sorted(nodes, key=lambda n: (n["sig"], n["node"])):
        kids.setdefault(n["parent"], []).append(n)
    out: list[str] = []
    stack: list = list(reversed(kids.get(0, [])))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        mark = {(True, True): "*", (True, False): "?", (False, True): "+"}.get((n["optional"], n["repeated"]), "")
        text = "" if n["slot"] is None else " #text" if n["slot"] else ' "text"'
        out.append(f" ({n['sig']}{text}")
        stack.append(")" + mark)
        stack += reversed(kids.get(n["node"], []))
    return "".join(out).strip()


TREE = pa.list_(pa.struct([("parent", pa.int32()), ("key", pa.string()), ("kind", pa.int32()), ("flags", pa.int32())]))
TREE_SQL = "array<struct<parent:int,key:string,kind:int,flags:int>>"


def _trees(column: pa.ListArray) -> Iterator[list[tuple]]:
    """The rows of every tree of a column, one tree at a time."""
    for i in range(len(column)):
        rows = column[i].values
        yield list(zip(*(rows.field(k).to_pylist() for k in range(4)))) if rows is not None else []


def _tree_array(trees: list[list[tuple]]) -> pa.Array:
    return pa.array([[dict(zip(("parent", "key", "kind", "flags"), n)) for n in t] for t in trees], TREE)


def skeletons(pages: DataFrame) -> DataFrame:
    """(id, url, html) as (id, url, tree, blocks): the folded tree, and of every block its node, kind and text."""
    kept = pages.select("id", "url").schema
    block = pa.list_(pa.struct([("node", pa.int32()), ("kind", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            trees, blocks = [], []
            for page in part.column("html").to_pylist():
                tree = Skeleton()
                found, _ = parse(page, tree)
                rows, at = tree.done()
                trees.append(rows)
                blocks.append([{"node": n, "kind": k, "text": t} for n, (_, k, t) in zip(at, found)])
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), _tree_array(trees), pa.array(blocks, block)], names=["id", "url", "tree", "blocks"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return pages.select("id", "url", "html").mapInArrow(run, f"{head}, tree {TREE_SQL}, blocks array<struct<node:int,kind:int,text:string>>")


def merged(shapes: DataFrame) -> DataFrame:
    """(host, tree): the wrapper of every host of (host, shape, tree). Rows of a bucket come one by one in order of their
    hash; a round leaves a row a bucket, the last one a row a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, root = None, None
        for batch in batches:
            done = []
            for host, bucket, order, tree in zip(*(batch.column(k).to_pylist() for k in range(3)), _trees(batch.column(3))):
                if now is None or now[:2] != (host, bucket):
                    if now:
                        done.append((now, flat(root)))
                    now, root = (host, bucket, order), grown(tree)
                else:
                    merge(root, grown(tree))
            if done:
                yield _out(done)
        if now:
            yield _out([(now, flat(root))])

    def _out(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0][0] for d in done], pa.string()), pa.array([d[0][2] for d in done], pa.int64()), _tree_array([d[1] for d in done])], names=["host", "turn", "tree"])

    rows = shapes.select("host", F.xxhash64("shape").alias("turn"), "tree")
    while True:
        most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        buckets = -(-most // FAN) or 1
        dealt = rows.select("host", F.pmod("turn", F.lit(buckets)).alias("bucket"), "turn", "tree")
        dealt = dealt.repartition("host", "bucket").sortWithinPartitions("host", "bucket", "turn")
        rows = written(dealt.mapInArrow(run, f"host string, turn bigint, tree {TREE_SQL}"), "wrappers")
        if buckets == 1:
            return rows.select("host", "tree")


def _each_shape(rows: DataFrame, f, column: str, kind: pa.DataType, sql: str) -> DataFrame:
    """(host, shape, tree, other) with f(tree, other) added as `column`; other is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [f(tree, part.column(3)[i]) for i, tree in enumerate(_trees(part.column(2)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(made, kind)], names=["host", "shape", "tree", column])

    return rows.mapInArrow(run, f"host string, shape string, tree {TREE_SQL}, {column} {sql}")


def _places(tree: list[tuple], wrapper: pa.Scalar) -> list[int]:
    rows = wrapper.values
    return matched(tree, list(zip(*(rows.field(k).to_pylist() for k in range(4)))))


def _kept(tree: list[tuple], weights: pa.Scalar) -> dict:
    rows = weights.as_py()
    keep, marked = region([n[:4] for n in tree], [r or 0.0 for r in rows])
    return {"keep": keep, "marked": marked}


def _total(rows: DataFrame, column: str) -> int:
    return rows.agg(F.sum(F.size(column))).first()[0] or 0


def aligned(rows: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(choices, templates) of hosts with FEWEST distinct pages or more in rows (host, content, shape, tree, blocks), None
    without any. choices: (s, places, keep, marked) of every shape s: its nodes' places in the wrapper, whether a node's text
    belongs to the article, and whether a mark says so. templates: (h, fixed), hashes of place and text."""
    pages_of = rows.select("host", "content").distinct().groupBy(F.col("host").alias("o")).agg(F.count(F.lit(1)).alias("pages"))
    pages_of = written(pages_of.filter(F.col("pages") >= FEWEST), "hosts")
    n_hosts = pages_of.count()
    if not n_hosts:
        return None
    some = looked_up(rows, pages_of, n_hosts, F.col("host"), "o", "left_semi")
    shapes = written(some.groupBy("host", "shape").agg(F.first("tree").alias("tree")), "shapes")
    wrapper = merged(shapes).select(F.col("host").alias("o"), F.col("tree").alias("wrapper"))
    with_wrapper = looked_up(shapes, wrapper, _total(wrapper, "wrapper"), F.col("host"), "o", "left").select("host", "shape", "tree", "wrapper")
    placed = written(_each_shape(with_wrapper, _places, "places", pa.list_(pa.int32()), "array<int>"), "places")
    n_places = _total(placed, "places")

    at = looked_up(some.select("host", "content", "shape", "blocks"), placed.select(F.col("shape").alias("s"), "places"), n_places, F.col("shape"), "s", "left")
    block = F.explode(F.expr("transform(blocks, b -> struct(places[b.node] as place, xxhash64(places[b.node], b.text) as key, length(b.text) as chars))"))
    texts = written(at.select("host", "content", block.alias("b")).select("host", "content", "b.*").distinct(), "texts")
    seen = texts.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FEWEST)
    fixed = seen.join(pages_of, F.col("host") == F.col("o")).filter(F.col("n") >= NEARLY_ALL * F.col("pages"))
    fixed = written(fixed.groupBy(F.col("host").alias("h")).agg(F.collect_set("key").alias("fixed")), "templates")  # a page's blocks / NEARLY_ALL at most
    slots = looked_up(texts, fixed, _total(fixed, "fixed"), F.col("host"), "h", "left").filter("place >= 0 and not array_contains(coalesce(fixed, array()), key)")
    weight = slots.groupBy("host", "place", "content").agg(F.sum("chars").alias("chars")).groupBy("host", "place").agg(F.avg("chars").alias("weight"))
    by_host = written(weight.groupBy(F.col("host").alias("o")).agg(F.map_from_entries(F.collect_list(F.struct("place", "weight"))).alias("weight")), "weights")  # a wrapper's places at most
    weighed = looked_up(placed, by_host, _total(by_host, "weight"), F.col("host"), "o", "left")
    weighed = weighed.select("host", "shape", "tree", F.expr("transform(places, p -> weight[p])").alias("weights"))
    weighed = weighed.withColumn("weights", F.coalesce("weights", F.expr("transform(tree, n -> cast(0 as double))")))
    chosen = _each_shape(weighed, _kept, "chosen", pa.struct([("keep", pa.list_(pa.bool_())), ("marked", pa.bool_())]), "struct<keep:array<boolean>,marked:boolean>")
    chosen = written(chosen.select("shape", "chosen.*"), "regions").join(placed.select("shape", "places"), "shape")
    return written(chosen.select(F.col("shape").alias("s"), "places", "keep", "marked"), "choices"), fixed


def extracted(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row of pages.

    A null or empty page has an empty text. Pages without a host share one wrapper. Copies of a page count once in what
    its host says; a page of which only the template's text would be left keeps that. Repeated ids and rows stay;
    other columns are ignored. An empty table gives an empty result.
    """
    rows = skeletons(pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(page).alias("html")))
    shape = F.concat_ws(" ", "host", F.hex(F.xxhash64("tree")), F.hex(F.hash("tree")))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumns({"content": F.xxhash64(F.expr("transform(blocks, b -> b.text)")), "shape": shape})
    rows = written(rows, "pages")
    marks = F.expr(f"filter(blocks, b -> b.kind = if(exists(blocks, c -> c.kind = {ARTICLE}), {ARTICLE}, {OTHER}))")
    found = aligned(rows)
    if found is None:
        joined = rows.withColumn("kept", marks)
    else:
        choices, fixed = found
        joined = looked_up(rows.drop("tree"), choices, 2 * _total(choices, "places"), F.col("shape"), "s", "left")
        joined = looked_up(joined, fixed, _total(fixed, "fixed"), F.col("host"), "h", "left")
        slots = F.expr("filter(group, b -> marked or not array_contains(coalesce(fixed, array()), xxhash64(places[b.node], b.text)))")
        joined = joined.withColumn("group", F.expr("filter(blocks, b -> keep[b.node])")).withColumn("slots", slots)
        joined = joined.withColumn("kept", F.when(F.col("keep").isNull(), marks).when(F.size("slots") > 0, F.col("slots")).otherwise(F.col("group")))
    text = F.array_join(F.transform("kept", lambda b: b["text"]), "\n")
    return joined.select(F.col("id").alias(id_col), F.col("url").alias(url), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op4_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
