"""Pages as token streams, against the library's parser."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from lurewatch.operators import markup

rng = random.Random(21)


class Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out = []

    def handle_starttag(self, tag, attrs):
        self.out.append((tag, False, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.out.append((tag, True, {}))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if self.out and isinstance(self.out[-1], str):
            self.out[-1] += data
        else:
            self.out.append(data)


def read(page):
    r = Reader()
    r.feed(page or "")
    r.close()
    return r.out


def mine(page):
    out = []
    for tag, ends, attrs, text in markup.tokens(page):
        if tag is not None:
            out.append((tag, ends, attrs))
        elif out and isinstance(out[-1], str):
            out[-1] += text
        else:
            out.append(text)
    return out


def page():
    value = lambda: rng.choice(["a", "x>y", "it's", "b c", "&amp;&lt;", "", "é", "http://e.in/p?q=1&r=2"])

    def attribute():
        v = value()
        quote = "'" if '"' in v else '"' if "'" in v or rng.random() < 0.7 else "'"
        plain = v if v and not set(v) & set(" >'\"=/&") else "v"
        return rng.choice([f' {rng.choice(["href", "Class", "type", "data-x"])}={quote}{v}{quote}', f" checked id={plain}", f" STYLE = {quote}{v}{quote}"])

    def element(depth):
        tag = rng.choice(["div", "p", "A", "form", "input", "br", "table", "template", "h1"])
        inner = "".join(part(depth + 1) for _ in range(rng.randrange(4))) if depth < 4 else ""
        return f"<{tag}{''.join(attribute() for _ in range(rng.randrange(3)))}{rng.choice(['', ' ', '/', ' /'])}>{inner}</{tag}{rng.choice(['', ' '])}>"

    def part(depth):
        return rng.choice([lambda: element(depth), lambda: rng.choice(["text ", "1 < 2 ", "&copy; &nbsp;x", "a & b", "\n"]), lambda: f"<!-- {value()} <p> -->", lambda: f"<script{attribute()}>if (a < b) '<p>' </scrip </script>", lambda: "<style>p > a {}</style>", lambda: "<!DOCTYPE html>", lambda: "<?php x ?>"])()

    return "".join(part(0) for _ in range(rng.randrange(8)))


def test_tokens_are_those_of_the_library(spark, sf):
    for html in [page() for _ in range(3000)]:
        assert mine(html) == read(html), html
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()
    assert len(rows) > 100 and all(mine(r.html) == read(r.html) for r in rows)


def test_broken_and_long_pages_end_in_time():
    for html in ("<", "<a", "<a href='", "</", "</p", "<!--", "<!-- x", "<script>x", "a<b", "<p x=\"1", "<![CDATA[x]]>", "<p " + "a=\"b\" " * 100_000 + ">t", "<div>" * 100_000, "<" * 300_000, "<!--" * 50_000, "<a href=\"" * 50_000):
        list(markup.tokens(html))
    assert mine("<p a=1 A=2>x") == [("p", False, {"a": "2"}), "x"]


def test_columns_by_fold(spark):
    pages = [
        (1, '<form action="http://evil.in/x"><div><input TYPE=password></div></form><input type="password">', "me.in"),
        (2, '<form action="https://www.me.in/x"></form><input type="password"><a title="<form>">x</a><!-- <form> -->', "www.me.in"),
        (3, '<form data-x="a > b" action="/in"><form><input type=password>', "me.in"),
        (4, '<title>My SBI <b>Bank</b></title><title>x</title>a<script src="http://cdn.in/a">var copyright</script><template>t</template><style>s</style>&lt;b', "me.in"),
        (5, '<p style="Color:red; DISPLAY:NONE">x</p><img src="http://me.in/a"><img src="//b"><script src="https://x.in"></script><link rel="Shortcut ICON" href="x">Copyright', "me.in"),
        (6, None, "me.in"),
        (7, "", None),
    ]
    t, d, h = F.col("tokens"), F.col("domain"), F.col("html")
    df = markup.parsed(spark.createDataFrame(pages, "k int, html string, domain string"))
    cols = {**markup.forms(t, d), **markup.counts(t), **markup.flags(t, h), "ratio": F.round(markup.external_ratio(t, d), 6), "text": markup.text(t), "title": markup.title(t)}
    got = {r.k: r for r in df.select("k", *(c.alias(n) for n, c in cols.items())).collect()}
    assert [(got[k].has_password_field, got[k].form_action_external, got[k].num_forms) for k in range(1, 8)] == [(True, True, 1), (False, False, 1), (True, False, 2), (False, False, 0), (False, False, 0), (False, False, 0), (False, False, 0)]
    assert got[4].title == "My SBI Bank" and got[4].title_has_brand and got[4].text == "My SBI Bankxa<b" and not got[4].has_copyright and got[4].ratio == 1.0
    assert (got[5].hidden_element_count, got[5].has_favicon, got[5].has_copyright, got[5].ratio) == (1, True, True, 0.333333)
    assert got[6].text == got[7].text == got[6].title == "" and got[6].ratio == 0.0


def test_references_without_an_end(spark, tmp_path):
    """A title cut within a reference keeps what is left of it (page_counts); a browser's reading does not."""
    from lurewatch.plans import registry

    pages = [(1, "<title>a &amp;&lt; b&amp</title><a href='x'>y</a>"), (2, "<title> &amp;lt; &lt &#39;&nbsp;</title>"), (3, None)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.title, r.links) for r in registry.QUERIES["page_counts"](spark, str(tmp_path)).collect()}
    assert got == {1: ("a &< b&amp", 1), 2: ("&lt; &lt '\u00a0", 0), 3: ("", 0)}
    assert {r.k: r.t for r in markup.parsed(df).select(F.col("page_id").alias("k"), markup.title(F.col("tokens")).alias("t")).collect()} == {1: "a &< b&", 2: " &lt; < '\u00a0", 3: ""}


def test_slices_and_tasks(spark, monkeypatch):
    """A batch becomes tokens slice by slice, and pages made of a small table are many tasks."""
    pages = [(i, "" if i % 7 == 0 else None if i % 5 == 0 else f"<p a=1 b='x&amp;{i}'>t{i}<br>u" * (i % 4)) for i in range(60)]
    held = []
    whole = markup._streams
    monkeypatch.setattr(markup, "SLICE", 50)
    monkeypatch.setattr(markup, "_streams", lambda some, decode: held.append(sum(len(p or "") for p in some[:-1])) or whole(some, decode))
    want = [[{"tag": t, "ends": e, "attrs": list(a.items()), "text": x} for t, e, a, x in markup.tokens(p)] for _, p in pages]
    parts = [markup._streams([p], markup.unescape).to_pylist() for _, p in pages]
    assert [x for (x,) in parts] == want and max(held) < 50
    rows = markup.parsed(spark.createDataFrame(pages, "k int, html string").coalesce(1)).collect()
    assert [[(t.tag, t.ends, t.attrs, t.text) for t in r.tokens] for r in rows] == [list(markup.tokens(p)) for _, p in pages]


def test_small_tables_are_many_tasks(spark, sf):
    from lurewatch.plans import decision_queries

    assert decision_queries.html_tokens(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
