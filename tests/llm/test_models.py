"""Operators that learn, page extraction, and the pipeline."""

import collections
import math
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lurewatch.llm import common, langid, passages, pitman_yor, quality, rules, simhash, tokens, wrappers

rng = random.Random(5)
EMPTY = "doc_id long, text string, lang string, score string"


# ---- Pitman-Yor ----


def test_gibbs_has_the_law_of_all_seatings():
    """Tables of one word: every set partition of its customers, with weight a ** tables and (1 - d)...(n - 1 - d) a table."""

    def partitions(n):
        if not n:
            yield []
            return
        for rest in partitions(n - 1):
            for i in range(len(rest)):
                yield [*rest[:i], rest[i] + 1, *rest[i + 1 :]]
            yield [*rest, 1]

    own = np.random.default_rng(6)
    for c, a, d in ((2, 0.7, 0.5), (4, 0.7, 0.5), (6, 2.0, 0.3), (7, 0.4, 0.8)):
        law = collections.Counter()
        for sizes in partitions(c):
            law[len(sizes)] += a ** len(sizes) * math.prod(math.prod(k - d for k in range(1, n)) for n in sizes)
        n, m = sum(law.values()), 20_000
        size, t = pitman_yor.first_seating(np.full(m, c), np.full(m, a), d, own)
        for _ in range(10):
            size, t = pitman_yor.gibbs(size, t, np.full(m, a), d, own)
        assert all(abs((t == k).mean() - law[k] / n) < 0.015 for k in range(1, c + 1))


def test_seating_keeps_customers_and_repeats():
    c = np.array([rng.choice([1, 2, 3, 30, 5000, 10**6]) for _ in range(300)])
    a = np.array([rng.choice([0.0, 1e-6, 0.5, 40.0]) for _ in c])
    both = []
    for _ in range(2):
        own = np.random.default_rng(3)
        size, t = pitman_yor.first_seating(c, a, 0.6, own)
        for _ in range(2):
            size, t = pitman_yor.gibbs(size, t, a, 0.6, own)
        ends = np.cumsum(t)
        assert (size > 0).all() and ends[-1] == len(size) and (np.add.reduceat(size, ends - t) == c).all()
        both.append((size.tolist(), t.tolist()))
    assert both[0] == both[1]
    assert [x.tolist() for x in pitman_yor.gibbs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0.5, own)] == [[], []]


PAGES = """
import resource
import numpy as np
from lurewatch.llm import common, pitman_yor

def step(n):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for _ in range(n):
        np.ones(3 << 17) + 1.0
    return resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before

def rss():
    return int(open("/proc/self/statm").read().split()[1]) * resource.getpagesize()

common._give_back_memory()
size, each = rss(), step(50)
print(each, common.keeping_memory(step)(50), (rss() - size) >> 20, pitman_yor._sampled(None, None, 0, 0, 0).__wrapped__ is not None)
"""


def test_steps_reuse_the_pages_of_their_arrays():
    """A step maps its memory once, not once an array, and gives it back."""
    out = subprocess.run([sys.executable, "-c", PAGES], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split()
    assert int(out[1]) < 5_000 < 20_000 < int(out[0]) and int(out[2]) < 10


def test_pairs_are_sorted_as_one_number_or_two():
    own = np.random.default_rng(8)
    w, u, by = (own.integers(0, n, 5000) for n in (40, 70, 3))
    for far in (0, 1 << 40):  # with so many bits the three are sorted one after another
        order, new = pitman_yor._sorted_pairs(w, u, by + far)
        rows = list(zip((by + far)[order].tolist(), w[order].tolist(), u[order].tolist()))
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(5000))
        order, new = pitman_yor._sorted_pairs(w + far, u + far)
        rows = list(zip(w[order].tolist(), u[order].tolist()))
        assert rows == sorted(rows) and new.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(5000)]
    assert [len(x) for x in pitman_yor._sorted_pairs(w[:0], u[:0])] == [0, 0]
    values, rank = pitman_yor._ranks(w)
    assert values.tolist() == sorted(set(w.tolist())) and (values[rank] == w).all()


@pytest.mark.parametrize("bucket", [2_000_000, 60])
def test_probabilities_sum_to_one(spark, monkeypatch, bucket):
    monkeypatch.setattr(pitman_yor, "BUCKET", bucket)  # 60: nearly all words are split
    monkeypatch.setattr(pitman_yor, "SAMPLE", 1)
    texts = ["the cat sat. The dog, 9 ran", "a b a b a b", None, "", "é x! y the the the"] * 9
    rows = spark.createDataFrame([(t, i % 5 != 1 or i < 20) for i, t in enumerate(texts)], "__t string, __learn boolean")
    model, final = pitman_yor.seated(rows, rounds=1, sweeps=2)
    assert bool(len(model.hot)) == (bucket == 60)
    held = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in final.collect():
        held[r.bucket][r.kind].append((r.at, r.data))
    now, theta = model.samples[0], model.theta[0]
    known, root, context = collections.defaultdict(dict), {}, {}
    for kinds in held.values():
        pairs = pitman_yor.Bucket(kinds[pitman_yor.PAIRS][0][1], model)
        p = pairs.probabilities(kinds[pitman_yor.STATE], kinds[pitman_yor.REPLY], model)
        t, size, r = pitman_yor._unpack(kinds[pitman_yor.STATE][0][1], np.int64, np.int64, np.int64)
        tables = pairs.tables(t)
        assert ((tables <= pairs.c) & ((tables > 0) == (pairs.c > 0))).all() and size.sum() == pairs.c[pairs.live].sum()
        c_u, T_u = pairs.replies(kinds[pitman_yor.REPLY])
        for u, a, b in zip(pairs.U, c_u, T_u):
            assert context.setdefault(u, (a, b)) == (a, b)
        for w, q in zip(pairs.W, model.root(*pairs.dishes(tables, r, now, model), now)):
            assert abs(root.setdefault(w, q) - q) < 1e-12
        for w, u, q in zip(pairs.W[pairs.word], pairs.U[pairs.ctx], p):
            known[u][w] = q
    unknown = float(model.root(np.zeros(1), np.zeros(1), now)[0])
    assert abs(sum(root.values()) + unknown - 1) < 1e-9 and len(root) == model.V
    for u, (c, t) in context.items():
        back = (theta + model.d * t) / (theta + c) if c else 1.0
        assert abs(sum(known[u].get(w, back * q) for w, q in root.items()) + back * unknown - 1) < 1e-9


@pytest.mark.parametrize("bucket", [2_000_000, 300])
def test_scores(spark, monkeypatch, bucket):
    monkeypatch.setattr(pitman_yor, "BUCKET", bucket)  # 300: several buckets and split words
    monkeypatch.setattr(pitman_yor, "SAMPLE", 1)
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 300)
    vocab = [f"v{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(vocab[: 3 + i % 30]) for _ in range(rng.randrange(40)))) for i in range(60)] + [(i, "hot " * 60) for i in range(60, 66)] + [(None, "v1 zzz"), (7, None), (7, "V1 v2")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    learn = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    got, model = pitman_yor.score_texts(df, learn, ("doc_id",))
    got = got.collect()
    count = collections.Counter()
    for i, t in rows:
        if i is None or i % 3:
            count.update([*(t or "").lower().split(), None])
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for i, t in rows:
        tok = [*(t or "").lower().split(), None]
        want[(i, len(tok), sum(x in count for x in tok), round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tok), 6))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert model.N == n and model.V == v and all(r.score < 0 for r in got)
    assert bool(len(model.hot)) == (bucket == 300)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)


def test_order_of_words_counts(spark):
    """What follows a word is learnt: a held-out text in the learnt order is likelier than one of the same words in another."""
    cycle = [f"c{i}" for i in range(30)]
    run = lambda k, n: " ".join(cycle[(k + j) % 30] for j in range(n))
    mixed = run(3, 40).split()
    random.Random(1).shuffle(mixed)
    rows = [(i, run(i, 50)) for i in range(40)] + [(100, run(3, 40)), (101, " ".join(mixed))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, _ = pitman_yor.score_texts(df, F.col("doc_id") < 100, ("doc_id",))
    score = {r.doc_id: r.score for r in got.collect()}
    assert score[100] > score[101] / 3


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    got, model = pitman_yor.score_texts(df, F.lit(False), ("doc_id",))
    assert (model.N, got.first().n_known) == (0, 0)
    empty, _ = pitman_yor.score_texts(df.limit(0), F.lit(True), ("doc_id",))
    assert empty.count() == 0


# ---- classifiers ----


def test_quality(spark):
    good = [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(rng.choice("alpha### beta$$$ %%% BUY!!".split()) for _ in range(60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(None, "x"), (None, None), (3, ""), (4, good[4])]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210)] + [(None, 1), (5, None)], "doc_id long, quality int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = quality.scored(docs, quality.train(docs, labels, ~held)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    test = [(r.predicted, int(r.doc_id < 150)) for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(a == b for a, b in test) >= 0.9 * len(test)
    none = quality.train(docs, labels.limit(0), ~held)
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    assert quality.scored(docs.limit(0), none).count() == 0


def test_languages(spark):
    words = {"en": "the and of that with from".split(), "de": "und der die nicht über für".split(), "fr": "le la être où déjà avec".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(["en", "de", "fr"] * 60)]
    rows += [(None, "the and", "en"), (900, None, "en"), (901, "123 !!", "de"), (902, "the", None), (902, "the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    got = langid.predicted(docs, langid.train(docs, ~held)).collect()
    assert len(got) == len(rows)
    right = [r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 180]
    assert sum(right) >= 0.97 * len(right)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.predicted(docs, langid.train(docs, F.lit(False))).collect()} == {"und"}


# ---- wrappers ----

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav class="menu"><ul><li>a</li><li>b</li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="content"><h1>Title %d</h1><p>First &amp; <b>bold</b> %d<p>Second   line %d</p>%s<div class="comments"><p>Reader says %d</p></div></div>
<aside>More</aside><form><input><button>Go</button></form><footer>&copy; x</footer><script>var a = "<p>no</p>";</script></body></html>"""


def test_wrappers(spark):
    rows = []
    for i in range(12):
        extra = f"<blockquote>Quote {i}</blockquote>" if i % 3 == 0 else "<p>Third</p>" * (i % 4)
        rows.append((i, f"http://h.example/{i}", PAGE % (i, i, i, extra, i)))
    rows += [(50, "http://other.example/", "<article><header><h1>A</h1></header><p>B<br>C</p><ul><li>x<li>y</ul></article><div>tail</div>"), (51, None, None), (52, "", ""), (53, "x", "just text"), (None, "http://h.example/z", PAGE % (9, 9, 9, "", 9)), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    got = collections.defaultdict(list)
    for r in wrappers.extracted(df).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert got[0] == ["Title 0\nFirst & bold 0\nSecond line 0\nQuote 0"] * 2
    assert got[2] == ["Title 2\nFirst & bold 2\nSecond line 2\nThird\nThird"]
    assert got[50] == ["A\nB C\nx\ny"] and got[51] == [""] and got[52] == [""] and got[53] == ["just text"]
    assert len(got[None]) == 1
    assert wrappers.extracted(df.limit(0)).count() == 0


def wrapped(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(wrappers.extracted(df).collect(), key=lambda r: r.page_id)]


def test_every_template_of_a_host_keeps_its_text(spark):
    makes = [lambda i: f"<body><main><article><p>Alpha {i} {'long ' * 40}</p></article></main></body>", lambda i: f"<body><div><article><p>Beta {i}</p></article></div></body>", lambda i: f"<body><nav>menu</nav><div><h1>Gamma {i}</h1></div><div><p>body {i} {'text ' * 30}</p></div><div><p>Owner</p></div></body>", lambda i: f"<body><article class='a'><p>One {i}</p></article><article class='b'><p>Two {i}</p></article></body>"]
    for url in ("http://two.example/{}", None):
        pages = [(url and url.format(i), makes[i % 4](i)) for i in range(16)]
        for i, text in enumerate(wrapped(spark, pages)):
            want = [[f"Alpha {i} {'long ' * 40}".strip()], [f"Beta {i}"], [f"Gamma {i}", f"body {i} {'text ' * 30}".strip(), "Owner"], [f"One {i}", f"Two {i}"]]
            assert text.split("\n") == want[i % 4]


def test_copies_and_rare_slots_are_no_template(spark):
    copies = [(f"http://c.example/{k}", f"<body><div><h1>Head</h1><p>Text of {k // 4} {'more ' * 9}</p></div></body>") for k in range(4)]
    assert all(t.split("\n")[0] == "Head" for t in wrapped(spark, copies))
    rare = [(f"http://r.example/{k}", f"<body><div><p>Page {k} {'more ' * 9}</p>{'<pre>same code</pre>' if k < 3 else ''}</div><div class='x'>Owner</div></body>") for k in range(40)]
    got = wrapped(spark, rare)
    assert all(("same code" in t) == (k < 3) for k, t in enumerate(got)) and not any("Owner" in t for t in got)
    cells = [(f"http://t.example/{k}", f"<body><div><p>Page {k} {'more ' * 9}</p>{'<table><tr><td>Yes<td>Yes<td>Yes</table>' if not k else ''}</div></body>") for k in range(5)]
    assert wrapped(spark, cells)[0].count("Yes") == 3
    article = [(f"http://a.example/{k}", f"<body><article><h1>Daily</h1><p>Page {k} {'more ' * 9}</p></article></body>") for k in range(5)]
    assert all(t.startswith("Daily\n") for t in wrapped(spark, article))


def plain(i, body, menu="Home Shop Blog", tail="All rights reserved"):
    """A page without article and without a telling class name."""
    return f"<html><body><div class='a1'><div>{menu}</div><ul><li>News</li><li>Help</li></ul></div><div class='b2'><h1>Title {i}</h1>{body}</div><div class='c3'><p>{tail}</p></div></body></html>"


def test_the_wrapper_decides_where_no_tag_or_class_tells(spark, monkeypatch):
    pages = [(f"http://w.example/{k}", plain(k, "".join(f"<p>Text {k} {j}</p>" for j in range(1 + k % 4)))) for k in range(12)]
    want = ["\n".join([f"Title {k}", *(f"Text {k} {j}" for j in range(1 + k % 4))]) for k in range(12)]
    assert wrapped(spark, pages) == want
    # every page twice over, and on a second host with one page alone nothing is known of a template
    assert wrapped(spark, pages * 2) == want * 2
    assert "Home Shop Blog" in wrapped(spark, [("http://single.example/", pages[0][1])])[0]
    monkeypatch.setattr(wrappers, "FEWEST", 10**9)  # the wrapper off
    assert all("Home Shop Blog" in t and "All rights reserved" in t for t in wrapped(spark, pages))


def test_template_join_without_broadcast(spark, monkeypatch):
    from lurewatch.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    pages = [(f"http://w.example/{k}", plain(k, f"<p>Text {k}</p>")) for k in range(8)] + [(None, None), ("http://x.example/", "<article>A</article>")]
    assert wrapped(spark, pages) == [f"Title {k}\nText {k}" for k in range(8)] + ["", "A"]


def test_only_the_template_left(spark):
    pages = [(f"http://p.example/{k}", "<body><div>Gone</div></body>" + "<p></p>" * k) for k in range(6)] + [(f"http://p.example/x{k}", f"<body><div>Gone</div><p>{k}</p></body>") for k in range(6)]
    assert wrapped(spark, pages) == ["Gone"] * 6 + [str(k) for k in range(6)]


def test_inferred_expression(spark):
    pages = ["<body><h1>A</h1><p>x</p><p>y</p><div>Owner</div></body>", "<body><h1>B</h1><p>z</p><div>Owner</div></body>", "<body><h1>C</h1><ul><li>1<li>2</ul><div>Owner</div></body>"]
    df = spark.createDataFrame([(f"http://e.example/{i}", h) for i, h in enumerate(pages * 2)], "url string, html string")
    assert wrappers.expression(wrappers.infer(df).collect()) == '(body (div "text")? (div "text")? (h1 #text) (p #text)* (ul (li #text)+)?)'
    assert wrappers.infer(df.limit(0)).count() == 0


def test_repeats_fold():
    blocks, nodes = wrappers.parse("<div><h2>1</h2><p>a<p>b<h2>2</h2><p>c</div>")
    places = [n for n, _, _ in blocks]
    assert places[1] == places[2] == places[4] and [t for _, _, t in blocks] == ["1", "a", "b", "2", "c"]
    assert [(n[2], n[3]) for n in nodes] == [("div", 1), ("h2", 1), ("p", 3), ("h2", 1)]


@pytest.mark.parametrize("page,text", [("<div>" * 100_000 + "deep", "deep"), ("<a " * 300_000, None), ("<!" * 300_000, None), ("<" * 300_000, None), ("</div>" * 200_000 + "x", "x"), ("<b><i>" * 100_000 + "y", "y"), ('<a ="\'>' * 100_000 + "z", None), ('<p ="><p ="' * 100_000 + ">z", None), ("<p class=" + "a" * 1_000_000 + ">w", "w"), ("<p " + "a" * 1_000_000 + ">w", "w"), ("".join(f"<x{k}><div class=u{k}>v</div>" for k in range(30_000)), "\n".join(["v"] * 30_000)), ("<p>" + "word " * 2_000_000, ("word " * 2_000_000).strip()), ("<script>" * 1000 + "lost", ""), ("<!-- open", ""), ("a < b <3 c", "a < b <3 c"), ("<div><p>x</b></div></div></p>y", "x\ny")])
def test_deep_long_and_broken_pages(page, text):
    import time

    began = time.time()
    blocks, _ = wrappers.parse(page)
    assert time.time() - began < 10
    assert text is None or "\n".join(t for _, _, t in blocks) == text


# ---- pipeline ----


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    vocab = [f"word{i}" for i in range(900)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, item = prose(120), prose(30)
    texts = {i: prose(150) for i in range(30)}
    texts |= {100: texts[0], 101: texts[0], 200: prose(20), 201: None, 202: "a b c " * 100, 300: prose(60) + " " + shared + " " + prose(60), 301: prose(70) + " " + shared + " " + prose(50), 400: prose(80) + " " + item + " " + prose(80)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(30), 300, 301}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    for i in range(30):
        assert got[i].ids == t.encode(texts[i], add_special_tokens=False).ids
    a, b = texts[300].encode(), texts[301].encode()
    start, end = a.index(shared.encode()), a.index(shared.encode()) + len(shared.encode())
    while a[start - 1 : start] == b[b.index(a[start:end]) - 1 : b.index(a[start:end])]:
        start -= 1
    while b.find(a[start : end + 1]) >= 0:
        end += 1
    assert got[300].ids == t.encode((a[:start] + a[end:]).decode(), add_special_tokens=False).ids
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
