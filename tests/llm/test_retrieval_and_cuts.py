"""Fill-in-middle, toxicity and ranked search, against brute force, SQL and held-out rows."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, views
from pyspark.sql import functions as F

from lurewatch.llm import middle, queries, ranked, toxicity

rng = random.Random(17)
LETTERS = "abcdeé漢😀 \n"
TEXTS = [None, "", " ", "x", "<P>", "a <M> b", "é", "漢字", "<<S<", "😀" * 700, "word " * 9000, "A" + "é" * 513, *("".join(rng.choice(LETTERS) for _ in range(rng.randrange(900))) for _ in range(120))]
ROWS = [(i, t, "clash", 1, 2.0, "r") for i, t in enumerate(TEXTS)] + [(5, "same same", "clash", 1, 2.0, "r"), (5, "same same", "clash", 1, 2.0, "r"), (None, "abc def", None, None, None, None), (None, None, None, None, None, None)]
SCHEMA = "doc_id long, text string, output string, `in0` int, Score double, `row` string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(name, spark, sf):
    assert compare(spark, views(duckdb.connect(), sf), sf, queries.QUERIES[name], queries.ORACLES[name]) == ""


# ---- fill in middle ----


@pytest.mark.parametrize("density", [0.0, 0.02, 0.5, 1.0])
def test_rank_and_select(density):
    for n in (1, 63, 64, 511, 512, 513, 5000):
        bits = np.random.default_rng(n).random(n) < density
        marks = middle.Marks(bits)
        upto = np.concatenate([[0], np.cumsum(bits)])
        assert (marks.rank(np.arange(n + 1)) == upto).all()
        assert (marks.select(np.arange(upto[-1])) == np.flatnonzero(bits)).all()


def cut(doc_id, text, plain=10, spm=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    if not text or any(s in text for s in middle.SENTINELS) or c % 100 >= 100 - plain:
        return n, "plain", None, None, text
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    out = f"<S>{s}<P>{p}<M>{m}" if d % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if d % 100 < spm else "psm", lo, hi - lo, out


def test_middle_against_slices_and_back(docs):
    made = middle.fill_in_middle(docs)
    assert made.columns == ["doc_id", "in0", "Score", "row", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    want = collections.Counter((i, *cut(i, t), t or "") for i, t, *_ in ROWS)
    assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_middle_of_nothing_and_of_other_shares(spark, docs):
    assert middle.fill_in_middle(docs.limit(0)).collect() == []
    assert {r.form for r in middle.fill_in_middle(docs, plain=100).collect()} == {"plain"}
    kinds = {r.form for r in middle.fill_in_middle(docs.filter("length(text) > 6 and not text like '%<%'"), plain=0, spm=100).collect()}
    assert kinds == {"spm"}


# ---- ranked search ----


def brute(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, collections.Counter(split(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = collections.Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(split(text)) if c[w])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return collections.Counter(out)


@pytest.mark.parametrize("block,cells", [(1000, 2_000_000), (2, 40)])
def test_search_against_all_pairs(spark, monkeypatch, block, cells):
    monkeypatch.setattr(ranked, "CELLS", cells)
    words = [f"w{int(1.25 ** i)}" for i in range(40)] + ["É", "naïve", "ABC9", "abcdefgh12345678x", "abcdefgh12345678y"]
    draw = lambda n: " ".join(rng.choice(words[: rng.randrange(2, len(words) + 1)]) for _ in range(n))
    rows = [(i, draw(rng.randrange(1, 60))) for i in range(400)] + [(i, "w1 w2 abc9") for i in range(500, 520)] + [(7, "w1 w2"), (None, "w1 É"), (None, None), (900, ""), (901, "-- !"), (902, draw(6000))]
    items = [(f"q{i}", draw(rng.randrange(1, 9))) for i in range(5)] + [("same", "w1"), ("all", " ".join(words)), ("none", "zz yy"), ("empty", ""), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item": F.lit("x"), "n": F.lit(1), "id": F.lit(2)}).repartition(5)
    q = spark.createDataFrame(items, "item_id string, text string").withColumn("term", F.lit(1)).coalesce(1)
    got = ranked.search(d, q, k=7, block=block)
    assert dict(got.dtypes) == {"item_id": "string", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert collections.Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == brute(rows, items, 7)


def test_search_prunes_and_empty_tables(spark):
    rows = [(i, "common " + ("rare " if i < 9 else "") + f"own{i} " * (i % 7)) for i in range(300)]
    d, q = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "common rare")], "item_id long, text string")
    block = ranked.Block.of(["common rare"])
    block.n_docs, block.n_terms = 300, 2000
    order = np.argsort([h != ranked.Block.of(["rare"]).hashes[0] for h in block.hashes])
    df, most, kth = np.zeros((3, 2), np.int64)
    df[order], most[order], kth[order] = [9, 300], [10**9, 10], [10**8, 5]
    block.seed(df, most, kth)
    assert block.essential.sum() == 1 and block.hashes[block.term[block.essential]] == ranked.Block.of(["rare"]).hashes and block.rest.tolist() == [10]
    assert collections.Counter(tuple(r) for r in ranked.search(d, q, k=5).collect()) == brute(rows, [(1, "common rare")], 5)
    assert ranked.search(d.limit(0), q).collect() == ranked.search(d, q.limit(0)).collect() == []


# ---- toxicity ----


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distances():
    terms = [("scum", False, 1.0), ("idiot", False, 1.0), ("idioti", False, 1.0), ("worthless", False, 1.0), ("pathetics", False, 1.0), ("vequ", True, 1.0), ("réeux", True, 1.0), ("ab", False, 1.0)]
    lexicon = toxicity.Lexicon(terms)
    words = ["", "idiot", "id1ot", "idot", "idiiot", "worthles", "w0rthl3ss", "vequ", "vequance", "vequx", "réeuxment", "reeux", "scam", "abc", "漢字"]
    for t, *_ in terms:
        for _ in range(80):
            w = list(t)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice(["", "x", "é", "i"])
            words.append("".join(w))
    words = [w for w in words if w]
    code, _, starts, ends, _ = toxicity.split(pa.array([" ".join(words)]))
    assert toxicity._words(code, starts, ends) == words
    hit, _, edit = lexicon.match(code, starts, ends)
    want = {}
    for i, w in enumerate(words):
        near = [0 for t, stem, _ in terms if stem and w.startswith(t)] + [d for t, stem, _ in terms if (d := distance(w, t)) <= toxicity.edits(t, stem)]
        if near:
            want[i] = min(near)
    assert dict(zip(hit.tolist(), edit.tolist())) == want
    lexicon.clear()
    assert dict(zip(*(x.tolist() for x in lexicon.match(code, starts, ends)[::2]))) == want


def test_words_of_texts():
    texts = ["Sh*t, 1d!ot!! a*", "b é-c", None, "", "x", "*y* z"]
    code, offsets, starts, ends, first = toxicity.split(pa.array(texts))
    found = [toxicity._words(code, starts[a:b], ends[a:b]) for a, b in zip(first, first[1:])]
    assert found == [["sh*t", "1d!ot", "a"], ["b", "é", "c"], [], [], ["x"], ["y", "z"]]


def test_quotation_counts_apart_from_abuse():
    lexicon = toxicity.Lexicon([("idiot", False, 3.0)])
    x, hits = toxicity.features(pa.array(["you are an idiot", "he wrote the word idiot in his report", 'the sign "no idiot here" was taken down', "nothing here", None, "an idi0t stood there"]), lexicon, frozenset())
    assert hits["row"].tolist() == [0, 1, 2, 5] and hits["quoted"].tolist() == [False, True, True, False]
    assert x[0, 0] > x[5, 0] > 0 == x[1, 0] == x[2, 0] == x[3, 0] and x[4].tolist() == [0, 0, 0] and x[1, 1] > 0
    _, hits = toxicity.features(pa.array(["an idi0t stood there"]), lexicon, frozenset(["idi0t"]))
    assert not len(hits["row"])


@pytest.fixture(scope="module")
def marked(spark):
    plain = ["river", "stone", "garden", "light", "window", "paper", "market", "winter", "letter", "bridge"] + [f"noun{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["grumbol", "snarvik", "plotterish"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learned_terms_catch_misspellings_and_leave_clean_texts(spark, marked):
    docs, labels = marked
    model = toxicity.train(docs, labels, F.col("doc_id") < 450)
    assert {t[:4] for t, *_ in model[0]} == {"grum", "snar", "plot"}
    out = toxicity.scored(docs.filter("doc_id >= 450"), model).collect()
    assert {r.doc_id for r in out if r.predicted} == {i for i in range(450, 600) if i % 5 == 0}
    assert all(bool(r.hits) == (r.doc_id % 5 == 0) for r in out)
    more = spark.createDataFrame([(1, "You are a gr0mbol and a snarviik, you grumbl", "x", 1), (2, None, None, None), (3, "", "x", 1), (3, "", "x", 1), (4, "river " * 30_000, "x", 1)], "doc_id long, text string, SCORE string, `in0` int")
    rows = toxicity.scored(more, model)
    assert rows.columns == ["doc_id", "in0", "score", "predicted", "hits"]
    score = {r.doc_id: r.score for r in rows.collect()}
    assert rows.count() == 5 and all(score[i] < 0.3 for i in (2, 3, 4)) and all(0 <= s <= 1 for s in score.values())


def test_toxicity_without_rows_or_with_one_class(spark, marked):
    docs, labels = marked
    for model in (toxicity.train(docs, labels.limit(0), F.lit(True)), toxicity.train(docs.limit(0), labels, F.lit(True)), toxicity.train(docs, labels.filter("toxic = 0"), F.lit(True))):
        assert model[0] == []
        assert {r.predicted for r in toxicity.scored(docs, model).collect()} == {0}
        assert toxicity.scored(docs.limit(0), model).collect() == []
    twice = toxicity.sample(docs.unionByName(docs.filter("doc_id < 9")), labels.unionByName(labels.withColumn("toxic", F.lit(None).cast("int"))), F.lit(True), "doc_id", "text", 10, 20).collect()
    assert len(twice) == 30 and sum(r.toxic for r in twice) == 10


def test_toxicity_held_out(spark, sf):
    out = queries.QUERIES["op12_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    caught = [r for r in out if r.toxic == 1]
    assert sum(r.predicted for r in caught) >= 0.85 * len(caught) and sum(r.predicted for r in out if r.toxic == 0) <= 0.01 * len(out)
