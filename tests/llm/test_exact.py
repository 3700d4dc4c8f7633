"""Operators with exact results, against brute force on awkward small tables."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lurewatch.llm import common, decontaminate, passages, rules, simhash, tokens, warc

rng = random.Random(11)
WORDS = [f"w{i}" for i in range(300)]
LONG = " ".join(rng.choice(WORDS) for _ in range(30_000))


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


A, B = prose(120), prose(150)
TEXTS = [None, "", " \t\n", "x", "a b", "A B c d e", A, A, A + " tail one two", A.replace("w1 ", "w2 "), B, "é" * 300 + B, B + "\n" + B, LONG, LONG + " more", "aaaa" * 300, "line\nline\n x\nline", "ab " * 500, "# $ % & |\n" * 60]
ROWS = [(i, t, "en", "s", 7, "clash", 1.0) for i, t in enumerate(TEXTS)] + [(6, A, "en", "s", 7, "clash", 1.0), (None, A, None, None, None, None, None), (None, None, None, None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_hash_and_words():
    texts = [None, "", *["".join(rng.choice("ab \n\té") for _ in range(rng.randrange(90))) for _ in range(200)], "y" * 5000]
    raw, offsets = common.text_bytes(pa.array(texts))
    h = common.xxh64(raw, offsets[:-1], offsets[1:])
    assert [int(x) for x in h] == [xxhash.xxh64_intdigest((t or "").encode(), 42) for t in texts]
    starts, ends, first = common.words(raw, offsets)
    for i, t in enumerate(texts):
        assert [raw[a:b].tobytes().decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])] == split(t)


# ---- SimHash ----


def fingerprint(t, width=4):
    w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(fps, radius=4):
    keys = sorted(set(fps))
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and (a ^ b).bit_count() <= radius and find(a) != find(b):
                root[find(b)] = find(a)
    return {k: find(k) for k in keys}


def test_simhash(docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    fps = [fingerprint(r[1]) for r in ROWS]
    cls = classes(fps)
    least = {}
    for r, f in zip(ROWS, fps):
        if r[0] is not None:
            least[cls[f]] = min(least.get(cls[f], r[0]), r[0])
    want = collections.Counter((r[0], f, least.get(cls[f])) for r, f in zip(ROWS, fps))
    assert collections.Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == want


def test_simhash_links_within_radius(spark):
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base[:30]:
        for k in range(1, 7):
            x = b
            for i in rng.sample(range(64), k):
                x ^= 1 << i
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.linked(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    cls = classes(list(fps))
    groups = lambda m: {frozenset(k for k in fps if m.get(k, k) == v) for v in {m.get(k, k) for k in fps}}
    assert groups(got) == groups(cls)


def test_simhash_crowded_cells(spark, monkeypatch):
    # families of a chain each, many in the cells of the others; cells of more than 3 members go the way of crowded ones
    seed, fps = random.Random(5), set()
    for _ in range(6):
        x = seed.getrandbits(64)
        for _ in range(40):
            x ^= 1 << seed.randrange(64) | 1 << seed.randrange(64)
            fps |= {x, x ^ 0b1011 << seed.randrange(60), x ^ 0b11111 << seed.randrange(59)}
    signed = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    cls = classes(list(fps))
    want = {frozenset(k for k in fps if cls[k] == v) for v in set(cls.values())}
    for crowd, agree in ((3, 1), (3, 2), (20, 1), (512, 2)):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.linked(signed, agree=agree).collect()}
        assert {frozenset(k for k in fps if got.get(k, k) == v) for v in {got.get(k, k) for k in fps}} == want


def test_simhash_cells_grow_with_the_logarithm(spark):
    # the shuffle is of so many rows a fingerprint
    cells = [len(simhash.cell_masks(4, simhash.cells_to_agree(n, 4))) for n in (47_000, 236_000, 14_000_000)]
    assert cells[0] == cells[1] <= 15 and cells[2] <= 35
    # a third in one cell: no join makes a row for each pair of its members
    fps = np.arange(3000) << 20
    assert len(simhash._stars(np.repeat(np.arange(100), 30), fps, 4)[0]) < 3000


def test_simhash_empty_and_keep(docs, empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(docs).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(6) == 1 and 7 not in ids and 10 in ids and len(ids) == len(set(ids))
    assert kept[0].asDict().keys() == set(docs.columns)


def test_similar_texts(spark):
    vocab = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for b in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randrange(30, 300))]
        for k in range(rng.randrange(1, 9)):
            words = list(base)
            for i in rng.sample(range(len(words)), round(len(words) * 0.006 * k)):
                words[i] = rng.choice(vocab)
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, rows[0][1].upper()), (n + 1, None), (n + 2, " \n"), (n + 3, "a b"), (n + 4, "a b"), (n + 5, "b"), (None, rows[3][1]), (None, "x y z q r s t"), (None, None), (2, "other text of this id with several words"), (2, rows[2][1])]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, f0 int")
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash.similar(df).collect())
    assert got == collections.Counter((key, least.get(find(i))) for i, (key, _) in enumerate(rows))
    assert len(set(least.values())) < len(rows) / 2
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter([*least.values(), None])  # one of each component


def test_manhattan_is_a_lower_bound(spark):
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a long, b long").select(F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b")))).alias("m"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("h"))
    assert all(r.m <= r.h for r in df.collect())


def test_similar_pairs_at_the_threshold_are_all_found(spark):
    own, rows, want = random.Random(8), [], 0
    for b in range(400):
        n = own.randrange(60, 400)
        base = [f"t{own.randrange(10**6)}" for _ in range(n)]
        while True:
            words = list(base)
            for i in own.sample(range(n), round(n * own.uniform(0.015, 0.03))):
                words[i] = "x" + words[i]
            a, c = ({tuple(w[i : i + 5]) for i in range(n - 4)} for w in (base, words))
            if 0.8 <= len(a & c) / len(a | c) <= 0.85:
                break
        rows += [(2 * b, " ".join(base)), (2 * b + 1, " ".join(words))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar(df).collect()} == {i: i // 2 * 2 for i in range(800)}


def test_leading_shingles_hold_a_shared_one():
    own = np.random.default_rng(4)
    common = own.permutation(200)[:50].astype(np.uint64)
    for _ in range(300):
        a = set(own.choice(200, own.integers(1, 60), replace=False).tolist())
        b = set(list(a)[own.integers(0, 3) :]) | set(own.choice(200, own.integers(0, 5)).tolist())
        if b and len(a & b) >= 0.8 * len(a | b):
            sets = [np.array(sorted(x), np.uint64) for x in (a, b)]
            first, ends = simhash.leading(np.concatenate(sets), np.array([0, len(a), len(a) + len(b)]), 0.8, common)
            assert set(first[: ends[1]].tolist()) & set(first[ends[1] :].tolist())


# ---- repeated passages ----


def cut(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(r), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram", [(400, 200), (40, 12)])
def test_passages(spark, length, gram):
    shared = [prose(90), prose(20), "xy" * 250, "common line of text " * 3]
    rows = [t for _, t, *_ in ROWS if t is None or len(t) < 20_000]
    rows += [" ".join(rng.choice([prose(3), rng.choice(shared)]) for _ in range(12)) for _ in range(40)]
    df = spark.createDataFrame([(i % 30 or None, t, "n") for i, t in enumerate(rows)], "doc_id long, text string, n_bytes string")
    got = passages.without_repeats(df, length, gram, give="kept_sha256").collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == collections.Counter((i % 30 or None, *c) for i, c in enumerate(cut(rows, length)))


def test_repeated_words_are_cut(spark):
    own = random.Random(3)
    fresh = lambda n: [f"{own.randrange(10**5)}" for _ in range(n)]
    shared = {n: fresh(n) for n in (20, 50, 51, 57, 63, 90)}
    rows = [fresh(own.randrange(200)) for _ in range(20)]
    for n, run in shared.items():
        for gap in (" ", "\n"):
            rows.append(fresh(own.randrange(1, 80)) + [gap.join(run)] + fresh(own.randrange(1, 80)))
    rows.append(fresh(9) + shared[90][20:75] + fresh(9))
    rows += [["common", "line"] * 60, fresh(5) + ["common", "line"] * 40]
    texts = [" ".join(r) for r in rows]
    split_ = [split(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + 51]) for w in split_ for i in range(len(w) - 50))
    want = []
    for w in split_:
        gone = {i + j for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for j in range(51)}
        want.append([x for i, x in enumerate(w) if i not in gone])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: split(r.kept_text) for r in passages.without_repeats(df, length=10**4, gram=200, give="kept_text", n_words=51).collect()}
    assert got == dict(enumerate(want)) and want != split_
    pipeline = pytest.importorskip("corpus_pipeline")
    staged = {r.doc_id: split(r.text) for r in pipeline.repeated_passages(spark, df.withColumn("n_chars", F.length("text")), "").collect()}
    assert all(len(staged[i]) <= len(w) for i, w in enumerate(want)) and sum(map(len, staged.values())) >= sum(map(len, want)) - 4


def test_short_passages_go_in_a_column_apart(spark, tmp_path):
    own = random.Random(9)
    fresh = lambda n: " ".join(f"{own.randrange(10**4)}" for _ in range(n))
    kept, passage, long = fresh(48), fresh(55), fresh(120)
    assert len(passage) < 400 < len(long)
    texts = [f"{fresh(30)} a {x} b {fresh(30)}" for x in (kept, kept, passage, passage, long, long)] + [fresh(80), "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in passages.op9_passages(spark, str(tmp_path)).collect()}
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for _, r in sorted(got.items())] == cut(texts, 400)
    for i in (0, 1, 6, 7, 8):  # a run of 50 words stays
        assert got[i].text == got[i].text_51_words == (texts[i] or "")
    for i in (2, 3):
        assert got[i].text == texts[i] and got[i].text_51_words == texts[i].replace(f"a {passage} b", "")
    for i in (4, 5):
        assert got[i].text == got[i].text_51_words and long not in got[i].text


def test_passages_empty(empty):
    assert passages.without_repeats(empty).count() == 0


def test_long_text_is_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(passages, "STEP", 500)
    text = "".join(rng.choice("abcd") for _ in range(4000))
    raw, offsets = common.text_bytes(pa.array([text, "short"]))
    starts = set()
    for part, off, rows, places in passages._pieces(raw, offsets, 40):
        _, _, row, first, last = passages.samples(part, off, 40, 12)
        for r, a, b in zip(row, first, last):
            assert rows[r] == 0
            starts |= set(range(a + places[r], b + places[r] + 1))
    assert starts == set(range(4000 - 40 + 1))


# ---- tokens ----


def test_tokens(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    extra = docs.sparkSession.createDataFrame([(100 + i, s) for i, s in enumerate(["It's <|endoftext|>we'll", "İΣΑΣ ﬁ é 日本", "q" * 3000, "\x1c\x85|"])], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(extra)
    for r in tokens.digests(df, with_ids=True).join(df.distinct(), "doc_id").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids if r.text is not None else []
        if r.doc_id == 6 or r.text is None:
            continue
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = tokens.decode(tokens.encode(extra)).collect()
    assert [r.decoded for r in back] == [t.decode(t.encode(s, add_special_tokens=False).ids, skip_special_tokens=False) for s in (x.text for x in extra.collect())]
    assert tokens.digests(empty).count() == 0


def test_random_words_have_one_path():
    from tokenizers import Tokenizer

    t, a = Tokenizer.from_file(tokens.default_path()), tokens.automaton(tokens.default_path())
    for _ in range(1500):
        s = "".join(rng.choice("aehtnrs") for _ in range(rng.randrange(1, 40)))
        assert np.frombuffer(a.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids
        assert a._searched("".join(a.letters[b] for b in s.encode())) == t.encode(s, add_special_tokens=False).ids


def test_words_are_read_without_search(monkeypatch):
    from tokenizers import Tokenizer

    t, a = Tokenizer.from_file(tokens.default_path()), tokens.Automaton(tokens.default_path())
    edge = ["", None, "<|endoftext|>", "a<|endoftext|><|startoftext|>b <|ENDOFTEXT|>", "\x1ca\x1fb", "don't 'S ''s !'s", "é,ß. ǆ; ɐ! ª. Σ.", "x" * 128, ". ,", "e\u0301. \u2000\u3000a", "12a3.", "日本語。日本", "\U0001f600!a."]
    letters = "aehtnrsäéøłжш日本 \u0301'.,;!?1\x1d\x85"
    texts = edge + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    want = [t.encode(s or "", add_special_tokens=False).ids for s in texts]
    long = ["q" * 129 + " a", "th" * 700]
    ids, offsets = a.encode_all(texts + long)
    assert [ids[x:y].tolist() for x, y in zip(offsets, offsets[1:])] == want + [t.encode(s, add_special_tokens=False).ids for s in long]
    assert [bytes(x).decode() for x in a.decode_all(ids, offsets)][: len(want)] == [t.decode(x, skip_special_tokens=False) for x in want]
    monkeypatch.setattr(a, "_searched", None)  # a path by search, for words of over 128 bytes alone
    for s, ids in zip(texts[:200], want):
        assert np.frombuffer(a.encode(s), "<u4").tolist() == ids
    some = np.array([(x, z) for x in range(0, 49000, 997) for z in range(0, 49000, 991)])
    assert a._tested(*some.T).tolist() == a._allowed(*some.T).tolist() == a._allowed(*some.T).tolist() == [a.allows(x, z) for x, z in some.tolist()]


# ---- WARC ----


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/x y\r\n", "<p>1</p>"), (2, None, "<p>1</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 200_000), (6, "u", "<p>2</p>"), (6, "u", "<p>2</p>"), (None, "u", "<p>3</p>"), (None, "u", "<p>1</p>")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    folder = f"file://{tmp_path}/w"
    index = warc.normalise(warc.write_monolithic(warc.classified(df), folder, roll_bytes=2000), folder + "/n")
    got = warc.read_indexed(index).collect()
    best = {}
    for i, _, h in pages:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    n = collections.Counter(h or "" for _, _, h in pages)
    want = []
    for i, _, h in pages:
        h = h or ""
        revisit = n[h] > 1 and h in best and i != best[h]
        want.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if revisit else "response", best[h] if revisit else None))
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == collections.Counter(want)
    assert {r.payload.decode() for r in got if r.page_id == 5} == {"é" * 200_000}
    # a sidecar line leads to one member that stands alone
    row = index.first()
    with open(row.archive.removeprefix("file://"), "rb") as f:
        f.seek(row.offset)
        assert warc.parse_member(f.read(row.length))["record_id"] == row.record_id
    assert open(row.archive.removeprefix("file://") + ".idx").read().count("\n") >= 1


def test_warc_stream_pieces():
    import io

    data = b"".join(warc.record_bytes({"page_id": i, "url": None, "payload": bytes([65 + i]) * 400_000, "payload_digest": "X", "record_type": "response", "refers_to": None}) for i in range(3))
    for packed in (zlib.compress(data, wbits=31), b"".join(zlib.compress(x, wbits=31) for x in (data[:1000], data[1000:]))):
        s, n = warc._Inflated(io.BytesIO(packed)), 0
        while (head := s.head()) is not None:
            n += 1
            assert sum(map(len, s.pieces(int(warc._fields(head)["content-length"]) + 4))) > 400_000
        assert n == 3


def test_warc_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.normalise(warc.write_monolithic(warc.classified(df), f"file://{tmp_path}/e"), f"file://{tmp_path}/f")
    assert warc.read_indexed(index).count() == 0


# ---- rules ----


def base(t):
    w = split(t)
    lines, seen = 0, set()
    for line in (t or "").split("\n"):
        if split(line):
            lines += line in seen
            seen.add(line)
    n, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if n[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), lines, len(covered)


def test_rule_counts(docs, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rules.assess(docs, labels).collect()
    want = collections.Counter()
    for r in ROWS:
        b = base(r[1])
        want[(r[0], *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept == (not r.base_failed) for r in got)  # no label, no certified cutoff
    assert rules.assess(empty, labels).count() == 0
    assert rules.keep_good(docs, labels).columns == docs.columns


def test_binomial_tail():
    for n, k, p in ((10, 0, 0.3), (10, 10, 0.3), (40, 7, 0.1), (40, 2, 0.5)):
        exact = sum(__import__("math").comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(rules.binomial_tail(k, n, p) - exact) < 1e-12


def test_cutoffs_are_certified(spark):
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(100)) + (" $$" * 40 if i % 50 == 0 else "")) for i in range(600)] + [(1000 + i, "x$ " * 0 + " ".join(f"{w}$$$" for w in rng.sample(WORDS, 100))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in rules.assess(df, labels).collect()}
    assert sum(not got[i] for i in range(600)) <= 0.03 * 600 and not any(got[1000 + i] for i in range(50))


# ---- decontamination ----


def leaks(docs_, items_):
    norm = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for i, t in items_:
        b = norm(t)
        width = min(5, len(b))
        if not width:
            continue
        want = collections.Counter(tuple(b[k : k + width]) for k in range(len(b) - width + 1))
        n = sum(want.values())
        for d, text in docs_:
            w = norm(text)
            s = [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]
            for k in range(max(1, len(s) - n + 1)):
                have = collections.Counter(s[k : k + n])
                both = sum((have & want).values())
                if have and both / (n + sum(have.values()) - both) >= 0.8 - 1e-12:
                    out.add((d, i))
    return out


def test_decontaminate(spark, docs, empty):
    items = [(i, prose(rng.randrange(18, 50))) for i in range(6)] + [(10, "two words"), (11, None), (12, " "), (13, A[:200]), (13, A[:200])]
    rows = [(r[0], r[1]) for r in ROWS if r[1] is None or len(r[1]) < 20_000]
    for i in range(6):
        w = items[i][1].split()
        edited = w[:]
        edited[len(w) - 1] = "zz"
        rows += [(200 + i, prose(40) + " " + items[i][1].upper() + ". " + prose(40)), (300 + i, prose(10) + " " + " ".join(edited) + " " + prose(5)), (400 + i, " ".join(w[: len(w) // 2])), (500 + i, " ".join(w[:-1]))]
    rows += [(600, "has Two, words inside"), (600, "has Two, words inside")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks(rows, items)
    kept = {r.doc_id for r in decontaminate.keep_clean(df, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in leaks(rows, items)} | ({None} if any(d is None for d, _ in rows) and (None, 13) not in leaks(rows, items) else set()) | ({None})
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_a_phrase_of_many_items_and_documents_makes_no_pairs(spark):
    """100 items and 100 documents with one opening phrase, in other respects unlike; one document holds an item."""
    phrase = " ".join(f"p{k}" for k in range(14))
    words = lambda mark, i: " ".join(f"{mark}{i}x{k}" for k in range(40))
    items = spark.createDataFrame([(i, f"{phrase} {words('i', i)}") for i in range(100)], "item_id long, text string")
    rows = [(i, f"{phrase} {words('d', i)}") for i in range(100)] + [(500, f"before it {phrase} {words('i', 7)} after it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = decontaminate.items(items, "item_id", "text")
    known = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), F.explode(decontaminate._all_shingles("text", [5])).alias("s")).select("doc", "text_hash", "s.*")
    known = known.join(wanted.select(F.explode("hashes").alias("hash")).distinct(), "hash", "left_semi")
    assert [tuple(r) for r in decontaminate.candidates(known, wanted, 0.8, 10_000).select("doc", "item_id").collect()] == [(500, 7)]
    assert [(r.doc_id, r.item_id, r.position) for r in decontaminate.leaks(docs, items).collect()] == [(500, 7, 2)]
