"""Toxic language by a lexicon trie intersected with Levenshtein automata, and context windows.

The lexicon is learned from a bounded sample of labelled rows: words and stems (first letters of words) whose occurrences,
counted once for each pair of neighbours, stand in toxic texts more often than chance allows (an exact binomial test for all
terms together). Its trie is intersected with the Levenshtein automaton of each term (no edit up to four letters, one up to eight,
two beyond; stems none): a state is a set of (trie node, edits), and the states that texts reach form a deterministic automaton over
letter classes, whose table is filled when a transition is first met. All words of a slice go through the table together.

A misspelling counts less than the term, and not at all where the sample's clean texts hold it. Of the words around a hit the
window tells whether it is quoted (inside quotation marks, or after a word that reports speech) or addressed to someone. A logistic
model over the sums of both kinds gives the score.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, written
from .rows import with_columns

#: labelled rows that the model is learned from, toxic and clean; terms and clean misspellings that are kept
MAX_TOXIC, MAX_CLEAN, MAX_TERMS, MAX_CLEAN_WORDS = 2_000, 6_000, 5_000, 20_000
#: letters of stems, words on each side of a hit that its window holds, states kept at a time
STEMS, WINDOW, MAX_STATES = (4, 5, 6), 6, 50_000
#: what a hit counts at 0, 1, 2 edits
CLOSE = (1.0, 0.6, 0.4)
#: words that report speech or name a word instead of using it
REPORTING = frozenset("said says say wrote writes quote quoted quotes word term called calling reads dijo dice palabra citó sagte sagt schrieb wort zitat dit écrit mot citation".split())
#: words that address someone
ADDRESS = frozenset("you your youre u ya tú tu eres usted du dich dein bist ihr toi ton ta vous es".split())
_QUOTES, _MARKS = "\"“”„«»‹›‘", "@$!*"


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 1 if a letter or digit, 2 if a mark that may stand for a letter; and whether it is a quotation mark."""
    kind = np.fromiter((chr(c).isalnum() for c in range(0x30000)), np.int8, 0x30000)
    quote = np.zeros(0x30000, bool)
    kind[[ord(c) for c in _MARKS]] = 2
    quote[[ord(c) for c in _QUOTES]] = True
    return kind, quote


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts as code points end to end with their n + 1 offsets; words (letters, digits, and a mark between two of
    them): starts, ends, the n + 1 word offsets of the rows. Null is empty."""
    flat = pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), "")
    sizes = pc.utf8_length(flat).to_numpy()
    code = np.frombuffer("".join(flat.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    kind = _classes()[0][np.minimum(code, 0x2FFFF)]
    inside = kind == 1
    if len(code):
        start = np.zeros(len(code) + 1, bool)
        start[offsets] = True
        inside[1:-1] |= (kind[1:-1] == 2) & (kind[:-2] == 1) & (kind[2:] == 1) & ~start[1:-2] & ~start[2:-1]
        before = np.concatenate([[False], inside[:-1]]) & ~start[:-1]
        after = np.concatenate([inside[1:], [False]]) & ~start[1:]
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return code, offsets, starts, ends, np.searchsorted(starts, offsets)


def edits(term: str, stem: bool) -> int:
    return 0 if stem or len(term) <= 4 else 1 if len(term) <= 8 else 2


class Lexicon:
    """The trie of terms (text, stem, weight) and the automaton of its intersection with their Levenshtein automata."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.most = [0]  # edits that some term below a node allows
        self.ends: list[list[int]] = [[]]
        for i, (text, stem, _) in enumerate(terms):
            node, allowed = 0, edits(text, stem)
            self.most[0] = max(self.most[0], allowed)
            for c in text:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.most.append(0)
                    self.ends.append([])
                node = self.next[node][c]
                self.most[node] = max(self.most[node], allowed)
            self.ends[node].append(i)
        self.letters = sorted({c for t, _, _ in terms for c in t})
        self.kind = np.full(0x30000, len(self.letters), np.int32)  # all other code points are one class
        self.kind[[ord(c) for c in self.letters]] = np.arange(len(self.letters))
        self.clear()

    def clear(self) -> None:
        self.states: list[frozenset[tuple[int, int]]] = []
        self.number: dict[frozenset[tuple[int, int]], int] = {}
        self.table = np.full((64, len(self.letters) + 1), -1, np.int32)
        #: term and edits of a word that ends in a state, and of one that has passed a stem there
        self.word, self.passed = np.full((2, 64, 2), -1, np.int32)
        self.dead, self.first = self._state(set()), self._state(self._closed({(0, 0)}))

    def _closed(self, found: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """With letters of the term left out, and the fewest edits of each node alone."""
        least: dict[int, int] = {}
        todo = list(found)
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or least.get(node, 9) <= e:
                continue
            least[node] = e
            todo += [(n, e + 1) for n in self.next[node].values()]
        return set(least.items())

    def _state(self, found: set[tuple[int, int]]) -> int:
        key = frozenset(found)
        if key in self.number:
            return self.number[key]
        s = self.number[key] = len(self.states)
        self.states.append(key)
        if s == len(self.table):
            grown = lambda a: np.concatenate([a, np.full_like(a, -1)])
            self.table, self.word, self.passed = grown(self.table), grown(self.word), grown(self.passed)
        hits = [(e, -len(self.terms[i][0]), i) for node, e in found for i in self.ends[node] if e <= edits(self.terms[i][0], self.terms[i][1])]
        if hits:
            e, _, i = min(hits)
            self.word[s] = i, e
        if stems := [(-len(self.terms[i][0]), i) for _, _, i in hits if self.terms[i][1]]:
            self.passed[s] = min(stems)[1], 0
        return s

    def _step(self, state: int, kind: int) -> int:
        c = self.letters[kind] if kind < len(self.letters) else None
        out = set()
        for node, e in self.states[state]:
            if e < self.most[node]:
                out.add((node, e + 1))
                out |= {(n, e + 1) for n in self.next[node].values()}
            if c in self.next[node]:
                out.add((self.next[node][c], e))
        return self._state(self._closed(out))

    def match(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in starts of the words that a term matches, the term and the edits."""
        if not self.terms or not len(starts):
            none = np.zeros(0, np.int64)
            return none, none, none
        if len(self.states) > MAX_STATES:  # the table is a cache
            self.clear()
        kinds = self.kind[np.minimum(code, 0x2FFFF)]
        live, state = np.arange(len(starts)), np.full(len(starts), self.first)
        term, edit = np.full(len(starts), -1), np.full(len(starts), 9)
        at = 0
        while len(live):
            kind = kinds[starts[live] + at]
            to = self.table[state, kind]
            open_ = np.flatnonzero(to < 0)
            if len(open_):
                for s, k in np.unique(np.stack([state[open_], kind[open_]], 1), axis=0).tolist():
                    new = self._step(s, k)
                    self.table[s, k] = new
                to = self.table[state, kind]
            at += 1
            over = ends[live] - starts[live] == at
            for found, where in ((self.passed, np.ones(len(live), bool)), (self.word, over)):
                t, e = found[to, 0], found[to, 1]
                better = where & (t >= 0) & (e <= edit[live])
                term[live[better]], edit[live[better]] = t[better], e[better]
            stay = ~over & (to != self.dead)
            live, state = live[stay], to[stay]
        hit = np.flatnonzero(term >= 0)
        return hit, term[hit], edit[hit]


def _words(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    return [code[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist())]


def found(texts: pa.Array, lexicon: Lexicon, clean: frozenset[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Words of each text, and its hits: row, start and end (code points), term, edits, whether quoted, weight."""
    code, offsets, starts, ends, first = split(texts)
    hit, term, edit = lexicon.match(code, starts, ends)
    text = _words(code, starts[hit], ends[hit])
    kept = np.array([e == 0 or w not in clean for w, e in zip(text, edit.tolist())], bool)
    hit, term, edit = hit[kept], term[kept], edit[kept]
    row = np.searchsorted(first, hit, side="right") - 1
    quotes = np.concatenate([[0], np.cumsum(_classes()[1][np.minimum(code, 0x2FFFF)])])
    quoted, weight = np.zeros(len(hit), bool), np.zeros(len(hit))
    for j, (w, r, t, e) in enumerate(zip(hit.tolist(), row.tolist(), term.tolist(), edit.tolist())):
        a, b = max(w - WINDOW, int(first[r])), min(w + WINDOW + 1, int(first[r + 1]))
        near = _words(code, starts[a:b], ends[a:b])
        left, right = quotes[starts[w]] - quotes[starts[a]], quotes[ends[b - 1]] - quotes[ends[w]]
        addressed = not ADDRESS.isdisjoint(near)
        quoted[j] = (left % 2 == 1 and right > 0) or (not addressed and not REPORTING.isdisjoint(near[: w - a]))
        weight[j] = lexicon.terms[t][2] ** 2 / 3 * CLOSE[e] * (1.2 if addressed else 1.0)
    return np.diff(first), {"row": row, "start": starts[hit] - offsets[row], "end": ends[hit] - offsets[row], "term": term, "edits": edit, "quoted": quoted, "weight": weight}


def features(texts: pa.Array, lexicon: Lexicon, clean: frozenset[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of each text: log of one and the weights of its hits, the same of the quoted ones, log of their share of all words; and the hits."""
    n, hits = found(texts, lexicon, clean)
    total = lambda mask: np.bincount(hits["row"][mask], weights=hits["weight"][mask], minlength=len(n))
    bare, quoted = total(~hits["quoted"]), total(hits["quoted"])
    return np.stack([np.log1p(bare), np.log1p(quoted), np.log1p(1000 * bare / np.maximum(n, 1))], 1), hits


def sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text: str, max_toxic: int, max_clean: int) -> DataFrame:
    """(toxic, t): labelled rows, of each class those of least hash of the id. An id's label is its highest, an id that repeats
    gives one text, that of least hash; null ids and labels are ignored."""
    marks = labels.filter(usable & F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = [marks.filter((F.col("toxic") == y)).orderBy(F.xxhash64("k"), "k").limit(n) for y, n in ((1, max_toxic), (0, max_clean))]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("t")).join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("id") == F.col("k"))  # max_toxic + max_clean short rows
    return rows.groupBy("id").agg(F.first("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("t"), "t")).alias("x")).select("toxic", "x.t")


_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def term_hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, word and kind (0 the word, else the letters of the stem) of all words and their stems, from sums over prefixes of the text."""
    power, inverse = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(code), x, np.uint64))]) for x in (_B, _B_INVERSE))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(code.astype(np.uint64) + _B) * power[:-1])])
    word, kind = [np.arange(len(starts))], [np.zeros(len(starts), np.int64)]
    for k in STEMS:
        longer = np.flatnonzero(ends - starts > k)
        word.append(longer)
        kind.append(np.full(len(longer), k))
    word, kind = np.concatenate(word), np.concatenate(kind)
    a = starts[word]
    b = np.where(kind, a + kind, ends[word])
    return _mixed((upto[b] - upto[a]) * inverse[a] + kind.astype(np.uint64) * _B).view(np.int64), word, kind


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, near): hashes of words and stems, and of the words before and after."""
    for part in slices(batches, "t"):
        code, _, starts, ends, first = split(part.column("t"))
        term, word, kind = term_hashes(code, starts, ends)
        own = term[kind == 0].view(np.uint64)
        before, after = np.concatenate([[0], own[:-1]]).astype(np.uint64), np.concatenate([own[1:], [0]]).astype(np.uint64)
        before[first[:-1][np.diff(first) > 0]] = 0
        after[first[1:][np.diff(first) > 0] - 1] = 0
        near = _mixed(before * np.uint64(3) + after).view(np.int64)[word]
        _, at = np.unique(_mixed(term.view(np.uint64) + _B * near.view(np.uint64)), return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(term[at]), pa.array(near[at])], names=["term", "near"])


def lexicon_of(rows: DataFrame, max_terms: int = MAX_TERMS, risk: float = 0.01) -> list[tuple[str, bool, float]]:
    """(term, stem, weight) of the terms of the sample (toxic, t) that stand in toxic texts more often than chance allows, the surest
    first: the Chernoff bound of the binomial tail, times the number of terms, is at most `risk`. Occurrences in toxic texts
    with the same neighbours count once, so copies of a text prove nothing. Words that a stem covers are left out."""
    spark = rows.sparkSession
    toxic, others = (rows.filter(F.col("toxic") == y).select("t") for y in (1, 0))
    seen = toxic.mapInArrow(_contexts, "term long, near long").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("a"))
    counts = written(seen, "toxic-terms")
    n_terms, a_all = counts.count(), toxic.mapInArrow(_sizes, "n long").agg(F.sum("n")).first()[0] or 0
    often = counts.filter("a >= 3").orderBy("term").toPandas()  # at most a third of the words of max_toxic texts
    known = spark.sparkContext.broadcast(often["term"].to_numpy())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            code, _, starts, ends, _ = split(part.column("t"))
            at, _, _ = _among(term_hashes(code, starts, ends), known.value)
            i, n = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(n.astype(np.int64))], names=["i", "n"])

    b = np.zeros(len(often), np.int64)
    for i, n in others.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n")).collect():  # terms of `often`
        b[i] = n
    b_all = others.mapInArrow(_sizes, "n long").agg(F.sum("n")).first()[0] or 0
    if not len(often) or not b_all:
        return []
    a = often["a"].to_numpy()
    share = a_all / (a_all + b_all)
    x = lambda c: np.where(c > 0, c * np.log(np.maximum(c, 1)), 0.0)
    chance = x(a + b) - x(a) - x(b) + a * math.log(share) + b * math.log(1 - share)
    weight = np.minimum(3.0, np.log10((a + 0.5) / (a_all + 1)) - np.log10((b + 0.5) / (b_all + 1)))
    sure = np.flatnonzero((weight >= 1) & (chance < math.log(risk / max(n_terms, 1))))
    sure = sure[np.lexsort((often["term"].to_numpy()[sure], chance[sure]))][: 4 * max_terms]
    chosen = np.sort(often["term"].to_numpy()[sure])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            code, _, starts, ends, _ = split(part.column("t"))
            hashes, word, kind = term_hashes(code, starts, ends)
            at, word, kind = _among((hashes, word, kind), chosen)
            _, one = np.unique(at, return_index=True)
            at, word, kind = at[one], word[one], kind[one]
            text = _words(code, starts[word], np.where(kind, starts[word] + kind, ends[word]))
            yield pa.RecordBatch.from_arrays([pa.array(chosen[at]), pa.array(text, pa.string()), pa.array(kind > 0)], names=["term", "text", "stem"])

    spelt = {r["term"]: (r["text"], r["stem"]) for r in toxic.mapInArrow(spell, "term long, text string, stem boolean").groupBy("term").agg(F.min("text").alias("text"), F.first("stem").alias("stem")).collect()}
    found = [(*spelt[h], w) for h, w in zip(often["term"].to_numpy()[sure].tolist(), weight[sure].tolist())]
    stems: set[str] = set()
    for t, stem, w in sorted(found, key=lambda r: len(r[0])):  # a stem must tell nearly as much as any term that it covers
        if stem and not any(t[:k] in stems for k in STEMS) and w > max((v for u, _, v in found if u != t and u.startswith(t)), default=0.0) - 1.0:
            stems.add(t)
    return [(t, stem, w) for t, stem, w in found if (t in stems if stem else not any(t[:k] in stems for k in STEMS if k < len(t)))][:max_terms]


def _among(found: tuple[np.ndarray, np.ndarray, np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (hash, word, kind) those whose hash is in the sorted array, with its place there."""
    if not len(known):
        none = np.zeros(0, np.int64)
        return none, none, none
    at = np.minimum(np.searchsorted(known, found[0]), len(known) - 1)
    hit = np.flatnonzero(known[at] == found[0])
    return at[hit], found[1][hit], found[2][hit]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "t"):
        yield pa.RecordBatch.from_arrays([pa.array([len(split(part.column("t"))[2])], pa.int64())], names=["n"])


def clean_words(rows: DataFrame, terms: list[tuple[str, bool, float]], most: int = MAX_CLEAN_WORDS) -> frozenset[str]:
    """Words of clean texts of the sample that a term matches with edits: they are words of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for part in slices(batches, "t"):
            code, _, starts, ends, _ = split(part.column("t"))
            hit, _, edit = lexicon.match(code, starts, ends)
            hit = hit[edit > 0]
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set(_words(code, starts[hit], ends[hit]))), pa.string())], names=["w"])

    found = rows.filter("toxic = 0").select("t").mapInArrow(run, "w string").groupBy("w").count()
    return frozenset(r["w"] for r in found.orderBy(F.desc("count"), "w").limit(most).collect())


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights and offset by Newton steps, with a ridge towards 0 for all but the offset."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), gradient)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text: str = "text", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[list[tuple[str, bool, float]], frozenset[str], np.ndarray]:
    """(terms, clean words, weights) from the labelled rows for which `usable`, over the id column, holds; at most max_toxic and
    max_clean of them. Without both classes there are no terms, and the score is the share of toxic rows, smoothed."""
    rows = written(sample(docs, labels, usable, id_col, text, max_toxic, max_clean), "toxic-sample")
    terms = lexicon_of(rows)
    clean = clean_words(rows, terms) if terms else frozenset()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for part in slices(batches, "t"):
            x, _ = features(part.column("t"), lexicon, clean)
            yield pa.RecordBatch.from_arrays([part.column("toxic"), *(pa.array(c) for c in x.T)], names=["y", "a", "b", "c"])

    got = rows.select("toxic", "t").mapInArrow(run, "y int, a double, b double, c double").toPandas().to_numpy(float)  # the sample's rows, four numbers each
    if len(set(got[:, 0])) < 2:
        return [], frozenset(), np.array([0.0, 0, 0, math.log((got[:, 0].sum() + 1) / ((1 - got[:, 0]).sum() + 1))])
    return terms, clean, logistic(got[:, 1:], got[:, 0])


_HITS = "array<struct<start:int,end:int,term:string,edits:int,quoted:boolean,weight:double>>"


def scored(docs: DataFrame, model: tuple, text: str = "text", cut: float = 0.7) -> DataFrame:
    """docs without `text`, plus score (0 to 1), predicted (score >= cut) and hits, each with its place in code points, the
    lexicon's term, the edits and whether it is quoted. Null and empty texts are scored, too; rows and other columns stay, but for
    those named like an output."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_TERMS and MAX_CLEAN_WORDS short words

    def run(texts: pa.Array) -> list[pa.Array]:
        lexicon, clean, w = loaded(shared)
        x, h = features(texts, lexicon, clean)
        score = 1 / (1 + np.exp(-np.clip(np.concatenate([x, np.ones((len(x), 1))], 1) @ w, -700, 700)))
        each = defaultdict(list)
        for r, a, b, t, e, q, v in zip(*(h[k].tolist() for k in ("row", "start", "end", "term", "edits", "quoted", "weight"))):
            each[r].append({"start": a, "end": b, "term": lexicon.terms[t][0], "edits": e, "quoted": q, "weight": v})
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("weight", pa.float64())]))
        return [pa.array(score), pa.array((score >= cut).astype(np.int32)), pa.array([each.get(i, []) for i in range(len(x))], kind)]

    return with_columns(docs, [F.col(f"`{text}`")], f"score double, predicted int, hits {_HITS}", run, (text,))


_LOADED: list = []


def loaded(shared) -> tuple:
    """The automaton of a broadcast model, made once in each worker process."""
    if not _LOADED or _LOADED[0] is not shared:
        terms, clean, w = shared.value
        _LOADED[:] = shared, (Lexicon(terms), clean, w)
    return _LOADED[1]


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = train(docs, table(spark, sf_dir, "labels"), ~held)
    return scored(docs.withColumn("held_out", F.coalesce(held, F.lit(False))), model).drop("hits")
