"""Removal of byte strings of a given length that occur more than once in a corpus.

The method works like induced suffix sorting on a sample of suffixes. In external induced sorting the suffixes at
local minima are ordered first and all others follow from them and the bytes to their left. Here the sample is the
set of local minima of a k-gram hash: every string of `length` bytes holds the first k-gram of least hash in its
`length - k + 1` k-grams, and two equal strings hold it at the same place. So equal strings meet at equal sampled
k-grams, and what lies to the left and right of these decides:

1. each sampled position stands for the run of strings that it is the minimum of (an interval of starts) and has a
   hash of the k-gram and one of the whole context of the run;
2. contexts that occur twice settle all their strings at once; one representative is kept of each;
3. where a k-gram still has several contexts, one of which is single, the strings of the representatives are
   compared one by one, spread by their own hash, so that a very common k-gram is no group of its own.

No step gathers a group: counts are pre-aggregated and joins are on hashes. A string counts as repeated only if two
independent hashes agree: k-gram and context (128 bits) in step 2, two hashes of the string (96 bits) in step 3; at 10**12
strings the chance of any wrong one is below one in 10**5. Documents are known by 128 bits of hash
of their text, so ids may repeat or be null. Sampled positions are about 1% of the bytes.

All of it also works on words in place of bytes (`by_word`): a word stands for its hash, whatever space is between words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import drop_written, keeping_memory, slices, table, text_bytes, words, written, written_so_far, xxh64

LENGTH, GRAM = 400, 200
#: words of the k-gram of a run of `n` words, as a share of n
WORD_GRAM = 0.5
#: bytes that one vectorised step works on; it needs about a hundred times as much memory
STEP = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_PLACE = 28


@lru_cache(1)
def _letters() -> np.ndarray:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**63, (2, 256), dtype=np.uint64)


_TABLES = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n of each at least; the tables grow and are kept."""
    for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
        while len(_TABLES[k]) < n:
            out = _TABLES[k]
            _TABLES[k] = np.concatenate([out, out * _U(int(out[-1]) * base % 2**64)])
    return _TABLES


def _mix(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = h ^ (h >> _U(32))
        h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class Hashes:
    """Hash of any range of a buffer of bytes or word hashes from prefix sums (a polynomial over random letters, modulo
    2**64)."""

    def __init__(self, raw: np.ndarray, which: int):
        self.power, self.inverse = _powers(len(raw) + 1)
        letters = np.take(_letters()[which], raw) if raw.dtype == np.uint8 else _mix(raw + _letters()[which][0])
        letters *= self.power[: len(raw)]
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(letters, out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.inverse[a])

    def every(self, n: int) -> np.ndarray:
        """Of the ranges of n places, from the first on."""
        h = self.sums[n:] - self.sums[:-n]
        h *= self.inverse[: len(h)]
        return _mix(h)


def samples(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Sampled positions of rows laid end to end: (hash of the k-gram, hash of the context, row, first start, last
    start). The strings that start at first..last hold this position as their minimum."""
    width, n = length - gram + 1, len(raw)
    if n < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    m = n - gram + 1
    h = Hashes(raw, 0).every(gram)
    blocks = -(-m // width)
    grid = np.full(blocks * width, _U(2**64 - 1))
    ranked = np.right_shift(h, _U(_PLACE), out=grid[:m])
    ranked <<= _U(_PLACE)
    ranked |= np.arange(m, dtype=np.uint64)
    grid = grid.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    many = n - length + 1
    least = np.minimum(after[:many], before[width - 1 : width - 1 + many])
    new = np.ones(many, bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[offsets[(offsets >= 0) & (offsets < many)]] = True
    first = np.flatnonzero(new)
    row = np.searchsorted(offsets, first, side="right") - 1
    final = offsets[row + 1] - length
    last = np.minimum(np.append(first[1:], many) - 1, final)
    whole = first <= final
    first, last, row = first[whole], last[whole], row[whole]
    place = (least[first] & _U((1 << _PLACE) - 1)).astype(np.int64)
    where = (place - first).astype(np.uint64) * _U(1000003) + (last - first).astype(np.uint64)
    context = _mix(Hashes(raw, 1).of(first, last + length) + _mix(where + _U(1)))
    return h[place], context, row, first - offsets[row], last - offsets[row]


def _pieces(raw: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of bounded size with their offsets, rows and places in the rows: short rows together, long ones cut
    with an overlap that keeps every string of `length` bytes in one piece."""
    if len(raw) <= 2 * STEP:
        yield raw, offsets, np.arange(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
        return
    for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        for c in range(a, max(b - length + 1, a + 1), STEP):
            d = min(b, c + STEP + length - 1)
            yield raw[c:d], np.array([0, d - c]), np.array([i]), np.array([c - a])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of a string column end to end and the n + 1 offsets of its rows."""
    raw, offsets = text_bytes(texts)
    starts, ends, first = words(raw, offsets)
    return xxh64(raw, starts, ends), first


def sampled(docs: DataFrame, length: int, gram: int, by_word: bool = False) -> DataFrame:
    """(d1, d2, text) -> (d1, d2, gram, context, first, last) for every sampled position."""
    units = word_hashes if by_word else text_bytes

    @keeping_memory
    def step(part: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        d1, d2 = (part.column(c).to_numpy() for c in ("d1", "d2"))
        for raw, offsets, rows, places in _pieces(*units(part.column("t")), length):
            g, c, row, first, last = samples(raw, offsets, length, gram)
            if len(g):
                own = rows[row]
                cols = [d1[own], d2[own], g.view(np.int64), c.view(np.int64), first + places[row], last + places[row]]
                out.append(pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["d1", "d2", "gram", "context", "first", "last"]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", STEP // 2):
            yield from step(part)

    return docs.mapInArrow(run, "d1 long, d2 long, gram long, context long, first long, last long")


def _strings(rows: DataFrame, length: int, by_word: bool = False) -> DataFrame:
    """(text, runs of (rep, first, last)) -> (h, g, rep, shift) for every string that starts in a run; h and g are two
    independent hashes of the string, 96 bits in all."""
    units = word_hashes if by_word else text_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            whole, offsets = units(part.column("t"))
            for k0, k1, runs in zip(offsets.tolist(), offsets[1:].tolist(), part.column("runs").to_pylist()):
                raw = whole[k0:k1]
                for k in range(0, len(runs), 2000):
                    some = runs[k : k + 2000]
                    a, b = min(r["first"] for r in some), max(r["last"] for r in some) + length
                    hash1, hash2 = Hashes(raw[a:b], 0), Hashes(raw[a:b], 1)
                    n = np.array([r["last"] - r["first"] + 1 for r in some])
                    shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    start = np.repeat(np.array([r["first"] for r in some]) - a, n) + shift
                    h, g = hash1.of(start, start + length), hash2.of(start, start + length) >> _U(32)
                    rep = np.repeat(np.array([r["rep"] for r in some]), n)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.astype(np.uint32).view(np.int32)), pa.array(rep), pa.array(shift.astype(np.int32))], names=["h", "g", "rep", "shift"])

    return rows.mapInArrow(run, "h long, g int, rep long, shift int")


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, by_word: bool = False) -> DataFrame:
    """(d1, d2, t, ...) -> (d1, d2, runs): for each text that has any, the intervals (first, last) of the starts of
    strings (by_word: runs of `length` words) that occur elsewhere too.

    The result is a plan over docs as a whole: a caller that joins it with docs shuffles the texts once for both."""
    first = written_so_far()
    found = written(sampled(docs.select("d1", "d2", "t").filter(F.octet_length("t") >= length), length, gram, by_word), "samples")
    classes = found.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"))
    classes = written(classes, "contexts")
    grams = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least")).filter("c > 1 and least = 1").select(F.col("gram").alias("g"))
    known = classes.join(grams, classes.gram == grams.g, "left").select(F.col("gram").alias("g"), F.col("context").alias("x"), "n", F.col("g").isNotNull().alias("open")).filter("open or n > 1")
    marked = written(found.join(known, (found.gram == known.g) & (found.context == known.x)).select("d1", "d2", "gram", "context", "first", "last", "n", "open"), "marked")
    settled = marked.filter("n > 1").select("d1", "d2", F.struct("first", "last").alias("run"))
    reps = marked.filter("open").groupBy("gram", "context").agg(F.min(F.struct("d1", "d2", "first", "last")).alias("r"), F.first("n").alias("n"))
    used = written_so_far() - 1
    reps = written(reps.select("r.*", "n", F.monotonically_increasing_id().alias("rep")), "representatives")
    drop_written(docs.sparkSession, first, used)  # samples and contexts: what follows reads marked and reps
    by_text = reps.groupBy(F.col("d1").alias("_1"), F.col("d2").alias("_2")).agg(F.collect_list(F.struct("rep", "first", "last")).alias("runs"))  # of one text
    texts = docs.join(by_text, (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2"))).dropDuplicates(["d1", "d2"])
    single = reps.filter("n = 1").select(F.col("rep").alias("one"), "d1", "d2", "first")
    twice = _strings(texts, length, by_word).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("h", "g"))).filter("c > 1").select("rep", "shift")
    hit = twice.join(single, F.col("rep") == F.col("one")).select("d1", "d2", F.struct((F.col("first") + F.col("shift")).alias("first"), (F.col("first") + F.col("shift")).alias("last")).alias("run"))
    return settled.union(hit).groupBy("d1", "d2").agg(F.collect_set("run").alias("runs"))  # of one text


_SHOWN = {"kept_bytes": (BinaryType(), pa.binary(), bytes), "kept_sha256": (StringType(), pa.string(), lambda x: hashlib.sha256(x).hexdigest()), "kept_text": (StringType(), pa.string(), lambda x: x.decode("utf-8", "ignore"))}
_ADDED = [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType())]


def _intervals(runs: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, first, last) of all runs of a column of lists."""
    flat = pc.list_flatten(runs)
    return pc.list_parent_indices(runs).to_numpy(), *(pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("first", "last"))


def _spans(row: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of rows laid end to end -> (row, first, end) of their unions' maximal runs, in order."""
    order = np.argsort(first, kind="stable")
    row, first, end = row[order], first[order], np.maximum.accumulate(end[order])
    new = np.ones(len(row), bool)
    new[1:] = (first[1:] > end[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    return row[head], first[head], end[np.append(head[1:], len(row)) - 1] if len(row) else end


def _left(raw: bytes, offsets: np.ndarray, row: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The bytes of every row outside the spans."""
    bounds, at = offsets.tolist(), np.searchsorted(row, np.arange(len(offsets))).tolist()
    first, end = first.tolist(), end.tolist()
    return [b"".join(raw[x:y] for x, y in zip([a, *end[k0:k1]], [*first[k0:k1], b])) for a, b, k0, k1 in zip(bounds, bounds[1:], at, at[1:])]


def _repeats(part: pa.RecordBatch, offsets: np.ndarray, length: int, n_words: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(row, first, end) of the repeated strings and of the repeated runs of words of rows laid end to end."""
    row, first, last = _intervals(part.column("runs"))
    strings = row, offsets[row] + first, offsets[row] + last + length
    row, first, last = _intervals(part.column("word_runs"))
    own = np.unique(row)
    raw, here = text_bytes(part.column("t").take(pa.array(own)))
    starts, ends, words_of = words(raw, here)
    k = np.searchsorted(own, row)
    shift = offsets[row] - here[k]
    return strings, (row, starts[words_of[k] + first] + shift, ends[words_of[k] + last + max(n_words, 1) - 1] + shift)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", give: str | tuple[str, ...] = "kept_bytes", n_words: int = 0, apart: str | None = None) -> DataFrame:
    """docs without `text`, plus n_bytes, n_removed, n_spans and, by `give` (one or several), the remaining bytes: as
    kept_bytes, as kept_sha256 (lower-case hex) or as kept_text (UTF-8; parts of a character that a cut left over are dropped).

    Every byte that lies in a string of `length` bytes which starts anywhere else too is removed, in all copies; with
    n_words also every run of so many words that stands anywhere else too, from its first word to its last. With `apart` the
    runs of words stay in all of these and go in one more text column of that name, the strings of `length` bytes with them.
    Null and short texts lose nothing; repeated rows count as occurrences of each other; ids and other columns are
    not looked at and stay; columns named like outputs are replaced. An empty table gives an empty result.
    """
    give = (give,) if isinstance(give, str) else give
    names = {f.name for f in _ADDED} | set(give) | {apart}
    keep = [c for c in docs.columns if c != text and c not in names]
    one = [f"__{i}" for i in range(len(keep))]
    base = docs.select(*(F.col(c).alias(a) for c, a in zip(keep, one)), F.col(text).alias("t"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"))
    runs = repeated_runs(base, length, gram).select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "runs")
    joined = base.join(runs, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    if n_words:
        spoken = repeated_runs(base, n_words, max(1, round(n_words * WORD_GRAM)), by_word=True).select(F.col("d1").alias("g1"), F.col("d2").alias("g2"), F.col("runs").alias("word_runs"))
        joined = joined.join(spoken, (F.col("d1") == F.col("g1")) & (F.col("d2") == F.col("g2")), "left")
    else:
        joined = joined.withColumn("word_runs", F.lit(None).cast("array<struct<first:bigint,last:bigint>>"))
    joined = joined.select(*one, "t", "runs", "word_runs")
    added = [*(StructField(g, _SHOWN[g][0]) for g in give), *_ADDED, *([StructField(apart, StringType())] if apart else [])]
    schema = StructType([*base.select(*one).schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            whole, offsets = text_bytes(part.column("t"))
            raw = whole.tobytes()
            strings, spoken = _repeats(part, offsets, length, n_words)
            both = _spans(*(np.concatenate(x) for x in zip(strings, spoken)))
            row, first, end = gone = _spans(*strings) if apart else both
            kept = _left(raw, offsets, *gone)
            head = [pa.array([_SHOWN[g][2](x) for x in kept], _SHOWN[g][1]) for g in give]
            removed = np.bincount(row, weights=end - first, minlength=len(kept)).astype(np.int64)
            counts = [pa.array(x.astype(np.int64)) for x in (np.diff(offsets), removed, np.bincount(row, minlength=len(kept)))]
            last = [pa.array([x.decode("utf-8", "ignore") for x in _left(raw, offsets, *both)], pa.string())] if apart else []
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in one), *head, *counts, *last], names=schema.names)

    return joined.mapInArrow(run, schema).withColumnsRenamed(dict(zip(one, keep)))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and `text` follow the repeated strings of 400 bytes alone; text_51_words is what is left of the
    text when repeated runs of 51 words go too, however few bytes they have."""
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), give=("kept_sha256", "kept_text"), n_words=51, apart="text_51_words")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"), "text_51_words")
