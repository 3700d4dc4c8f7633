"""Language-model scoring with a hierarchical Pitman-Yor process.

A leaf restaurant is a context: the word before, or the start of the text. All leaves share the root as their parent, whose
base is uniform over the training words and one unknown word. A word's customers sit in the restaurant of their context;
each table opened there is a customer of the root.

Seating is sampled by Gibbs. A step takes one customer of a word out of a restaurant, drawn among all of that word there,
and seats it again given all others: at one of the word's tables or at a new one. A sweep makes ceil(sqrt(c)) steps at every
pair of context and word, c being its customers (random scan, the same rule at every size), and the first seating is drawn
from the steps' own law for many customers, so that large pairs start where they stay. Between sweeps the root is seated anew; between rounds, words
and contexts exchange their totals. Concentrations follow from the seating, discounts from the counts. Every round gives one
sample, and predictive probabilities are averaged over the samples.

How it is spread: a pair (context, word) lives in a bucket of its word, so what the root needs is at hand; a bucket holds
about BUCKET tokens, and words that are more frequent (by a sample of the texts; nothing but the balance depends on it) are
split by context. Contexts meet in slices: a bucket sends each slice its contexts with their sums, once each, and gets the
totals back; a frequent context is one number of every bucket and no group of its own. Blocks of texts send each bucket
their pairs as packed arrays and get sums by text back. Everything that is gathered grows with the corpus; what goes to the
driver is a few totals and the split words.

Words are known by 64 bits of hash, contexts by 48. Random numbers come from bucket and round, so a task can be repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Parts, drop_written, free_shuffles, keeping_memory, lower_ascii, slices, table, text_bytes, words, written, written_so_far, xxh64

#: hash of the end token, which no word has but by chance; as a context it is the start of a text
END = np.uint64(0x9D39247E33776D41)
BUCKET = 2_000_000
BLOCK_BYTES = 8 << 20
#: one text of so many is looked at for frequent words
SAMPLE = 32
PAIRS, STATE, REPLY, ASK, MESSAGE, STAT, SPLIT = range(7)
ROW = "bucket long, kind int, at long, data binary, carried binary, s0 double, s1 double, s2 double, s3 double, s4 double"
NAMES = [c.split()[0] for c in ROW.split(", ")]
TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}[c.split()[1]] for c in ROW.split(", ")]
_U = np.uint64


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays, byte by byte in planes, compressed."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [len(a).to_bytes(8, "little"), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()]
    data = b"".join(parts)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    data, at, out = pa.decompress(memoryview(data)[8:], decompressed_size=size, codec="zstd", asbytes=True), 0, []
    for kind in kinds:
        n, size = int.from_bytes(data[at : at + 8], "little"), np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at + 8).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel() if n else np.zeros(0, kind))
        at += 8 + n * size
    return out


def _steps(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=sorted_.dtype.type(0))


def _rows(rows: list[dict]) -> pa.Table:
    return pa.table([pa.array([r.get(n) for r in rows], t) for n, t in zip(NAMES, TYPES)], names=NAMES)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, row) of every token of the texts, ends included, in order of rows."""
    raw, offsets = text_bytes(texts)
    raw = lower_ascii(raw)
    starts, ends, first = words(raw, offsets)
    n, rows = len(starts), len(texts)
    h, row = np.full(n + rows, END), np.repeat(np.arange(rows), np.diff(first) + 1)
    last = np.cumsum(np.diff(first) + 1) - 1
    inside = np.ones(n + rows, bool)
    inside[last] = False
    h[inside] = xxh64(raw, starts, ends)
    context = np.concatenate([[END], h[:-1]])  # what ends one text starts the next
    return h, context >> _U(16), row


# ---- seating ----


def first_seating(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Table sizes of c >= 1 customers of each item, end to end, and each item's number of tables. New tables have weight a,
    so seatings have weight a ** tables and each table of n the weight (1 - d)(2 - d)...(n - 1 - d). For many customers the
    tables but one are then Poisson(a / d) in number, and of sizes n with a chance over n of n ** -d / gamma(1 - d); steps
    of `gibbs` bring few customers to their own law."""
    t = 1 + np.minimum(rng.poisson(np.minimum(a / d, 1e12)), c - 1).astype(np.int64)
    first = np.cumsum(t) - t
    item = np.repeat(np.arange(len(c)), t)
    u = rng.random(len(item))
    size = np.where(u < d, 1.0, np.ceil((np.maximum(u - d, 1e-18) / (1 - d) * math.gamma(1 - d)) ** (-1 / d)))
    # the later tables take at most what leaves one for each other, the first takes the rest
    size = np.minimum(size, ((c - t) // t + 1)[item])
    size[first] = 0
    size[first] = c - np.add.reduceat(size, first)
    return size.astype(np.int64), t


def gibbs(size: np.ndarray, t: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One random-scan sweep over items whose tables stand end to end in `size`: ceil(sqrt(c)) times, one of an item's c
    customers is taken out and seated again, at a table of n others with weight n - d or at a new one with weight a."""
    if not len(t):
        return size, t
    start = np.concatenate([[0], np.cumsum(t)])
    c = np.add.reduceat(size, start[:-1])
    order = np.argsort(-c, kind="stable")  # those with most steps first
    number = np.empty(len(t), np.int64)
    number[order] = np.arange(len(t))
    seat = np.argsort(np.repeat(number, t), kind="stable")
    n, c, a, slots = size[seat], c[order], a[order], t[order].copy()
    steps = np.ceil(np.sqrt(c)).astype(np.int64)
    tables = slots.copy()
    for k in range(int(steps[0])):
        m = int(np.searchsorted(-steps, -k, side="left"))  # items with more than k steps
        first = np.concatenate([[0], np.cumsum(slots[:m])])
        head = n[: first[-1]]
        before = np.concatenate([[0], np.cumsum(head)])
        out = np.searchsorted(before, before[first[:-1]] + (rng.random(m) * c[:m]).astype(np.int64), side="right") - 1
        head[out] -= 1
        closed = head[out] == 0
        tables[:m] -= closed
        rest = c[:m] - 1 - d * tables[:m]
        x = rng.random(m) * (rest + a[:m])
        new = x >= rest
        weight = np.concatenate([[0.0], np.cumsum(np.where(head > 0, head - d, 0.0))])
        to = np.searchsorted(weight, weight[first[:-1]] + x, side="right") - 1
        to = np.clip(to, first[:-1], first[1:] - 1)
        back = ~new & (head[to] == 0)  # rounding at the edge of a closed table
        for i in np.flatnonzero(back).tolist():
            to[i] = first[i] + int(np.argmax(head[first[i] : first[i + 1]]))
        to[new & closed] = out[new & closed]
        tables[:m] += new
        fits = ~new | closed
        head[to[fits]] += 1
        grown = np.flatnonzero(~fits)
        if len(grown):
            n = np.insert(n, first[grown + 1], 1)
            slots[grown] += 1
    keep = n > 0
    item = np.repeat(np.arange(len(t)), slots)[keep]
    back = np.argsort(order[item], kind="stable")
    return n[keep][back], tables[number]


def _seated(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator, sweeps: int = 2) -> np.ndarray:
    """Tables of so many customers, seated from the start."""
    size, t = first_seating(c, a, d, rng)
    for _ in range(sweeps):
        size, t = gibbs(size, t, a, d, rng)
    return t


# ---- the model ----


@dataclass
class Totals:
    """What all buckets must know of a round: customers and tables of the root, and both of the split words."""

    customers: float = 0.0
    tables: float = 0.0
    split: dict[int, tuple[float, float]] = field(default_factory=dict)


@dataclass
class Model:
    V: int = 0
    N: int = 0
    buckets: int = 1
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pieces: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hot_counts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    d_root: float = 0.5
    d: float = 0.5
    theta_root: float = 10.0
    #: concentration of the leaves in each round
    theta: list[float] = field(default_factory=list)
    samples: list[Totals] = field(default_factory=list)

    def split_of(self, w: np.ndarray) -> np.ndarray:
        """Index of each word among the split ones, -1 for the others."""
        if not len(self.hot):
            return np.full(len(w), -1)
        at = np.minimum(np.searchsorted(self.hot, w), len(self.hot) - 1)
        return np.where(self.hot[at] == w, at, -1)

    def bucket(self, w: np.ndarray, u: np.ndarray) -> np.ndarray:
        b = ((w >> _U(32)) * _U(self.buckets) >> _U(32)).astype(np.int64)
        s = self.split_of(w)
        many = np.flatnonzero(s >= 0)
        b[many] = (b[many] + (u[many] % self.pieces[s[many]].astype(np.uint64)).astype(np.int64)) % self.buckets
        return b

    def root(self, customers: np.ndarray, tables: np.ndarray, now: Totals) -> np.ndarray:
        """Probability of words with so many customers and tables at the root."""
        return (customers - self.d_root * tables + (self.theta_root + self.d_root * now.tables) / (self.V + 1)) / (self.theta_root + now.customers)


class Bucket:
    """The pairs of a bucket, sorted by word and context: words W with their number of pairs, the contexts U that occur in
    it, of each pair the place of its context in U, and its training count."""

    def __init__(self, data: bytes, model: Model):
        w, k, u, self.ctx, self.c = _unpack(data, np.uint64, np.int32, np.uint64, np.int32, np.int64)
        self.W, self.U = np.cumsum(w, dtype=np.uint64), np.cumsum(u, dtype=np.uint64)
        self.word = np.repeat(np.arange(len(self.W)), k)
        self.live = np.flatnonzero(self.c > 1)
        self.hot = model.split_of(self.W)
        self.count = np.bincount(self.word, self.c, len(self.W))
        if len(model.hot):
            self.count = np.where(self.hot >= 0, model.hot_counts[self.hot], self.count)

    def tables(self, t: np.ndarray) -> np.ndarray:
        """Tables of every pair; t: those of the live ones."""
        out = (self.c > 0).astype(np.int64)
        out[self.live] = t
        return out

    def dishes(self, tables: np.ndarray, r: np.ndarray | None, now: Totals, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each word at the root; those of split words are the totals."""
        customers = np.bincount(self.word, tables, len(self.W))
        roots = (customers > 0).astype(np.float64) if r is None else r.astype(np.float64)
        for i in np.flatnonzero(self.hot >= 0).tolist():
            customers[i], roots[i] = now.split.get(int(model.hot[self.hot[i]]), (0.0, 0.0))
        return customers, roots

    def messages(self, bucket: int, buckets: int, tables: np.ndarray, kind: int = MESSAGE) -> Iterator[dict]:
        """What each slice of contexts is told: contexts, customers, tables."""
        c, t = (np.bincount(self.ctx, x, len(self.U)).astype(np.int64) for x in (self.c, tables))
        edge = np.searchsorted((self.U * _U(buckets) >> _U(48)).astype(np.int64), np.arange(buckets + 1))
        for s in np.flatnonzero(np.diff(edge)).tolist():
            a, z = edge[s], edge[s + 1]
            yield {"bucket": bucket, "kind": kind, "at": s, "data": _pack(_steps(self.U[a:z]), c[a:z], t[a:z])}

    def replies(self, rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each context in all, from the answers of the slices."""
        got = [_unpack(data, np.int64, np.int64) for _, data in sorted(rows)]
        return tuple(np.concatenate([np.zeros(0, np.int64), *(g[k] for g in got)]).astype(np.float64) for k in (0, 1))

    def probabilities(self, states: list[tuple[int, bytes]], replies: list[tuple[int, bytes]], model: Model) -> np.ndarray:
        """Probability of each pair's word in its context, averaged over the samples. Answers stand at sample * 2**32 + slice."""
        p = np.zeros(len(self.c))
        for number, data in states:
            now, theta = model.samples[number], model.theta[number]
            t, _, r = _unpack(data, np.int64, np.int64, np.int64)
            c_u, T_u = (x[self.ctx] for x in self.replies([(at, d) for at, d in replies if at >> 32 == number]))
            tables = self.tables(t)
            root = model.root(*self.dishes(tables, r, now, model), now)[self.word]
            p += np.where(c_u > 0, (self.c - model.d * tables + (theta + model.d * T_u) * root) / (theta + c_u), root)
        return p / max(1, len(states))

    def split_rows(self, bucket: int, tables: np.ndarray) -> Iterator[dict]:
        own = np.bincount(self.word, tables, len(self.W)), np.bincount(self.word, self.c, len(self.W))
        for i in np.flatnonzero(self.hot >= 0).tolist():
            yield {"bucket": bucket, "kind": SPLIT, "at": int(self.W[i].view(np.int64)), "s0": float(own[0][i]), "s1": float(own[1][i])}


def _ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of x in order, and the place of each x among them."""
    order = np.argsort(x)
    held = x[order]
    new = np.ones(len(x), bool)
    new[1:] = held[1:] != held[:-1]
    rank = np.empty(len(x), np.int64)
    rank[order] = np.cumsum(new) - 1
    return held[new], rank


def _sorted_pairs(w: np.ndarray, u: np.ndarray, by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of pairs by word and context (within `by`), given the ranks of both, and where a new one begins. They are sorted
    as one number, if it has the bits."""
    bits = [int(x.max(initial=0)).bit_length() for x in (u, w, w[:0] if by is None else by)]
    if sum(bits) > 63:
        order = np.lexsort((u, w) if by is None else (u, w, by))
        key = np.stack([w, u])[:, order]
        return order, np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])[: len(w)]
    key = w << bits[0] | u
    if by is not None:
        key |= by << bits[0] + bits[1]
    order = np.argsort(key)
    key = key[order]
    return order, np.concatenate([[True], key[1:] != key[:-1]])[: len(w)]


def _blocks(docs: DataFrame, model: Model, asks: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of kind ASK: what a block of texts has in a bucket: words, pairs a word, contexts, and of each pair its training
    tokens (asks: all its tokens, and the texts they stand in)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @keeping_memory
    def block(part: pa.RecordBatch, number: int) -> list[pa.RecordBatch]:
        m = shared.value
        w, u, row = tokens(part.column("__t"))
        learn = np.asarray(part.column("__learn").to_pylist(), bool)
        b = m.bucket(w, u)
        distinct, rank = _ranks(w)
        # the rank of a context is that of the word before, by the bits that a context has
        before = np.append(np.searchsorted(distinct, END), rank[:-1])
        order, new = _sorted_pairs(rank, np.cumsum(np.diff(distinct >> _U(16), prepend=_U(0)) > 0)[before], b)
        w, u, row, b = w[order], u[order], row[order], b[order]
        head = np.flatnonzero(new)
        bounds = np.append(head, len(w))
        trained = np.add.reduceat(learn[row].astype(np.int64), head)
        many = np.diff(bounds)
        w, u, b = w[head], u[head], b[head]
        edge = np.searchsorted(b, np.arange(m.buckets + 1))
        out = []
        for s in np.flatnonzero(np.diff(edge)).tolist():
            a, z = edge[s], edge[s + 1]
            fresh = np.flatnonzero(np.concatenate([[True], w[a + 1 : z] != w[a : z - 1]]))
            arrays = [_steps(w[a:z][fresh]), np.diff(np.append(fresh, z - a)).astype(np.int32), u[a:z]]
            r = {"bucket": s, "kind": ASK, "at": number}
            if asks:
                rows = row[bounds[a] : bounds[z]]
                r |= {"data": _pack(*arrays, many[a:z].astype(np.int32), rows.astype(np.int32)), "s0": float(part.num_rows)}
            else:
                r["data"] = _pack(*arrays, trained[a:z])
            out.append(r)
        if asks and out:
            sink = pa.BufferOutputStream()
            length = np.bincount(row, minlength=part.num_rows)
            held = pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(length.astype(np.int64))], names=[*carry, "n_tokens"])
            with pa.ipc.new_stream(sink, held.schema) as stream:
                stream.write_batch(held)
            out[number % len(out)]["carried"] = sink.getvalue().to_pybytes()
        return _rows(out).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for k, part in enumerate(slices(batches, "__t", BLOCK_BYTES)):
            yield from block(part, number + k)

    return docs.mapInArrow(run, ROW)


def _frequent(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that would fill a quarter of a bucket or more, by a sample of the texts, and into how many pieces they go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__t", BLOCK_BYTES):
            w, n = np.unique(tokens(part.column("__t"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["w", "n"])

    some = docs.filter(F.pmod(F.xxhash64("__t"), F.lit(SAMPLE)) == 0).select("__t").mapInArrow(run, "w long, n long")
    found = some.groupBy("w").agg((F.sum("n") * SAMPLE).alias("n")).filter(F.col("n") > BUCKET // 4).collect()  # a few words a bucket
    w = np.array([r["w"] for r in found], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in found], np.float64)
    order = np.argsort(w)
    return w[order], np.clip(np.ceil(n[order] / (BUCKET // 4)), 1, buckets).astype(np.int64)


def _merged(model: Model):
    """Pairs of a bucket from what all blocks have in it."""

    @keeping_memory
    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        got = [_unpack(d, np.uint64, np.int32, np.uint64, np.int64) for d in group.column("data").to_pylist()]
        w = np.concatenate([np.repeat(np.cumsum(g[0], dtype=np.uint64), g[1]) for g in got])
        u, c = (np.concatenate([g[k] for g in got]) for k in (2, 3))
        (W, w), (U, u) = _ranks(w), _ranks(u)
        order, new = _sorted_pairs(w, u)
        head = np.flatnonzero(new)
        w, ctx, c = w[order[head]], u[order[head]], np.add.reduceat(c[order], head)
        data = _pack(_steps(W), np.bincount(w).astype(np.int32), _steps(U), ctx.astype(np.int32), c)
        pairs = Bucket(data, model)
        tables = (c > 0).astype(np.int64)
        kinds = np.bincount(pairs.word, tables, len(pairs.W))[pairs.hot < 0]
        stat = {"bucket": bucket, "kind": STAT, "s0": float(c.sum()), "s1": float((kinds > 0).sum()), "s2": float((c == 1).sum()), "s3": float((c == 2).sum()), "s4": float(tables.sum())}
        ends = {"bucket": bucket, "kind": STAT, "at": 1, "s0": float((kinds == 1).sum()), "s1": float((kinds == 2).sum())}
        return _rows([{"bucket": bucket, "kind": PAIRS, "data": data}, stat, ends, *pairs.messages(bucket, model.buckets, tables), *pairs.split_rows(bucket, tables)])

    return run


def _answer(theta: float, d: float):
    """A slice's answers: customers and tables of each context over all buckets."""

    @keeping_memory
    def run(group: pa.Table) -> pa.Table:
        got = [_unpack(x, np.uint64, np.int64, np.int64) for x in group.column("data").to_pylist()]
        u = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got])
        _, at = np.unique(u, return_inverse=True)
        c, t = (np.bincount(at, np.concatenate([g[k] for g in got])) for k in (1, 2))
        ends = np.cumsum([len(g[0]) for g in got])
        out = [{"bucket": b, "kind": REPLY, "at": s, "data": _pack(c[at[z - len(g[0]) : z]].astype(np.int64), t[at[z - len(g[0]) : z]].astype(np.int64))} for b, s, g, z in zip(group.column("bucket").to_pylist(), group.column("at").to_pylist(), got, ends)]
        # expected values of the auxiliary variables of the concentration
        c, t = c[c > 1], t[c > 1]
        y = (theta / d * np.log((theta / d + t - 0.5) / (theta / d + 0.5))).sum()
        out.append({"bucket": -1, "kind": STAT, "s0": float(np.maximum(y, 0)), "s1": float(np.log((theta + c - 0.5) / (theta + 0.5)).sum())})
        return _rows(out)

    return run


def _parts(group: pa.Table, *kinds: int) -> list[list[tuple[int, bytes]]]:
    held: dict[int, list] = {k: [] for k in kinds}
    for k, at, data in zip(*(group.column(c).to_pylist() for c in ("kind", "at", "data"))):
        if k in held:
            held[k].append((at, data))
    return [held[k] for k in kinds]


def _sampled(model: Model, before: Totals, theta: float, number: int, sweeps: int):
    """One round of a bucket: sweeps over its pairs, and what it tells the others."""

    @keeping_memory
    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        pairs_, states, replies = _parts(group, PAIRS, STATE, REPLY)
        if not pairs_:
            return _rows([])
        pairs = Bucket(pairs_[0][1], model)
        rng = np.random.default_rng([20240229, number, bucket])
        _, T = pairs.replies(replies)
        c, live, word = pairs.c[pairs.live], pairs.live, pairs.word
        t, size, r = _unpack(states[0][1], np.int64, np.int64, np.int64) if states else (np.ones(len(live), np.int64), None, None)
        pull = (theta + model.d * T[pairs.ctx[live]]) if len(live) else np.zeros(0)
        customers, roots = pairs.dishes(pairs.tables(t), r, before, model)
        base = np.full(len(pairs.W), (model.theta_root + model.d_root * before.tables) / (model.V + 1))
        for _ in range(sweeps):
            a = pull * model.root(customers, roots, before)[word[live]]
            if size is None:
                size, t = first_seating(c, a, model.d, rng)
            size, t = gibbs(size, t, a, model.d, rng)
            customers, _ = pairs.dishes(pairs.tables(t), None, before, model)
            own = np.flatnonzero((customers > 0) & (pairs.hot < 0))
            roots = np.where(pairs.hot < 0, 0.0, roots)
            if len(own):
                roots[own] = _seated(customers[own], base[own], model.d_root, rng)
        tables = pairs.tables(t)
        cold = pairs.hot < 0
        stat = {"bucket": bucket, "kind": STAT, "s0": float(tables.sum()), "s1": float(roots[cold].sum())}
        state = {"bucket": bucket, "kind": STATE, "at": number, "data": _pack(t, size if size is not None else t, np.where(cold, roots, 0).astype(np.int64))}
        return _rows([state, stat, *pairs.messages(bucket, model.buckets, tables), *pairs.split_rows(bucket, tables)])

    return run


def _looked_up(model: Model):
    """Sums of each text of a block over a bucket: score, base score, known tokens."""

    @keeping_memory
    def run(group: pa.Table) -> pa.Table:
        pairs_, states, replies = _parts(group, PAIRS, STATE, REPLY)
        pairs = Bucket(pairs_[0][1], model)
        logs = np.log10(pairs.probabilities(states, replies, model))
        base = np.log10(pairs.count + 1.0) - np.log10(model.N + model.V + 1.0)
        key = pairs.word.astype(np.int64) * (len(pairs.U) + 1) + pairs.ctx
        out = []
        for kind, block, data, carried, n in zip(*(group.column(c).to_pylist() for c in ("kind", "at", "data", "carried", "s0"))):
            if kind != ASK:
                continue
            w, k, u, many, row = _unpack(data, np.uint64, np.int32, np.uint64, np.int32, np.int32)
            word = np.repeat(np.searchsorted(pairs.W, np.cumsum(w, dtype=np.uint64)), k)
            spot = np.searchsorted(key, word * (len(pairs.U) + 1) + np.searchsorted(pairs.U, u))
            sums = [np.bincount(row, np.repeat(x, many), int(n)) for x in (logs[spot], base[word], (pairs.count[word] > 0).astype(float))]
            out.append((block, carried, *(x.tobytes() for x in sums)))
        kinds = [pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["block", "carried", "score", "base", "known"])

    return run


def _round_totals(rows: Parts, model: Model, number: int) -> Totals:
    """Totals after a round; the split words' tables at the root are seated here, a few words a bucket."""
    s = rows.of(STAT).agg(F.sum("s0"), F.sum("s1")).first()
    split = rows.of(SPLIT).groupBy("at").agg(F.sum("s0").alias("t")).collect()
    now = Totals(float(s[0] or 0), float(s[1] or 0))
    w = np.array([r["at"] for r in split], np.int64).view(np.uint64)
    customers = np.array([r["t"] for r in split], float)
    order = np.argsort(w)
    w, customers = w[order], customers[order]
    some = np.flatnonzero(customers > 0)
    roots = np.zeros(len(w))
    if len(some):
        base = np.full(len(some), (model.theta_root + model.d_root * max(now.tables, 1.0)) / (model.V + 1))
        roots[some] = _seated(customers[some], base, model.d_root, np.random.default_rng([7, number]))
    now.tables += float(roots.sum())
    now.split = {int(a): (float(b), float(c)) for a, b, c in zip(w, customers, roots)}
    return now


def seated(rows: DataFrame, rounds: int, sweeps: int) -> tuple[Model, DataFrame]:
    """Seatings for the texts `__t` of rows, learnt from those marked `__learn`: the model, and the pairs, seatings and
    contexts' totals of every bucket."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("__t")), F.lit(0)) + F.count(F.lit(1))).first()[0]
    model = Model(buckets=min(1 << 30, max(4, -(-int(size) // (6 * BUCKET)))))
    model.hot, model.pieces = _frequent(rows, model.buckets)
    model.hot_counts = np.zeros(len(model.hot))
    pairs = Parts(_blocks(rows, model, asks=False).groupBy("bucket").applyInArrow(_merged(model), ROW), "kind", "pairs")
    zero = lambda n: [F.coalesce(F.sum(f"s{k}"), F.lit(0.0)) for k in range(n)]
    s = pairs.of(STAT).filter("at is null").agg(*zero(5)).first()
    k = pairs.of(STAT).filter("at = 1").agg(*zero(2)).first()
    split = {r["at"]: (r["t"], r["c"]) for r in pairs.of(SPLIT).groupBy("at").agg(F.sum("s0").alias("t"), F.sum("s1").alias("c")).collect()}
    model.hot_counts = np.array([split.get(int(w), (0, 0))[1] for w in model.hot.view(np.int64)], float)
    model.N, model.V = int(s[0]), int(s[1]) + int((model.hot_counts > 0).sum())
    share = lambda one, two: min(0.95, max(0.05, (one + 1) / (one + 2 * two + 2)))
    model.d, model.d_root = share(s[2], s[3]), share(k[0], k[1])
    now = Totals(float(s[4]), float(model.V), {int(np.int64(w).view(np.uint64)): (float(t), float(t > 0)) for w, (t, _) in split.items()})

    def answers(told: Parts, theta: float) -> Parts:
        """Totals of the contexts; the messages they come from go."""
        found = Parts(told.of(MESSAGE).groupBy("at").applyInArrow(_answer(theta, model.d), ROW), "kind", "totals")
        told.drop(MESSAGE)
        return found

    theta, state, final = 1.0, None, pairs.of(PAIRS)
    replies = answers(pairs, theta)
    for number in range(rounds):
        y, x = replies.of(STAT).agg(*zero(2)).first()
        theta = min(1e4, max(1e-2, (1 + y) / (1 + x)))
        known = pairs.of(PAIRS).unionByName(replies.of(REPLY))
        told = Parts((known if state is None else known.unionByName(state)).groupBy("bucket").applyInArrow(_sampled(model, now, theta, number, sweeps), ROW), "kind", "round")
        if not number:
            replies.drop(REPLY)  # totals of the first tables, of no sample
        now, state = _round_totals(told, model, number), told.of(STATE)
        model.samples.append(now)
        model.theta.append(theta)
        replies = answers(told, theta)
        final = final.unionByName(state).unionByName(replies.of(REPLY).withColumn("at", F.col("at") + (number << 32)))
    return model, final


def score_texts(docs: DataFrame, learn: F.Column, carry: tuple[str, ...], text: str = "text", rounds: int = 2, sweeps: int = 3) -> tuple[DataFrame, Model]:
    """(carry..., n_tokens, n_known, base_score, score, perplexity) for every row of docs, and the model, which learns from
    the rows for which `learn` holds (null: not).

    Null and blank texts are one end token. Ids are not looked at: repeated rows are learnt and scored each. Other columns
    than `carry` go. Without a training row every word is unknown. An empty table gives an empty result.
    """
    first = written_so_far()
    spark = docs.sparkSession
    rows = docs.select(*carry, F.col(text).alias("__t"), F.coalesce(learn, F.lit(False)).alias("__learn"))
    model, final = seated(rows, rounds, sweeps)
    parts = _blocks(rows, model, asks=True, carry=carry).unionByName(final).groupBy("bucket").applyInArrow(_looked_up(model), "block long, carried binary, score binary, base binary, known binary")
    meta = rows.select(*carry).schema

    def add(group: pa.Table) -> pa.Table:
        sums = [np.sum([np.frombuffer(x) for x in group.column(k).to_pylist()], axis=0) for k in ("score", "base", "known")]
        kept = pa.ipc.open_stream(next(x for x in group.column("carried").to_pylist() if x is not None)).read_all()
        n = kept.column("n_tokens").to_numpy()
        cols = [*(kept.column(c) for c in carry), kept.column("n_tokens"), pa.array(np.rint(sums[2]).astype(np.int64)), pa.array(sums[1]), pa.array(sums[0]), pa.array(10 ** np.minimum(-sums[0] / n, 300))]
        return pa.table(cols, names=[*carry, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in meta), "n_tokens long, n_known long, base_score double, score double, perplexity double"])
    out = written(parts.groupBy("block").applyInArrow(add, schema), "scores")
    drop_written(spark, first, written_so_far() - 1)
    free_shuffles(spark)
    return out, model


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    found, model = score_texts(docs.withColumn("held_out", held), ~F.col("held_out"), ("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.N).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
