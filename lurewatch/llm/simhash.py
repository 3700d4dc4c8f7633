"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 two-bit segments; its embedding is the vector of their bit counts. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints, because one flipped
bit moves one count by one. Counts are held in thermometer code (0 -> 00, 1 -> 01, 2 -> 11), so that distance is
`bit_count(a ^ b)` of two longs.

The grid cuts the 32 dimensions into radius + agree runs. Within Manhattan distance `radius` at most `radius` runs
differ, so `agree` runs match at least: a cell is the choice of so many runs and their counts, and all pairs within
the radius share a cell (known by a hash; where two cells collide, a pair is looked at for nothing). A larger `agree`
makes more cells of fewer chance meetings; `cells_to_agree` takes it from the number of fingerprints, so it grows with
the logarithm of the corpus. Members of cells are shuffled twice, once for their number (pre-aggregated) and once to meet.
Work stays in proportion to the links that matter:

1. equal fingerprints are one node, however many documents carry them;
2. cells of CROWD members at most are compared pair by pair as they stream by in order; what a cell links is a star;
3. members of larger cells are first compared with two members of the cell alone, its least and its largest;
4. only larger cells that still hold more than one component are joined with themselves, across components, the members of
   the largest component on one side alone.

Steps 2 and 4 compare every remaining pair, so no link that could join two components is lost.

`similar` links texts by the similarity of their shingle sets instead (0.8 or more): candidates share one of the
rarest shingles of both, which every pair of that similarity does; then sizes, a wide fingerprint of the same kind with
the Manhattan bound and the distance, and the exact similarity of each candidate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SALTS, looked_up, lower_ascii, slices, table, text_bytes, words, written, xxh64
from .components import components
from .decontaminate import sized
from .rows import unused

_LANES = np.array([sum(1 << (8 * j) for j in range(8) if b >> j & 1) for b in range(256)], np.uint64)
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprint of each row from its run hashes[bounds[i]:bounds[i + 1]]; an empty run gives 0."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    blocks = -(-sizes[full] // 255)
    first = np.concatenate([[0], np.cumsum(blocks)])
    inner = np.arange(first[-1]) - np.repeat(first[:-1], blocks)
    cuts = np.repeat(bounds[:-1][full], blocks) + 255 * inner
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, k]], cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first[:-1], axis=0)
        over = counts * 2 > sizes[full][:, None]
        out[full] |= (over * _BITS[8 * k : 8 * k + 8]).sum(axis=1, dtype=np.uint64)
    return out


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's shingles of `width` words (fewer words: all of them; none: no shingle), the n + 1 offsets
    of the texts, and a hash of each text's whole word sequence (no word: 0)."""
    raw, offsets = text_bytes(texts)
    raw = lower_ascii(raw)
    starts, ends, first = words(raw, offsets)
    whole = np.zeros(len(texts), np.uint64)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), whole
    # the words of all rows, joined by single spaces
    size = ends - starts
    new = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(new[-1], 32, np.uint8)
    step = np.ones(int(size.sum()), np.int64)
    inside = np.concatenate([[0], np.cumsum(size)[:-1]])
    step[inside] = starts - np.concatenate([[0], ends[:-1] - 1])
    source = np.cumsum(step)
    step[inside] = new[:-1] - np.concatenate([[0], new[:-2] + size[:-1] - 1])
    joined[np.cumsum(step)] = raw[source]
    n = np.diff(first)
    runs = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    head = np.arange(bounds[-1]) - np.repeat(bounds[:-1], runs) + np.repeat(first[:-1], runs)
    tail = head + np.repeat(np.minimum(n, width), runs) - 1
    some = np.flatnonzero(n)
    whole[some] = xxh64(joined, new[first[some]], new[first[some + 1]] - 1)
    return xxh64(joined, new[head], new[tail] + size[tail]), bounds, whole


def fingerprint_array(texts: pa.Array, width: int = 4) -> np.ndarray:
    """SimHash of each text over its shingles, repeats included; a text without words has 0."""
    return _majority(*shingles(texts, width)[:2])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """docs with a column `fp` (long, the 64 bits of the fingerprint); null texts count as empty."""
    keep = [c for c in docs.columns if c not in (text, "fp")]
    schema = docs.select(*keep, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__t"):
            fps = fingerprint_array(part.column("__t"), width)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, F.col(text).alias("__t")).mapInArrow(run, schema)


_ODD = 0x5555555555555555


def embedding(fp) -> F.Column:
    """Bit counts of the 32 two-bit segments in thermometer code."""
    up = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(up).bitwiseAND(F.lit(_ODD))
    both = fp.bitwiseAND(up).bitwiseAND(F.lit(_ODD))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def cell_masks(radius: int, agree: int) -> list[int]:
    """One mask over the embedding for each choice of `agree` of the radius + agree runs of segments."""
    runs = [sum(3 << (2 * int(s)) for s in part) for part in np.array_split(np.arange(32), radius + agree)]
    return [_signed(sum(c)) for c in combinations(runs, agree)]


def _close(a: str, b: str, radius: int) -> F.Column:
    """The Manhattan bound first, then the exact distance."""
    bound = F.bit_count(embedding(F.col(a)).bitwiseXOR(embedding(F.col(b)))) <= radius
    return bound & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius)


#: members up to which all pairs of a cell are compared where it streams by; what a meeting costs, a cell of a fingerprint (two
#: shuffled rows) being 1
CROWD, MEETING = 512, 1 / 30


def cells_to_agree(n: int, radius: int) -> int:
    """`agree` of least work for n fingerprints: cells a fingerprint, and what it meets in them by chance (a segment of
    random bits agrees with a chance of 3/8)."""
    cost = lambda a: math.comb(radius + a, radius) * (1 + MEETING * n * 0.375 ** (32 * a / (radius + a)))
    return min(range(1, 29 - radius), key=cost)


def _embedded(fp: np.ndarray) -> np.ndarray:
    """`embedding` of an array."""
    odd, up = np.uint64(_ODD), fp >> np.uint64(1)
    return ((fp | up) & odd) | ((fp & up & odd) << np.uint64(1))


def _stars(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the pairs within the radius of each cell join; rows of a cell stand together."""
    fp = fp.view(np.uint64)
    points, found = _embedded(fp), []
    at, d = np.arange(len(fp)), 0
    while len(at):
        d += 1
        at = at[: np.searchsorted(at, len(fp) - d)]
        at = at[cell[at] == cell[at + d]]
        near = at[np.bitwise_count(points[at] ^ points[at + d]) <= radius]
        near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= radius]
        found.append((near, near + d))
    u, v = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
    least = np.arange(len(fp))
    while len(u):
        low = np.minimum(least[u], least[v])
        if (low == least[u]).all() and (low == least[v]).all():
            break
        np.minimum.at(least, u, low)
        np.minimum.at(least, v, low)
    some = np.flatnonzero(least != np.arange(len(fp)))
    return fp[some].view(np.int64), fp[least[some]].view(np.int64)


def _met(members: DataFrame, radius: int) -> DataFrame:
    """(u, v): links of cells of CROWD members at most, from (cell, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 2  # the last cell, which may go on in the next batch
        links = lambda c, f: pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(c, f, radius)], names=["u", "v"])
        for batch in batches:
            c, f = (np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held))
            last = int(np.flatnonzero(np.diff(c, prepend=c[:1]))[-1:].sum())  # where it begins
            yield links(c[:last], f[:last])
            held = [c[last:], f[last:]]
        yield links(*held)

    return members.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long")


def linked(fps: DataFrame, radius: int = 4, agree: int | None = None) -> DataFrame:
    """Distinct longs `fp` -> (node, root) for all that have a link at `radius` differing bits or fewer."""
    masks = F.array(*[F.lit(m) for m in cell_masks(radius, agree or cells_to_agree(fps.count(), radius))])
    all_ = fps.select("fp", F.posexplode(masks).alias("c", "mask")).select(F.xxhash64("c", embedding(F.col("fp")).bitwiseAND(F.col("mask"))).alias("cell"), "fp")
    ends = all_.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count(F.lit(1)).alias("k")).filter(F.col("k") > CROWD)
    ends = written(ends.select(F.col("cell").alias("m"), "lo", "hi"), "crowded-cells")
    size = ends.count()
    few = looked_up(all_, ends.select("m"), size, F.col("cell"), "m", "left").filter("m is null").select("cell", "fp") if size else all_
    links = written(_met(few, radius), "met")
    if not size:
        return components(links)
    cells = written(looked_up(all_, ends, size, F.col("cell"), "m", "inner").select("cell", "fp", "lo", "hi"), "cells")
    near = [cells.filter((F.col("fp") != F.col(p)) & _close("fp", p, radius)).select(F.col("fp").alias("u"), F.col(p).alias("v")) for p in ("lo", "hi")]
    roots = components(links.union(near[0]).union(near[1]))
    named = written(cells.join(roots, cells.fp == roots.node, "left").select("cell", "fp", F.coalesce("root", "fp").alias("root")), "named")
    # in a cell, pairs that leave out the members of its largest component on one side are all that is needed
    top = named.groupBy("cell", "root").count().groupBy("cell").agg(F.max_by("root", F.struct("count", "root")).alias("top"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    top = written(top.select(F.col("cell").alias("m"), "top"), "mixed")
    open_ = looked_up(named, top, top.count(), F.col("cell"), "m", "inner")
    salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))  # the members of a cell go to so many tasks
    left = open_.filter("root <> top").select("cell", F.col("fp").alias("a"), F.col("root").alias("ra"), "top", F.explode(salts).alias("s"))
    right = open_.select("cell", F.col("fp").alias("b"), F.col("root").alias("rb"), F.pmod("fp", F.lit(SALTS)).alias("s"))
    across = left.join(right, ["cell", "s"]).filter(F.expr("ra <> rb and (rb = top or ra < rb)") & _close("a", "b", radius)).select(F.col("ra").alias("u"), F.col("rb").alias("v"))
    return components(across.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(id, fp, component_id) for every row of docs.

    Null or blank texts have fingerprint 0 and are linked like any other. component_id is the least non-null id of
    the component (null if none has one). Repeated ids and rows stay as they are; other columns are ignored. An
    empty table gives an empty result.
    """
    named = written(fingerprints(docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__x")), "__x", width), "fps")
    nodes = written(named.groupBy("fp").agg(F.min("__id").alias("least")), "nodes")
    roots = linked(nodes.select("fp"), radius)
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(classes, "root").select(F.col("fp").alias("f"), "component_id")
    return named.join(by_fp, F.col("fp") == F.col("f"), "left").select(F.col("__id").alias(id_col), "fp", "component_id")

# ---- near-duplicates by the similarity of shingle sets ----

#: longs of a wide fingerprint; at a similarity of 0.8 about 39 of 256 bits differ, with a deviation of 6
WIDE = 4
_WORDS = [f"f{k}" for k in range(WIDE)]
#: one text of so many is looked at for common shingles; so many are known at most; sets from this size on are compared by bits
SAMPLE, COMMON, SMALL = 32, 1 << 20, 64
#: bytes of text that a step over shingle sets works on; it needs about a hundred times as much memory
SLICE = 1 << 19


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = [np.unique(hashes[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
    return np.concatenate([np.zeros(0, np.uint64), *rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of the independent hashes made of one hash; the first is the hash itself."""
    if k:
        h = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def ordered(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of common in order, and their places in it from 1 on."""
    order = np.argsort(common)
    return common[order], order + 1


def leading(hashes: np.ndarray, bounds: np.ndarray, least: float, common: np.ndarray | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each distinct set hashes[bounds[i]:bounds[i + 1]], and their offsets: n - ceil(least * n) + 1
    of n, in one order of all shingles, those of `common` (or what `ordered` makes of it) last, as they stand in it.

    Sets of a similarity of `least` or more share at least ceil(least * n) shingles of either, so whatever the order, the
    first of those they share is among these of both."""
    sizes = np.diff(bounds)
    rank = np.zeros(len(hashes), np.int64)
    values, places = common if isinstance(common, tuple) else ordered(common)
    if len(values) and len(hashes):
        at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
        rank = np.where(values[at] == hashes, places[at], 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    sorted_ = hashes[np.lexsort((hashes, rank, row))]
    most = np.where(sizes > 0, sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1, 0)
    first = np.arange(len(hashes)) - np.repeat(bounds[:-1], sizes) < np.repeat(most, sizes)
    return sorted_[first], np.concatenate([[0], np.cumsum(most)])


def common_shingles(texts: DataFrame, text: str, width: int) -> np.ndarray:
    """Shingles that stand in many texts, the most frequent last, by a sample of the texts. Only the order of the shingles
    follows from them (rare ones first, so that few texts meet), so no result depends on the sample."""
    some = texts.filter(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0).select(text)
    sets = shingle_sets(some, text, width).dropDuplicates(["node"])
    counts = sets.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    found = counts.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow().column("h").to_numpy()
    return found[::-1].astype(np.int64).view(np.uint64)


def wide_fingerprints(docs: DataFrame, text: str, width: int, least: float | None = None, common: np.ndarray | None = None) -> DataFrame:
    """docs without text, with `node` (a hash of the word sequence) and the fingerprint f0..f3 of its distinct shingles;
    with `least` also their number `n` and the `leading` ones as `cells`."""
    keep = [c for c in docs.columns if c != text]
    added = [F.lit(0).cast("long").alias(c) for c in ("node", *_WORDS)]
    if least is not None:
        added += [F.lit(0).cast("int").alias("n"), F.array(F.lit(0).cast("long")).alias("cells")]
    schema = docs.select(*keep, *added).schema
    shared = docs.sparkSession.sparkContext.broadcast(ordered(np.zeros(0, np.uint64) if common is None else common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, SLICE):
            hashes, bounds, whole = shingles(part.column(text), width)
            hashes, bounds = _distinct(hashes, bounds)
            made = [pa.array(x.view(np.int64)) for x in (whole, *(_majority(_mixed(hashes, k), bounds) for k in range(WIDE)))]
            if least is not None:
                cells, ends = leading(hashes, bounds, least, shared.value)
                made += [pa.array(np.diff(bounds).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(cells.view(np.int64)))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=schema.names)

    return docs.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(node, hashes): the distinct shingles of each text of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, SLICE):
            hashes, bounds, whole = shingles(part.column(text), width)
            hashes, bounds = _distinct(hashes, bounds)
            sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), sets], names=["node", "hashes"])

    return docs.select(text).mapInArrow(run, "node long, hashes array<long>")


def reach(least: float) -> int:
    """Distance that wide fingerprints of sets of a similarity of `least` keep: eight deviations beyond the expected one
    (a chance of less than one in 10**12 to exceed it, whatever the size of the corpus)."""
    angle = math.acos(2 * least / (1 + least)) / math.pi
    return math.ceil(64 * WIDE * angle + 8 * math.sqrt(64 * WIDE * angle * (1 - angle)))


def _within(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes that may be similar and their distance d: by the sizes, then the Manhattan bound of the two-bit
    counts, then the distance. Sets of fewer than SMALL shingles, whose bits are no normal sample, pass by size alone."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias("n" + x), *[F.col(f).alias(x + f) for f in _WORDS])
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    both = both.filter(F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-9)
    bound = sum(F.bit_count(embedding(F.col("a" + f)).bitwiseXOR(embedding(F.col("b" + f)))) for f in _WORDS)
    exact = sum(F.bit_count(F.col("a" + f).bitwiseXOR(F.col("b" + f))) for f in _WORDS)
    small, radius = F.least("na", "nb") < SMALL, reach(least)
    return both.filter(small | (bound <= radius)).withColumn("d", exact).filter(small | (F.col("d") <= radius)).select("a", "b", "d")


def _meet(n, i, m, j, least: float) -> F.Column:
    """Whether sets of n and m shingles may be similar if the shingle at places i and j is the first in order that they share:
    what comes before is not shared, so they share n - i and m - j at most. At a later shared shingle the bound is lower
    still, so a pair that may be similar passes at its first one and no pair is lost."""
    most = F.least(n - i, m - j)
    return (most >= F.lit(least / (1 + least)) * (n + m) - 1e-9) & (F.least(n, m) >= F.lit(least) * F.greatest(n, m) - 1e-9)


def _ordered(u, v) -> list[F.Column]:
    return [F.least(u, v).alias("a"), F.greatest(u, v).alias("b")]


def similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """(id, text_hash, node, root, component_id) for every row of docs: texts link when the Jaccard similarity of their sets of shingles
    is `least` or more, root is the same for all rows of a component, and component_id is the least non-null id reachable
    (null if none has one). text_hash is the XXH64 of the text, node that of its words.

    Candidates share one of their `leading` shingles, a cell, as all pairs of that similarity do; the similarity of every
    candidate is computed exactly. Word sequences that are equal are one node, however many rows hold them. Null and
    blank texts are equal to each other and to no other text; repeated ids and rows stay; other columns are ignored; an
    empty table gives an empty result.

    Work stays in proportion to the links that matter: each node is first compared with two members of each of its
    cells, the closest is verified, then the closest pair of any two components; only cells of more than two nodes that
    still hold several components are joined with themselves, across components, with every pair that is left and that the
    places of the shared shingle allow (`_meet`).
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__x"), F.xxhash64(text).alias("__h"))
    named = written(wide_fingerprints(rows, "__x", width, least, common_shingles(rows, "__x", width)), "wide")
    nodes = written(named.groupBy("node").agg(F.min("__id").alias("least"), *[F.first(c).alias(c) for c in (*_WORDS, "n", "cells")]), "nodes")
    cells = nodes.select(F.posexplode("cells").alias("i", "cell"), "node", "n")
    nodes = nodes.drop("cells")
    # the pivots of a cell: the member with the fewest rarer shingles, which is most like the others, and the one with the most
    whole = F.struct("i", "node", "n")
    ends = cells.groupBy("cell").agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"), F.count(F.lit(1)).alias("k"))
    ends = written(ends.filter("k > 1"), "cells")
    met = written(cells.join(ends.filter("k > 2").select("cell", "lo", "hi").hint("merge"), "cell"), "met")
    of = lambda p: [F.col(f"{p}.n"), F.col(f"{p}.i")]
    pivots = met.select("node", "n", "i", F.explode(F.array("lo", "hi")).alias("p")).filter((F.col("node") != F.col("p.node")) & _meet(F.col("n"), F.col("i"), *of("p"), least)).select(*_ordered("node", "p.node"))
    pivots = pivots.union(ends.filter((F.col("k") == 2) & _meet(*of("lo"), *of("hi"), least)).select(*_ordered("lo.node", "hi.node"))).distinct()
    close = written(_within(pivots, nodes, least), "close")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar."""
        pairs = written(pairs.select("a", "b"), "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ends = written(nodes.select("node", "least").join(ends.hint("shuffle_hash"), "node", "left_semi"), "ends")
        size = ends.count()
        ids = ends.filter("least is not null").select(F.col("least").alias("__w"))
        some = rows.join(sized(ids, size), rows["__id"] == F.col("__w"), "left_semi")
        if not ends.filter("least is null").isEmpty():  # these texts are found by their node below
            some = some.union(rows.filter("__id is null"))
        sets = shingle_sets(some, "__x", width).join(sized(ends.select("node"), size), "node", "left_semi")
        sets = written(sets.dropDuplicates(["node"]), "sets")
        side = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias("h" + x))
        both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
        shared = F.size(F.array_intersect("ha", "hb"))
        return both.withColumn("n", shared).filter(F.col("n") >= least * (F.size("ha") + F.size("hb") - F.col("n")) - 1e-9).select(F.col("a").alias("u"), F.col("b").alias("v"))

    def rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """pairs with the roots ra and rb of both ends, where they differ."""
        side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias("r" + x))
        out = pairs.join(side("a").hint("merge"), "a", "left").join(side("b").hint("merge"), "b", "left")
        return out.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}).filter("ra <> rb")

    tree = lambda roots: roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    ends = close.select(F.col("b").alias("n"), "a", "b", "d").union(close.select("a", "a", "b", "d"))
    first = ends.groupBy("n").agg(F.min_by(F.struct("a", "b"), F.struct("d", "a", "b")).alias("e")).select("e.*").distinct()
    roots = components(verified(first))
    second = rooted(close, roots).groupBy(F.least("ra", "rb"), F.greatest("ra", "rb")).agg(F.min_by(F.struct("a", "b"), F.struct("d", "a", "b")).alias("e")).select("e.*")
    roots = components(verified(second).union(tree(roots)))
    parts = written(met.select("cell", "node", "n", "i").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "parts")
    # in a cell, pairs that leave out the members of its largest component on one side are all that is needed
    largest = parts.groupBy("cell", "root").count().groupBy("cell").agg(F.max_by("root", F.struct("count", "root")).alias("top"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("cell", "top")
    open_ = parts.join(largest.hint("merge"), "cell")
    left = open_.filter("root <> top").select("cell", F.col("node").alias("x"), F.col("root").alias("rx"), "top", F.col("n").alias("nx"), F.col("i").alias("ix"))
    right = open_.select(F.col("cell").alias("c"), F.col("node").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("i").alias("iy"))
    may = _meet(F.col("nx"), F.col("ix"), F.col("ny"), F.col("iy"), least)
    across = left.join(right.hint("merge"), (F.col("cell") == F.col("c")) & F.expr("rx <> ry and (ry = top or rx < ry)") & may).select(*_ordered("x", "y")).distinct()
    rest = rooted(_within(across, nodes, least), roots)
    roots = components(verified(rest).union(tree(roots)))
    joined = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    classes = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = joined.join(classes, "root").select(F.col("node").alias("n"), "root", "component_id")
    found = named.select("__id", "__h", "node").join(by_node, F.col("node") == F.col("n"), "left")
    return found.select(F.col("__id").alias(id_col), F.col("__h").alias("text_hash"), "node", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each component of `similar`: one with its least id, of several texts that of least hash.

    Rows with a null id stay only in a component without any id, one of them. Rows that repeat an id with an unlike text
    are another component and stay; rows that repeat id and text count as one. Null and blank texts are one component.
    Other columns stay as they are, whatever their names. An empty table stays empty.
    """
    found = written(similar(docs, id_col, text, width, least), "classes")
    k, h = (unused(docs.columns) + x for x in ("k", "h"))
    groups = found.groupBy("root", F.col(id_col).alias(k), F.col("text_hash").alias(h)).agg(F.first("component_id").alias("c"), F.count(F.lit(1)).alias("n"))
    first = groups.filter(F.col(k).eqNullSafe(F.col("c")))
    keep = written(first.groupBy("root").agg(F.min_by(F.struct(k, h, "n"), h).alias("x")).select("x.*"), "kept")
    # docs are compared with the rows that go, which are few; those that stay are about as many as docs
    kept = keep.select(F.col(k).alias("__i"), F.col(h).alias("__j"))
    gone = groups.join(kept.hint("merge"), F.col(k).eqNullSafe(F.col("__i")) & (F.col(h) == F.col("__j")), "left_anti")
    repeated = keep.filter("n > 1")
    out = written(gone.select(k, h).union(repeated.select(k, h)), "gone")
    match = docs[id_col].eqNullSafe(F.col(k)) & (F.xxhash64(docs[text]) == F.col(h))
    once = docs.join(sized(out, out.count()), match, "left_anti")
    size = repeated.count()
    if not size:
        return once
    again = docs.join(sized(repeated, size), match, "left_semi")
    return once.unionByName(again.dropDuplicates([id_col, text]))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
