"""Ranked lexical search by a threshold-seeded join.

Items are taken in blocks of a stated size against all documents. For the terms of a block each document keeps its counts, as one
row of the postings table. For each term the k greatest impacts are found (partly in each task, then over all); the least of
them is a floor of the k-th score of every item that holds the term, since scores only grow with further terms. An item's terms
stand in order of their greatest impact, and a document that holds none but the first ones, whose greatest impacts sum to
less than the item's floor, cannot be in the result: it is no candidate. A candidate's sum plus that bound must reach the floor,
then all its terms are added up exactly. All arithmetic is in 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import lower_ascii, slices, table, text_bytes, words, written, xxh64

#: items of a block; documents times items that one step of the candidate search sums over
BLOCK, CELLS = 1_000, 2_000_000
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of texts end to end, and their terms (runs of ASCII letters, digits and all beyond ASCII): starts, ends
    and the n + 1 term offsets of the rows."""
    raw, offsets = text_bytes(texts)
    raw = lower_ascii(raw)
    return raw, *words(np.where(_TERM[raw], raw, np.uint8(0x20)), offsets)


def _edges(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last eight bytes and length of terms: with the 64-bit hash, what tells two terms apart (all there is of a term of
    up to 16 bytes)."""
    padded = np.concatenate([np.zeros(8, np.uint8), raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = ends - starts
    mask = np.where(size < 8, (np.uint64(1) << (8 * np.minimum(size, 7)).astype(np.uint64)) - np.uint64(1), np.uint64(2**64 - 1))
    head = eight[starts + 8] & mask
    tail = np.where(size < 8, head, eight[ends])
    return head, tail, size


@dataclass
class Block:
    """The items of a block: sorted term hashes with edges, and the (item, term) pairs in order of items."""

    hashes: np.ndarray
    edges: tuple[np.ndarray, np.ndarray, np.ndarray]
    item: np.ndarray
    term: np.ndarray
    n_items: int
    #: filled from the postings: weight, greatest and k-th impact of each term, documents, their terms
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    essential: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    n_docs: int = 0
    n_terms: int = 0

    @staticmethod
    def of(texts: list[str | None]) -> Block:
        raw, starts, ends, first = terms(pa.array(texts, pa.string()))
        h = xxh64(raw, starts, ends)
        hashes, at, term = np.unique(h, return_index=True, return_inverse=True)
        item = np.repeat(np.arange(len(texts)), np.diff(first))
        pair = np.unique(item * max(len(hashes), 1) + term)
        return Block(hashes, tuple(e[at] for e in _edges(raw, starts, ends)), pair // max(len(hashes), 1), pair % max(len(hashes), 1), len(texts))

    def seed(self, df: np.ndarray, greatest: np.ndarray, kth: np.ndarray) -> None:
        """An item's floor from its terms' k-th impacts, and its essential terms: those beyond the ones whose greatest impacts sum to
        less than the floor."""
        self.floor, self.rest = np.ones(self.n_items, np.int64), np.zeros(self.n_items, np.int64)  # scores of 0 never count
        np.maximum.at(self.floor, self.item, kth[self.term])
        self.essential = np.zeros(len(self.item), bool)
        order = np.lexsort((self.term, greatest[self.term], self.item))
        items, g = self.item[order], greatest[self.term[order]]
        upto = np.cumsum(g)
        start = np.searchsorted(items, np.arange(self.n_items))
        before = np.concatenate([[0], upto])[start][items]
        self.essential[order] = upto - before >= self.floor[items]
        np.maximum.at(self.rest, items, np.where(upto - before < self.floor[items], upto - before, 0))
        self.weight = weights(df, self.n_docs)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 50 + (50 * n * n_docs) // n_terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def postings(docs: DataFrame, block: Block, id_col: str, text: str) -> DataFrame:
    """(doc, n, ids, tfs): documents with a term, their number of terms, and the numbers and counts of the block's terms."""
    shared = docs.sparkSession.sparkContext.broadcast((block.hashes, block.edges))  # the terms of BLOCK items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, edges = shared.value
        for part in slices(batches, "t"):
            raw, starts, ends, first = terms(part.column("t"))
            n = np.diff(first)
            h = xxh64(raw, starts, ends)
            at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
            hit = np.flatnonzero(hashes[at] == h) if len(hashes) else np.zeros(0, np.int64)
            same = reduce(np.logical_and, (e[at[hit]] == x for e, x in zip(edges, _edges(raw, starts[hit], ends[hit]))))
            hit = hit[same]
            key, tf = np.unique(np.repeat(np.arange(len(n)), n)[hit] * max(len(hashes), 1) + at[hit], return_counts=True)
            row, term = key // max(len(hashes), 1), key % max(len(hashes), 1)
            kept = np.flatnonzero(n > 0)
            cuts = pa.array(np.concatenate([np.searchsorted(row, kept), [len(row)]]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(kept)), pa.array(n[kept].astype(np.int64)), *lists], names=["doc", "n", "ids", "tfs"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t")).mapInArrow(run, "doc long, n long, ids array<int>, tfs array<int>")


def _flat(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term, count of a batch's postings, and the rows' numbers of terms."""
    ids = part.column("ids")
    row = np.repeat(np.arange(part.num_rows), np.diff(ids.offsets.to_numpy()))
    return row, ids.flatten().to_numpy(), part.column("tfs").flatten().to_numpy().astype(np.int64), part.column("n").to_numpy()


def _best(group: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores of each group, equal ones by least tie."""
    order = np.lexsort((tie, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


def greatest(held: DataFrame, block: Block, df: np.ndarray, k: int) -> DataFrame:
    """(term, greatest, kth): the greatest impact of each term and its k-th, 0 if fewer documents hold it."""
    shared = held.sparkSession.sparkContext.broadcast((weights(df, block.n_docs), block.n_docs, block.n_terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, n_docs, n_terms = shared.value
        term, impact = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for part in batches:
            row, ids, tf, n = _flat(part)
            term = np.concatenate([term, ids])
            impact = np.concatenate([impact, impacts(weight[ids], tf, n[row], n_docs, n_terms)])
            best = _best(term, impact, np.zeros(len(term), np.int8), k)
            term, impact = term[best], impact[best]
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(impact)], names=["term", "impact"])

    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    top = held.mapInArrow(run, "term int, impact long").withColumn("place", place).filter(F.col("place") <= k)
    return top.groupBy("term").agg(F.max("impact").alias("greatest"), F.coalesce(F.max(F.when(F.col("place") == k, F.col("impact"))), F.lit(0)).alias("kth"))


def _sums(rows: np.ndarray, term: np.ndarray, impact: np.ndarray, n_rows: int, of_term: tuple[np.ndarray, np.ndarray], n_items: int) -> np.ndarray:
    """Sum of impacts for each row and item, over the items that of_term (offsets, items) gives each term."""
    offsets, items = of_term
    reps = offsets[term + 1] - offsets[term]
    total = np.zeros(n_rows * n_items, np.int64)
    cuts = np.searchsorted(np.cumsum(reps) // CELLS, np.arange(reps.sum() // CELLS + 2))  # so many at a time
    for a, b in zip(cuts, cuts[1:]):
        r = reps[a:b]
        at = np.repeat(offsets[term[a:b]] - np.concatenate([[0], np.cumsum(r)[:-1]]), r) + np.arange(r.sum())
        np.add.at(total, np.repeat(rows[a:b], r) * n_items + items[at], np.repeat(impact[a:b], r))
    return total.reshape(n_rows, n_items)


def candidates(held: DataFrame, block: Block, k: int) -> DataFrame:
    """(item, doc, score): exact scores of the candidates that are among the k best of their task."""
    n_terms = len(block.hashes)

    def of_term(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(block.term[chosen], kind="stable")
        return np.searchsorted(block.term[chosen][order], np.arange(n_terms + 1)), block.item[chosen][order]

    shared = held.sparkSession.sparkContext.broadcast((block, of_term(block.essential), of_term(np.ones(len(block.item), bool))))
    step = max(1, CELLS // max(block.n_items, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, main, every = shared.value
        item, doc, null, score = (np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        floor = b.floor.copy()
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                part = whole.slice(start, step)
                row, ids, tf, n = _flat(part)
                impact = impacts(b.weight[ids], tf, n[row], b.n_docs, b.n_terms)
                some = _sums(row, ids, impact, part.num_rows, main, b.n_items)
                near = (some > 0) & (some + b.rest >= floor)
                docs = np.flatnonzero(near.any(1))
                if not len(docs):
                    continue
                place = np.full(part.num_rows, -1)
                place[docs] = np.arange(len(docs))
                mine = place[row] >= 0
                full = _sums(place[row[mine]], ids[mine], impact[mine], len(docs), every, b.n_items)
                d, i = np.nonzero(near[docs] & (full >= floor))
                got = part.column("doc").take(pa.array(docs[d]))
                item, score = np.concatenate([item, i]), np.concatenate([score, full[d, i]])
                doc = np.concatenate([doc, got.fill_null(2**63 - 1).to_numpy()])
                null = np.concatenate([null, got.is_null().to_numpy(zero_copy_only=False)])
                best = _best(item, score, doc, k)
                item, doc, null, score = item[best], doc[best], null[best], score[best]
                full_up = np.flatnonzero(np.bincount(item, minlength=b.n_items) >= k)
                if len(full_up):  # a task's own k-th score is a floor, too
                    least = np.full(b.n_items, 2**63 - 1)
                    np.minimum.at(least, item, score)
                    floor[full_up] = np.maximum(floor[full_up], least[full_up])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64(), mask=null), pa.array(score)], names=["item", "doc", "score"])

    return held.mapInArrow(run, "item long, doc long, score long")


#: parts in which the best of the tasks meet before the last step
PARTS = 64


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy("item", *by).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, equal scores by ascending
    id (null last). Ids of documents are integers. Null texts have no terms; a document without terms counts nowhere, an
    item without terms has no rows; items and documents that repeat are ranked each; empty tables give no rows. Every block
    of items reads the documents once."""
    spark = docs.sparkSession
    schema = StructType([StructField("item_id", items.schema[item_id].dataType), StructField("rank", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())])
    numbered = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("t")), "ranked-items")
    out = []
    for (number,) in numbered.select(F.floor(F.col("item") / block)).distinct().collect():  # block numbers
        mine = numbered.filter(F.floor(F.col("item") / block) == number)
        rows = mine.orderBy("item").collect()  # `block` items
        asked = Block.of([r["t"] for r in rows])
        if not len(asked.item):
            continue
        held = written(postings(docs, asked, id_col, text), "ranked-postings")
        asked.n_docs, asked.n_terms = (x or 0 for x in held.agg(F.count(F.lit(1)), F.sum("n")).first())
        if not asked.n_docs:
            continue
        df, most, kth = (np.zeros(len(asked.hashes), np.int64) for _ in range(3))
        for term, n in held.select(F.explode("ids").alias("term")).groupBy("term").count().collect():  # the block's terms
            df[term] = n
        for term, a, b in greatest(held, asked, df, k).collect():
            most[term], kth[term] = a, b
        asked.seed(df, most, kth)
        best = _first(_first(candidates(held, asked, k).withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(PARTS))), k, "part"), k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], StructType([StructField("at", LongType()), schema["item_id"]]))
        out.append(best.join(F.broadcast(names), F.col("item") == F.col("at")).select("item_id", "rank", F.col("doc").alias("doc_id"), "score"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_RUN}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
every AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM size),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_RUN}')) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, sum(CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN size USING (doc_id), every GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM placed WHERE rank <= 50"""
