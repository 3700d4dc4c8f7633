"""Naive Bayes support vectors for text quality.

Binary n-gram indicators are scaled by their class log-count ratios, and a linear hinge-loss model is fitted on
them by dual coordinate descent. Indicators: byte trigrams (hashed), bigrams of word shapes, and unary steps of
repetition statistics. A margin becomes a probability by a logistic map fitted on a fifth of the sample that the
margin was not fitted on.

The model is fitted on at most `max_rows` labelled rows (those with the least hash of their id; a documented bound);
scoring covers every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import slices, table, text_bytes, words, written, xxh64

GRAMS, SHAPES, STEPS = 1 << 16, 64 * 64, 20
DIM = GRAMS + SHAPES + 2 * STEPS
MAX_ROWS = 20_000
_KIND = np.zeros((5, 256), np.int32)
_KIND[0, 65:91] = 1  # upper case
_KIND[1, list(b"#*$%&|<>")] = 1  # symbols
_KIND[2, list(b"!?")] = 1
_KIND[3, 48:58] = 1  # digits
_KIND[4, [*range(97, 123), *range(0xC3, 0xF5)]] = 1  # other letters


def _shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 6-bit class of each word, and whether it equals the word before."""
    has = []
    for kind in _KIND:
        total = np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int32)])
        has.append(total[ends] - total[starts])
    # words that may equal the one before, by length and first byte, are compared by a hash of the whole word
    size = ends - starts
    same = np.zeros(len(starts), bool)
    may = np.flatnonzero((size[1:] == size[:-1]) & (raw[starts[1:]] == raw[starts[:-1]])) + 1
    same[may] = xxh64(raw, starts[may], ends[may]) == xxh64(raw, starts[may - 1], ends[may - 1])
    up = has[0] > 0
    shape = up + 2 * (up & (has[0] > 1) & (has[4] == 0)) + 4 * (has[1] > 0) + 8 * (has[2] > 0) + 16 * same + 32 * (has[3] > 0)
    return shape.astype(np.int32), same


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct indicators of each text."""
    raw, offsets = text_bytes(texts)
    starts, ends, first = words(raw, offsets)
    shape, same = _shapes(raw, starts, ends)
    gram = np.zeros(max(len(raw) - 2, 0), np.int32)
    if len(gram):
        wide = raw.astype(np.uint32)
        gram = (((wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int32)
    pair = GRAMS + 64 * shape[:-1] + shape[1:]
    flags = np.zeros(DIM, bool)
    for i in range(len(texts)):
        a, b, u, v = offsets[i], offsets[i + 1], first[i], first[i + 1]
        flags[gram[a : max(a, b - 2)]] = True
        flags[pair[u : max(u, v - 1)]] = True
        if v > u:
            lines = raw[a:b].tobytes().split(b"\n")
            lines = [x for x in lines if x.strip()]
            repeats = 1 - len(set(lines)) / len(lines) if lines else 0.0
            flags[GRAMS + SHAPES : GRAMS + SHAPES + int(STEPS * repeats)] = True
            flags[GRAMS + SHAPES + STEPS : GRAMS + SHAPES + STEPS + int((STEPS - 1) * same[u:v].mean()) + 1] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        yield found


def fit(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, c: float = 0.1, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(weights, squared log-count ratios, bias, slope, offset): score = sigmoid(slope * (sum of weights / norm + bias) +
    offset). A fifth of the rows gives slope and offset alone, ratios and weights come from the others. With one class
    only, weights are zero and the score is the smoothed share of label 1."""
    n1 = int((y == 1).sum())
    if n1 in (0, len(y)):
        return np.zeros(DIM), np.zeros(DIM), 0.0, 0.0, float(np.log((n1 + 1) / (len(y) - n1 + 1)))
    fitted = np.arange(len(y)) % 5 != 4 if len(set(y[np.arange(len(y)) % 5 != 4])) == 2 else np.ones(len(y), bool)
    p, q = np.full(DIM, alpha), np.full(DIM, alpha)
    for x, label in zip([x for x, f in zip(rows, fitted) if f], y[fitted]):
        (p if label == 1 else q)[x] += 1
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    sign = np.where(y == 1, 1.0, -1.0)
    norm = np.array([1.0 + float(np.sqrt((r[x] ** 2).sum())) for x in rows])
    w, bias, duals = np.zeros(DIM), 0.0, np.zeros(len(y))
    values = [r[x] / k for x, k in zip(rows, norm)]
    square = np.array([float((v**2).sum()) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    train = np.flatnonzero(fitted)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(train):
            x, v = rows[i], values[i]
            slope = sign[i] * (w[x] @ v + bias) - 1.0
            new = min(max(duals[i] - slope / square[i], 0.0), c)
            if step := (new - duals[i]) * sign[i]:
                w[x] += step * v
                bias += step
                moved = max(moved, abs(step))
                duals[i] = new
        if moved < 1e-4:
            break
    margin = np.array([w[x] @ v + bias for x, v in zip(rows, values)])
    held = ~fitted if len(set(y[~fitted])) == 2 else fitted  # too few rows to set some apart
    a, b = 1.0, 0.0
    m, t = margin[held], (y[held] == 1).astype(float)
    good, bad = t.sum(), len(t) - t.sum()
    t = np.where(t == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    for _ in range(100):  # Newton steps of the logistic map, with a little ridge
        s = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((s - t) * m).sum() + 1e-3 * a, (s - t).sum() + 1e-3 * b])
        h = s * (1 - s)
        hess = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(hess, g)
        a, b = a - np.clip(move[0], -2, 2), b - np.clip(move[1], -2, 2)
        if abs(move).max() < 1e-8:
            break
    return w * r, r**2, bias, float(a), float(b)


def score_one(x: np.ndarray, scale: np.ndarray, model: tuple) -> float:
    w, bias, a, b = model
    margin = w[x].sum() / (1.0 + float(np.sqrt(scale[x].sum()))) + bias
    return float(1 / (1 + np.exp(-np.clip(a * margin + b, -700, 700))))


def train(docs: DataFrame, labels: DataFrame, usable: F.Column, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text: str = "text") -> tuple:
    """Fit on labelled rows of docs for which `usable` (over the id column) holds. Labels of an id: the lowest
    quality counts; null ids or labels are ignored; ids may be of any type. Rows that repeat an id are fitted each."""
    marks = labels.filter(usable & F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("__y"))
    chosen = marks.orderBy(F.xxhash64(id_col), id_col).limit(max_rows).withColumnRenamed(id_col, "__k")
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__t")).join(F.broadcast(chosen), F.col("__id") == F.col("__k"))  # max_rows rows at most

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__t"):
            x = [f.astype(np.int32).tobytes() for f in features(part.column("__t"))]
            yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__y").cast(pa.int32()), pa.array(x, pa.binary())], names=["id", "y", "x"])

    coded = written(sample.select(F.xxhash64("__id").alias("__id"), "__y", "__t").mapInArrow(encode, "id long, y int, x binary"), "nbsvm")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((i, y, x) for b in batches for i, y, x in zip(*(b.column(k).to_pylist() for k in range(3)))), key=lambda r: (r[0], r[2]))
        x = [np.frombuffer(r[2], np.int32) for r in rows]
        y = np.array([r[1] for r in rows])
        w, scale, bias, a, b = fit(x, y)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([scale.tobytes()]), pa.array([bias]), pa.array([a]), pa.array([b])], names=["w", "scale", "bias", "a", "b"])

    row = coded.repartition(1).mapInArrow(solve, "w binary, scale binary, bias double, a double, b double").first()  # max_rows short rows in one task
    return np.frombuffer(row["scale"]), (np.frombuffer(row["w"]), row["bias"], row["a"], row["b"])


def scored(docs: DataFrame, model: tuple, text: str = "text", cut: float = 0.3) -> DataFrame:
    """docs without `text`, plus score (0 to 1) and predicted (score >= cut). Null and empty texts are scored too;
    rows and other columns stay; columns of the same names are replaced."""
    keep = [c for c in docs.columns if c not in (text, "score", "predicted")]
    schema = StructType([*docs.select(*keep).schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, fitted = shared.value
        for part in slices(batches, "__t"):
            s = np.array([score_one(x, scale, fitted) for x in features(part.column("__t"))])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__t")).mapInArrow(run, schema)


def op5_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train(docs, table(spark, sf_dir, "labels"), ~held)
    return scored(docs.withColumn("held_out", F.coalesce(held, F.lit(False))), model)
