"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Code-point 1- to 3-grams of lower-cased text are hashed into DIM bins; a bin weighs (1 + ln count) * idf and a text
has unit length. Weights are learned by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties,
so most stay zero. A temperature fitted on rows apart from these calibrates the probabilities.

Document frequencies cover every training document. Weights are fitted on at most `per_lang` documents of each
language (those with the least hash of their id; a documented bound). Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import slices, table, written

DIM = 1 << 15
PER_LANG = 1500
CODED = ["id", "lang", "at", "n", "bin", "df"]


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins of a text's n-grams and how often each occurs."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0)
    m = np.uint32(2654435761)
    grams = [c * m]
    for k in (1, 2):
        if len(c) > k:
            grams.append((grams[-1][: len(c) - k] ^ (c[k:] + np.uint32(k))) * m)
    bins = np.bincount(np.concatenate(grams) >> np.uint32(32 - 15), minlength=DIM)
    at = np.flatnonzero(bins)
    return at, bins[at]


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1.0 + np.log(n)) * idf[at]
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002, epochs: int = 3, seed: int = 11) -> tuple[np.ndarray, float]:
    """(weights of shape DIM + 1 by k, temperature); the last bin is the bias."""
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def current(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / ((beta + np.sqrt(n[at])) / alpha + l2))

    def softmax(m: np.ndarray) -> np.ndarray:
        e = np.exp(m - m.max())
        return e / e.sum()

    rng = np.random.default_rng(seed)
    fitted = np.arange(len(y)) % 5 != 4
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(fitted)):
            at, v = np.append(rows[i][0], DIM), np.append(rows[i][1], 0.1)
            w = current(at)
            p = softmax(v @ w)
            p[y[i]] -= 1.0
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = current(np.arange(DIM + 1))
    held = np.flatnonzero(~fitted) if (~fitted).any() else np.flatnonzero(fitted)
    logits = np.array([np.append(rows[i][1], 0.1) @ w[np.append(rows[i][0], DIM)] for i in held])

    def loss(log_t: float) -> float:
        m = logits / np.exp(log_t)
        m = m - m.max(axis=1, keepdims=True)
        return float((np.log(np.exp(m).sum(axis=1)) - m[np.arange(len(held)), y[held]]).mean())

    lo, hi = np.log(0.02), np.log(20.0)
    for _ in range(60):  # golden section; the loss has one minimum over the temperature
        a, b = hi - 0.618 * (hi - lo), lo + 0.618 * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return w, float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, usable: F.Column, per_lang: int = PER_LANG, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """Learn from rows of docs for which `usable` holds and lang is not null. Rows with a null id or text count
    towards document frequencies alone; of rows that repeat id and lang one is fitted; ids may be of any type. No usable
    row gives a model that answers `und`."""
    rows = docs.filter(usable & F.col(lang).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("t"))
    # of each language the rows of least hash: a cut that a count of hash ranges gives, so no language is one task's group
    usable_rows = rows.filter("id is not null and t is not null").select("lang", F.xxhash64("id").alias("h"))
    totals = {r["lang"]: r["n"] for r in usable_rows.groupBy("lang").agg(F.count_distinct("h").alias("n")).collect()}
    names = sorted(totals)
    if not names:
        return {"names": [], "idf": np.ones(DIM), "w": np.zeros((DIM + 1, 0), np.float32)}
    share = {name: min(1.0, (per_lang + 6 * per_lang**0.5 + 20) / n) for name, n in totals.items()}  # of hashes, six deviations beyond the need
    cut = F.create_map(*[x for name in names for x in (F.lit(name), F.lit(int(share[name] * (1 << 62))))])
    near = F.shiftrightunsigned(F.xxhash64("id"), 2) <= cut[F.col("lang")]
    marked = rows.withColumn("picked", F.coalesce(near & F.col("id").isNotNull() & F.col("t").isNotNull(), F.lit(False))).select(F.xxhash64("id").alias("id"), "lang", "t", "picked")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for part in slices(batches, "t"):
            out = []
            for i, name, t, picked in zip(*(part.column(c).to_pylist() for c in ("id", "lang", "t", "picked"))):
                at, c = counts(t or "")
                df[at] += 1
                n += 1
                if picked:
                    out.append((i, name, at.astype(np.int32).tobytes(), c.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.binary(), pa.binary()))), pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.int64())], names=CODED)
        used = np.flatnonzero(df)
        bins, sums = np.append(used, DIM), np.append(df[used], n)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(bins), kind) for kind in (pa.int64(), pa.string(), pa.binary(), pa.binary())), pa.array(bins.astype(np.int32)), pa.array(sums)], names=CODED)

    coded = written(marked.mapInArrow(collect, "id long, lang string, at binary, n binary, bin int, df long"), "langid-rows")
    sums = coded.filter("bin is not null").groupBy("bin").agg(F.sum("df").alias("df")).toArrow()  # DIM + 1 rows at most
    freq = np.zeros(DIM + 1)
    freq[sums.column("bin").to_numpy()] = sums.column("df").to_numpy()
    idf = np.log((1.0 + freq[DIM]) / (1.0 + freq[:DIM])) + 1.0

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {name: [] for name in names}
        for b in batches:
            for i, name, at, c in zip(*(b.column(k).to_pylist() for k in range(4))):
                held[name].append((np.uint64(i % 2**64), at, c))
        docs_ = [(name, *(np.frombuffer(x, np.int32) for x in r[1:])) for name in names for r in sorted(held[name])[:per_lang]]
        rows_ = [(at, weighted(at, c, idf)) for _, at, c in docs_]
        y = np.array([names.index(d[0]) for d in docs_])
        rng = np.random.default_rng(3).permutation(len(docs_))
        w, t = fit([rows_[i] for i in rng], y[rng], len(names))
        yield pa.RecordBatch.from_arrays([pa.array([(w / t).astype(np.float32).tobytes()])], names=["w"])

    sample = coded.filter("bin is null").select("id", "lang", "at", "n").dropDuplicates(["id", "lang"])
    row = sample.repartition(1).mapInArrow(solve, "w binary").first()  # the bounded sample: a little over per_lang rows a language
    return {"names": names, "idf": idf, "w": np.frombuffer(row["w"], np.float32).reshape(DIM + 1, -1)}


def predicted(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs without `text`, plus lang_pred and score. A null text or one without a letter is `und` with score 0; rows
    and other columns stay; columns of the same names are replaced."""
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    schema = StructType([*docs.select(*keep).schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(m: dict, t: str | None) -> tuple[str, float]:
        if not t or not m["names"] or not any(c.isalpha() for c in t):
            return "und", 0.0
        at, c = counts(t)
        logits = weighted(at, c, m["idf"]).astype(np.float32) @ m["w"][at] + 0.1 * m["w"][DIM]
        e = np.exp((logits - logits.max()).astype(np.float64))
        best = int(np.argmax(e))
        return m["names"][best], float(e[best] / e.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, "__t"):
            made = [one(m, t) for t in part.column("__t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.float64())], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__t")).mapInArrow(run, schema)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs, ~held)
    return predicted(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")), model)
