"""Quality rules whose cutoffs are risk-controlled on labelled documents.

A rule rejects a document when a statistic exceeds a cutoff. What is certified, in each stratum (a band of document
length), is the union of all rules: of good documents that pass the base rules at most a share `risk` may be rejected.

The labelled good documents of a stratum fall into two halves by a hash of their id. One half proposes nested settings,
from lenient to strict: at level q each rule takes the strictest cutoff of its grid that rejects at most a share q of
that half. The other half tests the settings in that order: a setting holds if P(Bin(n, risk) <= rejected) does not exceed
delta / strata, which is the same as an exact (Clopper-Pearson) upper bound below `risk`. The order is fixed before the
second half is looked at and testing stops at the first failure, so it needs no correction of its own; strata are
corrected by Bonferroni. With probability 1 - delta no stratum loses more than `risk` of its good documents. Where labels
are too few, nothing is certified and the rules never reject.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import looked_up, slices, table, text_bytes, words, written, xxh64

#: rule -> cutoffs from lenient to strict
GRIDS = {
    "symbol_ratio": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05),
    "repeat_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4),
    "upper_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "bang_ratio": (2.0, 1.5, 1.0, 0.75, 0.5, 0.25),
}
#: shares of the proposing half that one rule may reject, from lenient to strict
LEVELS = (0.0, 0.001, 0.002, 0.004, 0.006, 0.01, 0.015)
#: lower ends of the strata, in words
STRATA = (0, 200, 800)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Risk:
    risk: float = 0.03
    delta: float = 0.05
    min_words: int = 50


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeat_words(raw, starts, ends, first) -> np.ndarray:
    """Words of each row that lie in a 3-word window found twice or more in the row."""
    n = len(starts)
    covered = np.zeros(n + 1, bool)
    if n >= 3:
        h = xxh64(raw, starts, ends)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        whole = np.flatnonzero(row[2:] == row[:-2])
        if len(whole):
            a, b, c = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
            key = h[whole] * a
            key = (key ^ (key >> np.uint64(29))) + h[whole + 1] * b
            key = (key ^ (key >> np.uint64(31))) * c + h[whole + 2] * a
            key = (key ^ (key >> np.uint64(30))) + row[whole].astype(np.uint64) * b
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(order), bool)
            twice[1:] |= same
            twice[:-1] |= same
            at = whole[order[twice]]
            for k in range(3):
                covered[at + k] = True
    return _per_row(covered[:n], first)


def _dup_lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[int]]:
    dup, lines = [], []
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        seen: set[bytes] = set()
        n = 0
        for line in raw[a:b].tobytes().split(b"\n"):
            if line and line.strip(b" \t\n\v\f\r"):
                n += 1
                seen.add(line)
        dup.append(n - len(seen))
        lines.append(n)
    return dup, lines


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Base counts and rule statistics of whole texts; null and blank texts have zeros."""
    raw, offsets = text_bytes(texts)
    starts, ends, first = words(raw, offsets)
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1  # where a row's last word meets the next row's first, the two cancel out, which is right
    inside = np.cumsum(inside[:-1]).astype(bool) if len(raw) else np.zeros(0, bool)
    n = np.diff(first)
    dup, lines = _dup_lines(raw, offsets)
    out = {"n_words": n, "word_chars": _per_row(inside & ((raw & 0xC0) != 0x80), offsets), "n_symbols": _per_row(_SYMBOL[raw], offsets), "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": _repeat_words(raw, starts, ends, first)}
    upper = _UPPER[raw]
    if len(raw) > 1:
        upper[:-1] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    part = lambda x, y: x / np.maximum(y, 1)
    out["symbol_ratio"] = part(out["n_symbols"], out["word_chars"])
    out["repeat_ratio"] = part(out["n_repeat_words"], n)
    out["dup_line_ratio"] = part(out["n_dup_lines"], np.array(lines))
    out["upper_ratio"] = part(_per_row(upper, offsets), _per_row(_LETTER[raw], offsets))
    out["bang_ratio"] = part(_per_row(raw == 33, offsets), n)
    return out


def measured(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs plus the base counts and rule statistics, named with prefix; columns of the same names are replaced."""
    added = [*(StructField(prefix + c, LongType()) for c in BASE), *(StructField(prefix + c, DoubleType()) for c in GRIDS)]
    keep = [c for c in docs.columns if c not in {f.name for f in added}]
    schema = StructType([*docs.select(*keep).schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            s = statistics(part.column(text))
            new = [pa.array(s[f.name.removeprefix(prefix)].astype(np.int64 if isinstance(f.dataType, LongType) else np.float64)) for f in added]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new], names=schema.names)

    return docs.select(*keep).mapInArrow(run, schema)


def _stratum(n_words) -> F.Column:
    return sum(((n_words >= low).cast("int") for low in STRATA[1:]), F.lit(0))


def base_failed(p: Risk, prefix: str = "") -> F.Column:
    n = F.col(f"{prefix}n_words")
    return (n < p.min_words) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * n)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed from its largest term down."""
    if k >= n:
        return 1.0
    if k > n * p:
        return 1.0 - binomial_tail(n - k - 1, n, 1 - p)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = term, k
    while i and term > total * 1e-17:
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        i -= 1
    return min(1.0, total)


def fit_cutoffs(stats: DataFrame, labels: DataFrame, p: Risk = Risk(), id_col: str = "doc_id") -> dict[tuple[str, int], float]:
    """(rule, stratum) -> cutoff of the strictest certified setting; inf where there is none. Labels of an id: the lowest
    quality counts; rows with a null id or quality are ignored. Every labelled good document that passes the base rules is
    a holdout row; rows that repeat an id are in one half."""
    good = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("__l")).agg(F.min("quality").alias("__q")).filter("__q = 1")
    held = stats.filter(~base_failed(p)).join(good, stats[id_col] == good["__l"], "left_semi")
    held = written(held.select(_stratum(F.col("n_words")).alias("s"), (F.xxhash64(id_col) % 2 == 0).alias("proposes"), *GRIDS), "holdout")
    counts = [F.count_if(F.col(rule) > cut).alias(f"{rule}_{i}") for rule, grid in GRIDS.items() for i, cut in enumerate(grid)]
    rows = {r["s"]: r for r in held.filter("proposes").groupBy("s").agg(F.count(F.lit(1)).alias("n"), *counts).collect()}
    settings: dict[int, list[dict[str, float]]] = {}
    for s, r in rows.items():
        for q in LEVELS:
            one = {}
            for rule, grid in GRIDS.items():
                fine = [cut for i, cut in enumerate(grid) if r[f"{rule}_{i}"] <= q * r["n"]]
                one[rule] = min(fine, default=math.inf)
            if not settings.get(s) or one != settings[s][-1]:
                settings.setdefault(s, []).append(one)
    over = lambda one: F.greatest(*[(F.col(rule) > cut).cast("int") if cut < math.inf else F.lit(0) for rule, cut in one.items()], F.lit(0))
    tests = [F.sum(F.when(F.col("s") == s, over(one)).otherwise(0)).alias(f"t{s}_{k}") for s in sorted(settings) for k, one in enumerate(settings[s])]
    found = {(rule, s): math.inf for rule in GRIDS for s in range(len(STRATA))}
    if tests:
        row = held.filter("not proposes").agg(*[F.count_if(F.col("s") == s).alias(f"n{s}") for s in sorted(settings)], *tests).first()
        for s in settings:
            for k, one in enumerate(settings[s]):
                if not row[f"n{s}"] or binomial_tail(row[f"t{s}_{k}"], row[f"n{s}"], p.risk) > p.delta / len(STRATA):
                    break
                found |= {(rule, s): cut for rule, cut in one.items()}
    return found


def verdict(cutoffs: dict[tuple[str, int], float], p: Risk = Risk(), prefix: str = "") -> F.Column:
    """Whether a measured row is kept."""
    bad = base_failed(p, prefix)
    for rule in GRIDS:
        for s in range(len(STRATA)):
            if cutoffs[rule, s] < math.inf:
                bad |= (_stratum(F.col(f"{prefix}n_words")) == s) & (F.col(prefix + rule) > cutoffs[rule, s])
    return ~bad


def assess(docs: DataFrame, labels: DataFrame, p: Risk = Risk(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, base counts, statistics, base_failed, kept) for every row of docs. Null texts have no words and fail the
    base rules; repeated ids and rows stay; rows with a null id are judged like any other. An empty labels table
    leaves the base rules alone; an empty docs table gives an empty result."""
    stats = written(measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))).drop("text"), "rule-stats")
    cutoffs = fit_cutoffs(stats, labels, p)
    return stats.withColumns({"base_failed": base_failed(p), "kept": verdict(cutoffs, p)}).withColumnRenamed("doc_id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, p: Risk = Risk(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that `assess` keeps, with their own columns, whatever their names; null texts fail the base rules,
    repeated rows and ids are judged each, an empty table stays empty, and no labels leave the base rules alone."""
    ids = written(labels.select(F.col(id_col).alias("__l")).distinct(), "labelled")
    labelled = looked_up(docs.select(id_col, text), ids, ids.count(), F.col(id_col), "__l", "left_semi")
    stats = measured(labelled.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))).drop("text")
    cutoffs = fit_cutoffs(stats, labels.withColumnRenamed(id_col, "doc_id"), p)
    prefix = "__"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return measured(docs, text, prefix).filter(verdict(cutoffs, p, prefix)).select(*docs.columns)


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *BASE, "base_failed", "kept", *GRIDS)
