"""Shared helpers: written intermediate tables, Arrow batch slicing and columnar word splitting."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; bounds a task's memory whatever the batch size.
STEP_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. A local session that names none (tests) uses a
    folder in its warehouse; a cluster must name one."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
        where = context.getCheckpointDir()
    return where.rstrip("/")


_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver's JVM to collect its garbage: Spark deletes the shuffle files and broadcasts of finished steps when
    nothing refers to them any more, which otherwise happens when the driver's memory runs short, long after disk and memory
    of the executors did."""
    spark.sparkContext._jvm.System.gc()


class Parts:
    """A written table in one folder a value of an int column, each of which can be dropped alone."""

    def __init__(self, df: DataFrame, column: str, name: str):
        self.spark, self.schema, self.column = df.sparkSession, df.schema, column
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy(column).parquet(self.path)
        _WRITTEN.append(self.path)
        free_shuffles(self.spark)

    def of(self, value: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).filter(F.col(self.column) == value).select(self.schema.names)

    def drop(self, *values: int) -> None:
        for value in values:
            _delete(self.spark, f"{self.path}/{self.column}={value}")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written_so_far() -> int:
    return len(_WRITTEN)


def reads_written(df: DataFrame, first: int, last: int) -> bool:
    """Whether df still reads one of the tables first..last of those that `written` made."""
    names = {path.rsplit("/", 1)[1] for path in _WRITTEN[first:last]}
    return any(names.intersection(path.split("/")) for path in df.inputFiles())


def drop_written(spark: SparkSession, first: int, last: int) -> None:
    """Delete tables first..last of those that `written` made, once nothing reads them any more."""
    for path in _WRITTEN[first:last]:
        _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(1)
def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if libc.mallopt and libc.malloc_trim else None
    except (OSError, AttributeError):  # another C library
        return None


#: mallopt's names, and the least size of an array that is mapped and unmapped alone: as a rule, and within `keeping_memory`
_TRIM, _MMAP, _ALONE, _KEPT = -1, -3, 1 << 18, 32 << 20


@lru_cache(1)
def _give_back_memory() -> None:
    """Keep glibc from holding on to freed arrays in a worker that lives for many tasks (a fixed mmap threshold)."""
    if _libc():
        _libc().mallopt(_MMAP, _ALONE)


def keeping_memory(step: Callable) -> Callable:
    """step, within which freed arrays stay with the worker for the next ones: a step of many array operations spends most of
    its time on fresh pages otherwise. What is free when it ends goes back."""

    @wraps(step)
    def run(first, *rest):  # Spark counts the named arguments
        libc = _libc()
        if not libc:
            return step(first, *rest)
        libc.mallopt(_MMAP, _KEPT)
        libc.mallopt(_TRIM, 16 * _KEPT)
        try:
            return step(first, *rest)
        finally:
            libc.mallopt(_MMAP, _ALONE)
            libc.mallopt(_TRIM, _ALONE)
            libc.malloc_trim(0)

    return run


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about `most` bytes of `column` (one row at least)."""
    _give_back_memory()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end and the n + 1 offsets of its rows; null is empty."""
    flat = pc.fill_null(column, "").cast(pa.large_string())
    flat = pa.concat_arrays([flat])
    n = len(flat)
    offsets = np.frombuffer(flat.buffers()[1], dtype=np.int64, count=n + 1 + flat.offset)[flat.offset :]
    data = flat.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of rows laid end to end: starts, ends and the n + 1 word offsets of the rows."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    at = edge[edge < len(raw)]
    first[at] |= inside[at]
    at = edge[edge > 0] - 1
    last[at] |= inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


_P = [np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]
_U = np.uint64


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def xxh64(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges of one buffer, computed column by column instead of call by call."""
    import xxhash

    p1, p2, p3, p4, p5 = _P
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([raw, np.zeros(32, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    size = ends - starts
    h = np.full(n, (seed + int(p5)) & (2**64 - 1), np.uint64)
    long = np.flatnonzero(size >= 32)
    huge = long[size[long] > 2048]
    long = long[size[long] <= 2048]
    if len(long):
        stripes = size[long] // 32
        order = np.argsort(-stripes, kind="stable")
        rows, stripes = long[order], stripes[order]
        first = [(seed + int(p1) + int(p2)) % 2**64, (seed + int(p2)) % 2**64, seed, (seed - int(p1)) % 2**64]
        v = [np.full(len(rows), x, np.uint64) for x in first]
        at = starts[rows]
        for s in range(int(stripes[0])):
            m = int(np.searchsorted(-stripes, -s, side="left"))
            for k in range(4):
                v[k][:m] = _rot(v[k][:m] + eight[at[:m] + (32 * s + 8 * k)] * p2, 31) * p1
        acc = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
        for k in range(4):
            acc = (acc ^ (_rot(v[k] * p2, 31) * p1)) * p1 + p4
        h[rows] = acc
    h += size.astype(np.uint64)
    at = starts + (size // 32) * 32
    left = size % 32
    for _ in range(3):
        r = np.flatnonzero(left >= 8)
        if not len(r):
            break
        h[r] = _rot(h[r] ^ (_rot(eight[at[r]] * p2, 31) * p1), 27) * p1 + p4
        at[r] += 8
        left[r] -= 8
    r = np.flatnonzero(left >= 4)
    if len(r):
        h[r] = _rot(h[r] ^ (four[at[r]].astype(np.uint64) * p1), 23) * p2 + p3
        at[r] += 4
        left[r] -= 4
    for _ in range(3):
        r = np.flatnonzero(left > 0)
        if not len(r):
            break
        h[r] = _rot(h[r] ^ (padded[at[r]].astype(np.uint64) * p5), 11) * p1
        at[r] += 1
        left[r] -= 1
    h = (h ^ (h >> _U(33))) * p2
    h = (h ^ (h >> _U(29))) * p3
    h ^= h >> _U(32)
    for i in huge.tolist():
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed)
    return h


#: rows up to which a counted side is broadcast (about 60 bytes a row); copies of a larger one that a hot key is spread over
BROADCAST_ROWS, SALTS = 200_000, 16


def looked_up(rows: DataFrame, found: DataFrame, size: int, left: F.Column, right: str, how: str) -> DataFrame:
    """rows joined (left or left_semi) with found on left = found.right, found being distinct in `right`. A side of
    counted `size` that allows it is broadcast; a larger one is copied SALTS times and rows are dealt by key and salt, so
    that a key with a third of all rows is no single task."""
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found), left == F.col(right), how)
    number = F.monotonically_increasing_id()
    deal = F.when(left.isNull(), number + SALTS).otherwise(F.pmod(number, F.lit(SALTS)))  # a null key meets nothing
    spread = found.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    out = rows.withColumns({"__salt": deal, "__left": left}).join(spread, (F.col("__left") == F.col(right)) & (F.col("__salt") == F.col("__copy")), how)
    return out.drop("__salt", "__left", "__copy")
