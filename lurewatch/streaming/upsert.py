"""A keyed table on files that a stream keeps: rows are dealt into buckets by a hash of their key, so that a batch, a read or a compaction
touches the files of its own buckets alone.

A batch is appended to the buckets it changes, as one file each. A bucket of more than `DELTAS` such files is folded into one with the newest
row of each key. A version of the table is a list of the folders of each bucket; readers take the last one that was written whole,
so a batch is seen as a whole or not at all.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.store import latest

#: buckets of a new table; files of a bucket that are kept side by side; versions that a clean-up keeps
BUCKETS, DELTAS, KEPT = 64, 4, 2


class Table:
    """The table under path: one row for each key, the newest by the columns `newest`. There is one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, key: str, *newest: str, buckets: int = BUCKETS, deltas: int = DELTAS):
        self.spark, self.path, self.key, self.newest, self.deltas = spark, path.rstrip("/"), key, newest, deltas
        self.run = uuid.uuid4().hex  # a new writer's batches, counted from 0 again, never replace those of an older one
        found = self._version()
        self.buckets = found[1]["buckets"] if found else buckets

    # ---- versions ----

    def _folder(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, folder: str) -> list[str]:
        system, where = self._folder(folder)
        return [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []

    def _whole(self) -> list[int]:
        """Numbers of the versions that were written whole."""
        out = []
        for n in self._names(f"{self.path}/versions"):
            system, done = self._folder(f"{self.path}/versions/{n}/_SUCCESS")
            if n.isdecimal() and system.exists(done):
                out.append(int(n))
        return sorted(out)

    def _version(self, number: int | None = None) -> tuple[int, dict] | None:
        whole = self._whole()
        if not whole:
            return None
        number = whole[-1] if number is None else number
        row = self.spark.read.schema("buckets int, columns string, applied map<string,long>, folders map<int,array<string>>").parquet(f"{self.path}/versions/{number}").first()
        return number, row.asDict()

    def _commit(self, number: int, columns: str, applied: dict[str, int], folders: dict[int, list[str]]) -> None:
        row = self.spark.createDataFrame([(self.buckets, columns, applied, folders)], "buckets int, columns string, applied map<string,long>, folders map<int,array<string>>")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/{number}")

    # ---- writing ----

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _put(self, rows: DataFrame, name: str) -> list[int]:
        """Write rows, a file for each bucket; the buckets that have one."""
        folder = f"{self.path}/data/{name}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        return [int(n.split("=")[1]) for n in self._names(folder) if n.startswith("_bucket=")]

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: take in a batch. One that is written again after a crash changes nothing the second time."""
        at, now = self._version() or (-1, {"columns": batch.schema.json(), "applied": {}, "folders": {}})
        if now["applied"].get(self.run, -1) >= number:
            return
        rows = latest(batch, self.key, *self.newest).select(*batch.columns)
        name = f"{self.run}-{number}"
        folders = {b: list(f) for b, f in now["folders"].items()}
        for b in self._put(rows, name):
            folders.setdefault(b, []).append(f"{name}/_bucket={b}")
        many = [b for b, f in folders.items() if len(f) > self.deltas]
        if many:
            folded = f"{name}-folded"
            self._put(self._read(now["columns"], {b: folders[b] for b in many}), folded)
            folders |= {b: [f"{folded}/_bucket={b}"] for b in many}
        self._commit(at + 1, now["columns"], {**now["applied"], self.run: number}, folders)

    def compact(self) -> None:
        """Fold every bucket that has more than one file."""
        at, now = self._version() or (-1, None)
        many = [b for b, f in now["folders"].items() if len(f) > 1] if now else []
        if many:
            name = f"{self.run}-compact-{at + 1}"
            self._put(self._read(now["columns"], {b: now["folders"][b] for b in many}), name)
            self._commit(at + 1, now["columns"], now["applied"], {**now["folders"], **{b: [f"{name}/_bucket={b}"] for b in many}})

    def clean(self, keep: int = KEPT) -> None:
        """Delete what none of the last versions names, and older versions. A reader of an older version fails."""
        whole = self._whole()
        used = {f.split("/")[0] for n in whole[-keep:] for fs in self._version(n)[1]["folders"].values() for f in fs}
        gone = [f"{self.path}/data/{n}" for n in self._names(f"{self.path}/data") if n not in used] + [f"{self.path}/versions/{n}" for n in whole[:-keep]]
        for name in gone:
            system, where = self._folder(name)
            system.delete(where, True)

    # ---- reading ----

    def _read(self, columns: str, folders: dict[int, list[str]]) -> DataFrame:
        schema = StructType.fromJson(json.loads(columns))
        paths = [f"{self.path}/data/{f}" for fs in folders.values() for f in fs]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return latest(rows, self.key, *self.newest).select(*schema.names)

    def read(self) -> DataFrame:
        """The newest row of every key."""
        found = self._version()
        if found is None:
            raise ValueError(f"no table under {self.path}")
        return self._read(found[1]["columns"], found[1]["folders"])

    def rows_of(self, keys: list) -> DataFrame:
        """The rows of some keys, from the files of their buckets alone."""
        found = self._version()
        schema = StructType.fromJson(json.loads(found[1]["columns"]))
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType([schema[self.key]]))
        wanted = {r[0] for r in asked.select(self._bucket()).distinct().collect()}
        return self._read(found[1]["columns"], {b: f for b, f in found[1]["folders"].items() if b in wanted}).join(F.broadcast(asked.distinct()), self.key, "left_semi")
