"""A stream of certificate names that falls back to polled pages while the message feed is silent.

Both feeds are folders of files whose names begin with the millisecond they were finished at (`1700000000000-a.json`), in which
files appear in that order. A polled page counts if no message file was finished in the `silence` seconds before it. Both this and the
order follow from the names alone, so an offset, the last name of each folder, always stands for the same files: a
batch that is run again after a crash reads what it read before.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.rules import suspicious

#: seconds without messages after which polled pages count; entries of a page that are read; files of a partition
SILENCE, ENTRIES, FILES = 60, 50, 16


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, str]]):
        self.paths = paths


def _open(folder: str):
    from pyarrow import fs

    if urlparse(folder).scheme:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def time_of(name: str) -> int:
    return int(name.split("-", 1)[0].split(".", 1)[0])


def names_in(folder: str) -> list[str]:
    """Names of a folder's files that begin with a time, in order; none if there is no such folder."""
    from pyarrow import fs

    system, path = _open(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    names = [f.base_name for f in found if f.type == fs.FileType.File and f.base_name.split("-", 1)[0].split(".", 1)[0].isdecimal()]
    return sorted(names, key=lambda n: (time_of(n), n))


def fallback(messages: list[str], polls: list[str], silence: int = SILENCE) -> list[str]:
    """The polled pages that count."""
    times = [time_of(m) for m in messages]
    quiet = lambda t: bisect_right(times, t) == bisect_right(times, t - 1000 * silence)
    return [p for p in polls if quiet(time_of(p))]


def between(names: list[str], after: str, upto: str) -> list[str]:
    """Names after one and up to another, in order of time; an empty name stands before all."""
    key = lambda n: (time_of(n), n) if n else (-1, "")
    keys = [key(n) for n in names]
    return names[bisect_right(keys, key(after)) : bisect_right(keys, key(upto))] if upto else []


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folders = {"messages": options["messages"], "polls": options["polls"]}
        self.silence = int(options.get("silence", SILENCE))
        self.entries = int(options.get("entries", ENTRIES))

    def _names(self) -> dict[str, list[str]]:
        messages, polls = (names_in(self.folders[k]) for k in ("messages", "polls"))
        return {"messages": messages, "polls": fallback(messages, polls, self.silence)}

    def initialOffset(self) -> dict:
        return {"messages": "", "polls": ""}

    def latestOffset(self) -> dict:
        return {k: names[-1] if names else "" for k, names in self._names().items()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        paths = [(k, f"{self.folders[k].rstrip('/')}/{n}") for k, names in self._names().items() for n in between(names, start[k], end[k])]
        return [Files(paths[i : i + FILES]) for i in range(0, len(paths), FILES)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for kind, path in partition.paths:
            folder, name = path.rsplit("/", 1)
            system, where = _open(folder)
            at = datetime.fromtimestamp(time_of(name) / 1000, timezone.utc)
            with system.open_input_stream(f"{where}/{name}") as file:
                text = file.read().decode("utf-8", "replace")
            for domain in certified(text) if kind == "messages" else polled(text, self.entries):
                yield domain, kind, name, at

    def commit(self, end: dict) -> None:
        pass


def certified(text: str) -> Iterator[str]:
    """Names of a file of certificate messages, one JSON text a line; other messages and broken lines are left out."""
    for line in text.splitlines():
        try:
            message = json.loads(line)
            if message["message_type"] == "certificate_update":
                yield from [n.replace("*.", "") for n in message["data"]["leaf_cert"]["all_domains"] if n]
        except (ValueError, KeyError, TypeError, AttributeError):
            continue


def polled(text: str, entries: int = ENTRIES) -> Iterator[str]:
    """Names of a polled page, a JSON list whose first entries count; a broken page has none."""
    try:
        page = json.loads(text)
    except ValueError:
        return
    for entry in page[:entries] if isinstance(page, list) else []:
        if isinstance(entry, dict):
            yield from [n.replace("*.", "") for n in str(entry.get("name_value") or "").split("\n") if n]


class Reconnecting(DataSource):
    """spark.readStream.format("reconnecting") with options messages, polls (folders), silence (seconds), entries (of a page)."""

    @classmethod
    def name(cls) -> str:
        return "reconnecting"

    def schema(self) -> str:
        return "domain string, feed string, file string, at timestamp"

    def streamReader(self, schema) -> Reader:
        return Reader(dict(self.options))


def certificates(spark: SparkSession, messages: str, polls: str, silence: int = SILENCE, late: str = "1 day") -> DataFrame:
    """(domain, hit, feed, at): suspicious names of both feeds, each once within `late` of its first sight."""
    spark.dataSource.register(Reconnecting)
    rows = spark.readStream.format("reconnecting").option("messages", messages).option("polls", polls).option("silence", str(silence)).load()
    found = rows.withColumn("hit", suspicious(F.col("domain"))).filter("hit is not null").drop("file")
    return found.withWatermark("at", late).dropDuplicatesWithinWatermark(["domain"])
