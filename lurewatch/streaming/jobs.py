"""Structured Streaming jobs: daily dedup, whitelisting, retry with dead letters, monitoring escalation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rules import suspicious

CT_SCHEMA = "message_type string, data struct<leaf_cert: struct<all_domains: array<string>>>"


def certificate_names(messages: DataFrame) -> DataFrame:
    """(value: JSON text) -> (domain, hit): names of certificate messages that look suspicious; stateless."""
    m = messages.select(F.from_json("value", CT_SCHEMA).alias("m")).filter("m.message_type = 'certificate_update'")
    names = m.select(F.explode("m.data.leaf_cert.all_domains").alias("d")).select(F.regexp_replace("d", r"^\*\.", "").alias("domain"))
    return names.withColumn("hit", suspicious(F.col("domain"))).filter("hit is not null")


def daily_dedup(jobs: DataFrame, key: str = "domain", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """First job of a key and day. Works on batches and streams; the event's day is the key's day. A stream forgets a key when
    the watermark is past its first job of the day by `late`, so the state holds the keys of about two days."""
    dated = jobs.withColumn("day", F.to_date(ts))
    if not jobs.isStreaming:
        return dated.dropDuplicates([key, "day"])
    return dated.withWatermark(ts, late).dropDuplicatesWithinWatermark([key, "day"])


def whitelisted(jobs: DataFrame, whitelist: DataFrame, key: str = "domain") -> DataFrame:
    """jobs plus status Clean where the key is listed; a stream-static join."""
    listed = whitelist.select(F.col("domain").alias("_w")).distinct()
    return jobs.join(listed, F.col(key) == F.col("_w"), "left").withColumn("status", F.when(F.col("_w").isNotNull(), "Clean")).drop("_w")


def in_order(parts: Iterator[pd.DataFrame], names: tuple[str, ...]) -> list[tuple]:
    """The rows that one key has in a micro-batch, in order of the first name, over all the chunks they come in."""
    found = [row for part in parts for row in part[list(names)].itertuples(index=False, name=None)]
    return sorted(found, key=lambda r: r[0])


class Expiring(StatefulProcessor):
    """One value for each key that is forgotten `horizon` seconds of event time after the key's last row (`at`); without a horizon
    never. A value that says nothing more is not kept at all."""

    FIELD, COLUMNS = "", ()

    def __init__(self, horizon: int | None = None):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.FIELD)

    def held(self, default):
        return self.value.get()[0] if self.value.exists() else default

    def keep(self, value, last) -> None:
        """Hold a value (None: nothing) until `horizon` after the time `last`."""
        if self.horizon is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if value is None:
            self.value.clear()
            return
        self.value.update((value,))
        if self.horizon is not None:
            self.handle.registerTimer(int(pd.Timestamp(last).timestamp() * 1000) + 1000 * self.horizon)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        yield pd.DataFrame([], columns=list(self.COLUMNS))

    def close(self) -> None:
        pass


def expiring(rows: DataFrame, key: str, processor: Expiring, schema: str, late: str) -> DataFrame:
    """The processor's rows for each key; with a horizon, timers go by the event time `at`, which may be `late`."""
    if processor.horizon is None:
        return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "none")
    return rows.withWatermark("at", late).groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")


class Retry(Expiring):
    """Counts failures of a job: 30 s and 120 s to the next tries, dead after the third. A job that is done or dead leaves no state."""

    DELAYS = (30, 120)
    FIELD, COLUMNS = "n int", ("job", "outcome", "retries", "delay_s")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        out, n, last = [], self.held(0), None
        for _, failed, *at in in_order(rows, ("seq", "failed", *(["at"] if self.horizon is not None else []))):
            last = max([x for x in (last, *at) if x is not None], default=None)
            if not failed:
                n = 0
                out.append((key[0], "done", 0, 0))
                continue
            n += 1
            out.append((key[0], "dead", n, 0) if n >= 3 else (key[0], "retry", n, self.DELAYS[n - 1]))
            n = 0 if n >= 3 else n
        self.keep(n or None, last)
        yield pd.DataFrame(out, columns=list(self.COLUMNS))


RETRY_SCHEMA = "job long, outcome string, retries int, delay_s int"


def retries(results: DataFrame, horizon: int | None = None, late: str = "1 hour") -> DataFrame:
    """(job, seq, failed) -> (job, outcome, retries, delay_s). With a horizon, results also have their time `at`, and a job that is heard
    of no more is forgotten so many seconds after its last result."""
    return expiring(results, "job", Retry(horizon), RETRY_SCHEMA, late)


class Escalate(Expiring):
    """Keeps a domain's last content state and reports parked or unrelated pages that turn into look-alikes. Only those two states
    can lead to a report, so no other is kept."""

    FIELD, COLUMNS = "state string", ("domain", "seq", "change")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        out, state, last = [], self.held(None), None
        for seq, new, credentials, *at in in_order(rows, ("seq", "state", "credentials", *(["at"] if self.horizon is not None else []))):
            last = max([x for x in (last, *at) if x is not None], default=None)
            if state in ("parked", "unrelated") and new == "lookalike" and credentials:
                out.append((key[0], seq, "Suspected->Phishing"))
            state = new
        self.keep(state if state in ("parked", "unrelated") else None, last)
        yield pd.DataFrame(out, columns=list(self.COLUMNS))


def escalations(checks: DataFrame, horizon: int | None = None, late: str = "1 day") -> DataFrame:
    """(domain, seq, state, credentials) -> (domain, seq, change). With a horizon, checks also have their time `at`, and a domain is
    forgotten so many seconds after its last check."""
    return expiring(checks, "domain", Escalate(horizon), "domain string, seq long, change string", late)


class Delayed(StatefulProcessor):
    """Holds a failed job back until its time has come: 30 s after the first failure, 120 s after the second; after the third
    it is dead. A job is (job, failed); what comes out is what a worker may take now. A job that is done or dead leaves no state,
    and one that nobody reports on again goes after `horizon` seconds."""

    def __init__(self, delays: tuple[int, int] = Retry.DELAYS, horizon: int = 86_400):
        self.delays, self.horizon = delays, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tries = handle.getValueState("tries", "n int", ttlDurationMs=1000 * self.horizon)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        n, out = (self.tries.get()[0] if self.tries.exists() else 0), []
        for seq, failed in in_order(rows, ("seq", "failed")):
            n = n + 1 if failed else 0
            if n >= 3:
                out.append((key[0], "dead", n))
                n = 0
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if n:
            self.tries.update((n,))
            self.handle.registerTimer(timer.getCurrentProcessingTimeInMs() + 1000 * self.delays[n - 1])
        else:
            self.tries.clear()
        yield pd.DataFrame(out, columns=["job", "outcome", "retries"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.tries.get()[0] if self.tries.exists() else 0
        yield pd.DataFrame([(key[0], "ready", n)] if n else [], columns=["job", "outcome", "retries"])

    def close(self) -> None:
        pass


def delayed(results: DataFrame, delays: tuple[int, int] = Retry.DELAYS, horizon: int = 86_400) -> DataFrame:
    """(job, seq, failed) -> (job, outcome, retries): `ready` when the delay of a failed job has passed, `dead` after the
    third failure. Timers go by the processing time."""
    return results.groupBy("job").transformWithStateInPandas(Delayed(delays, horizon), "job long, outcome string, retries int", "append", "processingTime")


class Monitor(StatefulProcessor):
    """A domain's monitoring: its last state, its number of checks and its horizon. The state goes when the horizon passes."""

    DAYS = 90

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "state string, checks long, until long", ttlDurationMs=self.DAYS * 86_400_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        held, out = (self.held.get() if self.held.exists() else None), []
        for at, state, credentials in in_order(rows, ("at", "state", "credentials")):
            day = int(pd.Timestamp(at).timestamp() // 86_400)
            last, checks, until = held if held is not None else (None, 0, day + self.DAYS)
            if day >= until:
                continue  # beyond the horizon nothing is checked
            change = "Suspected->Phishing" if last in ("parked", "unrelated") and state == "lookalike" and credentials else None
            held = (state, checks + 1, until)
            out.append((key[0], pd.Timestamp(at), state, checks + 1, pd.Timestamp(86_400 * (day + 1), unit="s"), change))
        if held is not None:
            self.held.update(held)
        yield pd.DataFrame(out, columns=["domain", "at", "state", "checks", "next_check", "change"])

    def close(self) -> None:
        pass


def monitored(checks: DataFrame) -> DataFrame:
    """(domain, at, state, credentials) -> the log: (domain, at, state, checks, next_check, change)."""
    schema = "domain string, at timestamp, state string, checks long, next_check timestamp, change string"
    return checks.groupBy("domain").transformWithStateInPandas(Monitor(), schema, "append", "processingTime")


def queue(spark: SparkSession, folder: str) -> DataFrame:
    """The jobs of the queue's folder (`store.push`) as a stream; its checkpoint gives each job to the sink once."""
    schema = "domain string, source string, retries int, queued_at timestamp"
    return spark.readStream.text(folder).select(F.from_json("value", schema).alias("j")).select("j.*")


def daily_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the files of new registrations, as a stream, that look suspicious by the feed's rule."""
    names = spark.readStream.text(folder).select(F.trim("value").alias("domain")).filter("domain <> ''")
    return names.withColumn("hit", suspicious(F.col("domain"), feed=True)).filter("hit is not null")


def start_all(streams: dict[str, tuple[DataFrame, str]], folder: str) -> dict:
    """Start several streams (name -> stream and output folder) in one session, each with its own checkpoint."""
    return {n: s.writeStream.format("parquet").queryName(n).option("path", out).option("checkpointLocation", f"{folder}/{n}").trigger(availableNow=True).start() for n, (s, out) in streams.items()}
