"""Streaming jobs over call and change events, each with a batch twin that gives the same rows once all input is closed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loamstone.sources.code import CLAIMS, extract
from loamstone.sources.tables import Catalogue

LATENESS = "1 hour"


def debounced(calls: DataFrame, quiet: str = "30 minutes", key: str = "repo") -> DataFrame:
    """Batches of paths per key: a batch closes after a quiet period. Runs on a stream (with watermark) and on a table alike."""
    if calls.isStreaming:
        calls = calls.withWatermark("ts", LATENESS)
    grouped = calls.groupBy(key, F.session_window("ts", quiet).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n_events"), F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths")).select(key, F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "n_events", "paths")


def daily_budget(calls: DataFrame, budget: int, key: str = "session") -> DataFrame:
    """Which calls a budget per key and UTC day admits, in order of time."""
    order = Window.partitionBy(key, F.to_date("ts")).orderBy("ts", "call_id")
    return calls.withColumn("admitted", F.row_number().over(order) <= budget)


def in_flight(calls: DataFrame, hold: str = "10 minutes", keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """The calls that start work: within a window of ``hold`` the first one of a key does, the others join it.

    Windows are fixed, so the rule needs no state beyond a window; on a stream duplicates are dropped within the watermark."""
    slot = F.window("ts", hold)["start"].alias("slot")
    if calls.isStreaming:
        return calls.withWatermark("ts", LATENESS).withColumn("slot", F.window("ts", hold)["start"]).dropDuplicatesWithinWatermark([*keys, "slot"])
    return calls.groupBy(*keys, slot).agg(F.min(F.struct("ts", "call_id")).alias("first"), F.count(F.lit(1)).alias("n_joined")).select(*keys, F.col("first.call_id").alias("call_id"), "n_joined")


class Bucket:
    """A token bucket: ``burst`` tokens at most, ``rate`` tokens a second."""

    def __init__(self, rate: float, burst: float, tokens: float | None = None, last: float | None = None):
        self.rate, self.burst = rate, burst
        self.tokens, self.last = burst if tokens is None else tokens, last

    def admit(self, at: float) -> bool:
        if self.last is not None:
            self.tokens = min(self.burst, self.tokens + self.rate * max(0.0, at - self.last))
        self.last = at if self.last is None else max(self.last, at)
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True


_ADMITTED = "key string, call_id long, admitted boolean"


def _seconds(ts: pd.Series) -> pd.Series:
    return ts.astype("int64") / (1e9 if ts.dtype == "datetime64[ns]" else 1e6)


def token_bucket(calls: DataFrame, rate: float = 1.0, burst: float = 5.0, key: str = "session") -> DataFrame:
    """Which calls a token bucket per key admits. Rows stream through a task in order of key and time, so a key of any size fits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, bucket = None, Bucket(rate, burst)
        for frame in frames:
            flags = []
            for k, at in zip(frame["key"], _seconds(frame["ts"])):
                if k != current:
                    current, bucket = k, Bucket(rate, burst)
                flags.append(bucket.admit(at))
            yield pd.DataFrame({"key": frame["key"], "call_id": frame["call_id"], "admitted": flags})

    keyed = calls.select(F.col(key).cast("string").alias("key"), "ts", "call_id")
    return keyed.repartition("key").sortWithinPartitions("key", "ts", "call_id").mapInPandas(run, _ADMITTED)


def token_bucket_stream(calls: DataFrame, rate: float = 1.0, burst: float = 5.0, key: str = "session") -> DataFrame:
    """Which calls a bucket admits as they arrive: each is answered in its own micro-batch, in the order of arrival. State per key is (tokens, last),
    dropped once the bucket must be full again; ``ordered_bucket_stream`` waits for calls that come late instead."""

    def step(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        bucket = Bucket(rate, burst, tokens, last)
        rows = pd.concat(list(frames)).sort_values(["ts", "call_id"])
        flags = [bucket.admit(at) for at in _seconds(rows["ts"])]
        state.update((bucket.tokens, bucket.last))
        state.setTimeoutDuration(max(1000, int(1000 * burst / rate)))
        yield pd.DataFrame({"key": group[0], "call_id": rows["call_id"], "admitted": flags})

    keyed = calls.select(F.col(key).cast("string").alias("key"), "ts", "call_id")
    return keyed.groupBy("key").applyInPandasWithState(step, _ADMITTED, "tokens double, last double", "append", "ProcessingTimeTimeout")


_WAITING = "tokens double, last double, times array<long>, ids array<long>, tags array<string>"
_PASSED = "key string, call_id long, ts timestamp, tag string, admitted boolean"


def ordered_bucket_stream(calls: DataFrame, rate: float = 1.0, burst: float = 5.0, key: str = "session", tag: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """``token_bucket`` as a stream in event time: calls wait in a key's state until the watermark has passed them, and are then admitted in order of
    time, so the rows are those of ``token_bucket`` whatever order calls arrive in. Calls that are later than ``lateness`` are dropped.

    A key's state is its bucket and what waits; it goes once the bucket must be full again. ``tag`` is a column that is handed on as it is.
    """

    def step(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, last, *held = state.get if state.exists else (burst, None, [], [], [])
        waiting = list(zip(*held))
        for frame in frames:
            times = frame["ts"].astype("datetime64[us]").astype("int64")
            waiting += zip(times.tolist(), frame["call_id"].tolist(), frame["tag"].tolist())
        waiting.sort(key=lambda w: w[:2])
        passed = state.getCurrentWatermarkMs() * 1000
        ready = [w for w in waiting if w[0] < passed]
        waiting = waiting[len(ready) :]
        bucket = Bucket(rate, burst, tokens, last)
        flags = [bucket.admit(w[0] / 1e6) for w in ready]
        full_at = 0 if bucket.last is None else int((bucket.last + burst / rate) * 1e6)
        if not waiting and full_at <= passed:
            state.remove()
        else:
            state.update((bucket.tokens, bucket.last, *([w[k] for w in waiting] for k in range(3))))
            # when the next call may pass, or when the state may go
            state.setTimeoutTimestamp(max(passed, waiting[0][0] if waiting else full_at) // 1000 + 1)
        if ready:
            yield pd.DataFrame({"key": group[0], "call_id": [w[1] for w in ready], "ts": pd.to_datetime([w[0] for w in ready], unit="us"), "tag": [w[2] for w in ready], "admitted": flags})

    keyed = calls.select(F.col(key).cast("string").alias("key"), "ts", "call_id", (F.col(tag) if tag else F.lit("")).cast("string").alias("tag")).withWatermark("ts", lateness)
    return keyed.groupBy("key").applyInPandasWithState(step, _PASSED, _WAITING, "append", "EventTimeTimeout")


def two_level(calls: DataFrame, rates: tuple[float, float] = (1.0, 1.0), bursts: tuple[float, float] = (5.0, 2.0), keys: tuple[str, str] = ("session", "path")) -> DataFrame:
    """A bucket per session and one per session and document; a session's token is spent even where the document's bucket refuses."""
    outer = token_bucket(calls, rates[0], bursts[0], keys[0]).select("call_id", F.col("admitted").alias("by_session"))
    passed = calls.join(outer.filter("by_session"), "call_id").withColumn("_pair", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    inner = token_bucket(passed, rates[1], bursts[1], "_pair").select("call_id", F.col("admitted").alias("by_document"))
    return calls.join(outer, "call_id").join(inner, "call_id", "left").select("call_id", "by_session", F.coalesce("by_document", F.lit(False)).alias("admitted"))


def two_level_stream(calls: DataFrame, root: str, rates: tuple[float, float] = (1.0, 1.0), bursts: tuple[float, float] = (5.0, 2.0), keys: tuple[str, str] = ("session", "path"), lateness: str = LATENESS) -> None:
    """``two_level`` as two chained streams below a shared folder; runs until the input is used up.

    The first level writes what it says to ``root/first``. What it admits is the input of the second, keyed by both keys, which writes to
    ``root/second``. Each level has its own state, watermark and checkpoint, and each can be lost and resumed alone: the first hands calls on in
    order of its watermark, so none is late for the second."""
    pair = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    run = lambda df, name: df.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/checkpoint-{name}").trigger(availableNow=True).start().awaitTermination()
    run(ordered_bucket_stream(calls.withColumn("_pair", pair), rates[0], bursts[0], keys[0], "_pair", lateness), "first")
    passed = calls.sparkSession.readStream.schema(_PASSED).parquet(f"{root}/first").filter("admitted")
    run(ordered_bucket_stream(passed, rates[1], bursts[1], "tag", None, lateness), "second")


def apply_changes(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``merge`` on every micro-batch of changes, each once, until the input is used up."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain(stream: DataFrame, catalogue: Catalogue, checkpoint: str, table: str = "claims") -> StreamingQuery:
    """Keep a small table of claims in step with a stream of files (repo, path, status, text, ord).

    In each micro-batch the last state of a path counts: claims of its files are replaced by what they now hold, those of deleted ones go, and the
    table is published as a whole, so that a batch that runs twice gives the same table. ``streaming.incremental.maintain`` rewrites touched
    buckets only and takes dependants along.
    """

    def step(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("repo", "path").agg(F.max(F.struct("ord", "status", "text")).alias("l")).select("repo", "path", "l.status", "l.text")
        held = catalogue.read(table, StructType.fromDDL("repo string, " + CLAIMS))
        fresh = extract(last.filter("status <> 'D'").select("repo", "path", "text"))
        kept = held.join(last.select("repo", "path"), ["repo", "path"], "left_anti")
        catalogue.publish(table, kept.unionByName(fresh.select(*kept.columns)))

    return apply_changes(stream, step, checkpoint)


def _field(spec: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in spec.split(","):
        body, _, step = part.partition("/")
        a, b = (low, high) if body == "*" else (int(x) for x in (body.split("-") * 2)[:2])
        out.update(range(a, b + 1, int(step or 1)))
    return out


def next_run(cron: str, after: dt.datetime) -> dt.datetime | None:
    """The first minute after ``after`` that all five fields allow (day of month AND day of week), within 366 days."""
    minute, hour, day, month, weekday = (_field(s, a, b) for s, (a, b) in zip(cron.split(), ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))))
    at = (after + dt.timedelta(minutes=1)).replace(second=0, microsecond=0)
    limit = after + dt.timedelta(days=366)
    while at <= limit:
        if at.month in month and at.day in day and (at.weekday() + 1) % 7 in weekday:
            if at.hour in hour and at.minute in minute:
                return at
            at += dt.timedelta(minutes=1) if at.hour in hour else dt.timedelta(hours=1) - dt.timedelta(minutes=at.minute)
        else:
            at = at.replace(hour=0, minute=0) + dt.timedelta(days=1)
    return None


def next_runs(schedules: DataFrame, after: dt.datetime) -> DataFrame:
    """Schedules (repo, cron) with their next run; one that never runs within 366 days has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            runs = [next_run(c, after) for c in frame["cron"]]
            yield pd.DataFrame({"repo": frame["repo"], "cron": frame["cron"], "next_run": pd.Series(runs, dtype="datetime64[us]")})

    return schedules.select("repo", "cron").mapInPandas(run, "repo string, cron string, next_run timestamp")
