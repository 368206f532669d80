"""Bursts of failures on streams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from heapq import merge
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators import reports
from tidewatch.operators.bursts import check_window, incident_id
from tidewatch.operators.normalize import normalize
from tidewatch.operators.predicates import is_failure_stream
from tidewatch.plans import incidents

#: What a breach tells of each of its events, and what is kept of an open window.
_EVENT = ("us", "line_no", "source_ip", "user", "event_type", "auth_method")
_KINDS = "us long, line_no long, source_ip string, user string, event_type string, auth_method string"
_FIELDS = ", ".join(f.replace(" ", ":") for f in _KINDS.split(", "))
_OUT = f"breach_us long, n_events long, first_line long, again long, lines array<long>, events array<struct<{_FIELDS}>>"


def _tuples(frame: pd.DataFrame) -> list[tuple]:
    """The events of a frame in time order."""
    return sorted(zip(*(frame[c].tolist() for c in _EVENT), strict=True), key=lambda e: e[:2])


class _Windows(StatefulProcessor):
    """State: the failures of one key since its last breach that are still in the window; there are never
    `threshold` of them left after a batch."""

    def __init__(self, keys: list[str], threshold: int, window_us: int):
        self.keys, self.threshold, self.window_us = keys, threshold, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getListState("open", _KINDS)

    def fold(self, key: Any, events: Iterable[tuple]) -> pd.DataFrame:
        """The breaches that events, in time order, give with those of the open window, which is stored."""
        live = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        out, told = [], Counter()
        for event in events:
            live = [x for x in live if x[0] >= event[0] - self.window_us] + [event]
            if len(live) >= self.threshold:
                same = event[0], live[0][1]  # lines of one block have one number
                out.append((*key, event[0], len(live), live[0][1], told[same], [x[1] for x in live], [dict(zip(_EVENT, x, strict=True)) for x in live]))
                told[same] += 1
                live = []
        self.keep(live)
        return pd.DataFrame(out, columns=[*self.keys, "breach_us", "n_events", "first_line", "again", "lines", "events"])

    def keep(self, live: list[tuple]) -> None:
        if live:
            self.open.put(live)
        else:
            self.open.clear()

    def end_at(self, us: int) -> None:
        """Ask to be called when the clock has passed this time."""
        self.handle.registerTimer(us // 1000 + 1)

    def prune(self, us: int) -> None:
        """Drop the open failures that no event later than `us` can meet in a window; ask for the end of the
        others."""
        live = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        live = [x for x in live if x[0] >= us - self.window_us]
        self.keep(live)
        if live:
            self.end_at(live[-1][0] + self.window_us)

    def close(self) -> None:
        pass


class _Arriving(_Windows):
    """Takes the events of a batch at once, each batch in time order. By the clock of arrival, a timer ends a
    window that nothing more comes to; by that of the events it may not end while an earlier event may come."""

    def __init__(self, keys: list[str], threshold: int, window_us: int, arrival: bool, timers: bool):
        super().__init__(keys, threshold, window_us)
        self.arrival, self.timers = arrival, timers

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events: Iterable[tuple] = merge(*map(_tuples, rows), key=lambda e: e[:2])
        if self.arrival:  # one after the other, so that no two breaches have the same time
            events = ((e[0] + n, *e[1:]) for n, e in enumerate(events))
        yield self.fold(key, events)
        if self.timers and self.open.exists():
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.end_at(max(x[0] for x in self.open.get()) + self.window_us)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.prune(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        yield from ()


class _Ordered(_Windows):
    """Takes events when the watermark has passed them, so in time order however they came. More state: the events
    that wait, by spans of time. A timer at the end of each takes its events; the last one ends the window."""

    def __init__(self, keys: list[str], threshold: int, window_us: int, span_us: int):
        super().__init__(keys, threshold, window_us)
        self.span_us = span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "span long", f"events array<struct<{_FIELDS}>>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for span, events in groupby(_tuples(frame), key=lambda e: e[0] // self.span_us):
                held = self.waiting.getValue((span,))[0] if self.waiting.containsKey((span,)) else []
                self.waiting.updateValue((span,), ([*map(tuple, held), *events],))
                self.end_at((span + 1) * self.span_us)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for span in sorted(k[0] for k in self.waiting.keys() if (k[0] + 1) * self.span_us <= now):
            events = sorted(map(tuple, self.waiting.getValue((span,))[0]), key=lambda e: e[:2])
            self.waiting.removeKey((span,))
            yield self.fold(key, events)
        self.prune(now)


def burst_stream(events: DataFrame, keys: tuple[str, ...] = ("source_id",), threshold: int = 5, window_seconds: int = 60, clock: str = "event", lateness: str | None = None, end_idle: bool = False) -> DataFrame:
    """The breaches of a stream of events, with the columns of burst_incidents and their events(us,
    line_no, source_ip, user, event_type, auth_method).

    clock: "event" (ts, the same in every run) or "arrival" (when the batch is read, and a microsecond more
    for each event of the key before). By that of arrival, end_idle ends a window that nothing more comes to by
    a timer; Spark then runs batches for ever, so not with a trigger that should end by itself.

    lateness, by the clock of events: how far an event may be behind the latest failure. Failures wait until the
    watermark has passed them and are then taken in time order, so the breaches are those of
    burst_incidents however the events came; what is later than that is dropped, and counted by Spark
    (numRowsDroppedByWatermark). A breach is told that much later, and a quarter of a window; the state of a key ends
    with its window. Times that were assumed don't move the watermark. Without lateness no event
    is late: each batch is taken at once, in time order, and a key keeps its open window, of fewer than
    `threshold` events, until the next one.

    The events of a key are in memory for one batch at most or, with lateness, for one Arrow batch of input and a
    quarter of a window at a time. Needs the RocksDB state store (see use_rocksdb).
    """
    check_window(threshold, window_seconds)
    if lateness and clock != "event":
        raise ValueError("lateness is by the clock of events")
    f = events.where(is_failure_stream(F.col("event_type"), F.col("is_parsed")))
    us = F.unix_micros("ts") if clock == "event" else F.unix_micros(F.current_timestamp())
    more = [F.col(c) if c in f.columns else F.lit(None).cast("string").alias(c) for c in _EVENT[2:]]
    known = F.when(~F.coalesce("ts_assumed", F.lit(False)), F.col("ts")) if "ts_assumed" in f.columns else F.col("ts")
    f = f.select(*(F.col(k).alias(f"_{k}") for k in keys), us.alias("us"), F.coalesce("line_no", F.lit(0)).alias("line_no"), *more, *([known.alias("_ts")] if lateness else []))
    schema = ", ".join(f"{k} {f.schema[f'_{k}'].dataType.simpleString()}" for k in keys)
    window_us = window_seconds * 1_000_000
    if lateness:
        f, processor, mode = f.withWatermark("_ts", lateness), _Ordered(list(keys), threshold, window_us, max(1_000, window_us // 4)), "EventTime"
    else:
        timers = end_idle and clock == "arrival"
        processor, mode = _Arriving(list(keys), threshold, window_us, clock == "arrival", timers), "ProcessingTime" if timers else "None"
    got = f.groupBy(*(f"_{k}" for k in keys)).transformWithStateInPandas(processor, f"{schema}, {_OUT}", "append", mode)
    got = got.withColumn("breach_ts", F.timestamp_micros("breach_us")).drop("breach_us")
    return got.withColumn("incident_id", incident_id(keys, F.col("breach_ts"), F.col("first_line"), F.col("again"))).drop("again")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def watch(raw: DataFrame, kind: str, on_breach: Callable[[DataFrame, int], None], checkpoint: str, *, keys: tuple[str, ...] = ("source_id",), threshold: int = 5, window_seconds: int = 60, clock: str = "event", lateness: str | None = None, available_now: bool = False, **options):
    """Starts the query: normalize the landed lines of a stream, find breaches, hand each batch of
    incidents to on_breach(incidents, batch_id). The checkpoint holds offsets and windows. clock and lateness
    are those of burst_stream; other options are the normalizer's."""
    found = burst_stream(normalize(raw, kind, **options), keys, threshold, window_seconds, clock, lateness, not available_now)
    writer = found.writeStream.foreachBatch(on_breach).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_incidents(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch under its number, so a repeated batch replaces itself."""

    def write(incidents: DataFrame, batch: int) -> None:
        incidents.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def evidence_to(path: str, chunks: DataFrame, as_of: str | None = None, **options) -> Callable[[DataFrame, int], None]:
    """A handler for watch(): the events of each breach give its facts, these ask for guidance among
    chunks, and the evidence and an alert line go to a folder of the batch, which a repeat replaces."""

    def handle(found: DataFrame, batch: int) -> None:
        found = found.persist()
        told = found.select(F.col("incident_id").alias("source_id"), F.inline("events"))
        told = told.select("source_id", "line_no", F.timestamp_micros("us").alias("ts"), F.lit(False).alias("ts_assumed"), "source_ip", "user", "event_type", "auth_method", F.lit(True).alias("is_parsed"))
        rows = incidents.evidence_of(told, chunks, **options)
        at = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
        line = reports.syslog_line(F.struct("incident_id", "query", "packed_ids"), F.col("incident_id"), F.lit("unknown"), F.lit("breach"), at)
        rows.withColumn("alert", line).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        found.unpersist()

    return handle
