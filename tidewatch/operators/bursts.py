"""Bursts of failures in batch: a threshold within a sliding window that starts anew after each breach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.predicates import is_failure_stream
from tidewatch.sources import scratch


def check_window(threshold: int, window_seconds: int) -> None:
    if threshold <= 0:
        raise ValueError("threshold must be over 0")
    if window_seconds <= 0:
        raise ValueError("window_seconds must be over 0")


def incident_id(keys: tuple[str, ...], ts: Column, first: Column, again: Column | None = None) -> Column:
    """A name that a rerun gives again: 128 bits, so that no two breaches of a large table share one. `again` counts the
    breaches before it with the same keys, time and first line, where lines have no numbers of their own."""
    of = F.to_json(F.struct(F.struct(*keys).alias("of"), F.unix_micros(ts).alias("us"), first.alias("line")), {"ignoreNullFields": "false"})
    of = of if again is None else F.concat(of, F.when(again > 0, again.cast("string")).otherwise(""))
    return F.concat(F.lit("inc_"), F.substring(F.sha2(of, 256), 1, 32))


#: Failures of a key that one task reads; a key with more is cut into parts.
PART = 1 << 17


def burst_incidents(events: DataFrame, keys: tuple[str, ...] = ("source_id",), threshold: int = 5, window_seconds: int = 60, part: int = PART) -> DataFrame:
    """(keys, incident_id, breach_ts, n_events, first_line, lines) of each breach, by event time.

    A key's failures are read in time order (ties by line) from a sorted partition, with the `threshold`
    - 1 latest ones as the only state: however many a key has, they never meet in one row or in memory. The
    failures of a key with over `part` are dealt out in parts, a task each; see _in_parts. A failure without a time
    is in no window with others.
    """
    check_window(threshold, window_seconds)
    f = events.where(is_failure_stream(F.col("event_type"), F.col("is_parsed")))
    rows = scratch.written(f.select(*keys, F.unix_micros("ts").alias("_us"), F.col("line_no").alias("_line")), "failures")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > part)
    hot = scratch.written(counts.select(*keys, F.monotonically_increasing_id().alias("_key")), "hot")
    window = window_seconds * 1_000_000
    if hot.isEmpty():
        found = _in_order(rows, keys, threshold, window)
    else:
        named = hot.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), "_key")
        met = [rows[k].eqNullSafe(named[f"_{i}"]) for i, k in enumerate(keys)]
        cold = _in_order(rows.join(named, met, "left_anti"), keys, threshold, window)
        parts = _in_parts(rows.join(named, met).select("_key", "_us", "_line"), threshold, window, part)
        found = cold.unionByName(parts.join(hot, "_key").drop("_key"))
    got = found.select(*keys, F.timestamp_micros("_us").alias("breach_ts"), F.size("lines").cast("long").alias("n_events"), F.col("lines")[0].alias("first_line"), "lines")
    return got.withColumn("incident_id", incident_id(keys, F.col("breach_ts"), F.col("first_line")))


def _in_order(rows: DataFrame, keys: tuple[str, ...], threshold: int, window: int) -> DataFrame:
    """(keys, _us, lines) of each breach: a fold over the failures of each key in one task."""
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "_us", "_line")
    n = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, live = None, []
        for batch in batches:
            at, found = [], []
            for k, (*key, us, line) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if key != of:
                    of, live = key, []
                live = [x for x in live if us is not None and x[0] is not None and x[0] >= us - window]
                live.append((us, line))
                if len(live) >= threshold:
                    at.append(k)
                    found.append([x[1] for x in live])
                    live = []
            last = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*last.columns[: n + 1], pa.array(found, pa.list_(batch.schema.field(n + 1).type))], names)

    kinds = rows.schema.fields
    schema = T.StructType([*kinds[: n + 1], T.StructField("lines", T.ArrayType(kinds[n + 1].dataType))])
    names = schema.names
    return rows.mapInArrow(fold, schema)


def candidates(us: np.ndarray, known: np.ndarray, threshold: int, window: int) -> np.ndarray:
    """Places, among failures in time order, where the `threshold` latest ones are in one window. What the fold
    finds are those of them that are `threshold` places or more after the one that it found before, as a breach
    uses up its failures: the times matter no more."""
    n = len(us) - threshold + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    close = (us[threshold - 1 :] - us[:n] <= window) & known[:n] & known[threshold - 1 :] if threshold > 1 else np.ones(n, bool)
    return np.flatnonzero(close) + threshold - 1


def exits(found: np.ndarray, size: int, threshold: int) -> list[int]:
    """A part as an automaton. Its state is how many of the next failures still can't end a breach: 0 to threshold
    - 1. For each state at the start of a part of `size` failures with candidates at the places `found`, the state
    at its end."""
    after = np.searchsorted(found, found + threshold).tolist()
    left, at = [0] * len(found), found.tolist()
    for i in range(len(at) - 1, -1, -1):
        left[i] = left[after[i]] if after[i] < len(at) else max(0, at[i] + threshold - size)
    first = np.searchsorted(found, np.arange(threshold)).tolist()
    return [left[i] if i < len(at) else max(0, state - size) for state, i in enumerate(first)]


def breaches(found: np.ndarray, state: int, threshold: int) -> list[int]:
    """The candidates that are breaches if a part is entered in a state."""
    out, i = [], int(np.searchsorted(found, state))
    while i < len(found):
        out.append(int(found[i]))
        i = int(np.searchsorted(found, out[-1] + threshold))
    return out


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole parts from rows sorted by _key and _part."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.table(batch)
        key, part = rows.column("_key").to_numpy(), rows.column("_part").to_numpy()
        cuts = (np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1).tolist()
        if held and any(held[-1].column(c)[-1] != rows.column(c)[0] for c in ("_key", "_part")):
            cuts.insert(0, 0)
        start = 0
        for c in cuts:
            held.append(rows.slice(start, c - start))
            yield pa.concat_tables(held).combine_chunks()
            held, start = [], c
        held.append(rows.slice(start))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _in_parts(rows: DataFrame, threshold: int, window: int, part: int) -> DataFrame:
    """(_key, _us, lines) of each breach among rows(_key, _us, _line), any number of a key over many tasks.

    Ranges of (key, time, line) number each key's failures, of which every `part` are a part; it also gets the
    threshold - 1 before it. First each part gives the table of its automaton (exits), a row of `threshold` numbers;
    these are composed in the order of a key's parts; then each part, whose state at the start is known, gives its
    breaches. The same, to the line, as the fold in one task.
    """
    size = max(part, threshold)
    order = ("_key", "_us", "_line")
    ordered = scratch.written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    task = F.shiftright("_at", 33).alias("_task")
    runs = ordered.groupBy("_key", task).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("_key").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("_key").alias("_k"), F.col("_task").alias("_t"), (before - F.col("_first")).alias("_shift"))
    placed = ordered.join(runs, (F.col("_key") == F.col("_k")) & (F.shiftright("_at", 33) == F.col("_t")))
    placed = placed.select("_key", "_us", "_line", (F.col("_at") + F.col("_shift")).alias("_place"))
    own = F.expr(f"_place div {size}")
    reach = F.expr(f"(_place + {threshold - 1}) div {size}")  # the last failures of a part are also read before the next
    dealt = placed.select("*", F.explode(F.when(own == reach, F.array(own)).otherwise(F.array(own, reach))).alias("_part"))
    dealt = scratch.written(dealt, "parts")

    def found_in(rows: pa.Table) -> tuple[np.ndarray, int, int]:
        """The candidates of a part, counted from its own first failure, how many others are before that, and
        the number of its own."""
        us = rows.column("_us")
        known = us.is_valid().to_numpy()
        base = rows.column("_part")[0].as_py() * size
        halo = int((rows.column("_place").to_numpy() < base).sum())
        at = candidates(us.fill_null(0).to_numpy(), known, threshold, window) - halo
        return at[at >= 0], halo, rows.num_rows - halo

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts_of(batches):
            at, _, own = found_in(rows)
            if own:
                yield pa.RecordBatch.from_arrays([rows.column("_key").combine_chunks()[:1], rows.column("_part").combine_chunks()[:1], pa.array([exits(at, own, threshold)], pa.list_(pa.int32()))], ["_key", "_part", "_exits"])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, 0
        for batch in batches:
            states = []
            for k, after in zip(batch.column("_key").to_pylist(), batch.column("_exits").to_pylist(), strict=True):
                key, state = k, state if k == key else 0
                states.append(state)
                state = after[state]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_part"), pa.array(states, pa.int32())], ["_key", "_part", "_state"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts_of(batches):
            at, halo, own = found_in(rows)
            states = [s for s in rows.column("_state").to_pylist() if s is not None]
            ends = [x + halo for x in breaches(at, states[0], threshold)] if own and states else []
            last = rows.select(["_key", "_us"]).take(pa.array(ends, pa.int64())).combine_chunks()
            line = rows.column("_line").to_pylist()
            lines = pa.array([line[e - threshold + 1 : e + 1] for e in ends], pa.list_(rows.schema.field("_line").type))
            yield from last.append_column("lines", lines).combine_chunks().to_batches()

    deal = lambda df: df.repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_place")
    per_part = scratch.written(deal(dealt).mapInArrow(tables, "_key long, _part long, _exits array<int>"), "exits")
    states = per_part.repartition("_key").sortWithinPartitions("_key", "_part").mapInArrow(composed, "_key long, _part long, _state int")
    with_state = deal(dealt.join(states, ["_key", "_part"]))
    line = rows.schema["_line"].dataType.simpleString()
    return with_state.mapInArrow(found, f"_key long, _us long, lines array<{line}>")


def burst_flags(events: DataFrame, keys: tuple[str, ...] = ("source_id",), threshold: int = 5, window_seconds: int = 60) -> DataFrame:
    """Failures with n_recent, the failures of their key in the window up to them, and is_burst: the
    stateless form, equal to burst_incidents up to a key's first breach."""
    check_window(threshold, window_seconds)
    w = Window.partitionBy(*keys).orderBy(F.unix_micros("ts")).rangeBetween(-window_seconds * 1_000_000, 0)
    f = events.where(is_failure_stream(F.col("event_type"), F.col("is_parsed")))
    return f.withColumn("n_recent", F.count("*").over(w)).withColumn("is_burst", F.col("n_recent") >= threshold)
