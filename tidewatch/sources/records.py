"""Record files cut into byte ranges: a JSON array, or an object with a `Records` array, of any size read by many
tasks.

Where a record starts depends on all bytes before it: how deep they nest, and if they end within a string. A
range's bytes are an automaton for that. First each range tells, for each of the three ways to enter it (outside of
a string, in one, in one after a backslash), how it is left and by how many levels; a scan over the ranges of a file
gives the state that each is entered in; then each range gives the records that start in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import stripped
from tidewatch.sources import scratch
from tidewatch.sources.files import record_files
from tidewatch.sources.tail import _store, listed

#: Bytes of a range, and of what is read at once.
PART = 32 << 20
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_SPACE = " \t\r\n"
# How a file starts that holds a list of records.
_ARRAY, _WRAPPED = re.compile(rb"\s*\["), re.compile(rb'\s*\{\s*"Records"\s*:\s*\[')
HEAD = 4096


def strings(data: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """For each byte, if it is outside of a string (the quotes of one are not), and the state at the end."""
    slash = data == 92
    n = len(data)
    if not n:
        return np.zeros(0, bool), state
    # a backslash at an even place of its run escapes what comes after it; outside of strings there are none
    at = np.flatnonzero(slash)
    first = np.ones(len(at), bool)
    first[1:] = np.diff(at) > 1
    start = at[first][np.cumsum(first) - 1] if len(at) else at
    if state == ESCAPED and len(at) and at[0] == 0:  # the first is escaped itself
        start = np.where(start == 0, 1, start)
    escaping = at[(at - start) % 2 == 0] if len(at) else at
    escaping = escaping[escaping >= start[(at - start) % 2 == 0]] if len(at) else at
    quote = data == 34
    free = escaping + 1
    quote[free[free < n]] = False
    if state == ESCAPED:
        quote[0] = False
    inside = (np.cumsum(quote) + (state != OUTSIDE)) % 2 == 1
    end = (ESCAPED if len(escaping) and escaping[-1] == n - 1 else INSIDE) if inside[-1] else OUTSIDE
    return ~inside & ~quote, end


def levels(data: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """By how many levels each byte goes deeper."""
    up = (data == 123) | (data == 91)
    down = (data == 125) | (data == 93)
    return np.where(outside, up.astype(np.int64) - down, 0)


def summary(data: bytes) -> list[tuple[int, int, list[int]]]:
    """For each state at the start: that at the end, the levels between, and the places at which it is 1, 2, ... levels
    higher than at the start for the first time."""
    raw, out = np.frombuffer(data, np.uint8), []
    for state in (OUTSIDE, INSIDE, ESCAPED):
        outside, end = strings(raw, state)
        deep = np.cumsum(levels(raw, outside))
        least = -np.minimum.accumulate(np.minimum(deep, 0))
        out.append((end, int(deep[-1]), np.searchsorted(least, np.arange(1, least[-1] + 1)).tolist()))
    return out


def records_in(read, start: int, end: int, state: int, depth: int, level: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the objects at a level that start in [start, end), the state and depth at the start being
    known. read(from, to) gives bytes; it is asked for more until the last record has ended."""
    open_at, held, at, step = None, [], start, end - start
    while step and (data := read(at, at + step)):
        raw = np.frombuffer(data, np.uint8)
        outside, state = strings(raw, state)
        deep = depth + np.cumsum(levels(raw, outside))
        opens = np.flatnonzero(outside & (raw == 123) & (deep == level + 1))
        closes = np.flatnonzero(outside & (raw == 125) & (deep == level))
        depth, done = int(deep[-1]), 0
        if open_at is not None:
            if not len(closes):
                held.append(data)
                at += len(data)
                step = 1 << 20
                continue
            done = int(closes[0]) + 1
            yield open_at, b"".join([*held, data[:done]])
            open_at, held = None, []
        if at >= end:
            return
        opens = opens[(opens >= done) & (opens + at < end)]
        after = np.searchsorted(closes, opens)
        for o, c in zip(opens.tolist(), after.tolist(), strict=True):
            if c < len(closes):
                yield at + o, data[o : int(closes[c]) + 1]
            else:
                open_at, held = at + o, [data[o:]]
        at += len(data)
        if open_at is None:
            return
        step = 1 << 20


def split_record_files(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """(source_id, line_no, raw) of the records of files that hold a JSON array or an object whose first key is
    `Records`, each file in ranges of `part` bytes; other files, and those whose brackets or strings don't end, as by
    record_files(). raw is the record's own text; line_no orders the records of a file (the byte at which a record
    starts, from 1). Elements that are no objects are left out; a record that is no good JSON is a row of its own,
    where record_files() takes its whole file for lines. `path` is a file, a folder with all folders in it, or a folder with a
    pattern, in a store that executors reach through pyarrow.
    """
    files = [(f.path, f.size) for f in listed(path, True)]  # by the driver, as a file source does
    most = 8 * spark.sparkContext.defaultParallelism

    def tasks(rows: int) -> int:
        """As many as the bytes ask for: small files and ranges share tasks."""
        return max(1, min(rows, most + sum(size for _, size in files) // PART))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where a file's list starts, and at which level its records are; null if it holds none."""
        for batch in batches:
            found = []
            for p in batch.column("path").to_pylist():
                with _store(p)[0].open_input_file(p) as opened:
                    head = opened.read(HEAD)
                start = (array := _ARRAY.match(head)) or _WRAPPED.match(head)
                found.append((start.end(), 1 if array else 2) if start else (None, None))
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["path", "size", "begin", "level"])

    known = spark.createDataFrame(files, "path string, size long").repartition(tasks(len(files))).mapInArrow(heads, "path string, size long, begin long, level long")
    known = sorted(map(tuple, known.collect()))  # a row for each file
    split = [(p, begin, size, level) for p, size, begin, level in known if begin is not None]
    plain = [(p,) for p, _, begin, _ in known if begin is None]
    cuts = [(i, p, a, min(a + part, size), level) for i, (p, begin, size, level) in enumerate(split) for a in range(begin, size, part)]
    kinds = "file int, path string, start long, stop long, level int"
    names = ["file", "path", "start", "stop", "level", "state", "depth", "until", "over"]
    ranges = spark.createDataFrame(cuts, kinds).repartition(tasks(len(cuts)), "file", "start")

    def reader(p: str):
        opened = _store(path)[0].open_input_file(p)

        def read(a: int, b: int) -> bytes:
            opened.seek(a)
            return opened.read(b - a)

        return read

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [summary(reader(p)(a, b)) for p, a, b in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop")), strict=True)]
            lists = [pa.array([[x[k] for x in g] for g in got], pa.list_(pa.int64())) for k in (0, 1)]
            lists.append(pa.array([[x[2] for x in g] for g in got], pa.list_(pa.list_(pa.int64()))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "ends", "deeper", "higher"])

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, state, depth, ended = None, OUTSIDE, 0, False
        for batch in batches:
            states, depths, until, over = [], [], [], []
            for f, start, stop, level, ends, deeper, higher in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop", "level", "ends", "deeper", "higher")), strict=True):
                if f != file:
                    file, state, depth, ended = f, OUTSIDE, level, False
                states.append(state)
                depths.append(depth)
                up = depth - level + 1  # levels to the end of the list
                last = not ended and len(higher[state]) >= up
                until.append(start if ended else start + higher[state][up - 1] if last else stop)
                state, depth, ended = ends[state], depth + deeper[state], ended or last
                over.append(state == OUTSIDE and depth == 0)
            columns = [batch.column(c) for c in names[:5]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(states, pa.int64()), pa.array(depths, pa.int64()), pa.array(until, pa.int64()), pa.array(over)], names)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, a, b, level, state, depth in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "until", "level", "state", "depth")), strict=True):
                at, raw, size = [], [], 0
                for place, text in records_in(reader(p), a, b, state, depth, level):
                    at.append(place + 1)
                    raw.append(text.decode("utf-8", "replace"))
                    size += len(text)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array([p] * len(at)), pa.array(at, pa.int64()), pa.array(raw)], ["source_id", "line_no", "raw"])
                        at, raw, size = [], [], 0
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(at)), pa.array(at, pa.int64()), pa.array(raw)], ["source_id", "line_no", "raw"])

    sums = ranges.mapInArrow(summed, f"{kinds}, ends array<long>, deeper array<long>, higher array<array<long>>")
    sums = scratch.written(sums, "ranges").repartition("file").sortWithinPartitions("file", "start")
    states = scratch.written(sums.mapInArrow(entered, f"{kinds}, state long, depth long, until long, over boolean"), "states")
    whole = states.groupBy("file").agg(F.max_by("over", "start").alias("good"), F.max("path").alias("p"))
    bad = [r.p for r in whole.where("not good").collect()]
    good = states.where(~F.col("path").isin(bad)) if bad else states
    out = good.repartition(tasks(len(cuts)), "file", "start").mapInArrow(found, "source_id string, line_no long, raw string")
    rest = [p for p, *_ in plain] + bad
    out = out.select("source_id", "line_no", stripped(F.col("raw")).alias("raw"))
    return out.unionByName(record_files(spark, rest)) if rest else out
