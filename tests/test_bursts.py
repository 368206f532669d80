from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import bursts, facts
from tidewatch.operators.predicates import is_failure_batch, is_failure_stream
from tidewatch.streaming import bursts as stream

START = dt.datetime(2026, 1, 1)
SCHEMA = "source_id string, line_no long, ts timestamp, event_type string, is_parsed boolean, source_ip string, user string"


def frame(spark, seconds, kind="failed_login", key="k"):
    rows = [(key, i, START + dt.timedelta(seconds=s), kind, True, "ip", "u") for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, SCHEMA)


def breaches(df, threshold, window):
    rows = bursts.burst_incidents(df, ("source_id",), threshold, window).orderBy("source_id", "breach_ts").collect()
    return [(r.source_id, int((r.breach_ts - START).total_seconds()), r.n_events) for r in rows]


@pytest.mark.parametrize(
    "seconds, threshold, window, want",
    [((0, 10, 20), 3, 60, [20]), ((0, 10, 45), 3, 30, []), (range(0, 61, 10), 3, 60, [20, 50]), ((0, 60), 2, 60, [60]), ((0, 61), 2, 60, []), ((5, 5, 5), 3, 1, [5])],
)
def test_windows(spark, seconds, threshold, window, want):
    assert [b[1] for b in breaches(frame(spark, seconds), threshold, window)] == want


def test_hot_key_is_not_one_row(spark):
    """A key's failures go over several batches and are never collected."""
    rng = random.Random(5)
    seconds = sorted(rng.randrange(60_000) for _ in range(25_000))
    live, want = [], []
    for s in seconds:
        live = [x for x in live if x >= s - 20] + [s]
        if len(live) >= 12:
            want.append(("k", s, 12))
            live = []
    events = frame(spark, seconds)
    assert breaches(events, 12, 20) == want and len(want) > 10
    plan = bursts.burst_incidents(events, ("source_id",), 12, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def rows_of(df):
    return sorted(df.select("source_id", "breach_ts", "n_events", "first_line", "lines", "incident_id").collect(), key=str)


@pytest.mark.parametrize("threshold, window, part", [(1, 5, 7), (3, 60, 25), (5, 60, 4)])
def test_a_hot_key_in_parts_is_the_fold(spark, threshold, window, part):
    """Parts that end within windows, ties, times that are not known, and keys of one part beside it."""
    rng = random.Random(threshold)
    at = lambda s: None if s is None else START + dt.timedelta(seconds=s)
    seconds = [None] * 4 + [rng.randrange(1500) for _ in range(500)] + [700] * 30 + [5000 + i // 3 for i in range(90)]
    rows = [("hot", i, at(s)) for i, s in enumerate(seconds)] + [(None, i, at(s)) for i, s in enumerate(seconds[:200])] + [(k, i, at(10 * i)) for k in "ab" for i in range(6)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, i, t, "failed_login", True, "ip", "u") for k, i, t in rows], SCHEMA).repartition(5)
    want = rows_of(bursts.burst_incidents(df, ("source_id",), threshold, window))
    assert rows_of(bursts.burst_incidents(df, ("source_id",), threshold, window, part=part)) == want and len(want) > 15


def test_automata_of_parts_compose():
    import numpy as np

    rng = random.Random(4)
    for _ in range(200):
        n, threshold = rng.randrange(1, 60), rng.randrange(1, 6)
        us = np.array(sorted(rng.randrange(200) for _ in range(n)))
        found = bursts.candidates(us, np.ones(n, bool), threshold, 10)
        whole, cut, state, got = bursts.breaches(found, 0, threshold), 0, 0, []
        while cut < n:
            size = rng.randrange(1, 20)
            size = min(size, n - cut)
            mine = found[(found >= cut) & (found < cut + size)] - cut
            got += [cut + x for x in bursts.breaches(mine, state, threshold)]
            state = bursts.exits(mine, size, threshold)[state]
            cut += size
        assert got == whole


def test_a_hot_key_is_many_tasks(spark):
    """A key of 300,000 failures: no task has more than a few parts of it."""
    n = 300_000
    events = spark.range(n).select(F.lit("k").alias("source_id"), F.col("id").alias("line_no"), F.timestamp_seconds(F.col("id") + F.lit(10_000) * F.floor(F.col("id") / 7)).alias("ts"), F.lit("failed_login").alias("event_type"), F.lit(True).alias("is_parsed"))
    got = bursts.burst_incidents(events, ("source_id",), 5, 60, part=10_000)
    assert got.count() == n // 7 + (n % 7 >= 5)
    got = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(got) == 4 and max(r["count"] for r in got) < 0.6 * n // 7


def test_parameters(spark):
    with pytest.raises(ValueError):
        bursts.burst_incidents(frame(spark, [0]), threshold=0)
    with pytest.raises(ValueError):
        bursts.burst_flags(frame(spark, [0]), window_seconds=-1)


def test_predicates(spark):
    kinds = ["failed_login", "invalid_user", "sqli_attempt", "xss_attempt", "path_traversal", "windows_event_4625", "FAILED_x", "successful_login", "unparsed", "login_attempt", None]
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    got = df.select(is_failure_stream(F.col("k"), F.lit(True)), is_failure_batch(F.col("k"))).collect()
    assert [r[0] for r in got] == [True] * 7 + [False] * 4
    assert [bool(r[1]) for r in got] == [True] * 6 + [False, False, False, True, False]


def test_partitions_do_not_matter(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), i, START + dt.timedelta(seconds=rng.randrange(2000)), "failed_login", True, "ip", "u") for i in range(400)]
    want = None
    for n in (1, 4, 32):
        rng.shuffle(rows)
        got = breaches(spark.createDataFrame(rows, SCHEMA).repartition(n), 4, 60)
        want = want or got
        assert got == want and got


def test_stream_is_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = sorted((START + dt.timedelta(seconds=rng.randrange(3000)), rng.choice("abc")) for _ in range(300))
    rows = [(key, i, ts, "failed_login", True, "ip", "u") for i, (ts, key) in enumerate(rows)]
    whole = spark.createDataFrame(rows, SCHEMA)
    for n, part in enumerate((rows[:90], rows[90:200], rows[200:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / str(n)))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    found = stream.burst_stream(source, ("source_id",), 4, 60)
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    cols = ["source_id", "breach_ts", "n_events", "lines", "incident_id"]
    got = spark.read.parquet(str(tmp_path / "out")).select(cols).orderBy("source_id", "breach_ts").collect()
    want = bursts.burst_incidents(whole, ("source_id",), 4, 60).select(cols).orderBy("source_id", "breach_ts").collect()
    assert got == want and len(got) > 5


def fed(spark, folder, batches, **options):
    """The breaches of a stream that is fed one file after the other, and its progress after each batch."""
    (folder / "in").mkdir()
    source = spark.readStream.schema(SCHEMA).json(str(folder / "in"))
    found = stream.burst_stream(source, ("source_id",), **options)
    progress = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(folder / "in"))
        query = found.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        progress += [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.parquet(str(folder / "out")), progress


def failures_at(seconds, key="k", first=0):
    return [(key, first + i, START + dt.timedelta(seconds=s), "failed_login", True, "ip", "u") for i, s in enumerate(seconds)]


def test_late_stream_is_batch_however_events_come(spark, tmp_path):
    """Within the lateness the order of arrival does not matter, over several batches and restarts."""
    rng = random.Random(9)
    rows = [(rng.choice("abc"), i, START + dt.timedelta(seconds=rng.randrange(3000), milliseconds=rng.randrange(1000)), "failed_login", True, "ip", "u") for i in range(300)]
    by_arrival = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rng.randrange(200)))
    last = failures_at([9000], "end", 1000)
    got, progress = fed(spark, tmp_path, [by_arrival[:150], by_arrival[150:], last], threshold=4, window_seconds=60, lateness="200 seconds")
    cols = ["source_id", "breach_ts", "n_events", "lines", "incident_id"]
    want = bursts.burst_incidents(spark.createDataFrame(rows, SCHEMA), ("source_id",), 4, 60).select(cols).orderBy("source_id", "breach_ts").collect()
    assert got.select(cols).orderBy("source_id", "breach_ts").collect() == want and len(want) > 5
    assert sum(p["numRowsDroppedByWatermark"] for p in progress) == 0


def test_state_ends_with_the_window_and_late_rows_are_counted(spark, tmp_path):
    batches = [failures_at([0, 10]) + failures_at([5], "other"), failures_at([500], "clock"), failures_at([15, 400]), failures_at([5000], "clock"), failures_at([9000], "clock")]
    got, progress = fed(spark, tmp_path, batches, threshold=3, window_seconds=60, lateness="30 seconds")
    assert got.count() == 0  # the third failure, 15, came when the watermark was at 470
    assert sum(p["numRowsDroppedByWatermark"] for p in progress) == 2
    assert max(p["numRowsTotal"] for p in progress) >= 3
    # what is left belongs to the last event, which the watermark has not passed
    assert progress[-1]["numRowsTotal"] <= 3 and progress[-1]["numRowsRemoved"] + sum(p["numRowsRemoved"] for p in progress[:-1]) >= 5


def test_a_window_of_arrivals_ends(spark, tmp_path):
    import time

    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    spark.createDataFrame(failures_at([0, 1]), SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    found = stream.burst_stream(source, ("source_id",), 3, 1, clock="arrival", end_idle=True)
    query = found.writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        rows = lambda: [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        until = time.time() + 90
        while time.time() < until and not (rows() and max(rows()) > 0 and rows()[-1] == 0):
            time.sleep(0.5)
        assert max(rows()) > 0 and rows()[-1] == 0
    finally:
        query.stop()


def test_lateness_is_handed_on(spark, tmp_path):
    """watch() gives it to the stream: a line that assumes its time does not move the watermark."""
    line = "Aug 10 14:{:02d}:00 server sshd[1]: Failed password for root from 10.0.0.1 port 22 ssh2\n"
    (tmp_path / "in").mkdir()
    for name, minutes in (("a", (1, 2, 30)), ("c", (3, 31)), ("d", (59,))):
        (tmp_path / "in" / f"{name}.log").write_text("".join(map(line.format, minutes)))
        from tidewatch.sources.files import stream_lines

        stream.watch(stream_lines(spark, str(tmp_path / "in")), "ssh", stream.write_incidents(str(tmp_path / "out")), str(tmp_path / "check"), keys=("user",), threshold=2, window_seconds=120, lateness="5 minutes", available_now=True, year=2026).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("breach_ts", "n_events").orderBy("breach_ts").collect()
    assert [(r.breach_ts.minute, r.n_events) for r in got] == [(2, 2), (31, 2)]  # 3 came too late to matter
    with pytest.raises(ValueError):
        stream.burst_stream(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), clock="arrival", lateness="1 minute")


def test_watch_lines(spark, tmp_path):
    line = "Aug 10 14:12:{:02d} server sshd[1]: Failed password for root from 10.0.0.1 port 22 ssh2\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("".join(line.format(i) for i in range(3)))
    from tidewatch.sources.files import stream_lines

    query = stream.watch(stream_lines(spark, str(tmp_path / "in")), "ssh", stream.write_incidents(str(tmp_path / "out")), str(tmp_path / "check"), threshold=3, window_seconds=60, available_now=True, year=2026)
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r.n_events for r in got] == [3]


def watched(spark, folder, handler, name, **options):
    from tidewatch.sources.files import stream_lines

    lines = stream_lines(spark, str(folder / "in"), folder=str(folder / name))
    stream.watch(lines, "ssh", handler, str(folder / name), threshold=2, window_seconds=60, available_now=True, year=2026, **options).awaitTermination(120)


def test_arrival_clock_and_evidence(spark, tmp_path):
    """Lines hours apart arrive together; the evidence of a breach tells of its own events."""
    line = "Aug 10 {:02d}:00:00 server sshd[1]: Failed password for {} from 10.0.0.{} port 22 ssh2\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("".join(line.format(i, "root" if i < 2 else "bob", i) for i in range(5)))
    chunks = spark.createDataFrame([("g", "d", "Guide", "S", "evidence log preservation", 3)], "chunk_id string, document_id string, source_title string, section_or_page string, content string, word_count int")
    watched(spark, tmp_path, stream.write_incidents(str(tmp_path / "event")), "c1")
    assert spark.read.parquet(str(tmp_path / "event")).count() == 0
    watched(spark, tmp_path, stream.evidence_to(str(tmp_path / "out"), chunks, "2026-01-02 03:04:05"), "c2", clock="arrival")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 2 and all(r.packed_ids == ["g"] and "evidence log preservation" in r.evidence and r.incident_id in r.alert for r in got)
    assert sum('"root"' in r.evidence for r in got) == 1 and all('"total_lines": 2' in r.evidence for r in got)


def test_breaches_of_one_second_keep_their_evidence_apart(spark, tmp_path):
    """Lines of one file block have one number, so time and first line don't tell two breaches of a second apart."""
    line = "Aug 10 14:12:01 server sshd[1]: Failed password for root from 10.0.0.1 port 22 ssh2\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(line * 7)
    chunks = spark.createDataFrame([("g", "d", "Guide", "S", "evidence log preservation", 3)], "chunk_id string, document_id string, source_title string, section_or_page string, content string, word_count int")
    watched(spark, tmp_path, stream.evidence_to(str(tmp_path / "out"), chunks, "2026-01-02 03:04:05"), "c")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len({r.incident_id for r in got}) == len(got) == 3 and all('"failed_attempts": 2' in r.evidence for r in got)


def test_names_of_many_incidents_differ(spark):
    """Of 32 bits, two of 200,000 breaches would share a name nearly surely; nor do keys run into each other."""
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("k"), F.lit(None).cast("string").alias("m"), F.timestamp_seconds("id").alias("ts"), "id")
    rows = rows.unionByName(rows.limit(1).select(F.lit(None).cast("string").alias("k"), F.lit("0").alias("m"), "ts", "id"))
    assert rows.select(bursts.incident_id(("k", "m"), F.col("ts"), F.col("id")).alias("i")).distinct().count() == 200_001


def test_files_that_were_there_before(spark, tmp_path):
    import os
    import time

    from tidewatch.sources.files import stream_lines

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "old.txt").write_text("old\n")
    os.utime(folder / "old.txt", (time.time() - 3600,) * 2)

    def read():
        lines = stream_lines(spark, str(folder), process_existing=False, folder=str(tmp_path / "state"))
        query = lines.select("raw").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state" / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(r.raw for r in spark.read.schema("raw string").parquet(str(tmp_path / "out")).collect())

    assert read() == []
    (folder / "new.txt").write_text(" \u00a0new \n\n")
    os.utime(folder / "new.txt", (time.time() + 60,) * 2)
    assert read() == ["new"]
    with pytest.raises(ValueError):
        stream_lines(spark, str(folder), process_existing=False)


def test_range_windows(spark):
    f = frame(spark, (0, 10, 20, 500))
    got = facts.repeated_failures(f, "source_ip", 3, 300).collect()
    assert [r.line_no for r in got] == [2]
    ok = spark.createDataFrame([("k", 9, START + dt.timedelta(seconds=600), "successful_login", True, "ip", "u"), ("k", 10, START + dt.timedelta(seconds=2000), "successful_login", True, "ip", "u")], SCHEMA)
    got = facts.success_after_failures(f.unionByName(ok), least=4, seconds=900).collect()
    assert [(r.line_no, r.n_failures) for r in got] == [(9, 4)]
    flags = bursts.burst_flags(f, ("source_id",), 3, 60).orderBy("line_no").collect()
    assert [r.is_burst for r in flags] == [False, False, True, False]
