from __future__ import annotations

import os
import random

import pytest

from tidewatch.sources import tail
from tidewatch.streaming import bursts as stream


class Tailed:
    """A query over a folder that is started anew for each look, with one checkpoint."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = spark, folder, options
        (folder / "logs").mkdir()

    def __truediv__(self, name):
        return self.folder / "logs" / name

    def append(self, name, data):
        with open(self / name, "ab") as f:
            f.write(data if isinstance(data, bytes) else data.encode())

    def look(self):
        """The lines so far, in the order of (batch, file, place)."""
        lines = tail.tail_lines(self.spark, str(self.folder / "logs"), **self.options)

        def keep(df, batch):
            df.write.mode("overwrite").json(str(self.folder / "out" / f"batch={batch}"))

        lines.writeStream.foreachBatch(keep).option("checkpointLocation", str(self.folder / "state")).trigger(availableNow=True).start().awaitTermination(120)
        if not (self.folder / "out").exists():
            return []
        got = self.spark.read.schema("source_id string, line_no long, raw string, batch int").json(str(self.folder / "out"))
        return [r.raw for r in got.orderBy("batch", "source_id", "line_no").collect()]


def test_each_appended_line_once_over_restarts(spark, tmp_path):
    t = Tailed(spark, tmp_path)
    t.append("a.log", "old\n")
    assert t.look() == []  # it starts at the end
    t.append("a.log", " one \n\n \t\ntw")
    t.append("b.log", b"bad \xff byte\r\n")
    assert t.look() == ["one", "bad \N{REPLACEMENT CHARACTER} byte"]
    assert t.look() == ["one", "bad \N{REPLACEMENT CHARACTER} byte"]
    t.append("a.log", "o\nthree\nfo")
    assert t.look()[2:] == ["two", "three"]
    t.append("a.log", "ur\n")
    assert t.look()[4:] == ["four"]


def test_existing_lines_if_asked_for(spark, tmp_path):
    t = Tailed(spark, tmp_path, process_existing=True)
    t.append("a.log", "old\nhalf")
    t.append(".hidden", "no\n")
    t.append("_temporary", "no\n")
    assert t.look() == ["old"]


def test_a_shrunk_file_is_read_from_its_start(spark, tmp_path):
    t = Tailed(spark, tmp_path, process_existing=True)
    t.append("a.log", "first\nsecond\nthird\n")
    assert t.look() == ["first", "second", "third"]
    (t / "a.log").write_text("first\n")  # the same inode and first line, only shorter
    t.append("a.log", "new\n")
    assert t.look()[3:] == ["first", "new"]
    (t / "a.log").write_text("another line that makes it longer than it was before\n")
    assert t.look()[5:] == ["another line that makes it longer than it was before"]


def test_a_rotated_file_goes_on_under_its_new_name(spark, tmp_path):
    t = Tailed(spark, tmp_path, process_existing=True)
    t.append("a.log", "header\none\n")
    assert t.look() == ["header", "one"]
    t.append("a.log", "late\n")
    os.rename(t / "a.log", t / "a.log.1")
    t.append("a.log", "header\nfresh\n")  # the same first line: the inode tells them apart
    assert sorted(t.look()[2:]) == ["fresh", "header", "late"]
    os.rename(t / "a.log.1", t / "a.log.2")
    os.rename(t / "a.log", t / "a.log.1")
    assert len(t.look()) == 5
    os.remove(t / "a.log.2")
    t.append("a.log.1", "more\n")
    assert t.look()[5:] == ["more"]


def test_parts_give_each_line_once(spark, tmp_path):
    rng = random.Random(3)
    lines = [rng.choice(["", "x", "é" * rng.randrange(40), "y" * rng.randrange(300)]) + str(i) for i in range(500)]
    data = "\n".join(lines).encode() + b"\n"
    path = str(tmp_path / "a.log")
    with open(path, "wb") as f:
        f.write(data)
    store, _ = tail._store(path)
    for part in (1, 7, 100, 4096, len(data)):
        got = [x for r in tail.ranges({}, tail.state_of(path), part) for x in tail.lines_of(store, r)]
        assert [x.decode() for _, x in got] == lines
        assert all(data[at : at + len(x)] == x and (at == 0 or data[at - 1] == 10) for at, x in got)
    got = tail.tail_lines(spark, path, stream=False, part=1 << 12)
    assert [r.raw for r in got.orderBy("line_no").collect()] == lines
    assert tail.tail_lines(spark, path, stream=False, part=1000).rdd.getNumPartitions() > 20


def test_lines_longer_than_a_block(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 10)
    lines = [b"a" * 95, b"", b"b" * 10, b"c" * 9, b"d"]
    (tmp_path / "a").write_bytes(b"\n".join(lines) + b"\n" + b"e" * 35)
    store, path = tail._store(str(tmp_path / "a"))
    state = tail.state_of(path)
    assert state[path]["at"] == sum(map(len, lines)) + 5
    for part in (3, 10, 1000):
        assert [x for r in tail.ranges({}, state, part) for _, x in tail.lines_of(store, r)] == lines


def test_states_tell_what_to_read():
    f = lambda at, mark: {"at": at, "id": mark}
    read = lambda start, end: [(r.path, r.start, r.end) for r in tail.ranges(start, end, 100)]
    assert read({}, {}) == [] and read({"a": f(9, "x")}, {}) == []
    assert read({"a": f(9, "x")}, {"a": f(9, "x")}) == []
    assert read({"a": f(9, "x")}, {"a": f(250, "x")}) == [("a", 9, 109), ("a", 109, 209), ("a", 209, 250)]
    assert read({"a": f(9, "x")}, {"a": f(5, "x")}) == [("a", 0, 5)]
    assert read({"a": f(9, "x")}, {"a": f(12, "y")}) == [("a", 0, 12)]
    assert read({"a": f(9, "x")}, {"a": f(3, "y"), "b": f(11, "x")}) == [("a", 0, 3), ("b", 9, 11)]
    assert read({"a": f(9, "x")}, {"a": f(9, "x"), "b": f(4, "x")}) == [("b", 0, 4)]  # a copy, not a move


def test_patterns_and_missing_folders(spark, tmp_path):
    for name in ("a.log", "b.txt"):
        (tmp_path / name).write_text(f"{name}\n")
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "sub.log").mkdir()
    assert [r.raw for r in tail.tail_lines(spark, f"{tmp_path}/*.log", stream=False).collect()] == ["a.log"]
    assert [r.raw for r in tail.tail_lines(spark, f"file://{tmp_path}/b.txt", stream=False).collect()] == ["b.txt"]
    assert tail.tail_lines(spark, f"{tmp_path}/none", stream=False).count() == 0


def test_watching_a_growing_log(spark, tmp_path):
    """A breach whose failures were appended before and after a restart."""
    line = "Aug 10 14:12:{:02d} server sshd[1]: Failed password for root from 10.0.0.1 port 22 ssh2\n"
    log = tmp_path / "auth.log"
    log.write_text(line.format(0) * 5)

    def watch():
        lines = tail.tail_lines(spark, str(log))
        stream.watch(lines, "ssh", stream.write_incidents(str(tmp_path / "out")), str(tmp_path / "check"), threshold=3, window_seconds=60, available_now=True, year=2026).awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out")).count() if (tmp_path / "out").exists() else 0

    assert watch() == 0
    with log.open("a") as f:
        f.write(line.format(1) + line.format(2))
    assert watch() == 0
    with log.open("a") as f:
        f.write(line.format(3))
    assert watch() == 1


def test_a_tail_needs_a_path(spark):
    with pytest.raises(Exception, match="path"):
        spark.read.format("tidewatch_tail").load().count()
