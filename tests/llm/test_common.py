from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import components
from tidewatch.llm.common import Recent, connected_components, cut, few, measured

from tidewatch.sources.scratch import shared_folder


def test_cut_uses_the_shared_folder(spark):
    df = cut(spark.range(5))
    assert df.count() == 5 and shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert df.inputFiles() and all(shared_folder(spark) in f for f in df.inputFiles())


def test_measured(spark):
    table, got = measured(spark.range(7), rows=F.count(F.lit(1)), top=F.max("id"))
    assert table.count() == 7 and got == {"rows": 7, "top": 6}
    assert measured(spark.range(0), rows=F.count(F.lit(1)))[1] == {"rows": 0}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 300
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(150)] + [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)]
    want = components(n, links)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links + [(1, None), (None, 2)], "a long, b long")).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: want[i] for i in touched}


def test_contraction(monkeypatch):
    import pyarrow as pa

    from tidewatch.llm import common

    monkeypatch.setattr(common, "_CHUNK", 40)
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(70, 90)]
    batches = [pa.RecordBatch.from_pydict({"a": [a for a, _ in links[i : i + 7]], "b": [b for _, b in links[i : i + 7]]}) for i in range(0, len(links), 7)]
    got = [(x, y) for r in common._contracted(iter(batches)) for x, y in zip(r.column("a").to_pylist(), r.column("b").to_pylist(), strict=True)]
    assert components(100, got) == components(100, links) and all(y < x for x, y in got)


def test_finished_stars_are_set_aside(spark, monkeypatch):
    """Without contraction in tasks: of many stars and a long path, rounds after the first have the path alone."""
    from tidewatch.llm import common

    left = []

    def counted(df, **metrics):
        table, got = measured(df, **metrics)
        left.append(got["rows"])
        return table, got

    monkeypatch.setattr(common, "_contracted", lambda batches: batches)
    monkeypatch.setattr(common, "measured", counted)
    path = list(range(1000, 1060))
    random.Random(6).shuffle(path)
    links = [(10 * i, 10 * i + j) for i in range(90) for j in (3, 7, 5)] + list(zip(path, path[1:], strict=False))
    want = components(1060, links)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: want[x] for link in links for x in link}
    assert len(left) > 2 and max(left) < 2 * len(path)


def test_no_edges(spark):
    empty = spark.createDataFrame([], "a long, b long")
    assert connected_components(empty).collect() == []


def test_few(spark):
    t = spark.range(10)
    assert "broadcast" in few(t, 10)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in few(t, 9)._jdf.queryExecution().toString().lower()


def test_recent():
    asked = []
    r = Recent(lambda k: asked.append(k) or k.upper(), 2)
    assert [r[k] for k in ("a", "b", "c", "a", "a", "d", "x" * 70)] == ["A", "B", "C", "A", "A", "D", "X" * 70]
    assert asked.count("a") == 1 and len(r) <= 2
