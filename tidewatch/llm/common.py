"""What several training-data operators share: written cut points and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewatch.sources.scratch import new_path

#: The words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def measured(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """cut(df), and aggregates over its rows, which the task that writes them makes on its way."""
    spark = df.sparkSession
    path = new_path(spark, "cut")
    seen = Observation()
    df.observe(seen, *(c.alias(n) for n, c in metrics.items())).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table read back. Lineage ends there,
    so the loss of an executor costs no more than a read, and its size is known to the optimizer."""
    spark = df.sparkSession
    path = new_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids and numbers that may be broadcast.
FEW = 300_000


def few(df: DataFrame, most: int = FEW, numbers: str | None = None) -> DataFrame:
    """cut(df) of narrow rows, marked for broadcasting if they are `most` or fewer and have ten times as
    many numbers at most in all of their arrays `numbers`; a larger one is joined by shuffle."""
    inside = F.sum(F.size(numbers)) if numbers else F.max(F.lit(0))
    table, got = measured(df, rows=F.count(F.lit(1)), inside=inside)
    return F.broadcast(table) if got["rows"] <= most and (got["inside"] or 0) <= 10 * most else table


def dealt_cells(group: str, row: str, size: Column, most: int) -> Column:
    """Array of the cells that a row of a group goes to, so that every two rows of the group meet in one and
    no cell holds many more than `most`: one, or, if the group's size is over that, one for each two of its parts."""
    parts = F.ceil(2 * size / most).cast("int")  # two parts fill a cell
    part = F.pmod(F.xxhash64(row), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.xxhash64(group, F.least(part, q), F.greatest(part, q)))
    return F.when(size <= most, F.array(group)).otherwise(pairs)


def cells(batches: Iterator[pa.RecordBatch], by: tuple[str, ...] = ("cell",)) -> Iterator[tuple[pa.Table, list[int]]]:
    """Whole cells from rows sorted by cell (numbers in the columns `by`), as many as a batch ends, and where
    each starts."""

    def starts(rows: pa.Table) -> list[int]:
        new = np.ones(rows.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in (rows.column(b).to_numpy() for b in by)])
        return np.flatnonzero(new).tolist()

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.table(batch) if rest is None else pa.concat_tables([rest, pa.table(batch)]).combine_chunks()
        at = starts(rows)
        if len(at) > 1:  # the last cell may go on in the next batch
            yield rows.slice(0, at[-1]).combine_chunks(), at[:-1]
        rest = rows.slice(at[-1])
    if rest is not None:
        yield rest.combine_chunks(), starts(rest)


class Recent(dict):
    """A dictionary that computes what it misses, and forgets what was not asked for lately: when it is
    full, it becomes the older generation, whose entries come back one by one as they are asked for."""

    def __init__(self, compute, most: int):
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key: str):
        got = self.older.get(key)
        if got is None:
            got = self.compute(key)
        if len(key) < 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def same(a: Column, b: Column) -> Column:
    """Equality that also holds between nulls; usable as a join key."""
    return a.eqNullSafe(b)


#: Edges that a task contracts at once.
_CHUNK = 1 << 20


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a part of a graph, as an edge from each id to the smallest one that the part connects
    it to."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = place[: len(a)], place[len(a) :]
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root[x], root[y])
            new = root.copy()
            for end in (x, y):
                np.minimum.at(new, root[end], low)
                np.minimum.at(new, end, low)
            while (new[new] != new).any():
                new = new[new]
            if (new == root).all():
                break
            root = new
        up = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[up]), pa.array(ids[root[up]])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(h.num_rows for h in held) >= _CHUNK:
            yield stars(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in "ab"))
            held = []
    if held:
        yield stars(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in "ab"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The components of an undirected graph of long ids: one row (id, component) for each id that
    has an edge to another id; component is the smallest id reachable.

    Each task first contracts the edges that it has to stars. In each round the ids whose only edge goes to a smaller id
    are set aside with it: a finished star is nothing else, so what is left are the parts that still change. These
    get a large star and a small star: only edges move between executors, the driver gets a count a round. A hub's minimum
    is aggregated map-side and written before it is joined back, so that adaptive execution can split the hub. At the
    end the ids that were set aside take the component of the one they had an edge to, the last round's first. Edges with a null
    end, and from an id to itself, are left out; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
    e = cut(e.where("x is not null and y is not null and a <> b").select("a", "b").distinct().mapInArrow(_contracted, "a long, b long"))
    aside = []
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = cut(both.groupBy(F.col("a").alias("u")).agg(F.least("u", F.min("b")).alias("m"), F.max("b").alias("last")))
        lone = ends.where("m < u and m = last").select(F.col("u").alias("id"), F.col("m").alias("component"))
        aside.append(lone)
        e, left = measured(e.join(lone, F.col("a") == F.col("id"), "left_anti"), rows=F.count(F.lit(1)))
        if not left["rows"]:
            break
        # an id that was set aside was the larger one, and no minimum of its neighbour
        least = ends.select("u", "m")
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # after the large star an id has few smaller neighbours
        mins = large.withColumn("m", F.min("b").over(_by("a")))
        small = mins.select("a", F.col("m").alias("b")).unionByName(mins.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = cut(small.distinct())
    found = aside.pop()
    for lone in reversed(aside):
        later = few(found).select(F.col("id").alias("m"), F.col("component").alias("least"))
        lone = lone.withColumnRenamed("component", "m").join(later, "m", "left").select("id", F.coalesce("least", "m").alias("component"))
        found = later.select(F.col("m").alias("id"), F.col("least").alias("component")).unionByName(lone)
    found = cut(found) if aside else found
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)
