"""Embedding near-dedup: sign hashing in several tables, exact cosine, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cells, connected_components, cut, few, measured

#: Rows of a bucket, or of a part of it, that one task compares at once.
BLOCK = 1024
#: Signs of a vector's code, by which pairs of a bucket are told apart before their vectors are fetched.
CODE = 128


def tables_for(n: int, cosine: float, miss: float = 1e-4, bucket: int = 200) -> tuple[int, int]:
    """(bits, tables): bits so that a bucket of unrelated vectors holds about `bucket`, tables so that a
    pair at exactly `cosine` is missed with probability `miss` at most; pairs above it less often."""
    bits = min(30, max(4, round(math.log2(max(n, 1) / bucket)))) if n > bucket else 4
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def usable(vector: Column) -> Column:
    """Not null or empty, with finite components that aren't all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def code_limit(cosine: float) -> int:
    """The signs that may differ between the codes of two vectors at `cosine`: six standard deviations
    over the mean, so that one pair in 10^8 is taken for unlike."""
    p = math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    return min(CODE, math.ceil(CODE * p + 6 * math.sqrt(CODE * p * (1 - p))))


def _signatures(vectors: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """vectors(.., vec) with a struct s: sigs array<int>, one of `bits` signs for each table, and c0, c1
    of CODE more signs. The hyperplanes depend on the seed and the number of components alone."""

    @F.pandas_udf("sigs array<int>, c0 long, c1 long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for batch in batches:
            sigs: list[np.ndarray | None] = [None] * len(batch)
            codes = np.zeros((len(batch), CODE // 64), np.int64)
            sizes = np.array([len(v) for v in batch])
            for d in np.unique(sizes):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), bits * tables + CODE))
                rows = np.flatnonzero(sizes == d)
                signs = _unit(batch.iloc[rows]) @ planes[d] > 0
                codes[rows] = np.packbits(signs[:, bits * tables :], axis=1).view(np.int64)
                numbers = (signs[:, : bits * tables].reshape(len(rows), tables, bits) @ weights).astype(np.int32)
                for i, x in zip(rows, numbers, strict=True):
                    sigs[i] = x
            yield pd.DataFrame({"sigs": pd.Series(sigs, dtype=object), "c0": codes[:, 0], "c1": codes[:, 1]})

    return vectors.withColumn("s", of("vec"))


def _alike(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by cell, that have one in their cell whose code differs in `limit` signs or fewer."""
    for rows, starts in cells(batches):
        codes = np.stack([rows.column(c).to_numpy() for c in ("c0", "c1")]).view(np.uint64)  # bitwise_count takes the absolute value of a negative number
        found = np.zeros(rows.num_rows, bool)
        for i, j in zip(starts, [*starts[1:], rows.num_rows], strict=True):
            for k in range(i, j, 256):
                end = min(j, k + 256)
                apart = sum(np.bitwise_count(c[k:end, None] ^ c[None, i:j]).astype(np.int16) for c in codes)
                found[k:end] = (apart <= limit).sum(axis=1) > 1  # each is like itself
        yield from rows.select(["cell", "h", "at"]).filter(pa.array(found)).to_batches()


def _compare(group: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """One bucket, or one pair of its parts: for each row with a link, the ids that it links to here
    and the smallest node of its component here. A pair counts in the first table that has both in one
    bucket, and nowhere else."""
    table = int(group["at"].iloc[0]) // 4
    node, copies, side = group["node"].to_numpy(), group["copies"].to_numpy(), (group["at"].to_numpy() % 4 == 2).astype(int)
    crossed = (group["at"].to_numpy() % 4 > 0).any()
    x, sigs = _unit(group["vec"]), np.stack(group["sigs"].to_list())[:, :table]
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if crossed else (np.arange(len(x)),) * 2
    links, root = np.zeros(len(x), np.int64), np.arange(len(x))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def joined(a: int, b: int) -> None:
        a, b = top(a), top(b)
        if a != b:
            if node[a] > node[b]:
                a, b = b, a
            root[b] = a

    both = left is not right
    for i in range(0, len(left), 256):
        rows = left[i : i + 256]
        near = x[rows] @ x[right].T >= cosine
        a, b = np.nonzero(near)
        a, b = rows[a], right[b]
        keep = node[a] != node[b] if both else a < b
        a, b = a[keep], b[keep]
        for t in range(table):  # a step for each earlier table, over the pairs that are left
            keep = sigs[a, t] != sigs[b, t]
            a, b = a[keep], b[keep]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        seen = np.unique(a)
        first = b[np.searchsorted(a, seen)] if len(a) else b
        for p, q in zip(seen.tolist(), first.tolist(), strict=True):
            joined(p, q)
        # the other pairs matter only where they join two parts
        up = np.array([top(k) for k in range(len(x))])
        for p, q in zip(a[up[a] != up[b]].tolist(), b[up[a] != up[b]].tolist(), strict=True):
            joined(p, q)
    some = np.flatnonzero(links)
    return pd.DataFrame({"h": group["h"].to_numpy()[some], "node": node[some], "links": links[some], "root": node[[top(int(i)) for i in some]] if len(some) else node[some]})


def embedding_links(vectors: DataFrame, cosine: float, bits: int, tables: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(h, node, links, root) for vectors(h, node, copies, vec), h being a hash of vec: what each bucket found
    for each node. Summed over a node's rows, links is the number of linked vectors; (node, root) are
    edges that connect what is linked.

    Only codes are dealt out to the buckets of all tables; vectors follow to the buckets where another
    code is near, where their cosines decide. A bucket of more than `block` rows is dealt into parts,
    and each two parts meet in a task of their own, so no task holds a whole large bucket; only counts
    and one edge a row leave it.
    """
    signed = _signatures(vectors.select("h", "vec"), bits, tables, seed)
    coded = cut(signed.select("h", "s.c0", "s.c1", F.transform("s.sigs", lambda s, t: F.xxhash64(F.size("vec"), t, s)).alias("buckets")))
    hot = coded.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("size"))
    hot = few(hot.where(F.col("size") > block))
    rows = coded.select("h", "c0", "c1", F.posexplode("buckets").alias("table", "bucket"))
    rows = rows.join(hot, F.col("bucket") == F.col("b"), "left")
    rows = rows.withColumn("parts", F.ceil(F.coalesce("size", F.lit(1)) / block).cast("int")).withColumn("part", F.pmod("h", F.col("parts")).cast("int"))
    side = lambda q: F.when(q == F.col("part"), 0).when(q > F.col("part"), 1).otherwise(2)
    cell = lambda q: F.struct(F.xxhash64("bucket", F.least("part", q), F.greatest("part", q)).alias("cell"), (4 * F.col("table") + side(q)).alias("at"))
    rows = rows.select("h", "c0", "c1", F.inline(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), cell)))
    dealt = rows.repartition("cell").sortWithinPartitions("cell")
    limit = code_limit(cosine)
    near = cut(dealt.mapInArrow(lambda batches: _alike(batches, limit), "cell long, h long, at int"))
    some = _signatures(vectors.join(near.select("h").distinct(), "h", "left_semi"), bits, tables, seed)
    rows = near.join(some.select("h", "node", "copies", "vec", "s.sigs"), "h")
    return rows.groupBy("cell").applyInPandas(lambda g: _compare(g, cosine), "h long, node long, links long, root long")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, seed: int = 11, miss: float = 1e-4, block: int = BLOCK) -> DataFrame:
    """One row (id_col, n_links, component_id, kept) for each row of vectors.

    Two vectors link if they have equally many components, share a bucket of a table and have a cosine
    of at least `cosine` in double precision; equal vectors are one node and link to each other.
    Vectors that are null, empty or zero, hold null or non-finite components, or have a null id link
    with nothing and are kept. n_links counts ids: repeated rows count once, in their own links and in
    those of others; the vectors of an id that has several are one in the components, and each has its
    own links. Other columns are not read.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vec"))
    v = v.withColumn("ok", usable(F.col("vec")) & F.col("id").isNotNull()).withColumns({"h": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(seed), "vec")})
    good = v.where("ok")
    ids = good.groupBy("h", "h2", "id").agg(F.lit(1).alias("_")).groupBy("h", "h2").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    nodes = good.groupBy("h", "h2").agg(F.any_value("vec").alias("vec")).join(ids, ["h", "h2"])
    nodes, n = measured(nodes, rows=F.count(F.lit(1)))
    bits, tables = tables_for(n["rows"], cosine, miss)
    found = cut(embedding_links(nodes.select("h", "node", "copies", "vec"), cosine, bits, tables, seed, block))
    parts = connected_components(found, "node", "root")
    links = found.groupBy("node", "h").agg(F.sum("links").alias("links"))
    named = nodes.drop("vec").join(links, ["node", "h"], "left").join(parts.withColumnRenamed("id", "node"), "node", "left")
    named = cut(named.select("h", "h2", F.coalesce("links", F.lit(0)).alias("links"), "copies", F.coalesce("component", "node").alias("component_id")))
    got = good.select("id", "h", "h2").join(named, ["h", "h2"]).select("id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    rest = v.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = got.unionByName(rest)
    return every.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
