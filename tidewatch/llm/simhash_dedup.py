"""SimHash near-dedup over deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import cells, connected_components, cut, dealt_cells, spare

#: Hashes whose bits are counted at once, so that a very long text takes little memory.
_BLOCK = 1 << 16
#: Fingerprints that one task compares with each other.
CELL = 4096


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64 bits as a signed long: bit i is 1 if it is set in over half the XXH64 hashes of the text's
    word shingles, repeats included. Fewer words than width: one shingle of all; none: 0."""
    words = (text or "").encode().lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
    ones, left, digest = np.zeros(64, np.int64), n, xxhash.xxh64_intdigest
    while left:
        take = min(left, _BLOCK)
        h = np.fromiter((digest(s, seed) for _, s in zip(range(take), shingles)), np.uint64, take)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= take
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", width: int = 3, seed: int = 42) -> DataFrame:
    """docs with a long column of fingerprints."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, width, seed) for t in texts], dtype="int64")

    return docs.withColumn(out, of(F.col(text)))


def _variants(fp: Column) -> Column:
    """The 64 keys of a fingerprint: for each of two 32-bit segments, each bit in turn taken out.
    A key holds the segment's number, the wildcard's place and the segment with that bit at 0."""
    keys = [
        F.lit((s << 37) | (p << 32)).bitwiseOR(F.shiftrightunsigned(fp, 32 * s).bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << p))))
        for s in (0, 1)
        for p in range(32)
    ]
    return F.array(*keys)


def _links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """From rows (cell, fp), sorted by cell, pairs of one cell that differ in `most` bits or fewer: enough
    of them to connect all such, so no more than the cell has rows."""
    for rows, starts in cells(batches):
        every = rows.column("fp").to_numpy()
        a, b = [], []
        for i, j in zip(starts, [*starts[1:], rows.num_rows], strict=True):
            fp = every[i:j]
            bits, root = fp.view(np.uint64), np.arange(j - i)  # bitwise_count takes the absolute value of a negative number
            for k in range(0, j - i, 256):
                x, y = np.nonzero(np.bitwise_count(bits[k : k + 256, None] ^ bits[None, :]) <= most)
                x += k
                apart = root[x] != root[y]
                while apart.any():  # a row takes in one other part at a time
                    x, y = x[apart], y[apart]
                    up, down = np.maximum(root[x], root[y]), np.minimum(root[x], root[y])
                    _, one = np.unique(up, return_index=True)
                    a.append(fp[x[one]])
                    b.append(fp[y[one]])
                    root[up[one]] = down[one]
                    while (root[root] != root).any():
                        root = root[root]
                    apart = root[x] != root[y]
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])


def link_fingerprints(fps: DataFrame, most: int = 3) -> DataFrame:
    """Edges (a, b) of fingerprints (column fp, distinct) whose graph has the components that all
    links at `most` <= 3 differing bits give.

    Two segments: of three differing bits one segment has one at most, so linked fingerprints share
    one of the 64 one-wildcard keys. The rows that share a key meet in a cell and are compared there;
    a key of more than CELL rows is cut into parts, and each two parts meet in a cell of their own. A
    cell gives fewer edges than it has rows, so a group never gives all of its pairs.
    """
    if not 0 <= most <= 3:
        raise ValueError("two segments with one wildcard find 0 to 3 differing bits")
    keyed = fps.select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    shared = keyed.select("fp", "key", F.count("*").over(Window.partitionBy("key")).alias("size")).where("size > 1")
    shared = cut(shared)
    dealt = shared.select(F.explode(dealt_cells("key", "fp", F.col("size"), CELL)).alias("cell"), "fp")
    dealt = dealt.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(lambda batches: _links(batches, most), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """One row (id_col, fingerprint, component_id) for each row of docs: 16 lower-case hex digits,
    and the smallest id reachable over fingerprints that differ in `most` bits or fewer.

    Equal fingerprints are one node, so copies cost one row. Null and empty texts have fingerprint
    zero and link like any other. A null id is never a component's name unless its whole component
    has none; repeated rows come back repeated. Other columns of docs are not read.
    """
    rows = cut(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), width=width, seed=seed).select("id", "fp"))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    parts = connected_components(link_fingerprints(nodes.select("fp"), most))
    named = nodes.join(parts, nodes.fp == parts.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    name = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = named.join(name, "part").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_keep(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one document of each group: the one whose id names the component. Rows with a null
    id stay (nothing can name them). Repeated rows of the kept id stay as they are."""
    name = spare(docs, "_lost")
    lost = simhash_groups(docs, id_col, text, **options).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(lost, docs[id_col].cast("long") == lost[name], "left_anti")
