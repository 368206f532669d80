"""Merkle dataset manifest by time-forward processing: a queue ordered by node label delivers digests to parents,
and a sweep back delivers to each leaf the rest of its proof.

A node's label is its tree, level and place; children come before their parents. The queue's external part
are tables of messages in the shared folder, sorted by label as they are read: an epoch reads the
messages to SPAN levels of labels, tasks sort them by subtree and label, and what is addressed to later
labels goes to the next epoch's table. Within a subtree of 3^SPAN nodes a heap holds the messages.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import cells, cut, few, same

#: Children of a node, and levels that an epoch goes up: a subtree has 243 nodes at its lower end.
RUN, SPAN = 3, 5
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*values: Column) -> Column:
    """SHA-256 (32 bytes) of the values one after the other: each as its UTF-8 bytes' count, `:` and itself;
    null as `-`."""
    said = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said)).cast("binary"), 256))


def node(children: list[bytes]) -> bytes:
    """The digest of the children's digests as hex text."""
    return sha256(b"".join(c.hex().encode() for c in children)).digest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n."""
    h = 0
    while n > 1:
        n, h = -(-n // RUN), h + 1
    return h


def fold(digest: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof give. A proof has for each level, upwards, a byte for the node's place in
    its run, one for the number of its siblings, and their digests."""
    i = 0
    while i < len(proof):
        place, n = proof[i], proof[i + 1]
        run = [proof[j : j + 32] for j in range(i + 2, i + 2 + 32 * n, 32)]
        run.insert(place, digest)
        digest, i = node(run), i + 2 + 32 * n
    return digest


def siblings(proof: bytes) -> bytes:
    """The digests of a proof in their order as hex text."""
    out, i = [], 0
    while i < len(proof):
        n = proof[i + 1]
        out.append(proof[i + 2 : i + 2 + 32 * n].hex())
        i += 2 + 32 * n
    return "".join(out).encode()


def forward(places: list[int], digests: list[bytes], levels: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Level, place and children's digests of each node above the given ones, which lie in order, in the order of
    labels: a node is taken from the queue when all messages to it, which have its label, are first."""
    queue = [(1, i // RUN, i % RUN, d) for i, d in zip(places, digests, strict=True)] if levels else []  # in order, so a heap
    while queue:
        level, place, _, digest = heapq.heappop(queue)
        children = [digest]
        while queue and queue[0][:2] == (level, place):
            children.append(heapq.heappop(queue)[3])
        yield level, place, children
        if level < levels:
            heapq.heappush(queue, (level + 1, place // RUN, place % RUN, node(children)))


def backward(places: list[int], digests: list[bytes], levels: int, proof: bytes) -> list[bytes]:
    """The proofs of the given nodes, that of the node at the top of their subtree being `proof`. The queue
    holds messages to the greatest label first."""
    below = {(level, place): children for level, place, children in forward(places, digests, levels)}
    got, queue = {}, [(-levels, -(places[0] // RUN**levels), proof)]
    while queue:
        level, place, rest = heapq.heappop(queue)
        if not level:
            got[-place] = rest
            continue
        children = below[-level, -place]
        for k in range(len(children)):
            others = children[:k] + children[k + 1 :]
            heapq.heappush(queue, (level + 1, RUN * place - k, b"".join([bytes([k, len(others)]), *others, rest])))
    return [got[i] for i in places]


def _subtrees(nodes: DataFrame, span: int) -> DataFrame:
    """nodes(tree, place, ...), those of a subtree together and in the order of labels, with the subtree's number."""
    n = nodes.withColumn("subtree", F.when(F.col("place") >= 0, F.expr(f"place div {RUN**span}")).otherwise(-1 - F.col("place")))
    return n.repartition("tree", "subtree").sortWithinPartitions("tree", "subtree", "place")


def _levels_up(n: int, done: int, span: int) -> int:
    return min(span, height(n) - done)


def sweep_up(nodes: DataFrame, largest: int, span: int = SPAN) -> tuple[list[DataFrame], DataFrame]:
    """Of leaves (tree, n, place, digest, ...), n being the tree's number of leaves and `largest` the greatest of these:
    the tables that epochs start from, and (tree, n, digest) of all roots."""

    def up(done: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, starts in cells(batches, ("tree", "subtree")):
                tree, n, subtree = (rows.column(c).take(pa.array(starts)) for c in ("tree", "n", "subtree"))
                place, digest, tops = rows.column("place").to_pylist(), rows.column("digest").to_pylist(), []
                for i, j, size in zip(starts, [*starts[1:], rows.num_rows], n.to_pylist(), strict=True):
                    top = digest[i]  # of a tree that has no levels left
                    for _, _, children in forward(place[i:j], digest[i:j], _levels_up(size, done, span)):
                        top = node(children)
                    tops.append(top)
                yield pa.RecordBatch.from_arrays([tree.combine_chunks(), n.combine_chunks(), subtree.combine_chunks(), pa.array(tops, pa.binary())], ["tree", "n", "place", "digest"])

        return of

    starts, roots, done = [nodes], [], 0
    while True:
        tops = cut(_subtrees(starts[-1].select("tree", "n", "place", "digest"), span).mapInArrow(up(done), "tree long, n long, place long, digest binary"))
        done += span
        roots.append(tops.where(F.col("n") <= RUN**done).select("tree", "n", "digest"))
        if largest <= RUN**done:
            return starts, reduce(DataFrame.unionByName, roots)
        starts.append(tops.where(F.col("n") > RUN**done))


def sweep_down(starts: list[DataFrame], roots: DataFrame, finish: Callable[[list, list[bytes]], list[list]], fields: str, span: int = SPAN) -> DataFrame:
    """Of what sweep_up gave, and roots (tree, n, proof): the leaves with the columns `fields`, which finish()
    gives of their digests, their column `found` and their proofs."""

    def down(done: int, names: list[str], made: Callable[[pa.Table, list[bytes]], list[pa.Array]], out: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, starts in cells(batches, ("tree", "subtree")):
                place, digest = rows.column("place").to_pylist(), rows.column("digest").to_pylist()
                n, top = rows.column("n").to_pylist(), rows.column("proof").to_pylist()
                at, proofs = [], []
                for i, j in zip(starts, [*starts[1:], rows.num_rows], strict=True):  # first the message to the top
                    at += range(i + 1, j)
                    proofs += backward(place[i + 1 : j], digest[i + 1 : j], _levels_up(n[i], done, span), top[i])
                kept = rows.take(pa.array(at, pa.int64())).combine_chunks()
                columns = [kept.column(c) for c in names] + made(kept, proofs)
                yield from pa.table(columns, names=out).combine_chunks().to_batches()

        return of

    proofs = None
    for epoch in range(len(starts) - 1, -1, -1):
        done, nodes = epoch * span, starts[epoch]
        mine = roots.where((F.col("n") <= RUN ** (done + span)) & (F.col("n") > (RUN**done if epoch else 0)))
        messages = mine.select("tree", "n", F.lit(-1).cast("long").alias("place"), "proof")
        if proofs is not None:
            messages = messages.unionByName(proofs.select("tree", "n", (-1 - F.col("place")).alias("place"), "proof"))
        # a message to the top of subtree s has the place -1 - s, so it comes before the subtree's nodes
        met = _subtrees(nodes.unionByName(messages, allowMissingColumns=True), span)
        names = [c for c in nodes.columns if c not in ("digest", "found")] if not epoch else ["tree", "n", "place"]
        kinds = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in names)
        if epoch:
            proofs = met.mapInArrow(down(done, names, lambda _, p: [pa.array(p, pa.binary())], [*names, "proof"]), f"{kinds}, proof binary")
    finished = [f.split()[0] for f in fields.split(", ")]

    def end(rows: pa.Table, proofs: list[bytes]) -> list[pa.Array]:
        found = rows.column("found").to_pylist() if "found" in rows.column_names else [None] * rows.num_rows
        return list(map(pa.array, finish(list(zip(rows.column("digest").to_pylist(), found, strict=True)), proofs)))

    return met.mapInArrow(down(0, names, end, [*names, *finished]), f"{kinds}, {fields}")


def number_leaves(rows: DataFrame, source: str, *order: str) -> DataFrame:
    """rows with tree (the number of their source among all, null first, then by UTF-8 bytes), n (rows of that source)
    and place (within it, in the given order, nulls first).

    Rows are dealt out in ranges of (source, order), so a source with many rows is many ranges; each task numbers
    its own, and the rows of earlier ranges are added from a table of one row for each source and range."""
    keys = [F.col(c).asc_nulls_first() for c in (source, *order)]
    ordered = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")  # what the number says of the task
    runs = cut(ordered.groupBy(F.col(source).alias("_source"), part).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first")))
    trees = runs.groupBy(F.col("_source").alias("_s")).agg(F.sum("_rows").alias("n"), F.min("_first").alias("_begin")).withColumn("_p", F.shiftright("_begin", 33))
    new = trees.groupBy(F.col("_p").alias("_q")).agg(F.count("*").alias("_new"))  # a row for each range
    new = new.select("_q", F.coalesce(F.sum("_new").over(Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_begin")) - 1
    trees = trees.withColumn("_rank", rank).join(new, F.col("_p") == F.col("_q")).select("_s", "n", (F.col("_earlier") + F.col("_rank")).alias("tree"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_before", before).join(trees, same(F.col("_source"), F.col("_s"))).select("_source", "_part", "_first", "_before", "n", "tree")
    met = same(ordered[source], F.col("_source")) & (F.shiftright(ordered["_at"], 33) == F.col("_part"))
    got = ordered.join(few(runs), met).withColumn("place", F.col("_before") + F.col("_at") - F.col("_first"))
    return got.select("tree", "n", "place", *rows.columns)


def without_line_ends(id_col: str = "doc_id", text: str = "text") -> Column:
    """The text as found after a tampering that takes the \\n characters from every document whose id, in
    decimal, has an even CRC-32. Null texts and those of null ids stay."""
    return F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))


def manifest(docs: DataFrame, found: Column | None = None, columns: tuple[str, str, str, str, str] = COLUMNS, span: int = SPAN) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of docs, digests as lower-case
    hex text. `columns` names the id (an integer), source, language, length and text.

    A leaf is the digest of the five columns; the leaves of a source, by id, are the leaves of a tree of
    runs of three, and its root, the subroot, is a leaf of the tree of all sources. folded_root is worked
    out from the proof and the leaf of the text as `found` (another text for a row; none given, or the same:
    the leaf itself), and verified says if it is the root. Null ids come first in their source; rows with one
    id go by their leaves, and equal rows are leaves of their own with proofs of their own. A null source is one
    before the empty one. Columns beside the five are not read. No rows give no rows.
    """
    key, source, lang, chars, text = columns
    own = [F.col(c) for c in (key, source, lang, chars)]
    changed = F.lit(None).cast("binary") if found is None else F.when(~found.eqNullSafe(F.col(text)), leaf(*own, found))
    rows = cut(docs.select(F.col(source).cast("string").alias("source"), F.col(key).alias("id"), leaf(*own, F.col(text)).alias("digest"), changed.alias("found")))
    leaves = number_leaves(rows, "source", "id", "digest").select("tree", "n", "place", "id", "digest", "found")
    size = leaves.agg(F.max("n").alias("n"), F.max("tree").alias("last")).first()
    starts, roots = sweep_up(leaves, size.n or 1, span)
    roots = cut(roots)
    trees = 0 if size.last is None else size.last + 1
    upper, top = sweep_up(roots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("place"), "digest"), trees, span)
    top = top.select("tree", "n", "digest", F.lit(b"").alias("proof"))
    proofs = sweep_down(upper, top.drop("digest"), lambda _, proofs: [proofs], "proof binary", span).select(F.col("place").alias("tree"), "proof")
    one = top.first()
    root = one.digest.hex() if one else None

    def finish(digests: list[tuple[bytes, bytes | None]], proofs: list[bytes]) -> list[list]:
        return [[d.hex() for d, _ in digests], [sha256(siblings(p)).hexdigest() for p in proofs], [fold(f or d, p).hex() for (d, f), p in zip(digests, proofs, strict=True)]]

    got = sweep_down(starts, roots.join(proofs, "tree").select("tree", "n", "proof"), finish, "leaf string, proof_sha256 string, folded_root string", span)
    names = few(roots.select(F.col("tree").alias("_tree"), F.lower(F.hex("digest")).alias("subroot")))
    got = got.join(names, F.col("tree") == F.col("_tree"))
    return got.select(F.col("id").alias(key), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
