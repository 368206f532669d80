"""Benchmark decontamination: test windows as a broadcast hash set, document windows scanned against it, hits
verified word by word, spans or documents removed. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import FEW, cut, few, measured, same, spare

#: What is between words, once A-Z count as letters: all of ASCII but digits and letters.
_BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of windows, beside FEW rows, that may be broadcast at once.
MOST_BYTES = 64 << 20


def _raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{_BETWEEN}]+"), "")


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case and no other letter changed; null: none."""
    # lower() may not be used on words beyond ASCII, and translate() is slow
    plain = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, _CAPITALS, _CAPITALS.lower()))
    return F.transform(_raw_words(text), plain)


def _key(hashes: Column, at: Column, size: int) -> Column:
    """Hash of `size` words from a place on; hashes: those of the words."""
    return F.xxhash64(*(F.get(hashes, at + k) for k in range(size)))


def _said(said: Column, at: Column, size: Column) -> Column:
    return F.array_join(F.slice(said, at + 1, size), " ")


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = 10) -> DataFrame:
    """(key, size, said, items) for each window of `width` words of benchmark texts; a text of fewer is one
    window, one without words none. items: the sorted ids, as strings, of the items that have it."""
    w = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    w = w.select("item", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.least(F.size("w"), F.lit(width)).alias("size"))
    w = w.select("*", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("at"))
    key = F.coalesce(*(F.when(F.col("size") == k, _key(F.col("h"), F.col("at"), k)) for k in range(1, width + 1)))
    one = w.select(key.alias("key"), "size", _said(F.col("w"), F.col("at"), F.col("size")).alias("said"), "item")
    return one.groupBy("key", "size", "said").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _scan(docs: DataFrame, windows: DataFrame, sizes: list[int], ends: bool) -> DataFrame:
    """(doc, version, n, at, end, group): the places where a window of the broadcast table stands in documents
    of n words and, with `ends`, a row at the end (at = n) of each document, however many hits it has. Places and
    keys exist only within a task; what leaves it are verified hits and ends."""
    d = docs.select("doc", "version", words(F.col("text")).alias("w"))
    d = d.select("doc", "version", "w", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), "n")).alias("at"))
    key = lambda s: F.when(F.col("at") + s <= F.col("n"), _key(F.col("h"), F.col("at"), s)).alias("_key")
    keys = [F.lit(0).alias("_k"), key(sizes[0])] if len(sizes) == 1 else [F.posexplode(F.array(*map(key, sizes))).alias("_k", "_key")]
    end = (F.col("at") == F.col("n")) & (F.col("_k") == 0) & F.lit(ends)
    d = d.select("doc", "version", "w", "n", "at", *keys).where(F.col("_key").isNotNull() | end)
    # between, as an equality would become a key of the join and be worked out for every place
    verified = _said(F.col("w"), F.col("at"), F.col("size")).between(F.col("said"), F.col("said"))
    met = d.join(F.broadcast(windows), (d["_key"] == windows["key"]) & verified, "left").where(F.col("group").isNotNull() | end)
    return met.select("doc", "version", "n", "at", (F.col("at") + F.col("size")).alias("end"), "group")


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str, text: str, item: str = "item_id", item_text: str = "text", width: int = 10) -> tuple[DataFrame, DataFrame]:
    """(doc, version, n) of each row of docs: its id, the hash of its text and the number of its words; and (doc,
    version, spans, n_hit, items, n_items, items_sha256) for each document that has a window of an item: the merged
    spans of hit words (array of start and end, from 0, the end not included), the number of hit words, the
    sorted ids of the items and the digest of them, comma-joined. Rows with the same id and text are one there.

    The windows of the benchmark, with a number for each set of items that have the same, are broadcast
    in blocks of FEW rows and MOST_BYTES at most, one for any usual benchmark; every block is held
    against all documents, so no size loses a window. Windows that stand in many documents
    meet no one task: each is found where its document is. The items of a document are put together once for each
    distinct set of item groups, so that copies of a document, or of an item, cost no more rows.
    """
    w = item_windows(benchmark, item, item_text, width).withColumn("group", F.sha2(F.to_json("items"), 256))
    w, got = measured(w, rows=F.count(F.lit(1)), size=F.sum(F.octet_length("said")), sizes=F.collect_set("size"))
    blocks = max(1, -(-got["rows"] // FEW), -(-(got["size"] or 0) // MOST_BYTES))
    sizes = sorted(got["sizes"] or [width])
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    table = w.select("key", "size", "said", "group")
    rows = _scan(d, table if blocks == 1 else table.where(F.pmod("key", F.lit(blocks)) == 0), sizes, True)
    for i in range(1, blocks):
        rows = rows.unionByName(_scan(d, table.where(F.pmod("key", F.lit(blocks)) == i), sizes, False))
    rows = cut(rows)
    by_place = Window.partitionBy("doc", "version").orderBy("at", "end")
    before = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("at") > before, F.lit(True)).cast("int")
    hits = rows.where("group is not null").drop("n").distinct()
    spans = hits.withColumn("_new", new).withColumn("_span", F.sum("_new").over(by_place))
    spans = spans.groupBy("doc", "version", "_span").agg(F.min("at").alias("start"), F.max("end").alias("end"), F.collect_set("group").alias("g"))
    found = spans.groupBy("doc", "version").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
        F.sum(F.col("end") - F.col("start")).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("g")))).alias("groups"),
    )
    found = cut(found)
    groups = w.groupBy("group").agg(F.first("items").alias("items"))
    sets = found.select("groups").distinct().select("groups", F.explode("groups").alias("group")).join(groups, "group")
    sets = sets.groupBy("groups").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    sets = sets.select("groups", "items", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return rows.where("at = n").select("doc", "version", "n"), found.join(few(sets, numbers="items"), "groups").drop("groups")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id_col as a long, n_words, n_hit, n_items, items, items_sha256, spans, contaminated) for each row of docs.
    spans are merged spans of hit words, counted from 0, the end not included.

    A null or empty text, and any without words, has no windows. An item with fewer than `width` words is
    one window, one without words is in no document; an item whose id is null makes words hit
    but is no counted item. Repeated rows come back repeated; other columns are not read. No items:
    nothing is hit.
    """
    rows, found = _overlaps(docs, benchmark, id_col, text, **options)
    got = rows.alias("r").join(found.alias("f"), same(F.col("r.doc"), F.col("f.doc")) & (F.col("r.version") == F.col("f.version")), "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0)), F.sha2(F.lit("").cast("binary"), 256)
    return got.select(
        F.col("r.doc").alias(id_col), F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce("items_sha256", none).alias("items_sha256"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", whole: bool = False, **options) -> DataFrame:
    """docs, all columns, less the hit words, each with what stands between it and the word before; with
    `whole` less the documents that have any. Texts without hits stay as they are."""
    doc, version, spans = (spare(docs, c) for c in ("_doc", "_version", "_spans"))
    found = _overlaps(docs, benchmark, id_col, text, **options)[1].select(F.col("doc").alias(doc), F.col("version").alias(version), F.col("spans").alias(spans))
    met = same(docs[id_col].cast("long"), found[doc]) & (F.xxhash64(docs[text]) == found[version])
    if whole:
        return docs.join(found, met, "left_anti")
    pieces = F.regexp_extract_all(docs[text], F.lit(f"[{_BETWEEN}]*[^{_BETWEEN}]+"), F.lit(0))
    clean = F.filter(pieces, lambda _, i: ~F.exists(found[spans], lambda s: (i >= s.start) & (i < s.end)))
    tail = F.regexp_replace(docs[text], f"(?s)^.*[^{_BETWEEN}]", "")
    left = F.when(found[spans].isNull(), docs[text]).otherwise(F.concat(F.array_join(clean, ""), tail))
    return docs.join(found, met, "left").select(*(left.alias(c) if c == text else docs[c] for c in docs.columns))
