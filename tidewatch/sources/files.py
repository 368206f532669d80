"""Log and document sources: line scans, record files, admission with reasons, page assembly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import stripped
from tidewatch.schema import BENCHMARK_CASE

MIB = 1 << 20


def log_lines(spark: SparkSession, path: str | list[str], numbered: bool = True) -> DataFrame:
    """(source_id, line_no, raw): each line of text files, stripped, blank lines kept, invalid UTF-8
    replaced. line_no (from 1) follows the order in the file: a line's place in its block of the file,
    and the lines of the blocks before, which one more scan counts. Without `numbered` it is only an
    order within each task's part and costs no shuffle."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    raw = read.select("source_id", "_block", "_id", stripped(F.make_valid_utf8("value")).alias("raw"))
    if not numbered:
        return raw.select("source_id", F.col("_id").alias("line_no"), "raw")
    blocks = read.groupBy("source_id", "_block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("source_id", "_block", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("source_id", "_block").orderBy("_id"))
    return raw.withColumn("_n", place).join(blocks, ["source_id", "_block"]).select("source_id", (F.col("before") + F.col("_n")).alias("line_no"), "raw")


def started_at(spark: SparkSession, folder: str) -> str:
    """When a stream was started first, UTC: kept in a file of the folder, so a restart with the same
    folder goes on from there."""
    path = f"{folder.rstrip('/')}/first-start"
    try:
        return spark.read.text(path).first().value
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    now = spark.range(1).select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("value"))
    now.coalesce(1).write.text(path)
    return spark.read.text(path).first().value


def stream_lines(spark: SparkSession, path: str, process_existing: bool = True, folder: str | None = None) -> DataFrame:
    """The lines of files that land in a folder, blank ones dropped. line_no is the place of
    the lines' file block; lines of one block with equal times are in no order. A file is read once,
    when it has landed, the oldest first. Without `process_existing`, files that were there when the
    stream was started first give no lines; `folder` (of the checkpoint) keeps that time."""
    if not process_existing and not folder:
        raise ValueError("to leave out existing files, name the folder that keeps the time of the start")
    r = spark.readStream.format("text").schema("value string").load(path)
    if not process_existing:
        start = F.to_utc_timestamp(F.col("_metadata.file_modification_time"), F.current_timezone()) > F.lit(started_at(spark, folder)).cast("timestamp")
        r = r.where(start)
    raw = r.select(F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("line_no"), stripped(F.col("value")).alias("raw"))
    return raw.where("raw <> ''")


def record_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_id, line_no, raw) of files that hold a JSON array, an object with a `Records` array, or
    lines: each record a row, blank lines dropped. A file is one row on the way, so large inputs should
    be lines (log_lines)."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_id"), stripped(F.make_valid_utf8("value")).alias("_text"))
    v = F.try_parse_json("_text")
    items = F.coalesce(F.try_variant_get(v, "$.Records", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    closed = (F.col("_text").startswith("[") & F.col("_text").endswith("]")) | (F.col("_text").startswith("{") & F.col("_text").endswith("}"))
    whole = whole.withColumn("_items", F.when(closed, items))
    objects = F.filter("_items", lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    lines = F.filter(F.transform(F.split("_text", r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), stripped), lambda x: x != "")
    rows = whole.select("source_id", F.posexplode(F.when(F.col("_items").isNotNull(), F.transform(objects, lambda x: F.to_json(x))).otherwise(lines)).alias("_n", "raw"))
    return rows.select("source_id", (F.col("_n") + 1).cast("long").alias("line_no"), "raw")


@dataclass(frozen=True)
class Admission:
    """What files are let in: name endings, size, and which contents are tested for."""

    extensions: tuple[str, ...]
    most_bytes: int
    no_archives: bool = True
    no_nulls: bool = False
    utf8: bool = False


LOG_FILES = Admission((".log", ".txt", ".json", ".evtx"), 5 * MIB, no_archives=False)
UPLOADS = Admission((".log", ".txt"), 5 * MIB, no_nulls=True, utf8=True)
KNOWLEDGE_FILES = Admission((".pdf", ".md", ".txt"), 20 * MIB)


def rejected_reason(rule: Admission, path: Column, length: Column, content: Column) -> Column:
    """Why a file is not let in, or null."""
    name = F.lower(path)
    ending = F.lit(False)
    for e in rule.extensions:
        ending = ending | name.endswith(e)
    magic = F.substring(content, 1, 3)
    archive = F.substring(magic, 1, 2).isin(F.lit(b"PK"), F.lit(b"\x1f\x8b")) | (magic == F.lit(b"BZh"))
    out = F.when(~ending, "extension").when(length > rule.most_bytes, "size").when(length == 0, "empty")
    if rule.no_archives:
        out = out.when(archive, "archive")
    if rule.no_nulls:
        out = out.when(F.expr("position(X'00', content) > 0"), "null_byte")
    if rule.utf8:
        out = out.when(~F.is_valid_utf8(content.cast("string")), "encoding")
    return out


def admit(files: DataFrame, rule: Admission) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of files(path, length, content). Both keep the columns; rejected has a
    rejected_reason instead of the content. The test on length is a filter of its own, so that the
    source does not read what is too large."""
    small = files.where(F.col("length") <= rule.most_bytes).withColumn("rejected_reason", rejected_reason(rule, F.col("path"), F.col("length"), F.col("content")))
    large = files.where(F.col("length") > rule.most_bytes).drop("content").withColumn("rejected_reason", F.lit("size"))
    bad = small.where("rejected_reason is not null").drop("content")
    return small.where("rejected_reason is null").drop("rejected_reason"), bad.unionByName(large)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder and those inside it, or that a pattern names, as rows (path, modificationTime,
    length, content), those of no bytes included. Spark's reader passes over these, so the driver looks
    for them in the listing."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    store, empty = home.getFileSystem(spark._jsc.hadoopConfiguration()), []
    folders = [s for s in store.globStatus(home) or []]
    while folders:
        s = folders.pop()
        name = s.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        if s.isDirectory():
            folders += store.listStatus(s.getPath())
        elif s.getLen() == 0:
            empty.append((s.getPath().toString(), s.getModificationTime() / 1000))
    if not empty:
        return read
    rows = spark.createDataFrame(empty, "path string, at double")
    return read.unionByName(rows.select("path", F.timestamp_seconds("at").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")), allowMissingColumns=True)


def text_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected) of accepted files: Markdown and text in strict UTF-8 with a sha256; other
    endings and bad encodings are rejected. Page-marked documents come from assemble_pages."""
    f = files.withColumns({"sha256": F.sha2("content", 256), "filename": F.element_at(F.split("path", "/"), -1)})
    plain = F.lower("path").rlike(r"\.(md|txt)$")
    good = F.is_valid_utf8(F.col("content").cast("string"))
    f = f.withColumn("rejected_reason", F.when(~plain, "unsupported").when(~good, "encoding"))
    ok = f.where("rejected_reason is null").select("filename", F.col("content").cast("string").alias("content"), "sha256")
    return ok, f.where("rejected_reason is not null").select("filename", "sha256", "rejected_reason")


def parse_documents(files: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected) of accepted files(path, content) of every kind, told apart by their endings: Markdown and
    text as they are, page-marked documents (.pdf) from pages(path, page_no, text), which some other program has
    read from them. documents: (filename, content, sha256); the digest is the file's. rejected: (filename, sha256,
    rejected_reason): `unsupported` endings, `encoding`, and `empty` for a document whose pages hold no text."""
    paged = F.lower("path").endswith(".pdf")
    plain, refused = text_documents(files.where(~paged))
    named = files.where(paged).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("sha256"))
    read = named.join(assemble_pages(pages, "path"), "path", "left")
    empty = read.where("content is null").select("filename", "sha256", F.lit("empty").alias("rejected_reason"))
    return plain.unionByName(read.where("content is not null").select("filename", "content", "sha256")), refused.unionByName(empty)


def assemble_pages(pages: DataFrame, doc: str = "doc_id", number: str = "page_no", text: str = "text") -> DataFrame:
    """(doc, content): the pages of each document in order, each under `--- Page n ---`, empty ones
    skipped; a document without any text has no row."""
    clean = pages.where(stripped(F.coalesce(text, F.lit(""))) != "")
    one = F.struct(F.col(number).alias("n"), F.concat(F.lit("--- Page "), F.col(number).cast("string"), F.lit(" ---\n"), F.col(text)).alias("t"))
    return clean.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.t), "\n").alias("content"))


def benchmark_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCHMARK_CASE).json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    """Reports or benchmark results, one JSON object a line."""
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A text sink for alert lines."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)
