"""Knowledge corpus: cleaning, duplicate rejection, chunking, append and listing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import let, stripped
from tidewatch.sources import scratch

#: What ends a line: more than \n, as in str.splitlines.
LINE_ENDS = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
# Lines that start a section.
HEADING, PAGE = r"(?U)^#+\s+(.+)$", r"(?U)^---\s+(Page\s+\d+)\s+---$"


def word_list(text: Column) -> Column:
    """The words of a text: runs without (Unicode) white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def clean_text(text: Column) -> Column:
    """Lines stripped and blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(text, LINE_ENDS), stripped), lambda x: x != ""), "\n")


def document_id(sha256: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(sha256, 1, 12))


def reject_duplicates(documents: DataFrame, existing: DataFrame | None = None, order: str = "filename") -> tuple[DataFrame, DataFrame]:
    """(new, duplicates) of documents(sha256, ...): the first of each digest by `order`, unless the
    table `existing` has it already. The digest alone decides."""
    # the first of each digest is found before the shuffle: copies of one document never meet in one task
    first = documents.groupBy("sha256").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where(F.col("_n") > 1).select("sha256", "_first")
    again = F.row_number().over(Window.partitionBy("sha256", order).orderBy(order))
    ranked = documents.join(first, "sha256", "left").withColumn("_again", again)
    if existing is not None:
        known = existing.select("sha256").distinct().withColumn("_known", F.lit(True))
        ranked = ranked.join(known, "sha256", "left")
    else:
        ranked = ranked.withColumn("_known", F.lit(None).cast("boolean"))
    leads = F.col("_first").isNull() | F.col(order).eqNullSafe(F.col("_first"))
    fresh = leads & (F.col("_again") == 1) & F.col("_known").isNull()
    own = documents.columns
    return ranked.where(fresh).select(own), ranked.where(~fresh).select(own)


def overlap_pieces(text: Column, max_words: int = 400, overlap: int = 50) -> Column:
    """array of texts: windows of max_words words that step max_words - overlap; a text of no more than
    max_words words is kept as it is."""
    if not 0 <= overlap < max_words:
        raise ValueError("overlap must be at least 0 and below max_words")
    step = max_words - overlap

    def pieces(words: Column) -> Column:
        n = F.size(words)
        starts = F.sequence(F.lit(0), F.ceil((n - max_words) / F.lit(step)).cast("int"))
        parts = F.transform(starts, lambda k: F.array_join(F.slice(words, k * step + 1, max_words), " "))
        return F.when(n <= max_words, F.array(text)).otherwise(parts)

    return let(word_list(text), pieces)


def sections(documents: DataFrame, doc: str = "document_id", content: str = "content", most_carried: int = 15) -> DataFrame:
    """(doc, section_no, section, text): a heading or page mark starts a section if what was gathered
    before it has over `most_carried` words; else it joins what follows, and the later name counts.
    Blank lines are dropped."""
    lines = documents.select(doc, F.posexplode(F.split(content, LINE_ENDS)).alias("n", "line"))
    mark = F.coalesce(F.nullif(F.regexp_extract("line", HEADING, 1), F.lit("")), F.nullif(F.regexp_extract("line", PAGE, 1), F.lit("")))
    lines = lines.withColumn("mark", stripped(mark)).where("mark is not null or trim(line) <> ''")
    so_far = Window.partitionBy(doc).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    blocks = lines.withColumn("block", F.count("mark").over(so_far)).withColumn("words", F.size(word_list(F.col("line"))))
    one = blocks.groupBy(doc, "block").agg(
        F.first("mark", ignorenulls=True).alias("mark"), F.sum("words").alias("words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x.line), "\n").alias("text")
    )
    one = scratch.written(one, "blocks")
    narrow = one.select(doc, "block", F.col("mark").isNotNull().alias("marked"), "words").repartition(doc).sortWithinPartitions(doc, "block")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The section of each block, from the words since the last section began: numbers only, in one pass."""
        of, section, gathered = None, 0, 0
        for batch in batches:
            out = []
            for d, marked, words in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if d != of:
                    of, section, gathered = d, 0, 0
                elif marked and gathered > most_carried:
                    section, gathered = section + 1, 0
                gathered += words or 0
                out.append(section)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], [doc, "block", "section_no"])

    places = narrow.mapInArrow(numbered, f"`{doc}` {one.schema[doc].dataType.simpleString()}, block long, section_no int")
    parts = one.join(places, [doc, "block"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x.text), "\n")
    last = F.max(F.when(F.col("mark").isNotNull(), F.struct("block", "mark"))).getField("mark")
    return parts.groupBy(doc, "section_no").agg(F.coalesce(last, F.lit("General")).alias("section"), text.alias("text"))


def chunk_documents(documents: DataFrame, max_words: int = 400, overlap: int = 50) -> DataFrame:
    """The chunks of documents(document_id, source_title, content): chunk_id, document_id, source_title,
    section_or_page, content, word_count and chunk_index, which runs on over a document's sections."""
    s = sections(documents)
    pieces = s.select("document_id", "section_no", F.col("section").alias("section_or_page"), F.posexplode(overlap_pieces(F.col("text"), max_words, overlap)).alias("piece", "content"))
    pieces = pieces.withColumn("word_count", F.size(word_list(F.col("content")))).where("word_count > 0")
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("section_no", "piece")) - 1
    titled = pieces.withColumn("chunk_index", index).join(documents.select("document_id", "source_title"), "document_id")
    name = F.concat_ws("_", "document_id", F.lit("chk"), F.col("chunk_index").cast("string"), F.substring(F.sha2("content", 256), 1, 8))
    return titled.select(name.alias("chunk_id"), "document_id", "source_title", "section_or_page", "content", "word_count", "chunk_index")


def document_sizes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum("word_count").alias("n_words"))


class IngestConflict(Exception):
    """Another ingest committed while this one was at work; nothing of this one counts, so it can be tried again."""


def _hadoop(spark: SparkSession, path: str):
    """The path as one of Hadoop's, and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, folder: str) -> list[str]:
    """The batches of a corpus that count, in order: each has a file in folder/commits, named by its number, that
    names its folder."""
    home, store = _hadoop(spark, f"{folder}/commits")
    numbers = sorted(s.getPath().getName() for s in store.listStatus(home)) if store.exists(home) else []
    numbers = [n for n in numbers if n.isdigit()]
    if not numbers:
        return []
    read = spark.read.text([f"{folder}/commits/{n}" for n in numbers]).select(F.col("_metadata.file_name").alias("n"), "value")
    return [r.value for r in sorted(read.collect())]  # a row for each ingest


def corpus_table(spark: SparkSession, folder: str, name: str, batches: list[str] | None = None) -> DataFrame | None:
    """A table (documents, chunks or one that ingest was asked for) over all committed batches, or those given; None
    before the first."""
    batches = commits(spark, folder) if batches is None else batches
    return spark.read.parquet(*(f"{folder}/{b}/{name}" for b in batches)) if batches else None


def _commit(spark: SparkSession, folder: str, number: int, batch: str) -> None:
    """One rename makes all tables of a batch count, and fails if the number is taken."""
    spare, store = _hadoop(spark, f"{folder}/{batch}/commit")
    home, _ = _hadoop(spark, f"{folder}/commits")
    store.mkdirs(home)
    out = store.create(spare, False)
    out.write(bytearray(batch.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(spare, _hadoop(spark, f"{folder}/commits/{number:08d}")[0], plain)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        raise IngestConflict(f"{folder}: batch {number} is there") from e


def ingest(
    spark: SparkSession, documents: DataFrame, folder: str, created_at: Column | None = None, max_words: int = 400, overlap: int = 50, more: dict[str, Callable[[DataFrame], DataFrame]] | None = None
) -> DataFrame:
    """Adds documents(filename, content, sha256) to the corpus in a folder and returns the duplicates, which are
    those of the batch and of what was there before.

    A batch is a folder with the tables documents, chunks and, for each name in `more`, what its function makes of
    the batch's chunks (an index, say: {"vectors": retrieval.indexed_vectors}). It counts from the moment that its
    commit file is in place: a job that breaks off before leaves tables that no reader sees, and a retry
    starts anew. Of two ingests at once one gets an IngestConflict. The folder's store must rename a file at once
    and not over another (local disks and HDFS do).
    """
    done = commits(spark, folder)
    fresh, duplicates = reject_duplicates(documents, corpus_table(spark, folder, "documents", done))
    rows = fresh.select(document_id(F.col("sha256")).alias("document_id"), F.col("filename").alias("source_title"), clean_text(F.col("content")).alias("content"), "sha256", (created_at if created_at is not None else F.current_timestamp()).alias("created_at"))
    rows = scratch.written(rows, "ingest")
    batch = f"batch-{len(done) + 1:08d}-{uuid.uuid4().hex}"
    chunk_documents(rows, max_words, overlap).write.parquet(f"{folder}/{batch}/chunks")
    rows.drop("content").write.parquet(f"{folder}/{batch}/documents")
    for name, of in (more or {}).items():
        of(spark.read.parquet(f"{folder}/{batch}/chunks")).write.parquet(f"{folder}/{batch}/{name}")
    _commit(spark, folder, len(done) + 1, batch)
    return duplicates


def remove_uncommitted(spark: SparkSession, folder: str) -> list[str]:
    """Delete what broken ingests left and return its names. Not while one is at work."""
    home, store = _hadoop(spark, folder)
    kept = set(commits(spark, folder))
    lost = [s.getPath() for s in store.listStatus(home) if s.getPath().getName().startswith("batch-") and s.getPath().getName() not in kept]
    for path in lost:
        store.delete(path, True)
    return [path.getName() for path in lost]


def list_documents(documents: DataFrame) -> DataFrame:
    """Newest first."""
    return documents.orderBy(F.desc("created_at"), "document_id")


def ordered_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """All chunks of listed documents in order of arrival."""
    return chunks.join(documents.select("document_id", "created_at"), "document_id").orderBy("created_at", "document_id", "chunk_index")
