"""A training corpus from raw documents in five stages; each takes (spark, docs, sf_dir) and returns a
DataFrame, written as Parquet and read again as the next stage's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, line_dedup, mixing, quality_classifier, simhash_dedup
from tidewatch.llm.queries import CODE_VOCABULARY, PATTERN, table
from tidewatch.sources.scratch import new_path

#: Share of a document's characters that has to be left by line dedup.
REMNANT = 0.1
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on those of them that are labelled, does not reject."""
    model = quality_classifier.fit(docs, quality_classifier.ratings(table(spark, sf_dir, "labels")), 3)
    return quality_classifier.grade_documents(docs, model).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated lines. One that lost lines and keeps no word, or under REMNANT of its characters
    (n_chars; null: not known, so not asked), goes: what is left of a near copy are the few lines that were changed most."""
    got = line_dedup.dedup_lines(docs.select(*COLUMNS))
    enough = F.coalesce(F.length("text") >= REMNANT * F.col("n_chars"), F.lit(True))
    left = got.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]") & enough)
    return left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_dedup.simhash_keep(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs, mixing.cycle_weights(docs)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of each document, its ids, their digest, and that of what they decode to."""
    return bpe.digests(docs, CODE_VOCABULARY, PATTERN, with_ids=True)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_copies), ("mixing", mixture), ("byte-level bpe", tokens)]

#: SQL can express neither the classifier nor the hashes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each stage kept is written in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = new_path(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return STAGES[-1][1](spark, docs, sf_dir)
