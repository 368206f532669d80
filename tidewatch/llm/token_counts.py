"""Token counts: the exact histogram of encoded lengths, and suffix sums over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.bpe import count_tokens
from tidewatch.llm.common import cut

#: Lengths whose running sums are made in one task; the sums over blocks have max length / _BLOCK rows.
_BLOCK = 4096


def length_histogram(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """(length, n_docs): documents by encoded length; null and empty texts have length 0. Counts are
    combined before the shuffle, so a common length is one row from each task."""
    counted = count_tokens(docs.select(F.col(text).alias("_text")), vocabulary, pattern, "_text", "length")
    # written once: sums over it must not encode the documents again
    return cut(counted.groupBy("length").agg(F.count("*").alias("n_docs")))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """A row for each length that occurs, read as a context limit:

    length, n_docs, docs_longer and tokens_longer (of documents over the limit), docs_up_to (others),
    total_docs, total_tokens, truncated_total (tokens left if each document is cut at the limit) and
    docs_share (of documents that fit whole). An empty histogram gives no rows.
    """
    h = histogram.withColumn("block", F.floor(F.col("length") / _BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        F.col("block").alias("b"),
        *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"),
        *(F.sum(c).over(whole).alias(f"{c}_all") for c in "dt"),
    )
    longer = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    sums = h.select("*", F.coalesce(F.sum("n_docs").over(longer), F.lit(0)).alias("d"), F.coalesce(F.sum("tokens").over(longer), F.lit(0)).alias("t"))
    s = sums.join(blocks, F.col("block") == F.col("b"))
    docs_longer, tokens_longer = F.col("d") + F.col("d_after"), F.col("t") + F.col("t_after")
    return s.select(
        "length",
        "n_docs",
        docs_longer.alias("docs_longer"),
        tokens_longer.alias("tokens_longer"),
        (F.col("d_all") - docs_longer).alias("docs_up_to"),
        F.col("d_all").alias("total_docs"),
        F.col("t_all").alias("total_tokens"),
        (F.col("t_all") - tokens_longer + F.col("length") * docs_longer).alias("truncated_total"),
        ((F.col("d_all") - docs_longer) / F.col("d_all")).alias("docs_share"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_longer, truncated_total) for any limits, also between or beyond the
    lengths that occur: at a limit the suffix is that of the next shorter length."""
    ask = F.struct("length", "docs_longer", "tokens_longer")
    aggs = [F.struct(F.lit(int(x)).cast("long").alias("x"), F.max(F.when(F.col("length") <= int(x), ask)).alias("a")) for x in limits]
    got = sums.agg(F.max("total_docs").alias("d"), F.max("total_tokens").alias("t"), F.array(*aggs).alias("at")).select("d", "t", F.inline("at"))
    longer = F.coalesce("a.docs_longer", "d", F.lit(0))
    tokens = F.coalesce("a.tokens_longer", "t", F.lit(0))
    return got.select(F.col("x").alias("context_limit"), longer.alias("docs_longer"), (F.coalesce("t", F.lit(0)) - tokens + F.col("x") * longer).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least this share of documents does not exceed."""
    aggs = [F.min(F.when(F.col("docs_up_to") >= q * F.col("total_docs"), F.col("length"))) for q in shares]
    got = sums.agg(F.array(*[F.struct(F.lit(float(q)).alias("share"), a.alias("length")) for q, a in zip(shares, aggs, strict=True)]).alias("q"))
    return got.select(F.inline("q"))
