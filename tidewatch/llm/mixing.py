"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, cut, same


def word_count(text: str = "text") -> Column:
    """Words of a text; 0 for a null or empty one."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """sources(source, source_size, weight) with a double column target.

    The sum of all sizes is shared by weight. No target is over `most` times its source's size; what
    is cut off there is shared by weight among the others, again and again, until none is above.
    A null, negative or zero weight takes nothing. If every source is full, the rest is not given out.
    Each round is one aggregation over the sources; the driver gets three sums.
    """
    w = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    s = sources.withColumn("_w", w).withColumn("_cap", most * F.coalesce("source_size", F.lit(0)))
    total = float(s.agg(F.sum("source_size")).first()[0] or 0)
    share, full = 0.0, -1
    left = total
    weight = float(s.agg(F.sum("_w")).first()[0] or 0)
    while weight > 0:
        share = left / weight
        above = F.col("_cap") <= F.lit(share) * F.col("_w")
        now = s.agg(
            F.count_if(above & (F.col("_w") > 0)),
            F.sum(F.when(above & (F.col("_w") > 0), F.col("_cap"))),
            F.sum(F.when(~above, F.col("_w"))),
        ).first()
        if now[0] == full:
            break
        full, left, weight = now[0], total - float(now[1] or 0), float(now[2] or 0)
    target = F.least(F.col("_cap").cast("double"), F.lit(left) * F.col("_w") / F.lit(weight)) if weight > 0 else F.when(F.col("_w") > 0, F.col("_cap")).otherwise(0.0)
    return s.withColumn("target", target.cast("double")).drop("_w", "_cap")


def unit(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("null")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def plan_mix(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", source: str = "source", size: str = "size", most: float = 3.0, seed: int = 17) -> DataFrame:
    """docs (with a long column `size`) with _source_size, _target, _rate and _copies; columns of these
    names are replaced.

    weights(source, weight) has one row for each source, null included; a source without a row takes
    nothing. A source's rate is its target over its size. A document is taken floor(rate) times, and
    once more if its seeded number is below the fraction: no more than ceil(most) times, the same in
    every run. So what a source gives differs from its target by chance, with a variance of f (1 - f)
    times the sum of its squared sizes, f being the fraction. Documents without words are planned like the others of their source (in a source
    without any word the rate is 0). The one row of each source is joined to the documents; Spark
    broadcasts it if its size allows, else splits the hot source's partition. Columns of docs called
    _src, _rate, _copies, _source_size or _target don't come back.
    """
    docs = docs.drop("_source_size", "_target", "_rate", "_copies", "_src")
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    w = weights.select(F.col("source").alias("_s"), "weight")
    # one row for each source, written once: the rounds below don't read the documents again
    sources = cut(sizes.join(w, same(F.col("source"), F.col("_s")), "left").select("source", "source_size", "weight"))
    t = source_targets(sources, most).select(F.col("source").alias("_src"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    got = docs.join(t, same(docs[source], t["_src"])).drop("_src")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    whole = F.floor("_rate")
    extra = unit(seed, F.col(id_col)) < F.col("_rate") - whole
    return got.withColumn("_rate", rate).withColumn("_copies", (whole + extra.cast("long")).cast("long"))


def mix(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself: each row of docs repeated as often as it is taken, with docs' own columns."""
    # the row travels as one struct, so that its columns may have any names
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"))
    planned = plan_mix(rows, weights, "id", "source", "size", **options).where("_copies > 0")
    return planned.select("row", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("row.*")


def cycle_weights(docs: DataFrame, source: str = "source", cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, weight): sources by code point, null last, weigh 5, 2, 1, 5, 2, 1, ...

    One row for each source is left by an aggregation and dealt out by ranges of names; a source's number
    is its place in its range and the sources of the ranges before it, so no task orders them all."""
    from pyspark.sql import Window

    names = docs.groupBy(F.col(source).alias("source")).agg(F.lit(1).alias("_one")).drop("_one")
    names = cut(names.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()))
    # a row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = names.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())) - 1
    n = names.withColumn("_place", place).join(ranges, "_range")
    return n.select("source", F.element_at(F.array(*map(F.lit, cycle)), ((F.col("_before") + F.col("_place")) % len(cycle) + 1).cast("int")).alias("weight"))
