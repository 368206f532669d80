"""White space as Python's str.strip knows it, and values that are worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once a row however often it is used, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once a row, whatever is asked of them later. Columns of a plain select are
    put into each filter on them, as often as it names them; a filter on a generator's output stays above it."""
    return df.select("*", F.inline_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
