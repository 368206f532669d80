"""Time stamps of log records as Column expressions; all times are UTC unless they carry an offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of time stamps that records are searched for.
ISO_ANYWHERE = r"(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)"
ISO_AT_START = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)"
SYSLOG_AT_START = r"^([A-Z][a-z]{2}\s+\d+\s+\d{2}:\d{2}:\d{2})"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def iso(text: Column, pattern: str = ISO_ANYWHERE) -> Column:
    return F.try_to_timestamp(F.regexp_replace(found(text, pattern), r"\s", "T"))


def syslog(text: Column, year: Column) -> Column:
    """`Mon d HH:MM:SS` at the start, in the given year."""
    stamp = F.regexp_replace(found(text, SYSLOG_AT_START), r"\s+", " ")
    return F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), stamp), F.lit("yyyy MMM d HH:mm:ss"))


def first_format(text: Column, *formats: str) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))
