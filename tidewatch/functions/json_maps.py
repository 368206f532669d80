"""Alternate JSON keys: an object is read once, as a map of strings; inner values that are not strings
keep their JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import stripped

#: What counts as no value: the next key is tried.
NOTHING = ("", "0", "0.0", "false", "{}", "[]")
_MAP = "map<string,string>"


def json_map(text: Column) -> Column:
    """The object that a text holds, or null."""
    return F.when(text.startswith("{") & text.endswith("}"), F.from_json(text, _MAP))


def inner(value: Column, key: str) -> Column:
    """An object inside a map, or null."""
    return json_map(F.try_element_at(value, F.lit(key)))


def first_text(value: Column, *keys: str, key: str = "#text") -> Column:
    """The first value that is something; of an object its `key` or `Value`. `A.b` is b in the map column A."""
    tries = []
    for k in keys:
        column, _, name = k.rpartition(".")
        got = F.try_element_at(F.col(column) if column else value, F.lit(name))
        tries.append(F.when(~got.isin(*NOTHING), got))
    return _value(F.coalesce(*tries), key)


def first_present(value: Column, *keys: str, key: str = "#text") -> Column:
    """The value of the first key that is there, whatever it is; else as first_text."""
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        column, _, name = k.rpartition(".")
        at = F.col(column) if column else value
        out = F.when(F.map_contains_key(at, F.lit(name)), F.try_element_at(at, F.lit(name))).otherwise(out)
    return _value(out, key)


def _value(got: Column, key: str) -> Column:
    parts = F.from_json(got, _MAP)
    return F.when(got.startswith("{"), F.coalesce(F.try_element_at(parts, F.lit(key)), F.try_element_at(parts, F.lit("Value")))).otherwise(got)


def named(text: Column, *placeholders: str) -> Column:
    """Trimmed; null for blanks and the given placeholders."""
    clean = stripped(text)
    return F.when(~clean.isin("", *placeholders), clean)
