"""Arrays, maps and JSON objects as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.numbers import quoted


def indexed(values: Column) -> Column:
    """The elements of an array with their places from 0, as an array of ``i, v``; of null: none."""
    pairs = F.transform(values, lambda v, i: F.struct(i.cast("long").alias("i"), v.alias("v")))
    return F.coalesce(pairs, F.filter(F.array(F.struct(F.lit(0).cast("long").alias("i"), F.get(values, F.lit(0)).alias("v"))), lambda _: F.lit(False)))


def json_entries(text: Column, kind: str = "string") -> Column:
    """Members of a JSON object as an array of ``key, value``, values read as ``kind``; null for a text that is no object."""
    return F.map_entries(F.from_json(text, f"map<string, {kind}>"))


def inline_elements(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row per element of an array column: the ``keep`` columns, ``i`` (from 0) and ``v``. Empty and null arrays have no row."""
    return df.select(*[F.col(quoted(c)) for c in keep], F.inline(indexed(F.col(quoted(column)))))


def inline_members(df: DataFrame, column: str, keep: list[str], kind: str = "string") -> DataFrame:
    """One row per member of a JSON object in a text column: the ``keep`` columns, ``key`` and ``value``."""
    return df.select(*[F.col(quoted(c)) for c in keep], F.inline(json_entries(F.col(quoted(column)), kind)))
