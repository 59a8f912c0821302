"""Previews, projections and ordered heads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.dates import iso_text
from lumenframe.functions.numbers import number, quoted


def _rendered(df: DataFrame) -> DataFrame:
    """Values as the preview shows them: six decimals, ISO moments."""
    out = []
    for f in df.schema.fields:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(number(df, f.name), 6)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = iso_text(c)
        out.append(c.alias(f.name))
    return df.select(out)


def head(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """First ``n`` rows of a stated order; each task keeps only its own first ``n``."""
    return df.orderBy(*[F.col(quoted(c)) for c in order_by]).limit(n)


def preview(df: DataFrame, order_by: list[str], n: int = 20) -> DataFrame:
    return _rendered(head(df, order_by, n))


def preview_counts(df: DataFrame, n: int = 20) -> DataFrame:
    """``shown, total`` for a preview of ``n`` rows."""
    total = F.count(F.lit(1))
    return df.agg(F.least(total, F.lit(n).cast("bigint")).alias("shown"), total.alias("total"))


def data_table(df: DataFrame, order_by: list[str], columns: list[str] | None = None, limit: int = 50) -> DataFrame:
    """Chosen columns (the first ten by default) of the first rows."""
    columns = columns or df.columns[:10]
    return head(df, order_by, limit).select([F.col(quoted(c)) for c in columns])


def sorted_rows(df: DataFrame, col: str, descending: bool = False) -> DataFrame:
    """Whole table sorted by a column, missing values last either way."""
    c = F.col(quoted(col))
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())
