"""Dashboard filters folded into one predicate, and filters over report frames."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.dates import to_moment
from lumenframe.functions.numbers import is_numeric, number, quoted


def _as_number(v) -> float | None:
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def _comparable(df: DataFrame, name: str) -> Column:
    """A number to compare: numeric columns as they are, so that scans can use the filter."""
    dtype = df.schema[name].dataType
    return F.col(quoted(name)) if is_numeric(dtype) else number(df, name)


def _equals(df: DataFrame, name: str, value) -> Column:
    """Equality by number or moment where the column has that type, by text otherwise."""
    c, dtype = F.col(quoted(name)), df.schema[name].dataType
    if is_numeric(dtype) and _as_number(value) is not None:
        return _comparable(df, name) == F.lit(float(value))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c == to_moment(F.lit(str(value)), T.StringType()).cast(dtype)
    if isinstance(dtype, T.DateType):
        return to_moment(c, dtype) == to_moment(F.lit(str(value)), T.StringType())
    return c.cast("string") == F.lit(str(value))


def predicate(df: DataFrame, column: str, operator: str, value) -> Column | None:
    """One filter as a column, or None when it is to be skipped."""
    if column not in df.columns or value is None:
        return None
    c = F.col(quoted(column))
    if operator == "eq":
        return _equals(df, column, value)
    if operator == "neq":
        return ~F.coalesce(_equals(df, column, value), F.lit(False))
    if operator in ("gt", "gte", "lt", "lte"):
        x, v = _comparable(df, column), F.lit(float(value))
        hit = {"gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v}[operator]
        # NaN is missing, but sorts above every number.
        floating = isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType))
        return hit & ~F.isnan(c) if floating and operator in ("gt", "gte") else hit
    if operator == "contains":
        return c.cast("string").rlike("(?i)" + str(value))
    if operator == "in" and isinstance(value, (list, tuple)):
        return reduce(lambda a, b: a | b, [_equals(df, column, v) for v in value], F.lit(False))
    return None


def apply_filters(df: DataFrame, filters: list[dict]) -> DataFrame:
    """Rows that satisfy every ``{column, operator, value}``."""
    parts = [predicate(df, f.get("column"), f.get("operator", "eq"), f.get("value")) for f in filters]
    parts = [p for p in parts if p is not None]
    return df.where(reduce(and_, parts)) if parts else df


def filter_pairs(pairs: DataFrame, min_abs: float = 0.0, search: str = "", kind: str = "all") -> DataFrame:
    """Correlation pairs by strength, by name and by ``positive``/``negative``/``strong``."""
    keep = F.col("abs_value") >= min_abs
    if search:
        needle = search.lower()
        keep &= F.lower("feature_a").contains(needle) | F.lower("feature_b").contains(needle)
    if kind == "positive":
        keep &= F.col("direction") == "Positive"
    elif kind == "negative":
        keep &= F.col("direction") == "Negative"
    elif kind == "strong":
        keep &= F.col("strength").isin("Very Strong", "Strong")
    return pairs.where(keep)


def filter_distributions(report: DataFrame, column: str = "", search: str = "", kind: str = "") -> DataFrame:
    """Distribution rows by column, by name and by ``normal``/``skewed``/``outlier``."""
    keep = F.lit(True)
    if column:
        keep &= F.col("column") == column
    if search:
        keep &= F.lower("column").contains(search.lower())
    if kind == "normal":
        keep &= F.col("normal_tests") == F.col("total_tests")
    elif kind == "skewed":
        keep &= F.col("shape").contains("Skewed")
    elif kind == "outlier":
        keep &= F.col("outlier_count") > 0
    return report.where(keep)


def filter_insights(insights: DataFrame, search: str = "", priority: str = "all", category: str = "all") -> DataFrame:
    """Insights by text, priority and category."""
    keep = F.lit(True)
    if search:
        text = F.lower(F.concat_ws(" ", "title", "detail", "evidence", "action"))
        keep &= text.contains(search.lower())
    if priority != "all":
        keep &= F.col("priority") == priority
    if category != "all":
        keep &= F.col("category") == category
    return insights.where(keep)
