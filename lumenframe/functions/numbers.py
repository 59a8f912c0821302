"""Column helpers for coercion, rounding and bias-corrected moments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: text accepted as a number. Spark's own cast would also take '1d' and '5f'.
NUMBER_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|Inf|Infinity)\s*$"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def to_number(col: Column, dtype: T.DataType | None = None) -> Column:
    """Double value of a column, NULL where it is no number. NaN counts as missing."""
    if dtype is None or isinstance(dtype, T.StringType):
        text = col.cast("string")
        return F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.nanvl(col.cast("double"), F.lit(None).cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return col.cast("double")
    return F.lit(None).cast("double")


def number(df, name: str) -> Column:
    """``to_number`` for a named column of ``df``."""
    return to_number(F.col(quoted(name)), df.schema[name].dataType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def safe_round(col: Column, digits: int = 4) -> Column:
    """Round, with NaN and infinities reported as NULL."""
    finite = ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))
    return F.when(finite, F.round(col.cast("double"), digits))


def ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(num: Column, den: Column, digits: int = 2) -> Column:
    """Share in percent, 0 for an empty denominator."""
    return F.coalesce(F.round(ratio(num, den) * 100, digits), F.lit(0.0))


def sample_skewness(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population form."""
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population form."""
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def band(col: Column, *steps: tuple[float, str], otherwise: str, strict: bool = False) -> Column:
    """Label a value by descending thresholds: first step it reaches (or exceeds) wins."""
    expr = None
    for limit, label in steps:
        hit = (col > limit) if strict else (col >= limit)
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return expr.otherwise(otherwise)
