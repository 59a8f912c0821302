"""Value-frequency tables: one shuffle, pre-aggregated, shared by many statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.numbers import number, quoted


SMALL_ROWS = 4_000_000


def spread_small(df: DataFrame, rows: int | None) -> DataFrame:
    """Spread a small input over all cores; a large one comes in enough splits already.

    ``rows`` is its checked row count, or None to leave it as it is.
    """
    if rows is None or rows > SMALL_ROWS:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def numeric_long(df: DataFrame, cols: list[str], rows: int | None = None) -> DataFrame:
    """Non-missing numbers in long form: ``column, value``.

    Give the checked row count of a small table to spread the work that follows.
    """
    wide = spread_small(df.select([number(df, c).alias(c) for c in cols]), rows)
    return wide.unpivot([], [F.col(quoted(c)) for c in cols], "column", "value").where(
        F.col("value").isNotNull()
    )


def numeric_frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column, value, n`` for numbers. Copies of a hot value merge before the shuffle."""
    return numeric_long(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def value_frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column, whole, real, text, n`` for columns of any scalar type.

    Integers and moments keep their exact 64-bit value, fractions their double, anything
    else its text; exactly one of the three is set. Missing values are left out.
    """
    none = {"whole": F.lit(None).cast("long"), "real": F.lit(None).cast("double"), "text": F.lit(None).cast("string")}
    cells = []
    for name in cols:
        c, dtype = F.col(quoted(name)), df.schema[name].dataType
        cell = dict(none)
        if isinstance(dtype, T.IntegralType):
            cell["whole"] = c.cast("long")
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            cell["whole"] = F.unix_micros(c.cast("timestamp"))
        elif isinstance(dtype, T.DateType):
            cell["whole"] = F.unix_date(c).cast("long")
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            cell["real"] = number(df, name)
        elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
            cell["text"] = F.to_json(c)
        else:
            cell["text"] = c.cast("string")
        cells.append(F.struct(F.lit(name).alias("column"), *[v.alias(k) for k, v in cell.items()]))
    long = df.select(F.inline(F.array(*cells)))
    present = F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull()
    return long.where(present).groupBy("column", "whole", "real", "text").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """``column, unique_count`` over non-missing values.

    ``approx`` swaps the exact frequency shuffle for HyperLogLog sketches.
    """
    if approx:
        aggs = [F.approx_count_distinct(quoted(c)).alias(f"u{i}") for i, c in enumerate(cols)]
        cells = [
            F.struct(F.lit(c).alias("column"), F.col(f"u{i}").alias("unique_count")) for i, c in enumerate(cols)
        ]
        return df.agg(*aggs).select(F.inline(F.array(*cells)))
    return value_frequencies(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))


def top_values(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent values per column: ``column, rank, value, count``.

    Ties go to the smaller text. The per-column row limit runs before the shuffle
    (window group limit), so no task receives a column's whole value set.
    """
    freq = value_frequencies(df, cols)
    shown = F.coalesce(F.col("text"), F.col("whole").cast("string"), F.col("real").cast("string"))
    flat = freq.select("column", shown.alias("value"), F.col("n").alias("count"))
    rank = F.row_number().over(W.partitionBy("column").orderBy(F.col("count").desc(), F.col("value")))
    return flat.withColumn("rank", rank).where(F.col("rank") <= k).select("column", "rank", "value", "count")


def most_frequent(df: DataFrame, col: str, k: int) -> DataFrame:
    """Top ``k`` values of one column as ``value, count`` (ties to the smaller value)."""
    c = F.col(quoted(col))
    counts = df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), F.col("value")).limit(k)


def numeric_modes(freq: DataFrame, key: str = "column") -> DataFrame:
    """Most frequent number per key, the smallest on ties, from a frequency table."""
    best = F.min(F.struct(-F.col("n"), F.col("value")))
    return freq.groupBy(key).agg(best.alias("m")).select(key, F.col("m.value").alias("mode"))


def modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent value per column as driver scalars; the smallest wins ties."""
    best = F.min(F.struct(-F.col("n"), F.col("whole"), F.col("real"), F.col("text")))
    rows = value_frequencies(df, cols).groupBy("column").agg(best.alias("m")).collect()
    return {r["column"]: next((r["m"][k] for k in ("whole", "real", "text") if r["m"][k] is not None)) for r in rows}


def duplicate_rows(df: DataFrame) -> int:
    """Number of rows after the first copy of each; NULLs are equal."""
    return df.count() - distinct_rows(df).count()


def distinct_rows(df: DataFrame) -> DataFrame:
    """Distinct rows; maps are compared through their JSON text."""
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    if maps:
        df = df.withColumns({m: F.to_json(F.col(quoted(m))) for m in maps})
    return df.distinct()
