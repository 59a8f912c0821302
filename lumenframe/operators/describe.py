"""Profiles and descriptive statistics, one row per column."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.dates import iso_text, to_moment
from lumenframe.functions.numbers import (
    number,
    percent,
    quoted,
    ratio,
    safe_round,
    sample_kurtosis,
    sample_skewness,
)
from lumenframe.operators import catalog
from lumenframe.operators.frequency import (
    distinct_counts,
    duplicate_rows,
    numeric_frequencies,
    numeric_long,
    numeric_modes,
    top_values,
    value_frequencies,
)
from lumenframe.operators.quantiles import INLINE_ROWS, fences, quantile_frame
from lumenframe.plans.rules import pinned

#: Columns that one aggregate counts.
COLUMNS_PER_JOB = 300
PERCENTILES = [1, 5, 10, 25, 50, 75, 90, 95, 99]


def null_counts(df: DataFrame) -> DataFrame:
    """``column, null_count, non_null, null_pct`` from one aggregate over the table."""
    plain = catalog.missing_as_null(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(plain.columns)]
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            (F.col("rows") - F.col(f"c{i}")).alias("null_count"),
            F.col(f"c{i}").alias("non_null"),
            percent(F.col("rows") - F.col(f"c{i}"), F.col("rows")).alias("null_pct"),
        )
        for i, c in enumerate(plain.columns)
    ]
    return plain.agg(*aggs).select(F.inline(F.array(*cells)))


def missing_summary(df: DataFrame) -> DataFrame:
    """Columns that have missing values, most affected first."""
    return (
        null_counts(df)
        .where(F.col("null_count") > 0)
        .select("column", "null_count", "null_pct")
        .orderBy(F.col("null_count").desc(), "column")
    )


def moment_frame(
    long: DataFrame, key: str = "column", probs: list[float] | None = None, rows: int | None = None, approx: bool = False
) -> DataFrame:
    """Unrounded statistics per key of a long frame, with quantiles as an array ``q``.

    ``rows`` is a checked upper bound of rows per key. Within the inline limit the exact
    percentile rides in the same aggregate; beyond it the bracket search joins its result.
    """
    v = F.col("value")
    aggs = [
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.var_samp(v).alias("variance"),
        F.stddev_pop(v).alias("pop_std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.skewness(v).alias("g1"),
        F.kurtosis(v).alias("g2"),
        F.count_if(v == 0).alias("zeros"),
        F.count_if(v < 0).alias("negatives"),
    ]
    probs = probs or [0.25, 0.5, 0.75]
    inline = rows is not None and rows <= INLINE_ROWS and not approx
    if inline:
        aggs.append(F.percentile(v, F.array(*[F.lit(p) for p in probs])).alias("q"))
    out = long.groupBy(key).agg(*aggs)
    if not inline:
        out = out.join(F.broadcast(quantile_frame(long, probs, key, approx=approx)), key)
    return (
        out.withColumn("skewness", sample_skewness(F.col("g1"), F.col("count")))
        .withColumn("kurtosis", sample_kurtosis(F.col("g2"), F.col("count")))
    )


def numeric_summary(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """``moment_frame`` of numeric columns with ``q1, median, q3`` spelled out."""
    cols = cols or catalog.numeric_columns(df)
    rows = None if approx else df.count()
    out = moment_frame(numeric_long(df, cols, rows), rows=rows, approx=approx)
    q = F.col("q")
    return out.withColumns({"q1": q[0], "median": q[1], "q3": q[2]}).drop("q")


def date_ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column, min_date, max_date, range_days`` of date columns; dates as ISO text."""
    aggs, cells = [], []
    for i, c in enumerate(cols):
        t = to_moment(F.col(quoted(c)), df.schema[c].dataType)
        aggs += [F.min(t).alias(f"lo{i}"), F.max(t).alias(f"hi{i}")]
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        days = F.floor((F.unix_micros(hi) - F.unix_micros(lo)) / F.lit(86_400_000_000))
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                iso_text(lo).alias("min_date"),
                iso_text(hi).alias("max_date"),
                days.cast("bigint").alias("range_days"),
            )
        )
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, min_date string, max_date string, range_days bigint"
        )
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


class Facts:
    """Statistics of one table that several reports read, each computed once and pinned.

    Every frame has one row per column.
    """

    def __init__(self, df: DataFrame, kinds: dict[str, str] | None = None, approx: bool = False):
        self.df = catalog.missing_as_null(df)
        self._kinds = kinds
        self.approx = approx

    @cached_property
    def kinds(self) -> dict[str, str]:
        return self._kinds or catalog.column_kinds(self.df)

    @property
    def numeric(self) -> list[str]:
        return catalog.columns_of(self.df, "numeric", self.kinds)

    @cached_property
    def nulls(self) -> DataFrame:
        return pinned(null_counts(self.df))

    @cached_property
    def uniques(self) -> DataFrame:
        scalar = [c for c in self.df.columns if self.kinds[c] != "complex"]
        if not scalar:
            return self.df.sparkSession.createDataFrame([], "column string, unique_count bigint")
        return pinned(distinct_counts(self.df, scalar, self.approx))

    @cached_property
    def summary(self) -> DataFrame:
        return pinned(numeric_summary(self.df, self.numeric, self.approx))

    @cached_property
    def duplicates(self) -> int:
        return duplicate_rows(self.df)


class Profile:
    """A table's profile: totals, one row per column, and the top values of text columns.

    Each part is computed when first asked for, over shared statistics.
    """

    def __init__(self, df: DataFrame, approx: bool = False):
        self.facts = Facts(df, approx=approx)

    @property
    def kinds(self) -> dict[str, str]:
        return self.facts.kinds

    @cached_property
    def summary(self) -> DataFrame:
        return profile_summary(self.facts.df, self.facts)

    @cached_property
    def columns(self) -> DataFrame:
        return column_profile(self.facts.df, facts=self.facts)

    @cached_property
    def top_values(self) -> DataFrame:
        texts = catalog.columns_of(self.facts.df, "categorical", self.kinds)
        if not texts:
            schema = "column string, rank int, value string, count bigint"
            return self.facts.df.sparkSession.createDataFrame([], schema)
        return top_values(self.facts.df, texts)


def column_profile(
    df: DataFrame, kinds: dict[str, str] | None = None, approx: bool = False, facts: Facts | None = None
) -> DataFrame:
    """One row per column: kind, missing, distinct and type-specific statistics (4 decimals)."""
    facts = facts or Facts(df, kinds, approx)
    df, kinds, numeric = facts.df, facts.kinds, facts.numeric
    dates = catalog.columns_of(df, "datetime", kinds)
    out = catalog.kind_frame(df, kinds).join(F.broadcast(facts.nulls), "column", "left")
    out = out.join(F.broadcast(facts.uniques), "column", "left")
    if numeric:
        stats = facts.summary.select(
            "column", *[safe_round(F.col(c)).alias(c) for c in ("min", "max", "mean", "median", "std", "q1", "q3")]
        )
        out = out.join(F.broadcast(stats), "column", "left")
    else:
        out = out.withColumns(
            {c: F.lit(None).cast("double") for c in ("min", "max", "mean", "median", "std", "q1", "q3")}
        )
    out = out.join(F.broadcast(date_ranges(df, dates)), "column", "left")
    unique = F.when(F.col("kind") != "complex", F.coalesce(F.col("unique_count"), F.lit(0)))
    return out.withColumn("unique_count", unique).orderBy("position")


def profile_summary(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """``n_rows, n_cols, total_nulls, duplicate_rows``."""
    nulls = (facts.nulls if facts else null_counts(df)).agg(
        F.max(F.col("null_count") + F.col("non_null")).alias("n_rows"),
        F.count(F.lit(1)).alias("n_cols"),
        F.sum("null_count").alias("total_nulls"),
    )
    duplicates = facts.duplicates if facts else duplicate_rows(df)
    return nulls.withColumn("duplicate_rows", F.lit(duplicates).cast("bigint"))


def profile(df: DataFrame, approx: bool = False) -> Profile:
    """Profile of a table; ``approx`` uses sketches for distinct counts and quantiles."""
    return Profile(df, approx)


def _with_mode(df: DataFrame, cols: list[str] | None) -> DataFrame:
    cols = cols or catalog.numeric_columns(df)
    return numeric_summary(df, cols).join(F.broadcast(numeric_modes(numeric_frequencies(df, cols))), "column", "left")


def descriptive_stats(df: DataFrame, cols: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Sixteen statistics per column; ``cv`` is std / mean."""
    s = _with_mode(df, cols)
    values = {
        "mean": F.col("mean"),
        "median": F.col("median"),
        "std": F.col("std"),
        "variance": F.col("variance"),
        "min": F.col("min"),
        "max": F.col("max"),
        "range": F.col("max") - F.col("min"),
        "q1": F.col("q1"),
        "q3": F.col("q3"),
        "iqr": F.col("q3") - F.col("q1"),
        "skewness": F.col("skewness"),
        "kurtosis": F.col("kurtosis"),
        "cv": ratio(F.col("std"), F.col("mean")),
        "sem": F.col("std") / F.sqrt(F.col("count")),
        "mode": F.col("mode"),
    }
    return s.select("column", "count", *[safe_round(v, digits).alias(k) for k, v in values.items()])


def distribution_stats(df: DataFrame, cols: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Distribution-report statistics; ``cv`` is std / |mean| in percent."""
    s = _with_mode(df, cols)
    std = F.when(F.col("count") > 1, F.col("std")).otherwise(0.0)
    values = {
        "mean": F.col("mean"),
        "median": F.col("median"),
        "mode": F.col("mode"),
        "min": F.col("min"),
        "max": F.col("max"),
        "range": F.col("max") - F.col("min"),
        "variance": F.when(F.col("count") > 1, F.col("variance")).otherwise(0.0),
        "std": std,
        "std_error": std / F.sqrt(F.col("count")),
        "q1": F.col("q1"),
        "q2": F.col("median"),
        "q3": F.col("q3"),
        "iqr": F.col("q3") - F.col("q1"),
        "cv": ratio(std, F.abs(F.col("mean"))) * 100,
    }
    return s.select("column", "count", *[safe_round(v, digits).alias(k) for k, v in values.items()])


def report_stats(df: DataFrame, cols: list[str] | None = None, stats: DataFrame | None = None) -> DataFrame:
    """The thirteen statistics of the report table, for columns with at least two values.

    Here and below, ``stats`` is a ``numeric_summary`` already at hand.
    """
    s = (numeric_summary(df, cols) if stats is None else stats).where(F.col("count") >= 2)
    values = {
        "mean": F.col("mean"),
        "median": F.col("median"),
        "min": F.col("min"),
        "max": F.col("max"),
        "std": F.col("std"),
        "variance": F.col("variance"),
        "skewness": F.col("skewness"),
        "kurtosis": F.col("kurtosis"),
        "q1": F.col("q1"),
        "q2": F.col("median"),
        "q3": F.col("q3"),
        "iqr": F.col("q3") - F.col("q1"),
    }
    return s.select("column", "count", *[safe_round(v).alias(k) for k, v in values.items()])


def percentiles(df: DataFrame, cols: list[str] | None = None, digits: int = 6, approx: bool = False) -> DataFrame:
    """Percentiles 1 to 99 per column."""
    cols = cols or catalog.numeric_columns(df)
    rows = None if approx else df.count()
    q = quantile_frame(numeric_long(df, cols, rows), [p / 100 for p in PERCENTILES], approx=approx, rows=rows)
    return q.select("column", *[safe_round(F.col("q")[i], digits).alias(f"p{p}") for i, p in enumerate(PERCENTILES)])


def compare_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, median, std, min and max side by side for chosen columns."""
    return numeric_summary(df, cols).select(
        "column", *[safe_round(F.col(c)).alias(c) for c in ("mean", "median", "std", "min", "max")]
    )


def shape_label(skew, kurt):
    """Shape class from bias-corrected skewness and kurtosis (fixed thresholds)."""
    return (
        F.when((F.abs(skew) <= 0.5) & (F.abs(kurt) <= 1), "Symmetric")
        .when(skew > 1, "Highly Right Skewed")
        .when(skew > 0.5, "Right Skewed")
        .when(skew < -1, "Highly Left Skewed")
        .when(skew < -0.5, "Left Skewed")
        .when(kurt > 1, "Leptokurtic (Peaked)")
        .when(kurt < -1, "Platykurtic (Flat)")
        .otherwise("Approximately Symmetric")
    )


def shape_columns(stats: DataFrame) -> DataFrame:
    """Add ``shape`` to a stats frame, blanking the moments below eight values."""
    enough = F.col("count") >= 8
    return stats.withColumns(
        {
            "shape": F.when(enough, shape_label(F.col("skewness"), F.col("kurtosis"))).otherwise("Insufficient data"),
            "skewness": F.when(enough, F.col("skewness")),
            "kurtosis": F.when(enough, F.col("kurtosis")),
        }
    )


def shapes(df: DataFrame, cols: list[str] | None = None, stats: DataFrame | None = None) -> DataFrame:
    """``column, skewness, kurtosis, shape``."""
    return shape_columns(numeric_summary(df, cols) if stats is None else stats).select(
        "column", safe_round(F.col("skewness"), 6).alias("skewness"), safe_round(F.col("kurtosis"), 6).alias("kurtosis"), "shape"
    )


def outlier_counts(df: DataFrame, stats: DataFrame, cols: list[str], std: str = "std") -> DataFrame:
    """Join IQR and z-score outlier counts to a stats frame with ``q1, q3, mean`` and a spread.

    The stats frame has one row per column; its limits are literals of the second pass, one aggregate over the columns as they stand.
    """
    lower, upper = fences(F.col("q1"), F.col("q3"))
    limits = stats.select("column", lower.alias("lower_fence"), upper.alias("upper_fence"), F.col("mean").alias("m"), F.col(std).alias("s"))
    found = {r["column"]: r for r in limits.collect()}
    kept = [c for c in cols if c in found]
    schema = "column string, lower_fence double, upper_fence double, iqr_outliers bigint, zscore_outliers bigint"
    parts = [df.sparkSession.createDataFrame([], schema)]
    for start in range(0, len(kept), COLUMNS_PER_JOB):
        aggs, cells = [], []
        for i, c in enumerate(kept[start : start + COLUMNS_PER_JOB]):
            v, (lo, hi, m, s) = number(df, c), (F.lit(x).cast("double") for x in found[c][1:])
            z = F.abs((v - m) / F.nullif(s, F.lit(0.0)))
            aggs += [F.count_if((v < lo) | (v > hi)).alias(f"o{i}"), F.count_if(z > 3).alias(f"z{i}")]
            named = {"column": F.lit(c), "lower_fence": lo, "upper_fence": hi, "iqr_outliers": F.col(f"o{i}"), "zscore_outliers": F.col(f"z{i}")}
            cells.append(F.struct(*[x.alias(name) for name, x in named.items()]))
        parts.append(df.agg(*aggs).select(F.inline(F.array(*cells))))
    counts = reduce(DataFrame.unionByName, parts)
    return stats.join(F.broadcast(counts), "column")


def compact_numeric_stats(df: DataFrame, cols: list[str] | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Moments, quartiles, outliers, zeros and negatives per numeric column."""
    cols = cols or catalog.numeric_columns(df)
    s = outlier_counts(df, pinned(numeric_summary(df, cols)) if stats is None else stats, cols)
    shown = ("mean", "median", "std", "min", "max", "skewness", "kurtosis", "q1", "q3")
    return s.select(
        "column",
        *[safe_round(F.col(c)).alias(c) for c in shown],
        safe_round(F.col("q3") - F.col("q1")).alias("iqr"),
        F.col("iqr_outliers").alias("outlier_count"),
        percent(F.col("iqr_outliers"), F.col("count")).alias("outlier_pct"),
        "zeros",
        "negatives",
    )


def compact_text_stats(df: DataFrame, cols: list[str] | None = None, k: int = 5) -> DataFrame:
    """``column, unique_count, top_value, top_count, concentration, null_count, top_values``."""
    cols = cols or catalog.text_columns(df)
    freq = value_frequencies(df, cols).select("column", F.col("text").alias("value"), "n")
    top = F.min(F.struct(-F.col("n"), F.col("value")))
    heads = freq.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"), top.alias("t"))
    lists = top_values(df, cols, k).groupBy("column").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "value", "count"))),
                lambda r: F.concat_ws("=", r["value"], r["count"].cast("string")),
            ),
            ", ",
        ).alias("top_values")
    )
    base = null_counts(df.select([F.col(quoted(c)) for c in cols]))
    rows = F.col("null_count") + F.col("non_null")
    return (
        base.join(F.broadcast(heads), "column", "left")
        .join(F.broadcast(lists), "column", "left")
        .select(
            "column",
            F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
            F.col("t.value").alias("top_value"),
            (-F.col("t.col1")).alias("top_count"),
            percent(-F.col("t.col1"), rows).alias("concentration"),
            "null_count",
            "top_values",
        )
    )
