"""Question templates that run: each suggested question is a query over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.dates import to_moment
from lumenframe.functions.numbers import number, quoted
from lumenframe.operators import catalog, charts
from lumenframe.operators.correlation import complete_pearson
from lumenframe.operators.frequency import most_frequent

SHOWN = 8


def suggest(df: DataFrame, kinds: dict[str, str] | None = None, limit: int | None = SHOWN) -> DataFrame:
    """``position, template, x, y``: the questions that fit the table, the first eight."""
    kinds = kinds or catalog.column_kinds(df)
    num, cat, date = (catalog.columns_of(df, k, kinds) for k in ("numeric", "categorical", "datetime"))
    found = []
    if num:
        found += [("average", num[0], None), ("distribution", num[0], None), ("top_values", num[0], None)]
    if cat:
        found += [("unique_values", cat[0], None), ("records_per", cat[0], None), ("top_by_count", cat[0], None)]
    if date and num:
        found += [("over_time", date[0], num[0]), ("monthly_trend", date[0], num[0])]
    if len(num) >= 2:
        found.append(("correlation", num[0], num[1]))
    if cat and num:
        found.append(("average_by", cat[0], num[0]))
    rows = [(i + 1, *f) for i, f in enumerate(found[:limit])]
    return df.sparkSession.createDataFrame(rows, "position int, template string, x string, y string")


def answer(df: DataFrame, template: str, x: str, y: str | None = None) -> DataFrame:
    """Result of one question template."""
    cx = F.col(quoted(x))
    if template == "average":
        return df.agg(F.avg(number(df, x)).alias("average"))
    if template == "distribution":
        return charts.histogram(df, x)
    if template == "top_values":
        return df.select(number(df, x).alias("value")).orderBy(F.col("value").desc_nulls_last()).limit(10)
    if template == "unique_values":
        return df.select(cx.alias("value")).dropna().distinct()
    if template == "records_per":
        return df.where(cx.isNotNull()).groupBy(cx.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    if template == "top_by_count":
        return most_frequent(df, x, 5)
    if template == "correlation":
        return complete_pearson(df, [x, y])
    if template == "average_by":
        return df.where(cx.isNotNull()).groupBy(cx.alias("value")).agg(F.avg(number(df, y)).alias("average"))
    if template in ("over_time", "monthly_trend"):
        unit = "day" if template == "over_time" else "month"
        when = F.date_trunc(unit, to_moment(cx, df.schema[x].dataType))
        work = df.select(F.date_format(when, "yyyy-MM-dd").alias("period"), number(df, y).alias("value")).dropna()
        return work.groupBy("period").agg(F.avg("value").alias("average"), F.count(F.lit(1)).alias("n"))
    raise ValueError(f"unknown template {template!r}")
