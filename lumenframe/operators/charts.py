"""Chart data: the aggregate behind each chart type, without drawing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.dates import to_moment
from lumenframe.functions.numbers import number, quoted, ratio, sample_skewness
from lumenframe.operators import catalog, distribution
from lumenframe.operators.correlation import complete_pearson
from lumenframe.operators.frequency import most_frequent, numeric_long
from lumenframe.operators.joins import keep_top
from lumenframe.operators.order import number_rows
from lumenframe.operators.quantiles import fit_quantiles, quantile_frame
from lumenframe.operators.select import data_table
from lumenframe.session import settle

#: Consecutive points of a series in one window partition.
BLOCK_ROWS = 1_000_000


@dataclass
class ChartSpec:
    """A chart request: its type and its ``x, y, color, size, agg, bins, ...`` settings."""

    chart_type: str
    config: dict = field(default_factory=dict)


def aggregate(name: str, v: Column) -> Column:
    """A pass-through aggregate by name. Medians go through :func:`median_by`."""
    plain = {
        "mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
        "std": F.stddev_samp, "nunique": F.count_distinct,
    }
    if name not in plain:
        raise ValueError(f"unknown aggregate {name!r}")
    return plain[name](v).cast("double")


def _complete(df: DataFrame, x: str, y: str, *more: str) -> DataFrame:
    cols = [F.col(quoted(x)).alias("x"), number(df, y).alias("y")]
    cols += [F.col(quoted(c)).alias(k) for k, c in zip(("color", "size"), more)]
    return df.select(cols).dropna()


def grouped(df: DataFrame, x: str, y: str, agg: str = "mean", k: int = 25) -> DataFrame:
    """``x, y``: an aggregate of y over the ``k`` most frequent x."""
    top = keep_top(_complete(df, x, y), "x", k)
    if agg == "median":
        q = quantile_frame(top.select("x", F.col("y").alias("value")), [0.5], "x")
        return q.select("x", F.col("q")[0].alias("y"))
    return top.groupBy("x").agg(aggregate(agg, F.col("y")).alias("y"))


def bar(df: DataFrame, x: str, y: str, agg: str = "mean", k: int = 25) -> DataFrame:
    """Top 25 categories, highest first."""
    return grouped(df, x, y, agg, k).orderBy(F.col("y").desc(), "x")


def horizontal_bar(df: DataFrame, x: str, y: str, agg: str = "mean") -> DataFrame:
    """Top 20 categories, lowest first."""
    return grouped(df, x, y, agg, 20).orderBy("y", "x")


def stacked_bar(df: DataFrame, x: str, y: str, color: str | None = None, agg: str = "mean") -> DataFrame:
    """Mean by x and color over the top 15 x."""
    if not color:
        return bar(df, x, y, agg)
    top = keep_top(_complete(df, x, y, color), "x", 15)
    return top.groupBy("x", "color").agg(F.avg("y").alias("y"))


def grouped_bar(df: DataFrame, x: str, y: str, color: str | None = None, agg: str = "mean") -> DataFrame:
    """Mean by x and color over the top 12 x and the top 8 colors."""
    if not color:
        return bar(df, x, y, agg)
    work = _complete(df, x, y, color)
    xs = most_frequent(work, "x", 12).select(F.col("value").alias("x"))
    colors = most_frequent(work, "color", 8).select(F.col("value").alias("color"))
    top = work.join(F.broadcast(xs), "x", "left_semi").join(F.broadcast(colors), "color", "left_semi")
    return top.groupBy("x", "color").agg(F.avg("y").alias("y"))


def series(df: DataFrame, x: str, y: str, color: str | None = None, kinds: dict | None = None) -> DataFrame:
    """``x, y[, color]`` of complete rows in x order; text x that reads as dates becomes dates."""
    kinds = kinds or catalog.column_kinds(df.select(F.col(quoted(x))))
    cx = F.col(quoted(x))
    if kinds[x] == "datetime":
        cx = to_moment(cx, df.schema[x].dataType)
    cols = [cx.alias("x"), number(df, y).alias("y")]
    if color:
        cols.append(F.col(quoted(color)).alias("color"))
    out = df.select(cols).dropna()
    return out.orderBy("x", "y", *(["color"] if color else []))


def downsample(points: DataFrame, buckets: int = 1000) -> DataFrame:
    """``bucket, x, y_min, y_max, y_mean, n`` of a long series, for drawing: x bucketed evenly."""
    x = F.col("x").cast("double")
    lo, hi = points.agg(F.min(x), F.max(x)).first()
    if lo is None:
        at = F.lit(0)
    else:
        at = F.least(F.floor((x - F.lit(lo)) / (((hi - lo) or 1.0) / buckets)), F.lit(buckets - 1))
    return points.groupBy(at.cast("int").alias("bucket")).agg(
        F.min("x").alias("x"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.avg("y").alias("y_mean"),
        F.count(F.lit(1)).alias("n"),
    )


def pie(df: DataFrame, x: str, k: int = 12) -> DataFrame:
    """``x, count, share``: the ``k`` most frequent values and their share of those shown."""
    top = most_frequent(df, x, k)
    shown = F.sum("count").over(W.partitionBy())
    return top.select(F.col("value").alias("x"), "count", ratio(F.col("count"), shown).alias("share"))


def scatter(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Rows where x and y are present; color may be missing."""
    cols = [F.col(quoted(x)).alias("x"), F.col(quoted(y)).alias("y")]
    cols += [F.col(quoted(color)).alias("color")] if color else []
    return df.select(cols).dropna(subset=["x", "y"])


def bubble(df: DataFrame, x: str, y: str, size: str | None = None, color: str | None = None) -> DataFrame:
    """Complete rows of x, y and the given size and color."""
    cols = [F.col(quoted(x)).alias("x"), number(df, y).alias("y")]
    cols += [number(df, size).alias("size")] if size else []
    cols += [F.col(quoted(color)).alias("color")] if color else []
    return df.select(cols).dropna()


def histogram(df: DataFrame, x: str, bins: int = 30) -> DataFrame:
    return distribution.histogram(numeric_long(df, [x]), bins).drop("column")


def _mirror(pairs: DataFrame, cols: list[str]) -> DataFrame:
    ends = F.array(
        F.struct(F.col("feature_a").alias("x"), F.col("feature_b").alias("y"), F.col("r")),
        F.struct(F.col("feature_b").alias("x"), F.col("feature_a").alias("y"), F.col("r")),
    )
    diagonal = pairs.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "x string, y string, r double")
    return pairs.select(F.inline(ends)).unionByName(diagonal)


def heatmap(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``x, y, r`` for all pairs of the first eight numeric columns, over pairwise complete rows."""
    columns = columns or catalog.numeric_columns(df)[:8]
    return _mirror(complete_pearson(df, columns), columns)


def correlation_heatmap(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``x, y, r`` strictly below the diagonal, for the first ten numeric columns."""
    columns = columns or catalog.numeric_columns(df)[:10]
    return complete_pearson(df, columns).select(F.col("feature_a").alias("x"), F.col("feature_b").alias("y"), "r")


def treemap(df: DataFrame, path: str, value: str | None = None) -> DataFrame:
    """``path, value``: the sum of a value, or the row count, per path value."""
    if value is None:
        p = F.col(quoted(path))
        return df.where(p.isNotNull()).groupBy(p.alias("path")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return _complete(df, path, value).groupBy(F.col("x").alias("path")).agg(F.sum("y").alias("value"))


def box(df: DataFrame, x: str, y: str) -> DataFrame:
    """Box summary per category over the top 15."""
    return distribution.box_summary(distribution.by_category(df, y, x), "category")


def violin(df: DataFrame, x: str, y: str, points: int = distribution.GRID) -> DataFrame:
    """Density per category over the top 15."""
    return distribution.kde(distribution.by_category(df, y, x), points, "category")


def density(df: DataFrame, x: str, points: int = distribution.GRID) -> DataFrame:
    return distribution.kde(numeric_long(df, [x]), points).drop("column")


def radar(df: DataFrame, x: str, values: list[str] | None = None, k: int = 10) -> DataFrame:
    """Means of up to six numeric columns for the first ``k`` categories by name."""
    values = values or catalog.numeric_columns(df)[:6]
    cx = F.col(quoted(x))
    means = df.where(cx.isNotNull()).groupBy(cx.alias("category")).agg(*[F.avg(number(df, v)).alias(v) for v in values])
    return means.orderBy("category").limit(k)


def waterfall(df: DataFrame, x: str, y: str, order_by: list[str], k: int = 20) -> DataFrame:
    """First ``k`` complete rows as relative steps with their running total."""
    work = df.select(
        *[F.col(quoted(c)).alias(f"o{i}") for i, c in enumerate(order_by)],
        F.col(quoted(x)).alias("x"),
        number(df, y).alias("y"),
    ).dropna(subset=["x", "y"])
    keys = [f"o{i}" for i in range(len(order_by))]
    first = work.orderBy(*keys).limit(k)
    step = W.partitionBy().orderBy(*keys)
    return first.select(
        F.row_number().over(step).alias("step"), "x", "y", F.sum("y").over(step.rowsBetween(W.unboundedPreceding, 0)).alias("total")
    )


def funnel(df: DataFrame, x: str, y: str) -> DataFrame:
    """``x, y, percent_of_first`` sorted by y, highest first."""
    work = _complete(df, x, y)
    top = work.agg(F.max("y")).first()[0]
    share = ratio(F.col("y"), F.lit(top).cast("double")) * 100
    return work.select("x", "y", share.alias("percent_of_first")).orderBy(F.col("y").desc(), "x")


def gauge(df: DataFrame, col: str | None = None, value: float | None = None, maximum: float = 100.0) -> DataFrame:
    """``value, max, band``: a mean against a scale cut at 50 and 80 percent."""
    if value is not None:
        base = df.sparkSession.createDataFrame([(float(value),)], "value double")
    elif col:
        base = df.agg(F.avg(number(df, col)).alias("value"))
    else:
        base = df.sparkSession.createDataFrame([(0.0,)], "value double")
    v = F.col("value")
    band = F.when(v < maximum * 0.5, "low").when(v < maximum * 0.8, "middle").otherwise("high")
    return base.select("value", F.lit(float(maximum)).alias("max"), band.alias("band"))


def kpi(df: DataFrame, col: str | None = None, agg: str = "mean") -> DataFrame:
    """``value``: one aggregate of a column, or the row count."""
    if col is None:
        return df.agg(F.count(F.lit(1)).cast("double").alias("value"))
    if agg == "median":
        q = fit_quantiles(df, [col], [0.5]).get(col, [None])[0]
        return df.sparkSession.createDataFrame([(q,)], "value double")
    return df.agg(aggregate(agg, number(df, col)).alias("value"))


def kpi_trend(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``column, mean, median, trend``: up or down when the mean leaves the median by a tenth."""
    s = distribution.center_lines(df, cols or catalog.numeric_columns(df))
    mean, median = F.col("mean"), F.col("median")
    trend = F.when(mean > median * 1.1, "up").when(mean < median * 0.9, "down").otherwise("flat")
    return s.withColumn("trend", trend)


def _numbered(df: DataFrame, x: str, y: str, tie: list[str], rows_per_bucket: int | None) -> DataFrame:
    """Complete points ``x, y`` with their position; ``tie`` columns order equal x."""
    cx = to_moment(F.col(quoted(x)), df.schema[x].dataType) if x in catalog.columns_of(
        df.select(F.col(quoted(x))), "datetime"
    ) else F.col(quoted(x))
    work = df.select(cx.alias("x"), number(df, y).alias("y"), *[F.col(quoted(c)).alias(f"t{i}") for i, c in enumerate(tie)])
    return number_rows(
        work.dropna(subset=["x", "y"]), ["x", *[f"t{i}" for i in range(len(tie))]], "i", rows_per_bucket=rows_per_bucket
    )


def time_series(
    df: DataFrame, x: str, y: str, tie: list[str] | None = None, rows_per_bucket: int | None = None
) -> DataFrame:
    """``i, x, y, trend``: the ordered series with its rolling mean of min(10, n//3 + 1) points.

    The rolling frame runs inside blocks of consecutive positions; each block also gets
    the few rows before it, so no window spans the table.
    """
    points = settle(_numbered(df, x, y, tie or [y], rows_per_bucket))
    n = points.count()
    w = min(10, n // 3 + 1)
    length = rows_per_bucket or BLOCK_ROWS
    block = F.floor((F.col("i") - 1) / length)
    ahead = F.floor((F.col("i") - 1 + w - 1) / length)
    spread = points.withColumn("home", block).withColumn("block", F.explode(F.sequence(block, ahead)))
    frame = W.partitionBy("block").orderBy("i").rowsBetween(-(w - 1), 0)
    rolled = spread.withColumn("mean", F.avg("y").over(frame)).where(F.col("block") == F.col("home"))
    trend = F.when((F.col("i") >= w) & F.lit(n > 2), F.col("mean"))
    return rolled.select("i", "x", "y", trend.alias("trend"))


def forecast(
    df: DataFrame, x: str, y: str, periods: int = 10, tie: list[str] | None = None, rows_per_bucket: int | None = None
) -> DataFrame:
    """``step, value``: the line through the last third's ends, continued for ``periods`` steps.

    Empty for fewer than four points.
    """
    full = forecast_chart(df, x, y, periods, tie, rows_per_bucket)
    return full.where("is_forecast").select("step", F.col("y").alias("value"))


def forecast_chart(
    df: DataFrame, x: str, y: str, periods: int = 10, tie: list[str] | None = None, rows_per_bucket: int | None = None
) -> DataFrame:
    """``i, x, y, is_forecast, step``: the ordered points, then the forecast.

    The forecast continues the line through the first and last point of the last third. Its ``x`` goes on in steps of the mean
    distance between points when ``x`` is a number or a time, and is NULL otherwise. Fewer than four points
    stay a plain line.
    """
    points = settle(_numbered(df, x, y, tie or [y], rows_per_bucket))
    kind = points.schema["x"].dataType
    timed = isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
    place = F.unix_micros(F.col("x").cast("timestamp")).cast("double") if timed else F.col("x").try_cast("double")
    n = points.count()
    actual = points.select("i", "x", "y", F.lit(False).alias("is_forecast"), F.lit(None).cast("int").alias("step"))
    if n < 4:
        return actual
    k = max(1, n // 3)
    ends = points.where(F.col("i").isin(1, n, n - k + 1)).select("i", "y", place.alias("place")).agg(
        *[F.max(F.when(F.col("i") == at, F.col(c))).alias(f"{c}{name}") for c in ("y", "place") for name, at in (("1", 1), ("a", n - k + 1), ("n", n))]
    )
    ahead = ends.select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"))
    onward = F.col("placen") + (F.col("placen") - F.col("place1")) / (n - 1) * F.col("step")
    if timed:
        onward = F.timestamp_micros(F.round(onward).cast("long"))
    added = ahead.select(
        (F.lit(n) + F.col("step")).cast("long").alias("i"),
        onward.cast(kind).alias("x"),
        (F.col("yn") + (F.col("yn") - F.col("ya")) / k * F.col("step")).alias("y"),
        F.lit(True).alias("is_forecast"),
        F.col("step").cast("int").alias("step"),
    )
    return actual.unionByName(added)


def outlier(df: DataFrame, x: str) -> DataFrame:
    """``value, is_outlier`` of every present value against the fences."""
    fitted = fit_quantiles(df, [x], [0.25, 0.75])
    v = numeric_long(df, [x]).select("value")
    if x not in fitted:
        return v.withColumn("is_outlier", F.lit(False))
    from lumenframe.operators.quantiles import fences

    lo, hi = fences(*fitted[x])
    return v.withColumn("is_outlier", ~F.col("value").between(lo, hi))


def chart_insight(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """``fact, number, label``: what the chart's columns show, with a confidence row."""
    x, y = spec.config.get("x"), spec.config.get("y")
    rows: list[Column] = []
    aggs: list[Column] = []
    findings = F.lit(0)

    def fact(name: str, value: Column, label: Column = None) -> Column:
        label = F.lit(None).cast("string") if label is None else label.cast("string")
        return F.struct(F.lit(name).alias("fact"), value.cast("double").alias("number"), label.alias("label"))

    medians = {}
    top = None
    if x in df.columns and x in catalog.numeric_columns(df):
        v = number(df, x)
        aggs += [F.avg(v).alias("x_mean"), F.stddev_samp(v).alias("x_std"), F.min(v).alias("x_min"), F.max(v).alias("x_max")]
        aggs.append(sample_skewness(F.skewness(v), F.count(v)).alias("x_skew"))
        skewed = F.abs("x_skew") > 1
        rows += [fact(k, F.col(k)) for k in ("x_mean", "x_std", "x_min", "x_max")]
        rows.append(F.when(skewed, fact("x_skew", F.col("x_skew"), F.lit("log transform"))))
        findings = findings + 1 + F.coalesce(skewed.cast("int"), F.lit(0))
    elif x in df.columns:
        top = most_frequent(df, x, 1).first()
        aggs += [F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col(quoted(x))).alias("x_unique")]
        if top is not None:
            dominant = F.lit(top["count"]) > F.col("n_rows") * 0.5
            rows += [
                fact("x_unique", F.col("x_unique")),
                fact("x_mode", F.lit(top["count"]), F.lit(str(top["value"]))),
                F.when(dominant, fact("x_dominant", F.lit(top["count"]) / F.col("n_rows"), F.lit("group rare values"))),
            ]
            findings = findings + 1
    if y in df.columns:
        medians = fit_quantiles(df, [y], [0.5])
        if medians:
            aggs.append(F.avg(number(df, y)).alias("y_mean"))
            rows += [fact("y_mean", F.col("y_mean")), fact("y_median", F.lit(medians[y][0]))]
            findings = findings + 1
    if spec.chart_type in ("scatter", "bubble") and x in df.columns and y in df.columns:
        a, b = number(df, x), number(df, y)
        both = a.isNotNull() & b.isNotNull()
        a, b = F.when(both, a), F.when(both, b)
        aggs.append(ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("xy_r"))
        r = F.col("xy_r")
        label = F.when(F.abs(r) > 0.7, "strong").when(F.abs(r) > 0.3, "moderate").otherwise("weak")
        rows.append(F.when(r.isNotNull(), fact("xy_r", r, label)))
        findings = findings + r.isNotNull().cast("int")
    rows.append(fact("confidence", F.least(F.lit(95), 70 + findings * 5)))
    base = df.agg(*aggs) if aggs else df.agg(F.count(F.lit(1)).alias("n_rows"))
    return base.select(F.inline(F.array_compact(F.array(*rows))))


def chart_data(df: DataFrame, spec: ChartSpec, order_by: list[str] | None = None) -> DataFrame:
    """Chart data by type name; an unknown type falls back to bars."""
    c = spec.config
    x, y, color = c.get("x"), c.get("y"), c.get("color")
    order_by = order_by or [df.columns[0]]
    builders = {
        "bar": lambda: bar(df, x, y, c.get("agg", "mean")),
        "stacked_bar": lambda: stacked_bar(df, x, y, color),
        "horizontal_bar": lambda: horizontal_bar(df, x, y, c.get("agg", "mean")),
        "grouped_bar": lambda: grouped_bar(df, x, y, color),
        "line": lambda: series(df, x, y, color),
        "area": lambda: series(df, x, y),
        "spline": lambda: series(df, x, y),
        "pie": lambda: pie(df, x),
        "donut": lambda: pie(df, x),
        "scatter": lambda: scatter(df, x, y, color),
        "bubble": lambda: bubble(df, x, y, c.get("size"), color),
        "histogram": lambda: histogram(df, x, c.get("bins", 30)),
        "distribution": lambda: histogram(df, x, c.get("bins", 30)),
        "heatmap": lambda: heatmap(df, c.get("columns")),
        "correlation_heatmap": lambda: correlation_heatmap(df, c.get("columns")),
        "treemap": lambda: treemap(df, c.get("path") or x, y or c.get("value")),
        "sunburst": lambda: treemap(df, c.get("path") or x, y or c.get("value")),
        "box": lambda: box(df, x, y),
        "violin": lambda: violin(df, x, y),
        "density": lambda: density(df, x),
        "radar": lambda: radar(df, x or c.get("categories"), c.get("values")),
        "waterfall": lambda: waterfall(df, x, y, order_by),
        "funnel": lambda: funnel(df, x, y),
        "gauge": lambda: gauge(df, y or x, c.get("value"), c.get("max", 100)),
        "kpi": lambda: kpi(df, y or x, c.get("agg", "mean")),
        "data_table": lambda: data_table(df, order_by, c.get("columns"), c.get("limit", 50)),
        "time_series": lambda: time_series(df, x, y),
        "forecast": lambda: forecast(df, x, y, c.get("periods", 10)),
        "outlier": lambda: outlier(df, x),
    }
    return builders.get(spec.chart_type, builders["bar"])()
