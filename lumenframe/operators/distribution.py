"""Distribution report, distribution chart data and transform previews."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import special
from lumenframe.functions.numbers import band, number, percent, quoted, safe_round, sample_kurtosis, sample_skewness
from lumenframe.operators import catalog
from lumenframe.operators.describe import (
    numeric_summary,
    outlier_counts,
    shape_columns,
)
from lumenframe.operators.frequency import (
    most_frequent,
    numeric_frequencies,
    numeric_long,
    numeric_modes,
)
from lumenframe.operators.hypothesis import normality_tests
from lumenframe.operators.order import rank_values
from lumenframe.operators.quantiles import fences, fit_quantiles, quantile_frame
from lumenframe.plans.rules import emit, fixed, pinned
from lumenframe.session import settle

GRID = 200
COPIES = 65_536


# --- chart data ---------------------------------------------------------------------------


def histogram(long: DataFrame, bins: int = 50, key: str = "column") -> DataFrame:
    """``key, bin, lower, upper, count`` with equal-width bins from minimum to maximum.

    The last bin is closed. Empty bins are listed. ``key`` has few values.
    """
    v = F.col("value")
    limits = long.groupBy(F.col(key).alias("_k")).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(
        F.least(F.floor((v - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    )
    counts = (
        long.join(F.broadcast(limits), F.col(key) == F.col("_k"))
        .groupBy("_k", at.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    frame = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(counts, ["_k", "bin"], "left").select(
        F.col("_k").alias(key),
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def center_lines(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column, mean, median``: the marker lines of histogram and density charts."""
    return numeric_summary(df, cols).select("column", "mean", "median")


#: Terms of the kernel's expansion in a box, half the width of a box in bandwidths, and bandwidths beyond which a kernel is nothing: the
#: error is below 1e-13 of a kernel's height.
TERMS, HALF_BOX, REACH = 14, 0.25, 9.5


def _expansion() -> list[list[float]]:
    """``c[j][k]``: exp(u * t - u * u / 2) is the sum of ``c[j][k] * t**j * u**k``, cut off after TERMS powers of u (Hermite polynomials)."""
    hermite = [[1.0], [0.0, 1.0]]
    for k in range(1, TERMS - 1):
        up, down = [0.0, *hermite[k]], [*hermite[k - 1], 0.0, 0.0]
        hermite.append([a - k * b for a, b in zip(up, down)])
    return [[hermite[k][j] / math.factorial(k) if j <= k else 0.0 for k in range(TERMS)] for j in range(TERMS)]


def kde(long: DataFrame, points: int = GRID, key: str = "column") -> DataFrame:
    """``key, point, x, density``: Gaussian kernel density on an even grid, Scott's bandwidth.

    A fast Gauss transform: values are put in boxes half a bandwidth wide, and a box is summed up by the powers of the distances from its
    centre. From these sums every grid point near the box gets the sum of all its kernels; so the work per row does not depend on
    the grid, and the rows shuffled are boxes. Needs two values and a spread.
    """
    v = F.col("value")
    fits = long.groupBy(key).agg(F.count(v).alias("n"), F.stddev_samp(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    params = [(r[key], float(r["n"] ** -0.2 * r["s"]), float(r["lo"]), float(r["hi"]), int(r["n"])) for r in fits.collect() if r["s"]]
    key_type = long.schema[key].dataType.simpleString()
    frame = long.sparkSession.createDataFrame(params, f"_k {key_type}, h double, lo double, hi double, n long")
    h, lo = F.col("h"), F.col("lo")
    box = F.floor((v - lo) / (2 * HALF_BOX * h))
    centre = lo + (F.col("box") + 0.5) * (2 * HALF_BOX * h)
    placed = long.select(key, "value").join(F.broadcast(frame), F.col(key) == F.col("_k")).withColumn("box", box)
    placed = placed.withColumn("u", (v - centre) / h)
    powers = [F.lit(1.0)]
    for _ in range(1, TERMS):
        powers.append(powers[-1] * F.col("u"))
    boxes = placed.groupBy("_k", "h", "lo", "hi", "box").agg(*[F.sum(p).alias(f"p{k}") for k, p in enumerate(powers)])
    gap = (F.col("hi") - lo) / (points - 1)
    first = F.greatest(F.ceil((centre - REACH * h - lo) / gap), F.lit(0))
    last = F.least(F.floor((centre + REACH * h - lo) / gap), F.lit(points - 1))
    boxes = boxes.withColumns({"first": first.cast("int"), "last": last.cast("int")}).where("first <= last")
    near = boxes.withColumn("point", F.explode(F.sequence("first", "last"))).withColumn("t", (lo + F.col("point") * gap - centre) / h)
    whole = F.lit(0.0)
    for row in reversed(_expansion()):  # by powers of t
        inner = sum((F.col(f"p{k}") * c for k, c in enumerate(row) if c), F.lit(0.0))
        whole = whole * F.col("t") + inner
    totals = near.groupBy(F.col("_k").alias("_key"), F.col("point").alias("_point")).agg(F.sum(F.exp(-F.col("t") * F.col("t") / 2) * whole).alias("total"))
    grid = frame.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    out = grid.join(totals, (F.col("_k") == F.col("_key")) & (F.col("point") == F.col("_point")), "left")
    density = F.coalesce("total", F.lit(0.0)) / (F.col("n") * h * math.sqrt(2 * math.pi))
    return out.select(F.col("_k").alias(key), "point", (lo + F.col("point") * gap).alias("x"), density.alias("density"))


def box_summary(long: DataFrame, key: str = "column") -> DataFrame:
    """``key, n, mean, q1, median, q3, whisker_low, whisker_high, outliers``. Few keys."""
    q = pinned(quantile_frame(long, [0.25, 0.5, 0.75], key)).select(
        F.col(key).alias("_k"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    lo, hi = fences(F.col("q1"), F.col("q3"))
    v = F.col("value")
    inside = v.between(lo, hi)
    return (
        long.join(F.broadcast(q), F.col(key) == F.col("_k"))
        .groupBy(key, "q1", "median", "q3")
        .agg(
            F.count(v).alias("n"),
            F.avg(v).alias("mean"),
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
        .select(key, "n", "mean", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")
    )


def outlier_points(df: DataFrame, col: str) -> DataFrame:
    """``value`` of every row outside the fences."""
    fitted = fit_quantiles(df, [col], [0.25, 0.75])
    x = df.select(number(df, col).alias("value"))
    if col not in fitted:
        return x.where(F.lit(False))
    lo, hi = fences(*fitted[col])
    return x.where((F.col("value") < lo) | (F.col("value") > hi))


def ecdf(df: DataFrame, col: str, rows_per_bucket: int | None = None) -> DataFrame:
    """``value, proportion``: share of rows at or below each distinct value."""
    ranked = rank_values(numeric_frequencies(df, [col]), "column", rows_per_bucket=rows_per_bucket)
    return ranked.select("value", ((F.col("before") + F.col("n")) / F.col("total")).alias("proportion"))


def quartile_markers(df: DataFrame, col: str) -> DataFrame:
    """``proportion, value`` at 0.25, 0.5 and 0.75."""
    q = quantile_frame(numeric_long(df, [col]), [0.25, 0.5, 0.75])
    rows = F.arrays_zip(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)).alias("proportion"), F.col("q").alias("value"))
    return q.select(F.inline(rows)).toDF("proportion", "value")


def qq_points(df: DataFrame, col: str, rows_per_bucket: int | None = None) -> DataFrame:
    """``i, theoretical, sample`` for every row, with Filliben's order-statistic medians.

    Copies of one value are written out in chunks that spread over tasks.
    """
    ranked = rank_values(numeric_frequencies(df, [col]), "column", rows_per_bucket=rows_per_bucket)
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / COPIES)))
    chunks = ranked.select("value", "before", "n", "total", chunk.alias("chunk"))
    chunks = chunks.repartition("value", "chunk")
    first = F.col("chunk") * COPIES + 1
    last = F.least(F.col("n"), first + (COPIES - 1))
    rows = chunks.select("value", "total", "before", F.explode(F.sequence(first, last)).alias("copy"))
    rows = rows.select("value", "total", (F.col("before") + F.col("copy")).alias("i"))
    n = F.col("total").cast("double")
    edge = F.pow(F.lit(0.5), 1 / n)
    median = (
        F.when(F.col("i") == F.col("total"), edge)
        .when(F.col("i") == 1, 1 - edge)
        .otherwise((F.col("i") - 0.3175) / (n + 0.365))
    )
    return rows.select("i", special.ppf_column(median).alias("theoretical"), F.col("value").alias("sample"))


def qq_line(points: DataFrame) -> DataFrame:
    """``slope, intercept, r`` of the reference line through QQ points."""
    r2 = F.regr_r2("sample", "theoretical")
    return points.agg(
        F.regr_slope("sample", "theoretical").alias("slope"),
        F.regr_intercept("sample", "theoretical").alias("intercept"),
        F.sqrt(r2).alias("r"),
    )


def frequency(df: DataFrame, col: str) -> DataFrame:
    """``value, count`` of every distinct number, in order."""
    return numeric_frequencies(df, [col]).select("value", F.col("n").alias("count")).orderBy("value")


def rug(df: DataFrame, col: str) -> DataFrame:
    """Every value of the column."""
    return numeric_long(df, [col]).select("value")


def by_category(df: DataFrame, value: str, category: str, k: int = 15) -> DataFrame:
    """``category, value`` long form for the ``k`` most frequent categories."""
    work = df.select(F.col(quoted(category)).cast("string").alias("category"), number(df, value).alias("value")).dropna()
    top = most_frequent(work, "category", k).select(F.col("value").alias("_top"))
    return work.join(F.broadcast(top), F.col("category") == F.col("_top"), "left_semi")


# --- transforms -----------------------------------------------------------------------------


def _search_lambda(score, lo: float = -6.0, hi: float = 6.0) -> float:
    """Maximise a likelihood over λ by narrowing grids; ``score`` maps λs to values in one job."""
    steps = 12
    for _ in range(8):
        grid = [lo + (hi - lo) * i / steps for i in range(steps + 1)]
        best = int(np.argmax(score(grid)))
        if 0 < best < steps:
            break
        width = hi - lo
        lo, hi = (lo - width, lo + width / steps) if best == 0 else (hi - width / steps, hi + width)
    for _ in range(5):
        values = score(grid)
        best = min(max(int(np.argmax(values)), 1), steps - 1)
        lo, hi = grid[best - 1], grid[best + 1]
        a, b, c = values[best - 1], values[best], values[best + 1]
        grid = [lo + (hi - lo) * i / steps for i in range(steps + 1)]
    bend = a - 2 * b + c
    mid = (lo + hi) / 2
    return mid + 0.5 * (a - c) / bend * (hi - lo) / 2 if bend < 0 else mid


def _box_cox(x: Column, lam) -> Column:
    lam = F.lit(lam) if isinstance(lam, float) else lam
    return F.when(F.abs(lam) < 1e-12, F.log(x)).otherwise((F.pow(x, lam) - 1) / lam)


def _yeo_johnson(x: Column, lam) -> Column:
    lam = F.lit(lam) if isinstance(lam, float) else lam
    up, down = F.greatest(x, F.lit(0.0)) + 1, F.greatest(-x, F.lit(0.0)) + 1
    high = F.when(F.abs(lam) < 1e-12, F.log(up)).otherwise((F.pow(up, lam) - 1) / lam)
    low = F.when(F.abs(lam - 2) < 1e-12, -F.log(down)).otherwise(-(F.pow(down, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, high).otherwise(low)


def _box_cox_batch(x: np.ndarray, lam: float) -> np.ndarray:
    return np.log(x) if abs(lam) < 1e-12 else (x**lam - 1) / lam


def _yeo_johnson_batch(x: np.ndarray, lam: float) -> np.ndarray:
    up, down = np.maximum(x, 0.0) + 1, np.maximum(-x, 0.0) + 1
    high = np.log(up) if abs(lam) < 1e-12 else (up**lam - 1) / lam
    low = -np.log(down) if abs(lam - 2) < 1e-12 else -(down ** (2 - lam) - 1) / (2 - lam)
    return np.where(x >= 0, high, low)


def _variances(counted: DataFrame, transform, grid: list[float], centre: float) -> list[float]:
    """Population variance of ``transform(x, λ)`` for every λ of a grid, in one pass over the distinct ``x, n``.

    A batch of values is transformed by every λ in place, and a task sends one row per λ. Sums are taken around the
    transform of ``centre``, so that large values do not cancel.
    """
    middle = [float(transform(np.array([centre]), g)[0]) for g in grid]

    def partial(batches):
        sums = np.zeros((len(grid), 3))
        for pdf in batches:
            x, n = pdf["x"].to_numpy(), pdf["n"].to_numpy(dtype=float)
            with np.errstate(all="ignore"):
                for i, g in enumerate(grid):
                    t = transform(x, g) - middle[i]
                    sums[i] += n.sum(), (n * t).sum(), (n * t * t).sum()
        yield pd.DataFrame({"i": range(len(grid)), "n": sums[:, 0], "s": sums[:, 1], "q": sums[:, 2]})

    parts = counted.mapInPandas(partial, "i int, n double, s double, q double").groupBy("i").agg(F.sum("n"), F.sum("s"), F.sum("q"))
    found = {i: q / n - (s / n) ** 2 if n else None for i, n, s, q in parts.collect()}
    return [found.get(i) for i in range(len(grid))]


def _distinct_counts(values: DataFrame) -> DataFrame:
    """``x, n``: the distinct ``value``s with their counts, written once for all passes."""
    return settle(values.where("value is not null").groupBy(F.col("value").alias("x")).agg(F.count(F.lit(1)).alias("n")))


def box_cox_lambda(values: DataFrame) -> float:
    """Maximum-likelihood λ of positive ``value``s, scaled by their geometric mean."""
    counted = _distinct_counts(values)
    row = counted.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.log("x")) / F.sum("n")).alias("m")).first()
    scaled = counted.select((F.col("x") / F.lit(math.exp(row["m"]))).alias("x"), "n")

    def score(grid):
        found = _variances(scaled, _box_cox_batch, grid, 1.0)
        return [-row["n"] / 2 * math.log(v) if v and v > 0 and math.isfinite(v) else -math.inf for v in found]

    return _search_lambda(score)


def yeo_johnson_lambda(values: DataFrame) -> float:
    """Maximum-likelihood λ of any ``value``s."""
    counted = _distinct_counts(values)
    x = F.col("x")
    row = counted.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.signum(x) * F.log1p(F.abs(x))).alias("j"), (F.sum(F.col("n") * x) / F.sum("n")).alias("m")
    ).first()

    def score(grid):
        return [
            -row["n"] / 2 * math.log(v) + (lam - 1) * row["j"] if v and v > 0 and math.isfinite(v) else -math.inf
            for v, lam in zip(_variances(counted, _yeo_johnson_batch, grid, row["m"]), grid)
        ]

    return _search_lambda(score)


def transformed(df: DataFrame, col: str, transform: str) -> tuple[DataFrame, str]:
    """``value, transformed`` for every present value, and the label of what was applied."""
    base = df.select(number(df, col).alias("value")).where("value is not null")
    x = F.col("value")
    lo, hi, mean, std = base.agg(F.min(x), F.max(x), F.avg(x), F.stddev_samp(x)).first()
    if lo is None:
        return base.withColumn("transformed", F.lit(None).cast("double")), transform
    shift = x - F.lit(lo) + 1
    if transform == "log":
        y, label = (F.log(shift), "log(x - min + 1)") if lo <= 0 else (F.log(x), "log(x)")
    elif transform == "sqrt":
        y, label = (F.sqrt(x - F.lit(lo)), "sqrt(x - min)") if lo < 0 else (F.sqrt(x), "sqrt(x)")
    elif transform == "boxcox":
        moved = base.select((shift if lo <= 0 else x).alias("value"))
        lam = box_cox_lambda(moved)
        y = _box_cox(shift if lo <= 0 else x, lam)
        label = "Box-Cox(x - min + 1)" if lo <= 0 else "Box-Cox(x)"
    elif transform == "yeojohnson":
        y, label = _yeo_johnson(x, yeo_johnson_lambda(base)), "Yeo-Johnson(x)"
    elif transform == "minmax":
        y, label = (x - F.lit(lo)) / (hi - lo) if hi > lo else F.lit(0.0), "Min-Max Scaling"
    elif transform == "standardize":
        y, label = (x - F.lit(mean)) / std if std else F.lit(0.0), "Standardization (Z-score)"
    elif transform == "robust":
        q1, q2, q3 = fit_quantiles(df, [col], [0.25, 0.5, 0.75])[col]
        y, label = (x - F.lit(q2)) / (q3 - q1) if q3 > q1 else F.lit(0.0), "Robust Scaling"
    else:
        raise ValueError(f"unknown transform {transform!r}")
    return base.withColumn("transformed", y.cast("double")), label


def transform_preview(df: DataFrame, col: str, transform: str) -> DataFrame:
    """``label, original_skew, transformed_skew, original_kurt, transformed_kurt``."""
    both, label = transformed(df, col, transform)
    n = F.count("value")

    def moments(c: str):
        return sample_skewness(F.skewness(c), n), sample_kurtosis(F.kurtosis(c), n)

    (s0, k0), (s1, k1) = moments("value"), moments("transformed")
    return both.agg(
        safe_round(s0, 6).alias("original_skew"),
        safe_round(s1, 6).alias("transformed_skew"),
        safe_round(k0, 6).alias("original_kurt"),
        safe_round(k1, 6).alias("transformed_kurt"),
    ).select(F.lit(label).alias("label"), "*")


def transform_histograms(df: DataFrame, col: str, transform: str, bins: int = 40) -> DataFrame:
    """Histograms of a column before and after a transform."""
    both, _ = transformed(df, col, transform)
    long = both.unpivot([], ["value", "transformed"], "column", "v").withColumnRenamed("v", "value")
    return histogram(long.where("value is not null"), bins)


# --- report -----------------------------------------------------------------------------------


def distribution_quality(skew: Column, kurt: Column, outlier_pct: Column, normal: Column, tests: Column, cv: Column) -> Column:
    """Score from 100 with deductions for skew, tails, outliers, normality and spread."""

    def deduct(value: Column, *steps: tuple[float, float]) -> Column:
        expr = None
        for limit, points in steps:
            expr = F.when(value > limit, points) if expr is None else expr.when(value > limit, points)
        return expr.otherwise(0.0)

    score = (
        F.lit(100.0)
        - deduct(F.abs(skew), (2, 25.0), (1, 15.0), (0.5, 5.0))
        - deduct(F.abs(kurt), (3, 20.0), (2, 10.0), (1, 5.0))
        - deduct(outlier_pct, (10, 20.0), (5, 10.0), (2, 5.0))
        - F.when(normal == 0, 15.0).when(normal < tests / 2, 5.0).otherwise(0.0)
        - deduct(cv, (100, 10.0), (50, 5.0))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(score, 1)))


def quality_label(score: Column) -> Column:
    return band(score, (90, "Excellent"), (75, "Good"), (50, "Average"), otherwise="Poor")


def column_report(df: DataFrame, cols: list[str] | None = None, stats: DataFrame | None = None) -> DataFrame:
    """One row per numeric column with at least three values: statistics, shape, normality
    votes, outliers and quality score."""
    cols = cols or catalog.numeric_columns(df)
    stats = pinned((numeric_summary(df, cols) if stats is None else stats).where(F.col("count") >= 3))
    base = shape_columns(outlier_counts(df, stats, cols))
    votes = normality_tests(df, cols).groupBy("column").agg(
        F.count_if("is_normal").alias("normal_tests"), F.count(F.lit(1)).alias("total_tests")
    )
    mode = numeric_modes(numeric_frequencies(df, cols))
    pct = F.when(F.col("count") >= 4, percent(F.col("iqr_outliers"), F.col("count"))).otherwise(0.0)
    outliers = F.when(F.col("count") >= 4, F.col("iqr_outliers")).otherwise(0)
    cv = F.try_divide(F.col("std"), F.abs(F.col("mean"))) * 100
    base = base.join(F.broadcast(votes), "column", "left").join(F.broadcast(mode), "column", "left")
    base = base.fillna(0, ["normal_tests", "total_tests"]).withColumns({"outlier_pct": pct, "cv": cv})
    score = distribution_quality(
        F.col("skewness"), F.col("kurtosis"), F.col("outlier_pct"), F.col("normal_tests"), F.col("total_tests"), F.col("cv")
    )
    shown = ["mean", "median", "mode", "std", "min", "max", "q1", "q3", "cv", "skewness", "kurtosis"]
    return base.withColumn("quality_score", score).select(
        "column",
        "count",
        *[safe_round(F.col(c), 6).alias(c) for c in shown],
        "shape",
        outliers.alias("outlier_count"),
        "outlier_pct",
        *[safe_round(F.when(F.col("count") >= 4, F.col(c)), 6).alias(c) for c in ("lower_fence", "upper_fence")],
        "normal_tests",
        "total_tests",
        "quality_score",
        quality_label(F.col("quality_score")).alias("quality_status"),
    )


def report_summary(report: DataFrame) -> DataFrame:
    """Totals over the column report and the average quality."""
    avg = F.round(F.coalesce(F.avg("quality_score"), F.lit(0.0)), 1)
    all_normal = (F.col("total_tests") > 0) & (F.col("normal_tests") == F.col("total_tests"))
    return report.agg(
        F.count(F.lit(1)).alias("total_numeric"),
        F.count_if(all_normal).alias("normal_columns"),
        F.count_if(F.col("shape").contains("Skewed")).alias("skewed_columns"),
        F.count_if(F.col("shape").isin("Symmetric", "Approximately Symmetric")).alias("symmetric_columns"),
        F.count_if(F.col("outlier_count") > 0).alias("columns_with_outliers"),
        avg.alias("avg_quality_score"),
    ).withColumn("avg_quality_status", quality_label(F.col("avg_quality_score")))


def insights(report: DataFrame, p1_p99: DataFrame) -> DataFrame:
    """Seven sentence rules per column: ``column, rule, insight``."""
    c = F.col
    f = report.join(F.broadcast(p1_p99.select("column", "p1", "p99")), "column", "left")
    skewed = c("shape").contains("Skewed")
    gap = F.when(c("median") != 0, F.abs(c("mean") - c("median")) / F.abs(c("median")) * 100).otherwise(0.0)

    def say(*parts) -> dict:
        return {"insight": F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])}

    skew, kurt = fixed(c("skewness"), 3), fixed(c("kurtosis"), 3)
    share = c("outlier_pct").cast("string")
    rules = [
        (skewed, say(c("shape"), ": skewness ", skew, ", try a ", F.when(c("skewness") > 0, "log").otherwise("square root"), " transform.")),
        (c("shape").isin("Symmetric", "Approximately Symmetric"), say("Near symmetric (skewness ", skew, "), fit for parametric tests.")),
        (c("kurtosis") > 3, say("Heavy tails, kurtosis ", kurt, ".")),
        (c("kurtosis") < -3, say("Light tails, kurtosis ", kurt, ".")),
        (c("outlier_pct") > 5, say(c("outlier_count").cast("string"), " outliers (", share, "%) outside [", fixed(c("lower_fence"), 3), ", ", fixed(c("upper_fence"), 3), "].")),
        ((c("outlier_pct") > 0) & (c("outlier_pct") <= 5), say(c("outlier_count").cast("string"), " mild outliers (", share, "%).")),
        ((c("total_tests") > 0) & (c("normal_tests") == c("total_tests")), say("All normality tests pass.")),
        ((c("total_tests") > 0) & (c("normal_tests") == 0), say("All ", c("total_tests").cast("string"), " normality tests reject.")),
        (c("cv") > 100, say("Very variable, CV ", fixed(c("cv"), 1), "%.")),
        (c("cv") < 10, say("Stable, CV ", fixed(c("cv"), 1), "%.")),
        ((c("count") > 10) & (gap > 10), say("Mean ", fixed(c("mean"), 3), " and median ", fixed(c("median"), 3), " differ by ", fixed(gap, 1), "%.")),
        (c("p1").isNotNull() & c("p99").isNotNull(), say("Percentiles 1 to 99 span ", fixed(c("p1"), 3), " to ", fixed(c("p99"), 3), ".")),
    ]
    return emit(f, rules, ["column"])


def recommendations(report: DataFrame) -> DataFrame:
    """Per-column advice: ``column, rule, priority, category, title, description, action``."""
    c = F.col
    some_normal = c("normal_tests") > 0
    skew = fixed(c("skewness"), 3)

    def advise(priority, category, title, description, action) -> dict:
        return {"priority": priority, "category": category, "title": title, "description": description, "action": action}

    def skewed() -> Column:
        return F.concat(F.lit("Skewness is "), skew)

    amount = F.concat(c("outlier_count").cast("string"), F.lit(" outliers ("), c("outlier_pct").cast("string"), F.lit("%)"))
    scaling = F.concat(F.lit("std = "), fixed(c("std"), 4), F.lit(", mean = "), fixed(c("mean"), 4))
    rules = [
        (c("skewness") > 1, advise("high", "transformation", "Apply Log Transformation", skewed(), "log_transform")),
        ((c("skewness") > 0.5) & (c("skewness") <= 1), advise("medium", "transformation", "Apply Square Root Transformation", skewed(), "sqrt_transform")),
        (c("skewness") < -1, advise("high", "transformation", "Apply Box-Cox or Yeo-Johnson Transformation", skewed(), "boxcox_transform")),
        ((c("total_tests") > 0) & (c("normal_tests") == 0), advise("medium", "normalization", "Normalize Distribution", "No normality test passes", "normalize")),
        (c("outlier_pct") > 5, advise("high", "outliers", "Remove or Cap Outliers", amount, "remove_outliers")),
        ((c("outlier_pct") > 2) & (c("outlier_pct") <= 5), advise("low", "outliers", "Monitor Outliers", amount, "monitor_outliers")),
        (
            c("std").isNotNull() & (c("mean") != 0),
            advise(
                "low", "scaling",
                F.when(some_normal, "Standard Scaling Recommended").otherwise("Robust Scaling Recommended"),
                scaling,
                F.when(some_normal, "standard_scale").otherwise("robust_scale"),
            ),
        ),
        ((c("total_tests") > 0) & (c("normal_tests") == c("total_tests")), advise("low", "no_action", "No Action Needed", "All normality tests pass", "no_action")),
    ]
    return emit(report, rules, ["column"]).dropDuplicates(["title", "column"])


def export_rows(report: DataFrame) -> DataFrame:
    """The fourteen export fields, one flat row per column."""
    return report.select(
        "column", "count", "mean", "median", "std", "min", "max", "skewness", "kurtosis", "shape",
        "outlier_count", "outlier_pct", "quality_score", "quality_status",
    )
