"""Normality, location, independence and correlation tests.

Statistics are Spark aggregates (or sums over the ranked frequency table); p-values are
computed on the few aggregated rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import special
from lumenframe.functions.special import normal_cdf, normal_ppf
from lumenframe.functions.numbers import band, number, quoted, ratio, safe_round
from lumenframe.operators import catalog
from lumenframe.operators.correlation import average_ranks
from lumenframe.operators.frequency import numeric_frequencies, numeric_long
from lumenframe.operators.order import rank_values
from lumenframe.operators.quantiles import quantile_frame
from lumenframe.plans.rules import pinned
from lumenframe.session import settle

#: The p-value of Shapiro-Wilk was fitted for up to so many values.
ROYSTON_LIMIT = 5000
#: Positions of one value whose normal scores are added in one row.
RUN = 65_536

# Normal-case Anderson-Darling points at 15, 10, 5, 2.5 and 1 percent (Stephens).
ANDERSON_POINTS = {"15": 0.576, "10": 0.656, "5": 0.787, "2.5": 0.918, "1": 1.092}

# Royston's polynomials for the Shapiro-Wilk weights and p-value,
# lowest power first.
ROYSTON = {
    "last_weight": [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056],
    "next_weight": [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633],
    "small_shift": [-2.273, 0.459],
    "small_mean": [0.544, -0.39978, 0.025054, -6.714e-4],
    "small_log_sd": [1.3822, -0.77857, 0.062767, -0.0020322],
    "large_mean": [-1.5861, -0.31082, -0.083751, 0.0038915],
    "large_log_sd": [-0.4803, -0.082676, 0.0030302],
}


def _poly(name: str, x: float) -> float:
    return sum(c * x**i for i, c in enumerate(ROYSTON[name]))


def _normal_scores(at: np.ndarray, n) -> np.ndarray:
    """Expected order statistics of n normal values at the positions ``at`` (from 1)."""
    return normal_ppf((at - 0.375) / (n + 0.25))


def _w_and_p(n: int, spread: float, norm: float, scored: float, ends: list[float]) -> tuple[float, float]:
    """W and its p-value (Royston 1995) from sums over the ordered values.

    ``spread``: squared deviations. ``norm``: squared normal scores. ``scored``: scores times deviations. ``ends``:
    deviations of the first, second, last but one and last value.
    """
    if spread == 0:
        return 1.0, 1.0
    low, low2, high2, high = ends
    top, second = (float(x) for x in _normal_scores(np.array([n, n - 1.0]), n))
    if n == 3:
        w = min(1.0, (math.sqrt(0.5) * (high - low)) ** 2 / spread)
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, min(1.0, max(0.0, p))
    u = 1 / math.sqrt(n)
    last = top / math.sqrt(norm) + _poly("last_weight", u)
    inner = scored - top * (high - low)
    if n > 5:
        nxt = second / math.sqrt(norm) + _poly("next_weight", u)
        phi = (norm - 2 * top**2 - 2 * second**2) / (1 - 2 * last**2 - 2 * nxt**2)
        total = (inner - second * (high2 - low2)) / math.sqrt(phi) + nxt * (high2 - low2) + last * (high - low)
    else:
        phi = (norm - 2 * top**2) / (1 - 2 * last**2)
        total = inner / math.sqrt(phi) + last * (high - low)
    w = min(1.0, total**2 / spread)
    if w >= 1.0:
        return w, 1.0
    y = math.log(1 - w)
    if n <= 11:
        gamma = _poly("small_shift", n)
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mean, sd = _poly("small_mean", n), math.exp(_poly("small_log_sd", n))
    else:
        mean, sd = _poly("large_mean", math.log(n)), math.exp(_poly("large_log_sd", math.log(n)))
    return w, float(normal_cdf(-(y - mean) / sd))


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and its p-value for three or more values in memory."""
    x = np.sort(np.asarray(values, dtype=float))
    n, d = len(x), x - x.mean()
    m = _normal_scores(np.arange(1.0, n + 1), n)
    return _w_and_p(n, float(d @ d), float(m @ m), float(m @ d), [d[0], d[1], d[-2], d[-1]])


def shapiro(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``column, statistic, p_value, sample_size, p_extrapolated`` over all values; NULLs below three values.

    Sums run over the ranked table of distinct values: a value's copies fill a run of positions, whose normal scores are
    added up. A run of many copies is cut, so that a value of a third of the rows is spread over tasks. The p-value's
    fit was published for up to 5000 values; beyond, ``p_extrapolated`` says that it continues that fit.
    """
    cols = cols or catalog.numeric_columns(df)
    ranked = settle(rank_values(numeric_frequencies(df, cols), "column").select("column", "value", "n", "before", "total"))
    means = ranked.groupBy("column").agg((F.sum(F.col("value") * F.col("n")) / F.max("total")).alias("mean"))
    centred = ranked.join(F.broadcast(means), "column").withColumn("d", F.col("value") - F.col("mean"))

    def at(position: Column, name: str) -> Column:
        here = (F.col("before") < position) & (position <= F.col("before") + F.col("n"))
        return F.max(F.when(here, F.col("d"))).alias(name)

    last = F.col("total")
    fit = centred.groupBy("column").agg(
        F.max("total").alias("total"), F.sum(F.col("n") * F.col("d") * F.col("d")).alias("spread"),
        at(F.lit(1), "e1"), at(F.lit(2), "e2"), at(last - 1, "e3"), at(last, "e4"),
    )

    def add(batches):
        for pdf in batches:
            out = []
            lo, hi = pdf["lo"].to_numpy(), pdf["hi"].to_numpy()
            until = np.cumsum(hi - lo)
            start = 0
            while start < len(pdf):
                done = until[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(until, done + RUN)))
                part = slice(start, stop)
                sizes = (hi - lo)[part]
                first = np.cumsum(sizes) - sizes
                positions = np.arange(sizes.sum()) - np.repeat(first, sizes) + np.repeat(lo[part], sizes) + 1.0
                m = _normal_scores(positions, np.repeat(pdf["total"].to_numpy()[part], sizes))
                run = pd.DataFrame({"column": pdf["column"].to_numpy()[part], "scored": np.add.reduceat(m, first) * pdf["d"].to_numpy()[part],
                                    "norm": np.add.reduceat(m * m, first)})
                out.append(run.groupby("column", as_index=False).sum())
                start = stop
            if out:
                yield pd.concat(out)

    wide = F.col("n") > RUN
    runs = centred.where(~wide).select("column", "d", "total", F.col("before").alias("lo"), (F.col("before") + F.col("n")).alias("hi"))
    cuts = centred.where(wide).select(
        "column", "d", "total", (F.col("before") + F.col("n")).alias("end"),
        F.explode(F.sequence("before", F.col("before") + F.col("n") - 1, F.lit(RUN).cast("long"))).alias("lo"),
    )
    cuts = cuts.repartition("column", "lo").select("column", "d", "total", "lo", F.least(F.col("lo") + RUN, "end").alias("hi"))
    sums = runs.unionByName(cuts).mapInPandas(add, "column string, scored double, norm double")
    sums = sums.groupBy("column").agg(F.sum("scored").alias("scored"), F.sum("norm").alias("norm"))

    def test(batches):
        for pdf in batches:  # one row per column
            found = [
                _w_and_p(int(r.total), r.spread, r.norm, r.scored, [r.e1, r.e2, r.e3, r.e4]) if r.total >= 3 else (None, None)
                for r in pdf.itertuples()
            ]
            yield pd.DataFrame({
                "column": pdf["column"], "statistic": [w for w, _ in found], "p_value": [p for _, p in found],
                "sample_size": pdf["total"].astype("int64"), "p_extrapolated": pdf["total"] > ROYSTON_LIMIT,
            })

    return fit.join(sums, "column").mapInPandas(
        test, "column string, statistic double, p_value double, sample_size long, p_extrapolated boolean"
    )


def _distance_tests(df: DataFrame, cols: list[str], rows_per_bucket: int | None = None) -> DataFrame:
    """``column, n, ks, ad``: both empirical-distribution statistics from the ranked table."""
    freq = numeric_frequencies(df, cols)
    fit = numeric_long(df, cols).groupBy("column").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    ranked = rank_values(freq, "column", rows_per_bucket=rows_per_bucket).join(F.broadcast(fit), "column")
    z = (F.col("value") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))
    scored = ranked.withColumn("phi", special.log_cdf_columns(z))
    total = F.col("total").cast("double")
    low, high = F.col("before").cast("double"), (F.col("before") + F.col("n")).cast("double")
    gap = F.greatest(high / total - F.col("phi.cdf"), F.col("phi.cdf") - low / total)
    odd = high * high - low * low
    term = odd * F.col("phi.lower") + (2 * total * F.col("n") - odd) * F.col("phi.upper")
    sums = scored.groupBy("column").agg(F.max("total").alias("n"), F.max(gap).alias("ks"), F.sum(term).alias("t"))
    return sums.select("column", "n", "ks", (-F.col("n") - F.col("t") / F.col("n")).alias("ad"))


def anderson_points(n: Column) -> dict[str, Column]:
    """Critical values by significance level in percent, for a sample of size n."""
    n = n.cast("double")
    return {k: F.round(F.lit(v) / (1 + 4 / n - 25 / (n * n)), 3) for k, v in ANDERSON_POINTS.items()}


def kolmogorov_smirnov(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Against the normal fitted to the column; needs five values."""
    d = _distance_tests(df, cols or catalog.numeric_columns(df)).where(F.col("n") >= 5)
    p = special.p_kolmogorov(F.col("ks"), F.col("n").cast("double"))
    return d.select("column", F.col("ks").alias("statistic"), p.alias("p_value"), F.col("n").alias("sample_size"))


def anderson_darling(df: DataFrame, cols: list[str] | None = None, min_n: int = 8) -> DataFrame:
    """Statistic with its five critical values; normal when below the 5 percent one."""
    d = _distance_tests(df, cols or catalog.numeric_columns(df)).where(F.col("n") >= min_n)
    points = anderson_points(F.col("n"))
    return d.select(
        "column",
        F.col("ad").alias("statistic"),
        *[v.alias("crit_" + k.replace(".", "_")) for k, v in points.items()],
        (F.col("ad") < points["5"]).alias("is_normal"),
        F.col("n").alias("sample_size"),
    )


def _moments(df: DataFrame, cols: list[str]) -> DataFrame:
    return numeric_long(df, cols).groupBy("column").agg(
        F.count("value").cast("double").alias("n"),
        F.skewness("value").alias("g1"),
        F.kurtosis("value").alias("g2"),
    )


def _jarque_bera_statistic() -> Column:
    return F.col("n") / 6 * (F.col("g1") * F.col("g1") + F.col("g2") * F.col("g2") / 4)


def jarque_bera(df: DataFrame, cols: list[str] | None = None, min_n: int = 8) -> DataFrame:
    """Statistic, p-value and the population skewness and kurtosis behind it."""
    m = _moments(df, cols or catalog.numeric_columns(df)).where(F.col("n") >= min_n)
    jb = _jarque_bera_statistic()
    return m.select(
        "column",
        jb.alias("statistic"),
        F.exp(-jb / 2).alias("p_value"),
        F.col("g1").alias("skewness"),
        F.col("g2").alias("kurtosis"),
        F.col("n").cast("bigint").alias("sample_size"),
    )


def _k2_statistic() -> Column:
    """D'Agostino's omnibus statistic from n and the population moments."""
    n, g1 = F.col("n"), F.col("g1")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2 / (w2 - 1))
    z1 = delta * F.asinh(y / alpha)
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("g2") + 3 - mean) / F.sqrt(var)
    root_beta = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root_beta * (2 / root_beta + F.sqrt(1 + 4 / (root_beta * root_beta)))
    z2 = ((1 - 2 / (9 * a)) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    return z1 * z1 + z2 * z2


def dagostino_k2(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Skewness and kurtosis combined; needs twenty values."""
    m = _moments(df, cols or catalog.numeric_columns(df)).where(F.col("n") >= 20)
    return m.withColumn("statistic", _k2_statistic()).select(
        "column",
        "statistic",
        F.exp(-F.col("statistic") / 2).alias("p_value"),
        F.col("n").cast("bigint").alias("sample_size"),
    )


def normality_tests(df: DataFrame, cols: list[str] | None = None, suite: str = "distribution") -> DataFrame:
    """``column, test, statistic, p_value, is_normal`` for all tests a column is long enough for.

    ``suite`` is ``distribution`` (five tests, 20 values for the last three) or ``studio``
    (four tests, eight values).
    """
    cols = cols or catalog.numeric_columns(df)
    floor = 20 if suite == "distribution" else 8
    d = pinned(_distance_tests(df, cols))
    m = pinned(_moments(df, cols))
    no_p = F.lit(None).cast("double")

    def row(frame, test, stat, p, normal) -> DataFrame:
        return frame.select("column", F.lit(test).alias("test"), stat.alias("statistic"), p.alias("p_value"), normal.alias("is_normal"))

    s = shapiro(df, cols).where(F.col("statistic").isNotNull())
    out = row(s, "Shapiro-Wilk", F.col("statistic"), F.col("p_value"), F.col("p_value") > 0.05)
    ad = d.where(F.col("n") >= floor)
    out = out.unionByName(
        row(ad, "Anderson-Darling", F.col("ad"), no_p, F.col("ad") < anderson_points(F.col("n"))["5"])
    )
    ks = d.where(F.col("n") >= 5).withColumn("p", special.p_kolmogorov(F.col("ks"), F.col("n").cast("double")))
    out = out.unionByName(row(ks, "Kolmogorov-Smirnov", F.col("ks"), F.col("p"), F.col("p") > 0.05))
    if suite == "distribution":
        k2 = m.where(F.col("n") >= 20).withColumn("k2", _k2_statistic())
        p = F.exp(-F.col("k2") / 2)
        out = out.unionByName(row(k2, "D'Agostino K2", F.col("k2"), p, p > 0.05))
    jb = m.where(F.col("n") >= floor).withColumn("jb", _jarque_bera_statistic())
    p = F.exp(-F.col("jb") / 2)
    return out.unionByName(row(jb, "Jarque-Bera", F.col("jb"), p, p > 0.05))


def _effect(d: Column) -> Column:
    return band(F.abs(d), (0.8, "large"), (0.5, "medium"), otherwise="small", strict=True)


def _two_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = number(df, a), number(df, b)
    aggs = []
    for v, k in ((x, "a"), (y, "b")):
        aggs += [F.count(v).cast("double").alias(f"n_{k}"), F.avg(v).alias(f"mean_{k}"), F.var_samp(v).alias(f"var_{k}")]
    return df.agg(*aggs)


def t_test(df: DataFrame, a: str, b: str, equal_var: bool = False) -> DataFrame:
    """Two-sample t-test of two columns (Welch by default) with Cohen's d."""
    s = _two_columns(df, a, b).where((F.col("n_a") >= 2) & (F.col("n_b") >= 2))
    na, nb, va, vb = (F.col(c) for c in ("n_a", "n_b", "var_a", "var_b"))
    diff = F.col("mean_a") - F.col("mean_b")
    if equal_var:
        dof = na + nb - 2
        se = F.sqrt(((na - 1) * va + (nb - 1) * vb) / dof * (1 / na + 1 / nb))
    else:
        ea, eb = va / na, vb / nb
        se = F.sqrt(ea + eb)
        dof = ratio((ea + eb) * (ea + eb), ea * ea / (na - 1) + eb * eb / (nb - 1))
    s = s.withColumns({"statistic": ratio(diff, se), "dof": dof, "cohens_d": ratio(diff, F.sqrt((va + vb) / 2))})
    return s.select(
        "statistic",
        "dof",
        special.p_student(F.col("statistic"), F.col("dof")).alias("p_value"),
        "cohens_d",
        _effect(F.col("cohens_d")).alias("effect_size"),
        "mean_a",
        F.sqrt("var_a").alias("std_a"),
        na.cast("bigint").alias("n_a"),
        "mean_b",
        F.sqrt("var_b").alias("std_b"),
        nb.cast("bigint").alias("n_b"),
    )


def paired_t_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """t-test of the differences over rows that have both values."""
    diff = number(df, a) - number(df, b)
    s = df.agg(F.count(diff).cast("double").alias("n"), F.avg(diff).alias("mean_difference"), F.stddev_samp(diff).alias("sd"))
    s = s.where(F.col("n") >= 2).withColumn("statistic", ratio(F.col("mean_difference"), F.col("sd") / F.sqrt("n")))
    return s.select(
        "statistic",
        special.p_student(F.col("statistic"), F.col("n") - 1).alias("p_value"),
        "mean_difference",
        F.col("n").cast("bigint").alias("n"),
    )


def group_summary(df: DataFrame, value: str, group: str) -> DataFrame:
    """``group, n, mean, std`` of groups with at least two values."""
    long = df.select(F.col(quoted(group)).cast("string").alias("group"), number(df, value).alias("value")).dropna()
    return (
        long.groupBy("group")
        .agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
        .where(F.col("n") >= 2)
    )


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way analysis of variance over the group summary."""
    g = group_summary(df, value, group)
    n, m = F.col("n").cast("double"), F.col("mean")
    s = g.agg(
        F.count(F.lit(1)).cast("double").alias("k"),
        F.sum(n).alias("total"),
        F.sum(n * m).alias("sum"),
        F.sum(n * m * m).alias("squares"),
        F.sum((n - 1) * F.col("std") * F.col("std")).alias("within"),
    ).where(F.col("k") >= 2)
    between = F.col("squares") - F.col("sum") * F.col("sum") / F.col("total")
    d1, d2 = F.col("k") - 1, F.col("total") - F.col("k")
    s = s.withColumn("statistic", ratio(between / d1, F.col("within") / d2))
    return s.select(
        "statistic",
        special.p_fisher(F.col("statistic"), d1, d2).alias("p_value"),
        F.col("k").cast("bigint").alias("n_groups"),
    )


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed counts of value pairs: ``a, b, n``."""
    x, y = F.col(quoted(a)).cast("string").alias("a"), F.col(quoted(b)).cast("string").alias("b")
    return df.select(x, y).dropna().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two categorical columns, with Yates' correction for a 2x2 table.

    Empty cells enter through the identity sum((o-e)^2/e) = sum(o^2/e) - N, so the full
    table of absent pairs is never built; only the corrected 2x2 case looks at each cell.
    """
    table = contingency(df, a, b)
    rows = table.groupBy("a").agg(F.sum("n").alias("ra"))
    cols = table.groupBy("b").agg(F.sum("n").alias("cb"))
    size = table.agg(F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"), F.sum("n").alias("total")).first()
    r, c, total = size["r"], size["c"], size["total"] or 0
    schema = "statistic double, p_value double, degrees_of_freedom bigint, cramers_v double"
    if r < 2 or c < 2:
        return df.sparkSession.createDataFrame([], schema)
    if (r, c) == (2, 2):
        counts = {(x["a"], x["b"]): float(x["n"]) for x in table.collect()}
        ra = {x["a"]: float(x["ra"]) for x in rows.collect()}
        cb = {x["b"]: float(x["cb"]) for x in cols.collect()}
        stat = 0.0
        for i in ra:
            for j in cb:
                e = ra[i] * cb[j] / total
                gap = abs(counts.get((i, j), 0.0) - e)
                stat += max(gap - min(0.5, gap), 0.0) ** 2 / e
        base = df.sparkSession.createDataFrame([(stat,)], "statistic double")
    else:
        joined = table.join(rows, "a").join(cols, "b")
        share = F.col("n") / (F.col("ra").cast("double") * F.col("cb"))
        base = joined.agg(((F.sum(F.col("n") * share) - 1) * total).alias("statistic"))
    dof = (r - 1) * (c - 1)
    all_rows = df.count()
    return base.select(
        "statistic",
        special.p_chi2(F.col("statistic"), F.lit(float(dof))).alias("p_value"),
        F.lit(dof).cast("bigint").alias("degrees_of_freedom"),
        F.sqrt(F.col("statistic") / (all_rows * (min(r, c) - 1))).alias("cramers_v"),
    )


def mann_whitney(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two-sided U test of two columns: ``statistic, p_value, median_a, n_a, median_b, n_b``.

    Ranks come from the pooled frequency table. Exact when the smaller sample has at most
    eight values and nothing ties; otherwise normal with tie and continuity corrections.
    """
    x, y = number(df, a), number(df, b)
    long = df.select(x.alias("a"), y.alias("b")).unpivot([], ["a", "b"], "side", "value").where("value is not null")
    freq = long.groupBy("value").agg(
        F.count_if(F.col("side") == "a").alias("na"), F.count(F.lit(1)).alias("n")
    ).withColumn("column", F.lit("pooled"))
    ranked = rank_values(freq, "column")
    n = F.col("n").cast("double")
    s = ranked.agg(
        F.sum((F.col("before") + (n + 1) / 2) * F.col("na")).alias("rank_sum"),
        F.sum("na").cast("double").alias("na"),
        F.sum(n).alias("total"),
        F.sum(n * n * n - n).alias("ties"),
    )
    medians = {r["side"]: r["q"][0] for r in quantile_frame(long, [0.5], "side").collect()}
    row = s.first()
    na = row["na"] or 0.0
    nb = (row["total"] or 0.0) - na
    schema = "statistic double, p_value double, median_a double, n_a bigint, median_b double, n_b bigint"
    if na < 5 or nb < 5:
        return df.sparkSession.createDataFrame([], schema)
    u = row["rank_sum"] - na * (na + 1) / 2
    total = na + nb
    if min(na, nb) <= 8 and row["ties"] == 0:
        p = special.mann_whitney_exact(u, int(na), int(nb))
    else:
        sd = math.sqrt(na * nb / 12 * (total + 1 - row["ties"] / (total * (total - 1))))
        top = max(u, na * nb - u)
        p = min(1.0, 2 * float(normal_cdf(-(top - na * nb / 2 - 0.5) / sd))) if sd else 1.0
    return df.sparkSession.createDataFrame(
        [(u, p, medians.get("a"), int(na), medians.get("b"), int(nb))], schema
    )


def _correlation_test(r_frame: DataFrame, name: str) -> DataFrame:
    r = F.col("r")
    dof = F.col("n").cast("double") - 2
    t = ratio(r, F.sqrt(F.greatest(1 - r * r, F.lit(0.0)) / dof))
    label = band(
        F.abs(r), (0.9, "very strong"), (0.7, "strong"), (0.5, "moderate"), (0.3, "weak"), otherwise="very weak", strict=True
    )
    exact = F.abs(r) >= 1
    return r_frame.where(F.col("n") >= 3).select(
        r.alias(name),
        (r * r).alias("r_squared"),
        F.when(exact, 0.0).otherwise(special.p_student(t, dof)).alias("p_value"),
        label.alias("strength"),
        "n",
    )


def _r_of(work: DataFrame) -> DataFrame:
    r = ratio(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return work.agg(r.alias("r"), F.count(F.lit(1)).alias("n"))


def pearson_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """``r, r_squared, p_value, strength, n`` over complete pairs."""
    work = df.select(number(df, a).alias("x"), number(df, b).alias("y")).dropna()
    return _correlation_test(_r_of(work), "r")


def spearman_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """``rho, r_squared, p_value, strength, n`` over complete pairs."""
    work = df.select(number(df, a).alias("x"), number(df, b).alias("y")).dropna()
    return _correlation_test(_r_of(average_ranks(work, ["x", "y"])), "rho")


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column of a test result."""
    return frame.select(
        [safe_round(F.col(n), digits).alias(n) if t == "double" else F.col(n) for n, t in frame.dtypes]
    )
