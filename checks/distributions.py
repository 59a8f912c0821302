"""Distribution report, chart data of distributions, transforms and hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqlmath
from checks.base import EV_GAPS, LI_NUM, Fixture, query, scratch, table, tidy, union_all
from lumenframe.operators import describe, distribution, filters, hypothesis
from lumenframe.operators.frequency import numeric_long
from lumenframe.sources import writers

EV = Fixture("events", "value", "cast(user_id as double) as user_id", "cast(event_id % 17 as double) as slot")
EVC = ["value", "user_id", "slot"]


def _q(c, src="events"):
    return f"(select quantile_cont({c}, 0.25) as q1, median({c}) as q2, quantile_cont({c}, 0.75) as q3 from {src} where {c} is not null)"


# --- outliers and histograms ----------------------------------------------------------------------


@query("dst2_iqr_outliers", union_all(
    EVC,
    lambda c: f"""select '{c}' as "column", count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outlier_count,
     round(100.0 * count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) / count(*), 2) as outlier_pct,
     round(max(q1 - 1.5 * (q3 - q1)), 4) as lower_fence, round(max(q3 + 1.5 * (q3 - q1)), 4) as upper_fence from {EV.sql}, {_q(c, EV.sql)}"""))
def _(spark, sf):
    df = EV.df(spark, sf)
    s = describe.outlier_counts(df, describe.numeric_summary(df, EVC), EVC)
    pct = F.round(F.col("iqr_outliers") / F.col("count") * 100, 2)
    return tidy(s.select("column", F.col("iqr_outliers").alias("outlier_count"), pct.alias("outlier_pct"), "lower_fence", "upper_fence"))


def _hist(c, src, bins):
    return f"""select '{c}' as "column", b as bin, round(lo + b * w, 6) as lower, round(lo + (b + 1) * w, 6) as upper, count({c}) as count
     from (select min({c})::double as lo, max({c})::double as hi, (max({c})::double - min({c})::double) / {bins} as w from {src}) l
     cross join range(0, {bins}) t(b) left join {src} s on b = least(floor(({c} - lo) / nullif(w, 0)), {bins - 1}) group by b, lo, w"""


@query("dst6_histogram", _hist("value", EV.sql, 50))
def _(spark, sf):
    return tidy(distribution.histogram(numeric_long(EV.df(spark, sf), ["value"]), 50), 6)


@query("dst6_center_lines", """select 'value' as "column", round(avg(value), 4) as mean, round(median(value), 4) as median from events""")
def _(spark, sf):
    return tidy(distribution.center_lines(table(spark, sf, "events"), ["value"]))


def _kde(c, src):
    return f"""select '{c}' as "column", p::bigint as point, round(lo + p * (hi - lo) / 199, 4) as x,
     round(sum(k * exp(-0.5 * power((lo + p * (hi - lo) / 199 - v) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())), 8) as density
     from (select {c} as v, count(*) as k from {src} group by 1), (select count({c}) as n, power(count({c}), -0.2) * stddev({c}) as h, min({c})::double as lo, max({c})::double as hi from {src}),
     range(0, 200) t(p) group by p, lo, hi"""


def _density(out):
    return out.withColumns({"point": F.col("point").cast("bigint"), "x": F.round("x", 4), "density": F.round("density", 8)})


@query("dst7_kde", _kde("value", EV.sql))
def _(spark, sf):
    return _density(distribution.kde(numeric_long(EV.df(spark, sf), ["value"])))


def _box(c, src):
    return f"""select '{c}' as "column", count({c}) as n, round(avg({c}), 4) as mean, round(max(q1), 4) as q1, round(max(q2), 4) as median, round(max(q3), 4) as q3,
     round(min({c}) filter ({c} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))::double, 4) as whisker_low,
     round(max({c}) filter ({c} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))::double, 4) as whisker_high,
     count(*) filter ({c} not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as outliers from {src}, {_q(c, src)}"""


@query("dst8_box_summary", _box("value", EV.sql))
def _(spark, sf):
    return tidy(distribution.box_summary(numeric_long(EV.df(spark, sf), ["value"])))


@query("dst8_outlier_points", f"select value from events, {_q('value')} where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)")
def _(spark, sf):
    return distribution.outlier_points(table(spark, sf, "events"), "value")


@query("dst9_violin", f"""select d."column", d.point, d.x, d.density, b.median, b.q1, b.q3 from ({_kde('user_id', EV.sql)}) d, ({_box('user_id', EV.sql)}) b""")
def _(spark, sf):
    long = numeric_long(EV.df(spark, sf), ["user_id"])
    b = tidy(distribution.box_summary(long)).select("column", "median", "q1", "q3")
    return _density(distribution.kde(long)).join(F.broadcast(b), "column")


@query("dst10_ecdf", "select value, round(max(c), 6) as proportion from (select value, cume_dist() over (order by value) as c from events) group by value")
def _(spark, sf):
    return tidy(distribution.ecdf(table(spark, sf, "events"), "value", rows_per_bucket=1000), 6)


@query("dst10_quartile_markers", union_all([0.25, 0.5, 0.75], lambda p: f"select {p}::double as proportion, round(quantile_cont(value, {p}), 4) as value from events"))
def _(spark, sf):
    return tidy(distribution.quartile_markers(table(spark, sf, "events"), "value"))


_qq = f"""(select i, {sqlmath.ppf('q')} as theoretical, v as sample from (select i, v, case when i = n then power(0.5, 1.0 / n) when i = 1 then 1 - power(0.5, 1.0 / n) else (i - 0.3175) / (n + 0.365) end as q
  from (select value as v, row_number() over (order by value) as i, count(*) over () as n from events)))"""


@query("dst11_qq_points", f"select i, round(theoretical, 6) + 0.0 as theoretical, sample from {_qq}")
def _(spark, sf):
    return tidy(distribution.qq_points(table(spark, sf, "events"), "value"), 6)


@query("dst11_qq_line", f"select round(regr_slope(sample, theoretical), 6) as slope, round(regr_intercept(sample, theoretical), 6) as intercept, round(corr(sample, theoretical), 6) as r from {_qq}")
def _(spark, sf):
    return tidy(distribution.qq_line(distribution.qq_points(table(spark, sf, "events"), "value")), 6)


@query("dst12_frequency", "select l_quantity as value, count(*) as count from lineitem group by 1")
def _(spark, sf):
    return distribution.frequency(table(spark, sf, "lineitem"), "l_quantity")


@query("dst13_rug", f"select value from {EV_GAPS.sql} where value is not null")
def _(spark, sf):
    return distribution.rug(EV_GAPS.df(spark, sf), "value")


@query("dst14_overlay_histogram", union_all(EVC, lambda c: _hist(c, EV.sql, 40)))
def _(spark, sf):
    return tidy(distribution.histogram(numeric_long(EV.df(spark, sf), EVC), 40), 6)


@query("dst15_overlay_kde", union_all(EVC, lambda c: _kde(c, EV.sql)))
def _(spark, sf):
    return _density(distribution.kde(numeric_long(EV.df(spark, sf), EVC)))


@query("dst16_box_compare", union_all(EVC, lambda c: _box(c, EV.sql)))
def _(spark, sf):
    return tidy(distribution.box_summary(numeric_long(EV.df(spark, sf), EVC)))


@query("dst16_violin_compare", union_all(LI_NUM, lambda c: _kde(c, "lineitem")))
def _(spark, sf):
    return _density(distribution.kde(numeric_long(table(spark, sf, "lineitem"), LI_NUM)))


# --- transforms ----------------------------------------------------------------------------------------

TR = Fixture("customer", "c_custkey", "c_acctbal", "c_acctbal + 2000 as positive")


def _transform(name, col, transform, expr, src=TR.sql):
    sql = None
    if expr:
        sql = f"select round({col}, 4) as value, round({expr}, 6) as transformed from {src}, (select min({col}) as lo, max({col}) as hi, avg({col}) as m, stddev({col}) as s, quantile_cont({col}, 0.25) as q1, median({col}) as q2, quantile_cont({col}, 0.75) as q3 from {src})"

    @query(name, sql)
    def _(spark, sf):
        out, _label = distribution.transformed(TR.df(spark, sf), col, transform)
        return out.select(F.round("value", 4).alias("value"), (F.round("transformed", 6) + 0.0).alias("transformed"))


_transform("dst17_log", "positive", "log", "ln(positive) + 0.0")
_transform("dst17_log_shifted", "c_acctbal", "log", "ln(c_acctbal - lo + 1) + 0.0")
_transform("dst18_sqrt", "positive", "sqrt", "sqrt(positive)")
_transform("dst18_sqrt_shifted", "c_acctbal", "sqrt", "sqrt(c_acctbal - lo)")
_transform("dst19_boxcox", "positive", "boxcox", None)
_transform("dst20_yeojohnson", "c_acctbal", "yeojohnson", None)

_YJ = """case when x >= 0 then case when l = 0 then ln(x + 1) else (power(x + 1, l) - 1) / l end else case when l = 2 then -ln(1 - x) else -(power(1 - x, 2 - l) - 1) / (2 - l) end end"""


def _lambda_sql(values, transform, jacobian):
    """λ with the highest likelihood on a grid of hundredths."""
    return f"""select round(l, 2) as lambda from (select l, -count(*) / 2.0 * ln(var_pop({transform})) + (l - 1) * sum({jacobian}) as f
      from (select {values} as x from {TR.sql}), (select (i - 300) / 100.0::double as l from range(0, 601) t(i)) group by l) order by f desc limit 1"""


@query("dst19_boxcox_lambda", _lambda_sql("positive", "case when l = 0 then ln(x) else (power(x, l) - 1) / l end", "ln(x)"))
def _(spark, sf):
    lam = distribution.box_cox_lambda(TR.df(spark, sf).select(F.col("positive").alias("value")))
    return spark.createDataFrame([(round(lam, 2),)], "lambda double")


@query("dst20_yeojohnson_lambda", _lambda_sql("c_acctbal", _YJ, "sign(x) * ln(1 + abs(x))"))
def _(spark, sf):
    lam = distribution.yeo_johnson_lambda(TR.df(spark, sf).select(F.col("c_acctbal").alias("value")))
    return spark.createDataFrame([(round(lam, 2),)], "lambda double")


_transform("dst21_minmax", "c_acctbal", "minmax", "(c_acctbal - lo) / (hi - lo)")
_transform("dst21_standardize", "c_acctbal", "standardize", "(c_acctbal - m) / s")
_transform("dst21_robust", "c_acctbal", "robust", "(c_acctbal - q2) / (q3 - q1)")


@query("dst22_transform_preview", """select 'log(x)' as label, round(skewness(value + 0.0), 6) as original_skew, round(skewness(ln(value)), 6) as transformed_skew,
  round(kurtosis(value), 6) as original_kurt, round(kurtosis(ln(value)), 6) as transformed_kurt from (select value + 1 as value from events)""")
def _(spark, sf):
    df = table(spark, sf, "events").select((F.col("value") + 1).alias("value"))
    return distribution.transform_preview(df, "value", "log")


@query("dst22_transform_histograms", union_all(["value", "transformed"], lambda c: _hist(c, "(select value + 1 as value, ln(value + 1) as transformed from events)", 40)))
def _(spark, sf):
    df = table(spark, sf, "events").select((F.col("value") + 1).alias("value"))
    return tidy(distribution.transform_histograms(df, "value", "log"), 6)


# --- report ------------------------------------------------------------------------------------------------


def _report(spark, sf):
    return distribution.column_report(EV.df(spark, sf), EVC)


_cv = "stddev({c}) / abs(avg({c})) * 100"
# These columns fail every normality test at any scale (uniform, integer or exponential),
# so the normality deduction is the full one.
_DST = union_all(EVC, lambda c: f"""select '{c}' as "column", count({c}) as count, avg({c}) as mean, median({c}) as median, stddev({c}) as std, min({c})::double as min, max({c})::double as max,
  skewness({c}) as s, kurtosis({c}) as k, {_cv.format(c=c)} as cv, count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outlier_count,
  round(100.0 * count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) / count(*), 2) as outlier_pct, count({c}) as n from {EV.sql}, {_q(c, EV.sql)}""")
_DSCORE = """(100 - case when abs(s) > 2 then 25 when abs(s) > 1 then 15 when abs(s) > 0.5 then 5 else 0 end - case when abs(k) > 3 then 20 when abs(k) > 2 then 10 when abs(k) > 1 then 5 else 0 end
  - case when outlier_pct > 10 then 20 when outlier_pct > 5 then 10 when outlier_pct > 2 then 5 else 0 end - 15 - case when cv > 100 then 10 when cv > 50 then 5 else 0 end)::double"""
_BAND = "case when {x} >= 90 then 'Excellent' when {x} >= 75 then 'Good' when {x} >= 50 then 'Average' else 'Poor' end"
_SHAPE = """case when abs(s) <= 0.5 and abs(k) <= 1 then 'Symmetric' when s > 0.5 then case when abs(s) <= 1 then 'Right Skewed' else 'Highly Right Skewed' end
 when s < -0.5 then case when abs(s) <= 1 then 'Left Skewed' else 'Highly Left Skewed' end when k > 1 then 'Leptokurtic (Peaked)' when k < -1 then 'Platykurtic (Flat)' else 'Approximately Symmetric' end"""


@query("dst1_compute_distribution", f"""select "column", count, round(mean, 4) as mean, round(median, 4) as median, round(std, 4) as std, min, max, round(s, 4) + 0.0 as skewness, round(k, 4) as kurtosis,
  {_SHAPE} as shape, outlier_count, outlier_pct, {_DSCORE} as quality_score, {_BAND.format(x=_DSCORE)} as quality_status from ({_DST})""")
def _(spark, sf):
    return tidy(distribution.export_rows(_report(spark, sf)))


@query("dst1_summary", f"""select count(*) as total_numeric, 0::bigint as normal_columns, count(*) filter (shape like '%Skewed%') as skewed_columns, count(*) filter (shape in ('Symmetric', 'Approximately Symmetric')) as symmetric_columns,
  count(*) filter (outlier_count > 0) as columns_with_outliers, round(avg(score), 1) as avg_quality_score, {_BAND.format(x='round(avg(score), 1)')} as avg_quality_status
  from (select outlier_count, {_SHAPE} as shape, {_DSCORE} as score from ({_DST}))""")
def _(spark, sf):
    return distribution.report_summary(_report(spark, sf))


@query("dst3_quality_score", f'select "column", {_DSCORE} as quality_score, {_BAND.format(x=_DSCORE)} as quality_status from ({_DST})')
def _(spark, sf):
    return _report(spark, sf).select("column", "quality_score", "quality_status")


@query("dst4_insights")
def _(spark, sf):
    return distribution.insights(_report(spark, sf), describe.percentiles(EV.df(spark, sf), EVC))


@query("dst5_recommendations", f"""with r as ({_DST}) select "column", priority, category, action from (
  select "column", 'high' as priority, 'transformation' as category, 'log_transform' as action, s > 1 as ok from r
  union all select "column", 'medium', 'transformation', 'sqrt_transform', s > 0.5 and s <= 1 from r union all select "column", 'high', 'transformation', 'boxcox_transform', s < -1 from r
  union all select "column", 'medium', 'normalization', 'normalize', true from r union all select "column", 'high', 'outliers', 'remove_outliers', outlier_pct > 5 from r
  union all select "column", 'low', 'outliers', 'monitor_outliers', outlier_pct > 2 and outlier_pct <= 5 from r union all select "column", 'low', 'scaling', 'robust_scale', mean <> 0 from r) where ok""")
def _(spark, sf):
    return distribution.recommendations(_report(spark, sf)).select("column", "priority", "category", "action")


@query("flt11_distribution_filter", f"""select "column", outlier_count from ({_DST}) where "column" like '%a%' and outlier_count > 0 and {_SHAPE} like '%Skewed%'""")
def _(spark, sf):
    kept = filters.filter_distributions(_report(spark, sf), search="A", kind="outlier")
    return filters.filter_distributions(kept, kind="skewed").select("column", "outlier_count")


@query("snk4_export_distribution", f"""select "column", count, round(mean, 4) as mean, {_SHAPE} as shape, outlier_count, {_DSCORE} as quality_score from ({_DST})""")
def _(spark, sf):
    path = scratch(spark)
    writers.write_json(distribution.export_rows(_report(spark, sf)), path)
    return tidy(spark.read.json(path).select("column", "count", "mean", "shape", "outlier_count", "quality_score"))


# --- hypothesis tests ------------------------------------------------------------------------------------------


_u = "(1 / sqrt(n))"
_last = f"(mn / sqrt(mm) + 0.221157 * {_u} - 0.147981 * power({_u}, 2) - 2.07119 * power({_u}, 3) + 4.434685 * power({_u}, 4) - 2.706056 * power({_u}, 5))"
_next = f"(mx / sqrt(mm) + 0.042981 * {_u} - 0.293762 * power({_u}, 2) - 1.752461 * power({_u}, 3) + 5.682633 * power({_u}, 4) - 3.582633 * power({_u}, 5))"
def _shapiro(c, src):
    return f"""(with r as (select {c} as v, row_number() over (order by {c}) as i, count(*) over () as n from {src}),
  m as (select *, {sqlmath.ppf('((i - 0.375) / (n + 0.25))')} as m from r),
  t as (select *, sum(m * m) over () as mm, max(m) over () as mn, max(case when i = n - 1 then m end) over () as mx from m),
  w as (select *, {_last} as al, {_next} as an from t),
  a as (select v, n, case when i = n then al when i = 1 then -al when i = n - 1 then an when i = 2 then -an else m / sqrt((mm - 2 * mn * mn - 2 * mx * mx) / (1 - 2 * al * al - 2 * an * an)) end as a from w)
  select n, power(sum(a * v), 2) / (var_pop(v) * n) as w from a group by n)"""


_lw = "(ln(1 - w) - (-1.5861 - 0.31082 * ln(n) - 0.083751 * power(ln(n), 2) + 0.0038915 * power(ln(n), 3))) / exp(-0.4803 - 0.082676 * ln(n) + 0.0030302 * power(ln(n), 2))"


_sp = f"greatest(0, 1 - {sqlmath.phi(f'least(6.0, {_lw})')})"


def _shapiro_row(c, src):
    return f"""select '{c}' as "column", round(w, 6) as statistic, round({_sp}, 6) as p_value, n as sample_size, n > 5000 as p_extrapolated from {_shapiro(c, src)}"""


@query("stt1_shapiro_wilk", _shapiro_row("c_acctbal", "customer"))
def _(spark, sf):
    return hypothesis.rounded(hypothesis.shapiro(table(spark, sf, "customer"), ["c_acctbal"]))


@query("stt1_shapiro_lineitem", _shapiro_row("l_quantity", "lineitem"))
def _(spark, sf):
    return hypothesis.rounded(hypothesis.shapiro(table(spark, sf, "lineitem"), ["l_quantity"]))


def _edf(c):
    """Ranked distinct values of a column with the fitted normal's distribution function."""
    return f"""(select *, {sqlmath.phi('z')} as p from (select k, hi - k as lo, hi, n, (v - m) / s as z from (select {c} as v, count(*) as k, sum(count(*)) over (order by {c}) as hi from lineitem group by 1),
      (select count({c}) as n, avg({c}) as m, stddev({c}) as s from lineitem)))"""


_ks = "max(greatest(hi / n::double - p, p - lo / n::double))"


@query("stt2_kolmogorov_smirnov", union_all(LI_NUM, lambda c: f"""select '{c}' as "column", round({_ks}, 6) as statistic, round({sqlmath.kolmogorov_upper('d', 'nn')}, 6) as p_value, nn as sample_size from (select {_ks} as d, max(n) as nn from {_edf(c)}) group by d, nn""".replace(f"round({_ks}, 6)", "round(d, 6)")))
def _(spark, sf):
    return hypothesis.rounded(hypothesis.kolmogorov_smirnov(table(spark, sf, "lineitem"), LI_NUM))


_odd = "(hi::double * hi - lo::double * lo)"
_ad = f"(-max(n) - sum({_odd} * ln(p) + (2.0 * n * k - {_odd}) * ln(1 - p)) / max(n))"


@query("stt3_anderson_darling", union_all(LI_NUM, lambda c: f"""select '{c}' as "column", round(a, 4) as statistic, {', '.join(f"round({v} / (1 + 4.0 / n - 25.0 / (n::double * n)), 3) as crit_{k}" for k, v in (("15", 0.576), ("10", 0.656), ("5", 0.787), ("2_5", 0.918), ("1", 1.092)))},
  a < round(0.787 / (1 + 4.0 / n - 25.0 / (n::double * n)), 3) as is_normal, n as sample_size from (select {_ad} as a, max(n) as n from {_edf(c)})"""))
def _(spark, sf):
    return tidy(hypothesis.anderson_darling(table(spark, sf, "lineitem"), LI_NUM))


_pop = "(avg(power(x - m, {k})) / power(avg(power(x - m, 2)), {k} / 2.0))"


def _moments(c, src):
    return f"(select count(x) as n, {_pop.format(k=3)} as g1, {_pop.format(k=4)} - 3 as g2 from (select {c} as x from {src} where {c} is not null), (select avg({c}) as m from {src}))"


_jb = "n / 6.0 * (g1 * g1 + g2 * g2 / 4)"


@query("stt4_jarque_bera", union_all(["l_quantity", "l_discount"], lambda c: f"""select '{c}' as "column", round({_jb}, 4) as statistic, round(exp(-({_jb}) / 2), 4) as p_value,
  round(g1, 4) + 0.0 as skewness, round(g2, 4) as kurtosis, n as sample_size from {_moments(c, 'lineitem')}"""))
def _(spark, sf):
    return tidy(hypothesis.jarque_bera(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]))


@query("stt5_dagostino_k2", f"""with m as {_moments('value', 'events')},
  a as (select n::double as n, g2, g1 * sqrt((n + 1.0) * (n + 3) / (6.0 * (n - 2))) as y, 3.0 * (n * n + 27.0 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) as b2 from m),
  b as (select *, sqrt(2 * (b2 - 1)) - 1 as w2 from a),
  c as (select *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) as z1, (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) as x,
    6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) as rb from b),
  d as (select *, 6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) as a from c),
  e as (select n, z1, ((1 - 2 / (9 * a)) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) as z2 from d)
  select 'value' as "column", round(z1 * z1 + z2 * z2, 4) as statistic, round(exp(-(z1 * z1 + z2 * z2) / 2), 4) as p_value, n::bigint as sample_size from e""")
def _(spark, sf):
    return tidy(hypothesis.dagostino_k2(table(spark, sf, "events"), ["value"]))


@query("stt6_normality_suite")
def _(spark, sf):
    return hypothesis.rounded(hypothesis.normality_tests(table(spark, sf, "events"), ["value", "user_id"]))


@query("stt6_normality_verdicts", f"""with m as {_moments('l_quantity', 'lineitem')}, e as {_edf('l_quantity')}
  select 'l_quantity' as "column", 'Jarque-Bera' as test, exp(-({_jb}) / 2) > 0.05 as is_normal from m
  union all select 'l_quantity', 'Anderson-Darling', {_ad} < 0.787 from e
  union all select 'l_quantity', 'Kolmogorov-Smirnov', {sqlmath.kolmogorov_upper('d', 'n')} > 0.05 from (select {_ks} as d, max(n) as n from e) group by d, n
  union all select 'l_quantity', 'Shapiro-Wilk', {_sp} > 0.05 from {_shapiro('l_quantity', 'lineitem')}""")
def _(spark, sf):
    out = hypothesis.normality_tests(table(spark, sf, "lineitem"), ["l_quantity"], "studio")
    return out.select("column", "test", "is_normal")


TT = Fixture(
    "lineitem",
    "case when l_returnflag = 'A' then l_quantity end as a",
    "case when l_returnflag = 'R' then l_quantity + 0.05 end as b",
    "l_quantity as before",
    "l_quantity + l_discount * 10 - 0.5 as after",
)
_tt = f"(select count(a)::double as na, avg(a) as ma, var_samp(a) as va, count(b)::double as nb, avg(b) as mb, var_samp(b) as vb from {TT.sql})"
_d = "(ma - mb) / sqrt((va + vb) / 2)"
_eff = f"case when abs({_d}) > 0.8 then 'large' when abs({_d}) > 0.5 then 'medium' else 'small' end"
_side = "round(ma, 4) as mean_a, round(sqrt(va), 4) as std_a, na::bigint as n_a, round(mb, 4) as mean_b, round(sqrt(vb), 4) as std_b, nb::bigint as n_b"


@query("stt7_t_test_welch", f"""select round((ma - mb) / sqrt(va / na + vb / nb), 4) + 0.0 as statistic, round(power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)), 2) as dof,
  round({_d}, 4) + 0.0 as cohens_d, {_eff} as effect_size, {_side} from {_tt}""")
def _(spark, sf):
    out = hypothesis.t_test(TT.df(spark, sf), "a", "b").drop("p_value").withColumn("dof", F.round("dof", 2))
    return tidy(out)


@query("stt7_t_test_student", f"""select round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 4) + 0.0 as statistic, na + nb - 2 as dof, round({_d}, 4) + 0.0 as cohens_d from {_tt}""")
def _(spark, sf):
    return tidy(hypothesis.t_test(TT.df(spark, sf), "a", "b", True).select("statistic", "dof", "cohens_d"))


_welch_t, _welch_dof = "(ma - mb) / sqrt(va / na + vb / nb)", "power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1))"


@query("stt7_t_test_p_value", f"select round({sqlmath.student_two_sided('t', 'dof')}, 6) as p_value from (select {_welch_t} as t, {_welch_dof} as dof from {_tt})")
def _(spark, sf):
    return tidy(hypothesis.t_test(TT.df(spark, sf), "a", "b").select("p_value"), 6)


@query("stt8_paired_t_test", f"select round(avg(before - after) / (stddev(before - after) / sqrt(count(*))), 4) + 0.0 as statistic, round(avg(before - after), 4) + 0.0 as mean_difference, count(*) as n from {TT.sql}")
def _(spark, sf):
    return tidy(hypothesis.paired_t_test(TT.df(spark, sf), "before", "after").drop("p_value"))


_anova = """(select count(*) as k, sum(n) as t, sum(n * m) as sm, sum(n * m * m) as sq, sum((n - 1) * s * s) as w from (select event_type, count(value) as n, avg(value) as m, stddev(value) as s from events group by 1 having count(value) >= 2))"""


@query("stt9_anova", f"select round(((sq - sm * sm / t) / (k - 1)) / (w / (t - k)), 4) as statistic, k as n_groups from {_anova}")
def _(spark, sf):
    return tidy(hypothesis.anova(table(spark, sf, "events"), "value", "event_type").drop("p_value"))


@query("stt9_anova_p_value", f"select round({sqlmath.f_upper_four('f', 'd2')}, 6) as p_value from (select ((sq - sm * sm / t) / (k - 1)) / (w / (t - k)) as f, (t - k)::double as d2 from {_anova} where k = 5)")
def _(spark, sf):
    return tidy(hypothesis.anova(table(spark, sf, "events"), "value", "event_type").select("p_value"), 6)


@query("stt9_group_summary", 'select event_type as "group", count(value) as n, round(avg(value), 4) as mean, round(stddev(value), 4) as std from events group by 1 having count(value) >= 2')
def _(spark, sf):
    return tidy(hypothesis.group_summary(table(spark, sf, "events"), "value", "event_type"))


def _chi(a, b, src, yates=False):
    gap = "greatest(abs(o - e) - least(0.5, abs(o - e)), 0)" if yates else "(o - e)"
    return f"""with c as (select {a} as a, {b} as b, count(*) as n from {src} group by 1, 2), r as (select a, sum(n) as ra from c group by 1), k as (select b, sum(n) as cb from c group by 1),
      t as (select sum(n) as t from c), e as (select coalesce(c.n, 0) as o, ra * cb / t::double as e, t from r cross join k cross join t left join c on c.a = r.a and c.b = k.b),
      s as (select sum({gap} * {gap} / e) as x, max(t) as t from e)
      select round(x, 4) as statistic, ((select count(*) from r) - 1) * ((select count(*) from k) - 1) as degrees_of_freedom, round(sqrt(x / (t * (least((select count(*) from r), (select count(*) from k)) - 1))), 4) as cramers_v from s"""


@query("stt10_chi_square", _chi("p_brand", "p_type", "part"))
def _(spark, sf):
    return tidy(hypothesis.chi_square(table(spark, sf, "part"), "p_brand", "p_type").drop("p_value"))


YATES = Fixture("customer", "case when c_acctbal > 4000 then 'rich' else 'poor' end as wealth", "case when c_nationkey % 2 = 0 then 'even' else 'odd' end as side")


@query("stt10_chi_square_yates", _chi("wealth", "side", YATES.sql, True))
def _(spark, sf):
    return tidy(hypothesis.chi_square(YATES.df(spark, sf), "wealth", "side").drop("p_value"))


_x2 = _chi("p_brand", "p_type", "part").replace("round(x, 4) as statistic", "x as statistic")


@query("stt10_chi_square_p_value", f"select round({sqlmath.chi2_upper_even('statistic', 'degrees_of_freedom')}, 6) as p_value from ({_x2}) where degrees_of_freedom % 2 = 0")
def _(spark, sf):
    return tidy(hypothesis.chi_square(table(spark, sf, "part"), "p_brand", "p_type").select("p_value"), 6)


@query("stt11_mann_whitney", f"""with l as (select a as v, 1 as side from {TT.sql} where a is not null union all select b, 0 from {TT.sql} where b is not null),
  r as (select side, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as rk from l)
  select round(sum(rk) filter (side = 1) - count(*) filter (side = 1) * (count(*) filter (side = 1) + 1) / 2.0, 4) as statistic, count(*) filter (side = 1) as n_a, count(*) filter (side = 0) as n_b,
   (select round(median(a), 4) from {TT.sql}) as median_a, (select round(median(b), 4) from {TT.sql}) as median_b from r""")
def _(spark, sf):
    return tidy(hypothesis.mann_whitney(TT.df(spark, sf), "a", "b").drop("p_value"))


@query("stt11_mann_whitney_p_value", f"""with l as (select a as v, 1 as side from {TT.sql} where a is not null union all select b, 0 from {TT.sql} where b is not null),
  r as (select side, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as rk from l), k as (select sum(power(c, 3) - c) as ties from (select count(*)::double as c from l group by v)),
  u as (select sum(rk) filter (side = 1) - count(*) filter (side = 1) * (count(*) filter (side = 1) + 1) / 2.0 as u, (count(*) filter (side = 1))::double as na, (count(*) filter (side = 0))::double as nb from r),
  z as (select (greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))) as z from u, k)
  select round(least(1.0, 2 * (1 - {sqlmath.phi('least(6.0, z)')})), 6) as p_value from z""")
def _(spark, sf):
    return tidy(hypothesis.mann_whitney(TT.df(spark, sf), "a", "b").select("p_value"), 6)


_lab = "case when abs(r) > 0.9 then 'very strong' when abs(r) > 0.7 then 'strong' when abs(r) > 0.5 then 'moderate' when abs(r) > 0.3 then 'weak' else 'very weak' end as strength"


@query("stt12_pearson_test", f"select round(r, 4) as r, round(r * r, 4) as r_squared, {_lab}, n from (select corr(before, after) as r, count(*) as n from {TT.sql})")
def _(spark, sf):
    return tidy(hypothesis.pearson_test(TT.df(spark, sf), "before", "after").drop("p_value"))


@query("stt13_spearman_test", f"""with r as (select rank() over (order by before) + (count(*) over (partition by before) - 1) / 2.0 as x, rank() over (order by after) + (count(*) over (partition by after) - 1) / 2.0 as y from {TT.sql})
  select round(r, 4) as rho, round(r * r, 4) as r_squared, {_lab}, n from (select corr(x, y) as r, count(*) as n from r)""")
def _(spark, sf):
    return tidy(hypothesis.spearman_test(TT.df(spark, sf), "before", "after").drop("p_value"))


# Columns whose statistics are moderate, so that the p-values are neither 0 nor 1.
PV = Fixture("lineitem", "l_quantity as a", "l_quantity + (l_tax - 0.04) * 2 + l_discount - 0.05 as b", "l_tax as c")


def _r_p(r):
    return f"select {sqlmath.student_two_sided('t', 'dof')} as p from (select r * sqrt((n - 2) / (1 - r * r)) as t, n - 2 as dof from (select {r}))"


@query("stt7_student_p_value", f"select round({sqlmath.student_two_sided('t', 'dof')}, 6) as p_value from (select (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)) as t, na + nb - 2 as dof from {_tt})")
def _(spark, sf):
    return tidy(hypothesis.t_test(TT.df(spark, sf), "a", "b", True).select("p_value"), 6)


@query("stt8_paired_p_value", f"select round({sqlmath.student_two_sided('t', 'dof')}, 6) as p_value from (select avg(a - b) / (stddev(a - b) / sqrt(count(*))) as t, count(*) - 1 as dof from {PV.sql})")
def _(spark, sf):
    return tidy(hypothesis.paired_t_test(PV.df(spark, sf), "a", "b").select("p_value"), 6)


@query("stt12_pearson_p_value", f"select round(p, 6) as p_value from ({_r_p(f'corr(a, c) as r, count(*)::double as n from {PV.sql}')})")
def _(spark, sf):
    return tidy(hypothesis.pearson_test(PV.df(spark, sf), "a", "c").select("p_value"), 6)


_PV_RANKS = f"(select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as x, rank() over (order by c) + (count(*) over (partition by c) - 1) / 2.0 as y from {PV.sql})"


@query("stt13_spearman_p_value", f"select round(p, 6) as p_value from ({_r_p(f'corr(x, y) as r, count(*)::double as n from {_PV_RANKS}')})")
def _(spark, sf):
    return tidy(hypothesis.spearman_test(PV.df(spark, sf), "a", "c").select("p_value"), 6)
