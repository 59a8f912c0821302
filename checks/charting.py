"""Chart data, recommenders, reports, insights and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import EV_GAPS, LI_SPIKES, Fixture, query, scratch, table, tidy, union_all
from checks.distributions import _box, _hist, _kde
from lumenframe.operators import charts, filters
from lumenframe.operators.charts import ChartSpec
from lumenframe.plans import eda, insights, questions, recommend
from lumenframe.sources import writers

LI = Fixture("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "cast(l_suppkey % 40 as varchar(10)) as lane", "l_extendedprice")
LS = LI.sql


def _top(col, k, src=LS):
    return f"(select {col} from {src} where {col} is not null group by 1 order by count(*) desc, {col} limit {k})"


def _li(spark, sf):
    return LI.df(spark, sf)


# --- charts --------------------------------------------------------------------------------------------


@query("cht1_bar", f"select lane as x, round(avg(l_quantity), 4) as y from {LS} where lane in {_top('lane', 25)} group by 1")
def _(spark, sf):
    return tidy(charts.chart_data(_li(spark, sf), ChartSpec("bar", {"x": "lane", "y": "l_quantity"})))


_AGGS = {"sum": "sum(l_quantity)", "count": "count(l_quantity)::double", "min": "min(l_quantity)", "max": "max(l_quantity)", "median": "median(l_quantity)", "std": "stddev(l_quantity)", "nunique": "count(distinct l_quantity)::double"}


def _bar_agg(name):
    @query(f"cht1_bar_{name}", f"select lane as x, round({_AGGS[name]}, 4) as y from {LS} where lane in {_top('lane', 25)} group by 1")
    def _(spark, sf):
        return tidy(charts.bar(_li(spark, sf), "lane", "l_quantity", name))


for _name in _AGGS:
    _bar_agg(_name)


@query("cht2_stacked_bar", f"select lane as x, l_returnflag as color, round(avg(l_quantity), 4) as y from {LS} where lane in {_top('lane', 15)} group by 1, 2")
def _(spark, sf):
    return tidy(charts.chart_data(_li(spark, sf), ChartSpec("stacked_bar", {"x": "lane", "y": "l_quantity", "color": "l_returnflag"})))


@query("cht3_horizontal_bar", f"select lane as x, round(sum(l_quantity), 4) as y from {LS} where lane in {_top('lane', 20)} group by 1")
def _(spark, sf):
    return tidy(charts.chart_data(_li(spark, sf), ChartSpec("horizontal_bar", {"x": "lane", "y": "l_quantity", "agg": "sum"})))


GB = Fixture("lineitem", "l_quantity", "cast(l_suppkey % 40 as varchar(10)) as lane", "cast(l_partkey % 20 as varchar(10)) as shade")


@query("cht4_grouped_bar", f"select lane as x, shade as color, round(avg(l_quantity), 4) as y from {GB.sql} where lane in {_top('lane', 12, GB.sql)} and shade in {_top('shade', 8, GB.sql)} group by 1, 2")
def _(spark, sf):
    return tidy(charts.chart_data(GB.df(spark, sf), ChartSpec("grouped_bar", {"x": "lane", "y": "l_quantity", "color": "shade"})))


def _line(kind):
    @query(f"cht5_{kind}", f"select strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as x, value as y from {EV_GAPS.sql} where value is not null")
    def _(spark, sf):
        out = charts.chart_data(EV_GAPS.df(spark, sf), ChartSpec(kind, {"x": "ts", "y": "value"}))
        return out.withColumn("x", F.date_format("x", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


for _name in ("line", "area", "spline"):
    _line(_name)


@query("cht5_line_color", f"select strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as x, value as y, event_type as color from {EV_GAPS.sql} where value is not null and event_type is not null")
def _(spark, sf):
    out = charts.chart_data(EV_GAPS.df(spark, sf), ChartSpec("line", {"x": "ts", "y": "value", "color": "event_type"}))
    return out.withColumn("x", F.date_format("x", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("cht5_line_downsampled", """select b::bigint as bucket, min(value) as y_min, max(value) as y_max, round(avg(value), 4) as y_mean, count(*) as n from (
  select value, least(floor((event_id - lo) / ((hi - lo)::double / 100)), 99) as b from events, (select min(event_id) as lo, max(event_id) as hi from events)) group by 1""")
def _(spark, sf):
    pts = charts.series(table(spark, sf, "events"), "event_id", "value")
    return tidy(charts.downsample(pts, 100).drop("x"))


def _pie(kind):
    @query(f"cht6_{kind}", "select p_brand as x, count, round(count / sum(count) over (), 6) as share from (select p_brand, count(*) as count from part group by 1 order by 2 desc, 1 limit 12)")
    def _(spark, sf):
        return tidy(charts.chart_data(table(spark, sf, "part"), ChartSpec(kind, {"x": "p_brand"})), 6)


for _name in ("pie", "donut"):
    _pie(_name)


@query("cht7_scatter", f"select user_id as x, value as y, event_type as color from {EV_GAPS.sql} where value is not null")
def _(spark, sf):
    return charts.chart_data(EV_GAPS.df(spark, sf), ChartSpec("scatter", {"x": "user_id", "y": "value", "color": "event_type"}))


@query("cht7_bubble", f"select event_id as x, value as y, user_id::double as size, event_type as color from {EV_GAPS.sql} where value is not null and event_type is not null")
def _(spark, sf):
    return charts.chart_data(EV_GAPS.df(spark, sf), ChartSpec("bubble", {"x": "event_id", "y": "value", "size": "user_id", "color": "event_type"}))


def _histogram(kind):
    @query(f"cht8_{kind}", f"select bin, lower, upper, count from ({_hist('value', 'events', 30)})")
    def _(spark, sf):
        return tidy(charts.chart_data(table(spark, sf, "events"), ChartSpec(kind, {"x": "value"})), 6)


for _name in ("histogram", "distribution"):
    _histogram(_name)

HM = Fixture("lineitem", "case when l_orderkey % 7 = 0 then null else l_quantity end as a", "case when l_partkey % 5 = 0 then null else l_quantity + l_discount * 100 end as b", "l_tax - l_discount as c")


def _complete(x, y):
    return f"select '{x}' as x, '{y}' as y, round(corr({x}, {y}), 6) + 0.0 as r from {HM.sql} where {x} is not null and {y} is not null"


@query("cht9_heatmap", " union all ".join([_complete(x, y) for x in "abc" for y in "abc" if x != y] + [f"select '{x}', '{x}', 1.0::double" for x in "abc"]))
def _(spark, sf):
    return tidy(charts.chart_data(HM.df(spark, sf), ChartSpec("heatmap")), 6)


@query("cht10_correlation_heatmap", " union all ".join(_complete(x, y) for x, y in ("ab", "ac", "bc")))
def _(spark, sf):
    return tidy(charts.chart_data(HM.df(spark, sf), ChartSpec("correlation_heatmap")), 6)


def _tree(kind):
    @query(f"cht11_{kind}", "select p_type as path, round(sum(p_retailprice), 2) as value from part group by 1")
    def _(spark, sf):
        return tidy(charts.chart_data(table(spark, sf, "part"), ChartSpec(kind, {"path": "p_type", "y": "p_retailprice"})), 2)


for _name in ("treemap", "sunburst"):
    _tree(_name)


@query("cht11_treemap_counts", "select p_type as path, count(*)::double as value from part group by 1")
def _(spark, sf):
    return charts.treemap(table(spark, sf, "part"), "p_type")


_TYPES = ["click", "error", "purchase", "signup", "view"]


def _by_type(template):
    return union_all(_TYPES, lambda t: f"""select '{t}' as category, * exclude ("column") from ({template('value', f"(select value from events where event_type = '{t}')")})""")


@query("cht12_box", _by_type(_box))
def _(spark, sf):
    return tidy(charts.chart_data(table(spark, sf, "events"), ChartSpec("box", {"x": "event_type", "y": "value"})))


@query("cht12_violin", _by_type(_kde))
def _(spark, sf):
    out = charts.chart_data(table(spark, sf, "events"), ChartSpec("violin", {"x": "event_type", "y": "value"}))
    return out.withColumns({"point": F.col("point").cast("bigint"), "x": F.round("x", 4), "density": F.round("density", 8)})


@query("cht12_density", f'select * exclude ("column") from ({_kde("value", "events")})')
def _(spark, sf):
    out = charts.chart_data(table(spark, sf, "events"), ChartSpec("density", {"x": "value"}))
    return out.withColumns({"point": F.col("point").cast("bigint"), "x": F.round("x", 4), "density": F.round("density", 8)})


@query("cht13_radar", "select p_brand as category, round(avg(p_size), 4) as p_size, round(avg(p_retailprice), 4) as p_retailprice from part group by 1 order by 1 limit 10")
def _(spark, sf):
    return tidy(charts.chart_data(table(spark, sf, "part"), ChartSpec("radar", {"x": "p_brand", "values": ["p_size", "p_retailprice"]})))


@query("cht14_waterfall", f"select row_number() over (order by event_id) as step, event_type as x, value as y, round(sum(value) over (order by event_id), 4) as total from (select * from {EV_GAPS.sql} where value is not null and event_type is not null order by event_id limit 20)")
def _(spark, sf):
    return tidy(charts.waterfall(EV_GAPS.df(spark, sf), "event_type", "value", ["event_id"]))


@query("cht15_funnel", "select c_name as x, c_acctbal as y, round(100.0 * c_acctbal / max(c_acctbal) over (), 4) + 0.0 as percent_of_first from customer")
def _(spark, sf):
    return tidy(charts.chart_data(table(spark, sf, "customer"), ChartSpec("funnel", {"x": "c_name", "y": "c_acctbal"})))


@query("cht16_gauge", "select round(avg(value), 4) as value, 100.0::double as max, case when avg(value) < 50 then 'low' when avg(value) < 80 then 'middle' else 'high' end as band from events")
def _(spark, sf):
    return tidy(charts.chart_data(table(spark, sf, "events"), ChartSpec("gauge", {"y": "value", "max": 100})))


def _kpi(agg, sql):
    @query(f"cht17_kpi_{agg}", f"select round({sql}, 4) as value from events")
    def _(spark, sf):
        config = {"agg": agg, "x": "value"} if agg != "rows" else {}
        return tidy(charts.chart_data(table(spark, sf, "events"), ChartSpec("kpi", config)))


for _name, _sql in {"mean": "avg(value)", "max": "max(value)", "median": "median(value)", "std": "stddev(value)", "count": "count(value)::double", "rows": "count(*)::double"}.items():
    _kpi(_name, _sql)


@query("cht18_data_table", "select event_id, event_type, value from events order by event_id limit 50")
def _(spark, sf):
    spec = ChartSpec("data_table", {"columns": ["event_id", "event_type", "value"]})
    return charts.chart_data(table(spark, sf, "events"), spec, ["event_id"])


@query("cht19_time_series", """with r as (select o_orderkey, o_orderdate, o_totalprice, row_number() over (order by o_orderdate, o_orderkey) as i from orders)
  select i, strftime(o_orderdate, '%Y-%m-%d') as x, o_totalprice as y, case when i >= 10 then round(avg(o_totalprice) over (order by i rows between 9 preceding and current row), 3) end as trend from r""")
def _(spark, sf):
    out = charts.time_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", ["o_orderkey"], rows_per_bucket=1700)
    return out.withColumns({"x": F.date_format("x", "yyyy-MM-dd"), "trend": F.round("trend", 3)})


@query("cht20_forecast", """with r as (select o_totalprice as v, row_number() over (order by o_orderdate, o_orderkey) as i, count(*) over () as n from orders),
  e as (select max(v) filter (i = n) as b, max(v) filter (i = n - n // 3 + 1) as a, max(n // 3) as k from r) select s::bigint as step, round(b + (b - a) / k * s, 4) as value from e, range(1, 6) t(s)""")
def _(spark, sf):
    return tidy(charts.forecast(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", 5, ["o_orderkey"]))


@query("cht20_forecast_chart", """with r as (select epoch_us(o_orderdate) as x, o_totalprice as v, row_number() over (order by o_orderdate, o_orderkey) as i, count(*) over () as n from orders),
  e as (select max(v) filter (i = n) as b, max(v) filter (i = n - n // 3 + 1) as a, max(n // 3) as k, max(n) as n, max(x) filter (i = n) as xn, max(x) filter (i = 1) as x1 from r)
  select i, x // 1000000 as seconds, round(v, 4) as y, false as is_forecast from r
  union all select n + s, cast(floor((xn + (xn - x1) / (n - 1) * s) / 1000000) as bigint), round(b + (b - a) / k * s, 4), true from e, range(1, 6) t(s)""")
def _(spark, sf):
    out = charts.forecast_chart(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", 5, ["o_orderkey"])
    return tidy(out.select("i", F.unix_seconds(F.col("x").cast("timestamp")).alias("seconds"), "y", "is_forecast"))


@query("cht21_outlier", "select value, not (value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as is_outlier from events, (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events)")
def _(spark, sf):
    return charts.chart_data(table(spark, sf, "events"), ChartSpec("outlier", {"x": "value"}))


@query("cht22_kpi_trend", union_all(["value", "user_id"], lambda c: f"""select '{c}' as "column", round(avg({c}), 4) as mean, round(median({c}), 4) as median,
  case when avg({c}) > median({c}) * 1.1 then 'up' when avg({c}) < median({c}) * 0.9 then 'down' else 'flat' end as trend from events"""))
def _(spark, sf):
    return tidy(charts.kpi_trend(table(spark, sf, "events"), ["value", "user_id"]))


@query("cht23_chart_insight_scatter", f"""with s as (select avg(user_id) as m, stddev(user_id) as sd, min(user_id)::double as lo, max(user_id)::double as hi, skewness(user_id) as sk,
   avg(value) as ym, median(value) as yq, corr(user_id, value) as r from {EV_GAPS.sql})
  select fact, round(number, 4) + 0.0 as number, label from (select 'x_mean' as fact, m as number, null::varchar as label from s union all select 'x_std', sd, null from s union all select 'x_min', lo, null from s union all select 'x_max', hi, null from s
   union all select 'x_skew', sk, 'log transform' from s where abs(sk) > 1 union all select 'y_mean', ym, null from s union all select 'y_median', yq, null from s
   union all select 'xy_r', r, case when abs(r) > 0.7 then 'strong' when abs(r) > 0.3 then 'moderate' else 'weak' end from s
   union all select 'confidence', least(95, 70 + 5 * (3 + (abs(sk) > 1)::int)), null from s)""")
def _(spark, sf):
    # pairwise rows: user_id is always present, so the correlation is over rows with a value
    return tidy(charts.chart_insight(EV_GAPS.df(spark, sf), ChartSpec("scatter", {"x": "user_id", "y": "value"})))


@query("cht23_chart_insight_bar", f"""with g as (select event_type as v, count(*) as n from {EV_GAPS.sql} where event_type is not null group by 1), t as (select v, n from g order by n desc, v limit 1), c as (select count(*) as rows from {EV_GAPS.sql})
  select 'x_unique' as fact, count(*)::double as number, null::varchar as label from g union all select 'x_mode', n::double, v from t union all select 'x_dominant', n::double / rows, 'group rare values' from t, c where n > rows * 0.5
  union all select 'y_mean', round(avg(value), 4), null from {EV_GAPS.sql} union all select 'y_median', round(median(value), 4), null from {EV_GAPS.sql} union all select 'confidence', 80, null""")
def _(spark, sf):
    return tidy(charts.chart_insight(EV_GAPS.df(spark, sf), ChartSpec("bar", {"x": "event_type", "y": "value"})))


# --- recommenders ------------------------------------------------------------------------------------------


@query("rec1_suggest_charts", """select * from (values (1::bigint, 1::bigint, 'scatter', 'event_id', 'user_id', null), (2, 1, 'scatter', 'user_id', 'value', null), (3, 1, 'line', 'ts', 'event_id', null),
  (4, 2, 'bar', 'event_type', 'event_id', 'mean'), (5, 3, 'histogram', 'event_id', null, null), (6, 3, 'histogram', 'user_id', null, null), (7, 3, 'histogram', 'value', null, null),
  (8, 4, 'box', 'event_type', 'event_id', null)) t(position, priority, chart_type, x, y, agg) where (select count(*) from events) > 0""")
def _(spark, sf):
    return tidy(recommend.suggest_charts(table(spark, sf, "events")))


@query("rec2_recommend_charts", """with s as (select count(distinct event_type) as t, count(distinct props) as p, corr(event_id, user_id) as r1, corr(user_id, value) as r2, skewness(event_id) as k1, skewness(user_id) as k2, skewness(value) as k3 from events)
  select row_number() over (order by confidence desc, o) as position, confidence::bigint as confidence, category, chart_type, x, y, agg, round(metric, 4) + 0.0 as metric from (
   select 1 as o, 95 as confidence, 'trend' as category, 'line' as chart_type, 'ts' as x, 'event_id' as y, null as agg, null::double as metric from s union all select 2, 95, 'trend', 'line', 'ts', 'user_id', null, null from s
   union all select 3, 85, 'composition', 'pie', 'event_type', null, null, t::double from s where t <= 8 union all select 4, 90, 'comparison', 'bar', 'event_type', 'event_id', 'count', null from s
   union all select 5, 85, 'composition', 'pie', 'props', null, null, p::double from s where p <= 8 union all select 6, 90, 'comparison', 'bar', 'props', 'event_id', 'count', null from s
   union all select 7, 88, 'comparison', 'bar', 'event_type', 'event_id', 'mean', null from s union all select 8, 88, 'comparison', 'bar', 'event_type', 'user_id', 'mean', null from s
   union all select 9, 88, 'comparison', 'bar', 'props', 'event_id', 'mean', null from s union all select 10, 88, 'comparison', 'bar', 'props', 'user_id', 'mean', null from s
   union all select 11, 90, 'distribution', 'histogram', 'event_id', null, null, k1 from s union all select 12, 90, 'distribution', 'histogram', 'user_id', null, null, k2 from s union all select 13, 90, 'distribution', 'histogram', 'value', null, null, k3 from s
   union all select 14, case when abs(r1) > 0.3 then 85 else 70 end, 'relationship', 'scatter', 'event_id', 'user_id', null, r1 from s union all select 15, case when abs(r2) > 0.3 then 85 else 70 end, 'relationship', 'scatter', 'user_id', 'value', null, r2 from s
   union all select 16, 82, 'distribution', 'box', 'event_type', 'event_id', null, null from s where t <= 15)""")
def _(spark, sf):
    return tidy(recommend.recommend_charts(table(spark, sf, "events")))


_LINUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("rec3_target_candidates", 'select * from (' + union_all(_LINUM, lambda c: f"""select '{c}' as "column", count(distinct {c}) as unique_values,
  case when count(distinct {c}) between 2 and least(20, count(*) * 0.05) then 'classification' when count(distinct {c}) > 20 and count(distinct {c}) > count(*) * 0.05 then 'regression' end as task from lineitem""") + ") where task is not null")
def _(spark, sf):
    return recommend.target_candidates(table(spark, sf, "lineitem"))


@query("rec4_kpi_candidates", """select position, "column", kpi_kind, non_null from (select position, "column", (select count(*) from orders) as non_null, case when regexp_matches("column", 'revenue|sales|amount|total|income') then 'revenue' when regexp_matches("column", 'profit|margin|gain|net') then 'profit'
   when regexp_matches("column", 'cost|expense|spend|price') then 'cost' when regexp_matches("column", 'count|quantity|orders|transactions|units') then 'count' when regexp_matches("column", 'rate|ratio|percent|conversion|growth') then 'rate'
   when regexp_matches("column", 'customer|user|client|subscriber') then 'customer' when regexp_matches("column", 'date|time|period|month|year|day') then 'date' end as kpi_kind
  from (select unnest(range(0, 6)) as position, unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) as "column") where (select count(*) from orders) > 0) where kpi_kind is not null""")  # orders has no nulls
def _(spark, sf):
    return tidy(recommend.kpi_candidates(table(spark, sf, "orders")))


BL = Fixture("labels", "doc_id", "quality", "toxic", "case when quality = 1 then 'yes' else 'no' end as word", "quality = 1 as flag", "cast(quality + 1 as bigint) as shifted")


@query("rec5_boolean_like", f"""select c as "column" from (select 'quality' as c, count(distinct quality) = 2 and bool_and(quality in (0, 1)) as ok from {BL.sql} union all select 'toxic', count(distinct toxic) = 2 and bool_and(toxic in (0, 1)) from {BL.sql}
  union all select 'word', count(distinct word) = 2 and bool_and(word in ('yes', 'no')) from {BL.sql} union all select 'flag', true union all select 'shifted', bool_and(shifted in (0, 1)) from {BL.sql}) where ok""")
def _(spark, sf):
    return recommend.boolean_like(BL.df(spark, sf))


@query("fea17_recommend_features", f"""with s as (select count(distinct event_type) as k, count(*) - count(value) as gaps from {EV_GAPS.sql})
  select row_number() over (order by o) as position, operation, columns, priority, n as unique_count from (select 1 as o, case when k <= 10 then 'onehot' else 'label' end as operation, 'event_type' as columns, case when k <= 10 then 'medium' else 'low' end as priority, k as n from s where k <= 50
   union all select 2, 'standardize', 'event_id, user_id, value', 'medium', null union all select 3, 'date_features', 'ts', 'high', null union all select 4, 'missing_indicator', 'value', 'low', null from s where gaps > 0
   union all select 5, 'binning', 'event_id', 'low', null union all select 6, 'binning', 'user_id', 'low', null union all select 7, 'binning', 'value', 'low', null)""")
def _(spark, sf):
    return tidy(recommend.recommend_features(EV_GAPS.df(spark, sf)))


# --- exploratory report ------------------------------------------------------------------------------------


def _fenced(c, src):
    return f"(select quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as hi, avg({c}) as m, stddev({c}) as s from {src})"


@query("eda1_outlier_analysis", """select *, case when percentage > 10 then 'high' when percentage > 5 then 'medium' else 'low' end as severity from (""" + union_all(["price", "qty", "l_discount"], lambda c: f"""select '{c}' as "column",
  count(*) filter ({c} < lo or {c} > hi) as iqr_outliers, count(*) filter (abs({c} - m) / s > 3) as zscore_outliers, round(100.0 * count(*) filter ({c} < lo or {c} > hi) / count({c}), 2) as percentage,
  round(max(lo), 4) as lower_fence, round(max(hi), 4) as upper_fence from {LI_SPIKES.sql}, {_fenced(c, LI_SPIKES.sql)}""") + ")")
def _(spark, sf):
    return tidy(eda.outlier_analysis(LI_SPIKES.df(spark, sf), ["price", "qty", "l_discount"]))


INTEL = Fixture("customer", "c_custkey", "c_name", "c_mktsegment", "concat('u', cast(c_custkey as varchar(20)), '@x.org') as contact", "concat('https://x.org/', cast(c_custkey % 3 as varchar(20))) as link",
                "concat('555-0', cast(100000 + c_custkey as varchar(20))) as phone", "concat('$', cast(c_custkey % 5 as varchar(20))) as fee", "case when c_custkey % 2 = 0 then 'Yes' else 'no' end as opted", "cast(null as varchar(10)) as nothing", "c_acctbal as country_lat")


@query("typ6_column_intelligence", f"""with n as (select count(*) as n from {INTEL.sql}) select "column", kind, tags || case when regexp_matches("column", 'password|ssn|social|credit|card|secret|token|key') then ',sensitive' else '' end
    || case when regexp_matches("column", 'city|state|country|address|zip|lat|lon|location') then ',location' else '' end as tags, unique_count, round(100.0 * unique_count / nullif(present, 0), 2) as unique_pct_raw from (
   select 'c_custkey' as "column", 'numeric' as kind, 'possible_id,numeric' as tags, count(distinct c_custkey) as unique_count, count(c_custkey) as present from {INTEL.sql}
   union all select 'c_name', 'categorical', 'identifier,high_cardinality', count(distinct c_name), count(c_name) from {INTEL.sql} union all select 'c_mktsegment', 'categorical', 'categorical', count(distinct c_mktsegment), count(c_mktsegment) from {INTEL.sql}
   union all select 'contact', 'categorical', 'identifier,emails,high_cardinality', count(distinct contact), count(contact) from {INTEL.sql} union all select 'link', 'categorical', 'urls,categorical', count(distinct link), count(link) from {INTEL.sql}
   union all select 'phone', 'categorical', 'identifier,phone_numbers,high_cardinality', count(distinct phone), count(phone) from {INTEL.sql} union all select 'fee', 'categorical', 'currency,categorical', count(distinct fee), count(fee) from {INTEL.sql}
   union all select 'opted', 'categorical', 'boolean,categorical', count(distinct opted), count(opted) from {INTEL.sql} union all select 'nothing', 'empty', '', 0, 0
   union all select 'country_lat', 'numeric', case when count(distinct country_lat) = count(country_lat) then 'possible_id,numeric' else 'numeric' end, count(distinct country_lat), count(country_lat) from {INTEL.sql})""".replace("as unique_pct_raw", "as unique_pct").replace("round(100.0 * unique_count / nullif(present, 0), 2)", "coalesce(round(100.0 * unique_count / nullif(present, 0), 2), 0.0)"))
def _(spark, sf):
    return eda.column_intelligence(INTEL.df(spark, sf))


ML = Fixture("customer", "c_custkey", "c_name", "c_mktsegment", "case when c_custkey % 5 = 0 then null else c_acctbal end as balance", "cast(1.0 as double) as one", "c_nationkey")
_MLF = f"""(select 100.0 * (count(*) - count(balance)) / (6 * count(*)) as missing, count(*) as n, count(distinct balance) as ub, count(distinct c_nationkey) as un, 100.0 * (count(*) - (select count(*) from (select distinct * from {ML.sql}))) / count(*) as dup from {ML.sql})"""
_MLSCORE = "greatest(0, least(100, round(100 - case when missing > 30 then 30 when missing > 10 then 15 when missing > 5 then 5 else 0 end - case when dup > 20 then 15 when dup > 5 then 5 else 0 end - 5 - 3 - case when n < 100 then 20 when n < 1000 then 10 else 0 end, 1)))::double"


def _ml(spark, sf):
    from lumenframe.operators.describe import column_profile
    from lumenframe.operators.frequency import duplicate_rows

    df = ML.df(spark, sf)
    return eda.ml_facts(column_profile(df), duplicate_rows(df))


@query("eda2_ml_readiness", f"""select {_MLSCORE} as score, case when {_MLSCORE} >= 80 then 'Excellent' when {_MLSCORE} >= 60 then 'Good' when {_MLSCORE} >= 40 then 'Fair' else 'Poor' end as status, 4::bigint as numeric_features, 2::bigint as categorical_features,
  concat_ws(', ', case when ub / n::double > 0.01 and ub / n::double < 0.8 then 'balance' end, case when un / n::double > 0.01 and un / n::double < 0.8 then 'c_nationkey' end) as target_candidates, 'one' as constant_features, 'c_name' as high_cardinality_features,
  case when missing > 20 then 'high' when missing > 5 then 'medium' else 'low' end as missing_impact, true as encoding_needed, true as scaling_needed from {_MLF}""")
def _(spark, sf):
    return tidy(eda.ml_readiness(_ml(spark, sf)))


@query("eda3_ml_recommendations", f"""select rule, priority, topic from (select 1::bigint as rule, 'high' as priority, 'missing' as topic, missing > 5 as ok from {_MLF} union all select 2, 'high', 'duplicates', dup > 5 from {_MLF} union all select 3, 'medium', 'constant', true
  union all select 4, 'medium', 'high_cardinality', true union all select 5, 'low', 'scaling', true union all select 6, 'medium', 'small_data', n < 1000 from {_MLF}) where ok""")
def _(spark, sf):
    return tidy(eda.ml_recommendations(_ml(spark, sf)).select("rule", "priority", "topic"))


def _events_report(spark, sf, kind="full"):
    return eda.eda_report(EV_GAPS.df(spark, sf), kind)


@query("eda4_insights")
def _(spark, sf):
    return _events_report(spark, sf)["insights"]


@query("eda4_insight_rules", f"""with s as (select skewness(value) as sk, kurtosis(value) as ku, count(*) - count(value) as gaps, count(distinct ts) > floor(count(*) * 0.5) as wide from {EV_GAPS.sql})
  select rule::bigint as rule from (select 1 as rule, true as ok union all select 2, true union all select 3, true union all select 5, abs(sk) > 0.5 from s union all select 7, gaps > 0 from s union all select 8, wide from s) where ok""")
def _(spark, sf):
    return tidy(_events_report(spark, sf)["insights"].select("rule"))


@query("eda5_business_summary")
def _(spark, sf):
    return _events_report(spark, sf)["business"]


@query("eda6_column_details", f"""select position::int as position, "column", kind, n - gaps as non_null, gaps as null_count, round(100.0 * gaps / n, 2) as null_pct, u as unique_count, tags from (
  select 0 as position, 'event_id' as "column", 'numeric' as kind, count(*) as n, count(*) - count(event_id) as gaps, count(distinct event_id) as u, 'possible_id,numeric' as tags from {EV_GAPS.sql}
  union all select 1, 'ts', 'datetime', count(*), count(*) - count(ts), count(distinct ts), 'datetime' from {EV_GAPS.sql} union all select 2, 'user_id', 'numeric', count(*), count(*) - count(user_id), count(distinct user_id), 'numeric' from {EV_GAPS.sql}
  union all select 3, 'event_type', 'categorical', count(*), count(*) - count(event_type), count(distinct event_type), 'categorical' from {EV_GAPS.sql} union all select 4, 'value', 'numeric', count(*), count(*) - count(value), count(distinct value), 'numeric' from {EV_GAPS.sql})""")
def _(spark, sf):
    return _events_report(spark, sf, "quick")["column_details"].withColumn("position", F.col("position").cast("int"))


@query("eda7_report_overview", f"""select count(*) as rows, 5::bigint as columns, 3::bigint as numeric_columns, 1::bigint as categorical_columns, 1::bigint as datetime_columns, 0::bigint as boolean_columns,
  round(100.0 * (2 * count(*) - count(event_type) - count(value)) / (5 * count(*)), 2) as missing_pct, 0.0::double as duplicate_pct from {EV_GAPS.sql}""")
def _(spark, sf):
    return _events_report(spark, sf, "executive")["overview"]


@query("eda7_report_sections", """select * from (values ('full', true, true), ('quick', false, false), ('technical', true, true), ('business', false, false), ('executive', false, false)) t(profile, has_correlation, has_distribution) where (select count(*) from events) > 0""")
def _(spark, sf):
    rows = []
    for name, report in eda.eda_reports(EV_GAPS.df(spark, sf)).items():
        rows.append((name, *(s in report and report[s].count() > 0 for s in ("correlation", "distribution"))))
    return spark.createDataFrame(rows, "profile string, has_correlation boolean, has_distribution boolean")


@query("snk6_eda_export", f"""select 'value' as "column", count(value) as count, round(avg(value), 4) as mean, round(median(value), 4) as median from {EV_GAPS.sql}""")
def _(spark, sf):
    path = scratch(spark)
    writers.export_sections(_events_report(spark, sf, "quick"), path)
    return spark.read.json(f"{path}/statistics").where(F.col("column") == "value").select("column", "count", "mean", "median")


# --- statistical insights and questions --------------------------------------------------------------------


INS = Fixture("lineitem", "l_orderkey", "case when l_orderkey % 3 = 1 then null else l_quantity end as quantity", "case when l_orderkey % 3 = 0 then null else l_extendedprice * 2 end as total", "case when l_orderkey % 11 = 0 then l_tax * 1000 else l_tax end as rate", "l_extendedprice as amount", "l_returnflag")


def _ins(spark, sf):
    df = INS.df(spark, sf)
    return insights.dataset_statistics(df)


@query("ins1_totals", f"""select count(*) as rows, 6::bigint as columns, round(100.0 * (2 * count(*) - count(quantity) - count(total)) / (6 * count(*)), 2) as total_missing_pct,
  count(*) - (select count(*) from (select distinct * from {INS.sql})) as duplicate_rows, round(100.0 * (count(*) - (select count(*) from (select distinct * from {INS.sql}))) / count(*), 2) as duplicate_pct from {INS.sql}""")
def _(spark, sf):
    return _ins(spark, sf)["totals"].drop("score", "status")


_INSQ = {c: _fenced(c, INS.sql) for c in ("l_orderkey", "quantity", "total", "rate", "amount")}
_INS_NUM = union_all(list(_INSQ), lambda c: f"""select '{c}' as "column", round(100.0 * count(*) filter ({c} < lo or {c} > hi) / count({c}), 2) as outlier_pct, skewness({c}) as sk from {INS.sql}, {_INSQ[c]}""")


@query("ins2_statistical_insights", f"""with m as (select round(100.0 * (2 * count(*) - count(quantity) - count(total)) / (6 * count(*)), 2) as p from {INS.sql}), r as ({_INS_NUM}),
   f as (select coalesce(quantity, 0.0) as quantity, coalesce(total, 0.0) as total, rate, amount, l_orderkey::double as l_orderkey from {INS.sql}),
   k as ({union_all([("l_orderkey", "quantity"), ("l_orderkey", "total"), ("l_orderkey", "rate"), ("l_orderkey", "amount"), ("quantity", "total"), ("quantity", "rate"), ("quantity", "amount"), ("total", "rate"), ("total", "amount"), ("rate", "amount")], lambda p: f"select '{p[0]}' as a, '{p[1]}' as b, corr({p[0]}, {p[1]}) as r from f")})
  select 'quality_missing' as id, 'quality' as category, case when p > 30 then 'critical' else 'high' end as priority, least(10, floor(p / 5))::bigint as impact_score from m where p > 10
  union all select 'outlier_' || "column", 'outlier', case when outlier_pct > 10 then 'high' else 'medium' end, least(10, floor(outlier_pct))::bigint from r where outlier_pct > 5
  union all select 'dist_' || "column", 'distribution', 'medium', 5 from r where abs(sk) > 1
  union all select 'corr_' || a || '_' || b, 'correlation', 'high', 7 from (select * from k order by abs(r) desc limit 5) where abs(r) > 0.7
  union all select 'kpi_' || c, 'kpi', 'medium', 6 from (values ('l_orderkey'), ('quantity'), ('total'), ('rate'), ('amount')) t(c) where c <> 'l_orderkey'""")
def _(spark, sf):
    stats = _ins(spark, sf)
    return tidy(insights.statistical_insights(stats).select("id", "category", "priority", "impact_score"))


# Five text and date columns come before the first numeric one.
INS_MIXED = Fixture(
    "lineitem", "l_returnflag as f1", "l_linestatus as f2", "l_shipdate as d1", "concat(l_returnflag, l_linestatus) as f3", "l_shipdate as d2",
    "l_quantity * l_quantity * l_quantity * l_quantity as weight", "l_tax as rate",
)


@query("ins2_skew_behind_text_columns", f"""select 'dist_' || c as id, round(sk, 4) as skewness from (
  select 'weight' as c, skewness(weight) as sk from {INS_MIXED.sql} union all select 'rate', skewness(rate) from {INS_MIXED.sql}) where abs(sk) > 1""")
def _(spark, sf):
    stats = insights.dataset_statistics(INS_MIXED.df(spark, sf))
    found = insights.statistical_insights(stats).where("category = 'distribution'").select("id")
    shapes = stats["shapes"].select(F.concat(F.lit("dist_"), "column").alias("id"), "skewness")
    return tidy(found.join(shapes, "id"))


@query("ins1_collinear_pairs", f"""with f as (select coalesce(quantity, 0.0) as quantity, coalesce(total, 0.0) as total, rate, amount, l_orderkey::double as l_orderkey from {INS.sql}),
   k as ({union_all([("l_orderkey", "quantity"), ("l_orderkey", "total"), ("l_orderkey", "rate"), ("l_orderkey", "amount"), ("quantity", "total"), ("quantity", "rate"), ("quantity", "amount"), ("total", "rate"), ("total", "amount"), ("rate", "amount")], lambda p: f"select '{p[0]}' as a, '{p[1]}' as b, corr({p[0]}, {p[1]}) as r from f")})
  select count(*) filter (abs(r) > 0.9) as collinear, count(*) filter (abs(r) > 0.7) as strong, count(*) as pairs from k""")
def _(spark, sf):
    stats = _ins(spark, sf)
    return tidy(stats["pairs"].agg(F.count_if(F.col("abs_value") > 0.9).alias("collinear"), F.count_if(F.col("abs_value") > 0.7).alias("strong"), F.count("*").alias("pairs")))


@query("ins3_quality_score", f"""select score, case when score >= 90 then 'excellent' when score >= 70 then 'good' when score >= 50 then 'fair' else 'poor' end as status from (
  select round(greatest(0, 100 - 2 * round(100.0 * (2 * count(*) - count(quantity) - count(total)) / (6 * count(*)), 2) - round(100.0 * (count(*) - (select count(*) from (select distinct * from {INS.sql}))) / count(*), 2)), 4) as score from {INS.sql})""")
def _(spark, sf):
    return tidy(_ins(spark, sf)["totals"].select("score", "status"))


@query("flt12_insight_filter", f"select 'dist_' || \"column\" as id, 'medium' as priority from ({_INS_NUM}) where abs(sk) > 1")
def _(spark, sf):
    stats = _ins(spark, sf)
    found = insights.statistical_insights(stats)
    return filters.filter_insights(found, "SKEW", "medium", "distribution").select("id", "priority")


@query("snk5_insights_export")
def _(spark, sf):
    stats = _ins(spark, sf)
    rows = insights.export_rows(insights.statistical_insights(stats), insights.risks(stats), insights.kpi_rows(stats))
    path = scratch(spark)
    writers.write_csv(rows, path)
    return spark.read.csv(path, header=True, escape='"')


@query("qst1_suggested_questions", """select * from (values (1::bigint, 'average', 'event_id', null), (2, 'distribution', 'event_id', null), (3, 'top_values', 'event_id', null), (4, 'unique_values', 'event_type', null), (5, 'records_per', 'event_type', null),
  (6, 'top_by_count', 'event_type', null), (7, 'over_time', 'ts', 'event_id'), (8, 'monthly_trend', 'ts', 'event_id')) t(position, template, x, y) where (select count(*) from events) > 0""")
def _(spark, sf):
    return tidy(questions.suggest(table(spark, sf, "events")))


_ANSWERS = {
    "average": ("value", None, "select round(avg(value), 4) as average from events"),
    "distribution": ("value", None, f"select bin, round(lower, 6) as lower, round(upper, 6) as upper, count from ({_hist('value', 'events', 30)})"),
    "top_values": ("value", None, "select value from events order by value desc limit 10"),
    "unique_values": ("event_type", None, "select distinct event_type as value from events"),
    "records_per": ("event_type", None, "select event_type as value, count(*) as count from events group by 1"),
    "top_by_count": ("user_id", None, "select user_id as value, count(*) as count from events group by 1 order by 2 desc, 1 limit 5"),
    "over_time": ("ts", "value", "select strftime(ts, '%Y-%m-%d') as period, round(avg(value), 4) as average, count(*) as n from events group by 1"),
    "monthly_trend": ("ts", "value", "select strftime(ts, '%Y-%m-01') as period, round(avg(value), 4) as average, count(*) as n from events group by 1"),
    "correlation": ("user_id", "value", "select 'user_id' as feature_a, 'value' as feature_b, round(corr(user_id, value), 4) + 0.0 as r from events"),
    "average_by": ("event_type", "value", "select event_type as value, round(avg(value), 4) as average from events group by 1"),
}


def _answer(template, x, y, sql):
    @query(f"qst1_{template}", sql)
    def _(spark, sf):
        return tidy(questions.answer(table(spark, sf, "events"), template, x, y), 6 if template == "distribution" else 4)


for _name, _spec in _ANSWERS.items():
    _answer(_name, *_spec)
