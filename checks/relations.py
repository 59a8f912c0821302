"""Correlation, joins, set operations, windows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from checks.base import EV_GAPS, Fixture, query, scratch, table, tidy, union_all
from checks.profile import LI_DUP_SQL, li_dup
from lumenframe.operators import charts, correlation, features, filters, frequency, joins, order, select
from lumenframe.sources import writers

# Correlated columns with gaps: missing counts as 0.
COR = Fixture(
    "lineitem",
    "case when l_orderkey % 7 = 0 then null else l_quantity end as qty",
    "l_discount as disc",
    "l_quantity * 2 + l_discount * 100 as mix",
    "-1 * l_quantity + l_tax * 30 as inverse",
    "cast(l_linenumber as double) as line",
    "cast(1.0 as double) as one",
)
COLS = ["qty", "disc", "mix", "inverse", "line", "one"]
_filled = f"(select {', '.join(f'coalesce({c}, 0.0) as {c}' for c in COLS)} from {COR.sql})"


def _r(a, b, src):
    return f"case when stddev_pop({a}) > 0 and stddev_pop({b}) > 0 then covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) end"


def _pairs_sql(src, cols):
    return union_all(
        list(combinations(cols, 2)),
        lambda p: f"select '{p[0]}' as feature_a, '{p[1]}' as feature_b, {_r(p[0], p[1], src)} as r from {src}",
    )


def _report(raw):
    return f"""select feature_a, feature_b, round(r, 4) + 0.0 as value, round(abs(r), 4) as abs_value,
      case when abs(r) >= 0.9 then 'Very Strong' when abs(r) >= 0.7 then 'Strong' when abs(r) >= 0.5 then 'Moderate' when abs(r) >= 0.3 then 'Weak' else 'Very Weak' end as strength,
      case when r > 0 then 'Positive' when r < 0 then 'Negative' else 'None' end as direction from ({raw}) where r is not null"""


PEARSON = _report(_pairs_sql(_filled, COLS))


def _pairs(spark, sf):
    return tidy(correlation.pair_report(COR.df(spark, sf), "pearson", COLS))


@query("cor1_pearson_matrix", f"select feature_a, feature_b, round(r, 4) + 0.0 as r from ({_pairs_sql(_filled, COLS)})")
def _(spark, sf):
    return tidy(correlation.correlations(COR.df(spark, sf), "pearson", COLS))


def _ranked(src, cols):
    ranks = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in cols)
    return f"(select {ranks} from {src})"


@query("cor2_spearman", _report(_pairs_sql(_ranked(_filled, COLS), COLS)))
def _(spark, sf):
    return tidy(correlation.pair_report(COR.df(spark, sf), "spearman", COLS))


def _tau(a, b, src):
    return f"""select '{a}' as feature_a, '{b}' as feature_b, s / sqrt(ta::double * tb) as r from (select
       sum(sign(x.{a} - y.{a}) * sign(x.{b} - y.{b})) as s, sum(abs(sign(x.{a} - y.{a}))) as ta, sum(abs(sign(x.{b} - y.{b}))) as tb from {src} x, {src} y)"""


PART = Fixture("part", "cast(p_size as double) as size", "p_retailprice as price", "cast(p_partkey % 37 as double) as slot")


@query("cor3_kendall", _report(union_all(list(combinations(["size", "price", "slot"], 2)), lambda p: _tau(p[0], p[1], PART.sql))))
def _(spark, sf):
    return tidy(correlation.pair_report(PART.df(spark, sf), "kendall"))


# Discordant pairs: for every quantity, rows of a smaller one with a higher price.
_LINEITEM_TAU = """with c as (select l_quantity as x, l_extendedprice as y, cast(count(*) as double) as w from lineitem group by all),
  above as (select c.x, t.x as q, c.w, sum(case when c.x < t.x then c.w else 0 end) over (
      partition by t.x order by c.y desc range between unbounded preceding and current row exclude group) as before
    from c join (select distinct x from c) t on true),
  parts as (select (select sum(w * before) from above where x = q) as d, (select sum(w) from c) as n, (select sum(w * (w - 1) / 2) from c) as txy,
    (select sum(w * (w - 1) / 2) from (select sum(w) as w from c group by x)) as tx, (select sum(w * (w - 1) / 2) from (select sum(w) as w from c group by y)) as ty),
  counted as (select *, n * (n - 1) / 2 as every from parts)
  select round((every - tx - ty + txy - 2 * d) / sqrt((every - tx) * (every - ty)), 6) + 0.0 as tau, cast(n as bigint) as n,
    every - tx - ty + txy - d as concordant, d as discordant from counted"""


@query("cor3_kendall_lineitem", _LINEITEM_TAU)
def _(spark, sf):
    return tidy(correlation.kendall_tau(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), 6)


@query("cor4_pair_list", PEARSON)
def _(spark, sf):
    return _pairs(spark, sf)


@query("cor5_top_positive", f"select feature_a, feature_b, value from ({PEARSON}) where direction = 'Positive' order by abs_value desc, feature_a, feature_b limit 10")
def _(spark, sf):
    return correlation.top_pairs(_pairs(spark, sf), "positive").select("feature_a", "feature_b", "value")


@query("cor5_top_negative", f"select feature_a, feature_b, value from ({PEARSON}) where direction = 'Negative' order by abs_value desc, feature_a, feature_b limit 10")
def _(spark, sf):
    return correlation.top_pairs(_pairs(spark, sf), "negative").select("feature_a", "feature_b", "value")


@query("cor5_independent", f"select feature_a, feature_b, value from ({PEARSON}) order by abs_value, feature_a, feature_b limit 10")
def _(spark, sf):
    return correlation.top_pairs(_pairs(spark, sf), "independent").select("feature_a", "feature_b", "value")


@query("cor6_influence", f"""select "column", round(avg(abs_value), 4) as avg_corr from (select feature_a as "column", abs_value from ({PEARSON}) union all select feature_b, abs_value from ({PEARSON})) group by 1""")
def _(spark, sf):
    return correlation.influence(_pairs(spark, sf))


@query("cor7_multicollinear", f"select feature_a, feature_b, value from ({PEARSON}) where abs_value > 0.9")
def _(spark, sf):
    return correlation.multicollinear(_pairs(spark, sf)).select("feature_a", "feature_b", "value")


@query("cor8_network_edges", f"select feature_a as source, feature_b as target, value, abs_value, round(greatest(1.0, abs_value * 5), 4) as width from ({PEARSON}) where abs_value >= 0.3")
def _(spark, sf):
    return tidy(correlation.network_edges(_pairs(spark, sf)))


@query("cor8_network_nodes", f"""select id, count(*) filter (abs_value >= 0.3) as degree from (
  select feature_a as id, abs_value from ({PEARSON}) union all select feature_b, abs_value from ({PEARSON})) group by id""")
def _(spark, sf):
    return correlation.network_nodes(_pairs(spark, sf))


@query("cor9_matrix", f"""select "column", {', '.join(f"max(value) filter (other = '{c}') as {c}" for c in COLS)} from (
  select feature_a as "column", feature_b as other, value from ({PEARSON}) union all select feature_b, feature_a, value from ({PEARSON})
  union all {union_all(COLS, lambda c: f"select '{c}', '{c}', 1.0::double")}) group by 1""")
def _(spark, sf):
    return correlation.matrix(_pairs(spark, sf), COLS)


_fit = f"""(select covar_pop(mix, qty) / var_pop(qty) as slope, avg(mix) - covar_pop(mix, qty) / var_pop(qty) * avg(qty) as intercept,
  power(covar_pop(mix, qty) / (stddev_pop(mix) * stddev_pop(qty)), 2) as r2, min(qty) as lo, max(qty) as hi, count(*) as n from {COR.sql} where qty is not null and mix is not null)"""


@query("cor10_trend_fit", f"select round(slope, 4) as slope, round(intercept, 4) as intercept, round(r2, 4) as r_squared, lo as x_min, hi as x_max, n from {_fit}")
def _(spark, sf):
    return tidy(correlation.trend_fit(COR.df(spark, sf), "qty", "mix"))


@query("cor10_trend_line", f"select round(lo + i * (hi - lo) / 99, 4) as x, round(slope * (lo + i * (hi - lo) / 99) + intercept, 4) as y from {_fit}, range(0, 100) t(i)")
def _(spark, sf):
    return tidy(correlation.trend_line(COR.df(spark, sf), "qty", "mix"))


@query("cor10_scatter_points", f"select qty as x, mix as y from {COR.sql} where qty is not null and mix is not null")
def _(spark, sf):
    return correlation.scatter_points(COR.df(spark, sf), "qty", "mix")


@query("cor11_insights")
def _(spark, sf):
    return correlation.insights(_pairs(spark, sf))


@query("cor11_insight_rules", f"""with p as ({PEARSON}) select 1::bigint as rule from (select direction from p order by abs_value desc, feature_a, feature_b limit 1) where direction = 'Positive'
  union all select 2 from p having count(*) filter (direction = 'Negative') > 0 union all select 3 from p having count(*) > 2
  union all select 4 from p having count(*) filter (abs_value > 0.9) > 0 union all select 5 from p having count(*) > 0
  union all select 6 from p having count(*) filter (abs_value < 0.1) > 0 union all select 7 from p having count(*) filter (abs_value >= 0.7) > 0""")
def _(spark, sf):
    return tidy(correlation.insights(_pairs(spark, sf)).select("rule"))


@query("cor12_recommendations", f"""with p as ({PEARSON}), d as (select *, row_number() over (order by abs_value desc, feature_a, feature_b) as k from p where abs_value > 0.9),
   inf as (select "column", round(avg(abs_value), 4) as a from (select feature_a as "column", abs_value from p union all select feature_b, abs_value from p) group by 1),
   low as (select distinct c from (select feature_a as c from p where abs_value < 0.1 union all select feature_b from p where abs_value < 0.1))
  select k::bigint as rule, 'high' as priority, 'multicollinearity' as category, feature_a || ', ' || feature_b as affected_columns, 'remove_feature' as action from d where k <= 3
  union all select 4, 'medium', 'feature_engineering', feature_a || ', ' || feature_b, 'merge_features' from d where k = 1
  union all select 5, 'medium', 'prediction', (select string_agg("column", ', ' order by a desc, "column") from (select * from inf order by a desc, "column" limit 3)), 'use_for_prediction'
  union all select 6, 'low', 'feature_selection', (select string_agg(c, ', ' order by c) from (select c from low order by c limit 5)), 'review_columns' where exists (select 1 from low)""")
def _(spark, sf):
    return tidy(correlation.recommendations(_pairs(spark, sf)).select("rule", "priority", "category", "affected_columns", "action"))


@query("flt10_pair_filter", f"select feature_a, feature_b, value from ({PEARSON}) where abs_value >= 0.2 and (feature_a like '%qty%' or feature_b like '%qty%') and strength in ('Very Strong', 'Strong')")
def _(spark, sf):
    return filters.filter_pairs(_pairs(spark, sf), 0.2, "QTY", "strong").select("feature_a", "feature_b", "value")


@query("snk3_export_pairs", PEARSON)
def _(spark, sf):
    path = scratch(spark)
    writers.export_pairs(_pairs(spark, sf), path)
    return spark.read.csv(path, header=True, inferSchema=True)


# --- windows, sorts, joins, sets ------------------------------------------------------------------------


@query("win1_rolling_mean_trend", """with r as (select ts, value, row_number() over (order by ts, event_id) as i, count(*) over () as n from events),
  w as (select *, avg(value) over (order by i rows between 9 preceding and current row) as m from r)
  select i, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as x, value as y, case when i >= 10 then round(m, 4) end as trend from w""")
def _(spark, sf):
    out = charts.time_series(table(spark, sf, "events"), "ts", "value", ["event_id"])
    return tidy(out.withColumn("x", F.date_format("x", "yyyy-MM-dd HH:mm:ss.SSSSSS")))


@query("win2_row_numbers_in_ranges", "select event_id, row_number() over (order by ts, event_id) as row_no from events")
def _(spark, sf):
    return order.number_rows(table(spark, sf, "events").select("ts", "event_id"), ["ts", "event_id"], rows_per_bucket=997).select("event_id", "row_no")


@query("win3_average_rank", "select event_id, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0 as value from events")
def _(spark, sf):
    return tidy(correlation.average_ranks(table(spark, sf, "events").select("event_id", "value"), ["value"]))


@query("win4_cumulative_distribution", "select value, round(max(c), 6) as proportion from (select value, cume_dist() over (order by value) as c from events) group by value")
def _(spark, sf):
    from lumenframe.operators import distribution

    return tidy(distribution.ecdf(table(spark, sf, "events"), "value"), 6)


_forecast = """with r as (select value, row_number() over (order by ts, event_id) as i, count(*) over () as n from events),
  e as (select max(value) filter (i = n) as b, max(value) filter (i = n - n // 3 + 1) as a, max(n // 3) as k from r)
  select s::bigint as step, round(b + (b - a) / k * s, 4) as value from e, range(1, 11) t(s)"""


@query("win5_trend_extrapolation", _forecast)
def _(spark, sf):
    return tidy(charts.forecast(table(spark, sf, "events"), "ts", "value", 10, ["event_id"]))


@query("srt1_ordered_series", f"select strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as x, value as y from {EV_GAPS.sql} where value is not null")
def _(spark, sf):
    return charts.series(EV_GAPS.df(spark, sf), "ts", "value").withColumn("x", F.date_format("x", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("srt2_top_k_categories", "select p_partkey, p_brand from part where p_brand in (select p_brand from part group by 1 order by count(*) desc, p_brand limit 8)")
def _(spark, sf):
    return joins.keep_top(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", 8)


@query("srt3_head_n", "select event_id, user_id from events order by user_id, event_id limit 20")
def _(spark, sf):
    return select.head(table(spark, sf, "events").select("event_id", "user_id"), ["user_id", "event_id"], 20)


_CUST_FREQ = "select o_orderkey, (select count(*) from orders) as n, count(*) over (partition by o_custkey) as k from orders"


@query("joi1_lookup_join", f"select o_orderkey, round(k::double / n, 8) as o_custkey from ({_CUST_FREQ})")
def _(spark, sf):
    return tidy(features.encode_frequency(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"]), 8)


@query("joi2_semi_join", "select c_custkey, c_mktsegment from customer where c_mktsegment in (select c_mktsegment from customer group by 1 order by count(*) desc, c_mktsegment limit 2)")
def _(spark, sf):
    return joins.keep_top(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", 2)


HOT = Fixture(
    "orders", "o_orderkey", "o_totalprice",
    "case when o_orderkey % 3 = 0 then cast(7 as bigint) when o_orderkey % 5 = 0 then null else o_custkey + 300 end as c_custkey",
)
MERGED = {
    "inner": "o.o_orderkey, o.c_custkey, c.c_mktsegment from {o} o join customer c on o.c_custkey = c.c_custkey",
    "left": "o.o_orderkey, o.c_custkey, c.c_mktsegment from {o} o left join customer c on o.c_custkey = c.c_custkey",
    "right": "o.o_orderkey, c.c_custkey, c.c_mktsegment from {o} o right join customer c on o.c_custkey = c.c_custkey",
    "full": "o.o_orderkey, coalesce(o.c_custkey, c.c_custkey) as c_custkey, c.c_mktsegment from {o} o full join customer c on o.c_custkey = c.c_custkey",
    "semi": "o.o_orderkey, o.c_custkey, null as c_mktsegment from {o} o where c_custkey in (select c_custkey from customer)",
    "anti": "o.o_orderkey, o.c_custkey, null as c_mktsegment from {o} o where c_custkey is null or c_custkey not in (select c_custkey from customer)",
}


def _merge(how):
    @query(f"joi4_merge_{how}", "select " + MERGED[how].format(o=HOT.sql))
    def _(spark, sf):
        cu = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
        out = joins.merge_datasets(HOT.df(spark, sf), cu, ["c_custkey"], how)
        if "c_mktsegment" not in out.columns:
            out = out.withColumn("c_mktsegment", F.lit(None).cast("string"))
        return out.select("o_orderkey", "c_custkey", "c_mktsegment")


for _how in MERGED:
    _merge(_how)


# Every other order number is one that the left table lacks.
_SHIFTED = "case when l_orderkey % 2 = 0 then l_orderkey else -l_orderkey end"


@query("joi4_merge_suffixes", f"""select b.l_orderkey, b.l_linenumber, a.l_quantity as l_quantity_old, b.l_quantity as l_quantity_new
  from (select l_orderkey, l_linenumber, l_quantity from lineitem) a
  right join (select {_SHIFTED} as l_orderkey, l_linenumber, l_quantity + 1 as l_quantity from lineitem) b
    on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    other = li.selectExpr(f"{_SHIFTED} as l_orderkey", "l_linenumber", "l_quantity + 1 as l_quantity")
    out = joins.merge_datasets(li, other, ["l_orderkey", "l_linenumber"], "right", ("_old", "_new"))
    return out.withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("set1_concatenate", "select o_orderkey, o_orderpriority, null::double as o_totalprice from orders where o_orderstatus = 'F' union all select o_orderkey, null, o_totalprice from orders where o_orderstatus <> 'F'")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return joins.concat([o.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority"), o.where("o_orderstatus <> 'F'").select("o_orderkey", "o_totalprice")])


@query("set2_distinct", f"select distinct l_returnflag, l_shipdate::date::varchar as d from {LI_DUP_SQL}")
def _(spark, sf):
    return frequency.distinct_rows(li_dup(spark, sf).select("l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("d")))


