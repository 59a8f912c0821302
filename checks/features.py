"""Feature engineering and date parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import LI_GAPS, Fixture, query, table, tidy
from lumenframe.functions.collections import inline_elements, inline_members
from lumenframe.functions.dates import calendar_parts, iso_text
from lumenframe.functions.numbers import safe_round
from lumenframe.operators import features

CU = Fixture(
    "customer",
    "c_custkey",
    "case when c_custkey % 9 = 0 then null else c_mktsegment end as segment",
    "case when c_custkey % 8 = 0 then null else c_acctbal end as balance",
    "cast(c_nationkey as double) as nation",
    "cast(1.0 as double) as one",
)
CS = CU.sql
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _cu(spark, sf, *cols):
    df = CU.df(spark, sf)
    return df.select(*cols) if cols else df


@query("fea1_onehot", f"select c_custkey, {', '.join(f'case when segment = {chr(39)}{s}{chr(39)} then 1::bigint else 0 end as segment_{s}' for s in SEGMENTS)} from {CS}")
def _(spark, sf):
    return tidy(features.encode_onehot(_cu(spark, sf, "c_custkey", "segment"), ["segment"]))


@query("fea2_label", f"select c_custkey, (select count(distinct b.segment) from {CS} b where b.segment < a.segment) + case when segment is null then null else 0 end as segment from {CS} a")
def _(spark, sf):
    return features.encode_label(_cu(spark, sf, "c_custkey", "segment"), ["segment"])


@query("fea3_ordinal", f"select c_custkey, case segment when 'FURNITURE' then 0::bigint when 'BUILDING' then 1 when 'MACHINERY' then 2 end as segment from {CS}")
def _(spark, sf):
    return features.encode_ordinal(_cu(spark, sf, "c_custkey", "segment"), ["segment"], {"segment": ["FURNITURE", "BUILDING", "MACHINERY"]})


@query("fea4_frequency", f"select c_custkey, case when segment is not null then round(count(*) over (partition by segment)::double / (select count(segment) from {CS}), 6) end as segment from {CS}")
def _(spark, sf):
    return tidy(features.encode_frequency(_cu(spark, sf, "c_custkey", "segment"), ["segment"]), 6)


@query("fea5_target", f"select c_custkey, case when segment is not null then round(avg(balance) over (partition by segment), 4) end as segment, balance from {CS}")
def _(spark, sf):
    return tidy(features.encode_target(_cu(spark, sf, "c_custkey", "segment", "balance"), ["segment"], "balance"))


def _scaled(name, fn, expr):
    stats = ", ".join(
        f"avg(coalesce({c}, 0)) as m_{c}, stddev_pop(coalesce({c}, 0)) as s_{c}, min(coalesce({c}, 0)) as lo_{c}, max(coalesce({c}, 0)) as hi_{c}, "
        f"quantile_cont(coalesce({c}, 0), 0.25) as q1_{c}, median(coalesce({c}, 0)) as q2_{c}, quantile_cont(coalesce({c}, 0), 0.75) as q3_{c}"
        for c in ("balance", "one")
    )
    cols = ", ".join(f"round({expr.format(c=c)}, 6) + 0.0 as {c}" for c in ("balance", "one"))

    @query(name, f"select c_custkey, {cols} from {CS}, (select {stats} from {CS})")
    def _(spark, sf):
        return tidy(fn(_cu(spark, sf, "c_custkey", "balance", "one"), ["balance", "one"]), 6)


_scaled("fea6_standard_scale", features.scale_standard, "(coalesce({c}, 0) - m_{c}) / case when s_{c} = 0 then 1 else s_{c} end")
_scaled("fea7_minmax_scale", features.scale_minmax, "(coalesce({c}, 0) - lo_{c}) / case when hi_{c} = lo_{c} then 1 else hi_{c} - lo_{c} end")
_scaled("fea8_robust_scale", features.scale_robust, "(coalesce({c}, 0) - q2_{c}) / case when q3_{c} = q1_{c} then 1 else q3_{c} - q1_{c} end")


@query("fea9_log1p", f"select c_custkey, round(ln(1 + greatest(balance, 0.0)) * case when balance is null then null else 1 end, 6) as balance from {CS}")
def _(spark, sf):
    return tidy(features.transform_log(_cu(spark, sf, "c_custkey", "balance"), ["balance"]), 6)


@query("fea10_sqrt", f"select c_custkey, case when balance is not null then round(sqrt(greatest(balance, 0.0)), 6) end as balance from {CS}")
def _(spark, sf):
    return tidy(features.transform_sqrt(_cu(spark, sf, "c_custkey", "balance"), ["balance"]), 6)


@query("fea11_power_yeojohnson")
def _(spark, sf):
    return tidy(features.transform_power(_cu(spark, sf, "c_custkey", "balance"), ["balance"]), 6)


@query("fea11_power_boxcox")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    return tidy(features.transform_power(df, ["l_extendedprice"], "boxcox"), 6)


_parts = """year({c}) as {p}year, month({c}) as {p}month, day({c}) as {p}day, isodow({c}) - 1 as {p}dayofweek, quarter({c}) as {p}quarter,
  case when {c} is null then null when isodow({c}) >= 6 then 1::bigint else 0 end as {p}is_weekend, weekofyear({c}) as {p}week"""


@query("fea12_date_features", f"select l_orderkey, l_linenumber, {_parts.format(c='shipped', p='shipped_')} from {LI_GAPS.sql}")
def _(spark, sf):
    out = features.create_date_features(LI_GAPS.df(spark, sf).select("l_orderkey", "l_linenumber", "shipped"), "shipped")
    return tidy(out.drop("shipped")).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("fea13_polynomial", f"""select c_custkey, balance, nation, round(coalesce(balance, 0) * coalesce(balance, 0), 2) as "balance^2", round(coalesce(balance, 0) * nation, 2) + 0.0 as "balance nation", nation * nation as "nation^2" from {CS}""")
def _(spark, sf):
    return tidy(features.create_polynomial(_cu(spark, sf, "c_custkey", "balance", "nation"), ["balance", "nation"]), 2)


@query("fea14_interactions", f"select c_custkey, balance, nation, one, round(balance * nation, 2) + 0.0 as balance_x_nation, balance * one as balance_x_one, nation * one as nation_x_one from {CS}")
def _(spark, sf):
    return tidy(features.create_interactions(_cu(spark, sf, "c_custkey", "balance", "nation", "one"), ["balance", "nation", "one"]), 2)


@query("fea15_binning", f"""select c_custkey, case when balance is not null then 'Bin_' || least(greatest(ceil((balance - lo) / ((hi - lo) / 5)), 1), 5)::bigint end as balance_binned
  from {CS}, (select min(balance) as lo, max(balance) as hi from {CS})""")
def _(spark, sf):
    return features.create_binning(_cu(spark, sf, "c_custkey", "balance"), "balance").drop("balance")


@query("fea16_missing_indicator", f"select c_custkey, segment, balance, case when segment is null then 1::bigint else 0 end as segment_is_missing, case when balance is null then 1::bigint else 0 end as balance_is_missing from {CS}")
def _(spark, sf):
    return tidy(features.create_missing_indicator(_cu(spark, sf, "c_custkey", "segment", "balance")), 2)


@query("scl8_log1p_sqrt", "select c_custkey, round(ln(1 + greatest(0.0, c_acctbal)), 6) as log1p, round(sqrt(greatest(0.0, c_acctbal)), 6) as root from customer")
def _(spark, sf):
    cu = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("log1p"), F.col("c_acctbal").alias("root"))
    return tidy(features.transform_sqrt(features.transform_log(cu, ["log1p"]), ["root"]), 6)


@query("scl9_date_parts", f"select event_id, {_parts.format(c='ts', p='')} from events")
def _(spark, sf):
    ev = table(spark, sf, "events")
    return tidy(ev.select("event_id", *[c.alias(k) for k, c in calendar_parts(F.col("ts")).items()]))


@query("scl10_equal_width_bin", "select l_quantity, count(*) as n, 'Bin_' || least(greatest(ceil((l_quantity - lo) / ((hi - lo) / 8)), 1), 8)::bigint as bin from lineitem, (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem) group by 1, 3")
def _(spark, sf):
    out = features.create_binning(table(spark, sf, "lineitem").select("l_quantity"), "l_quantity", 8)
    return out.groupBy("l_quantity", F.col("l_quantity_binned").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("scl11_safe_rounding", "select event_id, case when event_id % 10 in (0, 1) then null else round(value / 3, 4) end as x from events")
def _(spark, sf):
    x = F.when(F.col("event_id") % 10 == 0, F.lit(float("inf"))).when(F.col("event_id") % 10 == 1, F.lit(float("nan"))).otherwise(F.col("value") / 3)
    return table(spark, sf, "events").select("event_id", safe_round(x).alias("x"))


@query("scl12_iso_timestamp_text", "select event_id, case when microsecond(ts) % 1000000 = 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') end as at from events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", iso_text(F.col("ts")).alias("at"))


@query("scl13_json_arrays_inlined", "select e.vec_id, u.i::bigint as i, round(u.v::double, 4) + 0.0 as v from embeddings e, (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings) u where u.vec_id = e.vec_id")
def _(spark, sf):
    return tidy(inline_elements(table(spark, sf, "embeddings"), "embedding", ["vec_id"]))


@query("scl13_json_members_inlined", "select event_id, key, cast(json_extract_string(props, '$.' || key) as bigint) as value from (select event_id, props, unnest(json_keys(props)) as key from events)")
def _(spark, sf):
    return inline_members(table(spark, sf, "events"), "props", ["event_id"], "bigint")
