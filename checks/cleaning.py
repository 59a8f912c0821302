"""Cleaning, imputation and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import CU_PADDED, EV_GAPS, LI_GAPS, LI_SPIKES, OR_TEXT, Fixture, query, table, tidy, union_all
from checks.profile import LI_DUP_SQL, li_dup
from lumenframe.functions import text
from lumenframe.operators import clean, impute, quality

LG, EG = LI_GAPS.sql, EV_GAPS.sql


def _mode(c, src):
    return f"(select {c} from {src} where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"


# --- filling -----------------------------------------------------------------------------------


def _fill_sql(num):
    return f"""select l_orderkey, l_linenumber, round(coalesce(qty, {num('qty')}), 4) as qty, round(coalesce(disc, {num('disc')}), 4) as disc,
      coalesce(flag, {_mode('flag', LG)}) as flag, strftime(coalesce(shipped, {_mode('shipped', LG)}), '%Y-%m-%d') as shipped from {LG}"""


def _filled(spark, sf, strategy):
    out = clean.fill_nulls(LI_GAPS.df(spark, sf), strategy, ["qty", "disc", "flag", "shipped"])
    out = tidy(out.withColumn("shipped", F.date_format("shipped", "yyyy-MM-dd")))
    return out.withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("cln1_fill_nulls_mean", _fill_sql(lambda c: f"(select avg({c}) from {LG})"))
def _(spark, sf):
    return _filled(spark, sf, "mean")


@query("cln1_fill_nulls_median", _fill_sql(lambda c: f"(select median({c}) from {LG})"))
def _(spark, sf):
    return _filled(spark, sf, "median")


@query("cln1_fill_nulls_mode", _fill_sql(lambda c: _mode(c, LG)))
def _(spark, sf):
    return _filled(spark, sf, "mode")


@query("cln2_drop_duplicates", f"select distinct l_orderkey, l_linenumber, l_quantity, l_returnflag from {LI_DUP_SQL}")
def _(spark, sf):
    return clean.drop_duplicates(li_dup(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"))


@query("cln3_strip_whitespace", f"select c_custkey, trim(padded) as padded, trim(c_mktsegment) as c_mktsegment, c_acctbal from {CU_PADDED.sql}")
def _(spark, sf):
    return clean.strip_whitespace(CU_PADDED.df(spark, sf))


@query("cln4_drop_nulls", f"select l_orderkey, l_linenumber, qty, disc from {LG} where qty is not null and disc is not null")
def _(spark, sf):
    return clean.drop_nulls(LI_GAPS.df(spark, sf), ["qty", "disc"]).select("l_orderkey", "l_linenumber", "qty", "disc")


@query("cln5_reset", f"select * from {EG}")
def _(spark, sf):
    h = clean.History(EV_GAPS.df(spark, sf))
    h.apply("fill_nulls", clean.fill_nulls, "mean", ["value"])
    h.apply("drop_nulls", clean.drop_nulls)
    return h.reset()


EV_ENDS = Fixture(
    "events",
    "event_id",
    "case when event_id < 50 then null else value end as lead_gap",
    "case when event_id >= 9000 then null else value end as tail_gap",
    "case when event_id % 3 = 0 then null else value end as spread_gap",
    "cast(null as double) as all_gap",
    "case when event_id % 50 = 0 then null else event_type end as text_gap",
)


def _pattern(c, kind):
    advice = (
        "'mode'" if kind != "numeric" else "case when p < 5 then 'mean' when p < 20 then 'median' else 'knn' end"
    )
    return f"""select '{c}' as "column", '{kind}' as kind, nulls as null_count, p as null_pct,
      case when nulls = n then 'all_missing' when last_null < first_ok then 'top_rows' when first_null > last_ok then 'bottom_rows' else 'random' end as pattern,
      {advice} as recommendation from (select count(*) as n, count(*) - count({c}) as nulls, round(100.0 * (count(*) - count({c})) / count(*), 2) as p,
      max(event_id) filter ({c} is null) as last_null, min(event_id) filter ({c} is null) as first_null,
      max(event_id) filter ({c} is not null) as last_ok, min(event_id) filter ({c} is not null) as first_ok from {EV_ENDS.sql})"""


EV_ENDS_SQL = " union all ".join(
    [*[_pattern(c, "numeric") for c in ("lead_gap", "tail_gap", "spread_gap", "all_gap")], _pattern("text_gap", "categorical")]
)


@query("cln6_analyze_missing", f"select * from ({EV_ENDS_SQL}) where null_count > 0")
def _(spark, sf):
    return clean.analyze_missing(EV_ENDS.df(spark, sf), ["event_id"])


@query("cln6_missing_totals", f"""select cast(6 * count(*) - count(l_orderkey) - count(l_linenumber) - count(qty) - count(disc) - count(flag) - count(shipped) as bigint) as total_missing,
  cast(6 * count(*) as bigint) as total_cells, round(100.0 * (6 * count(*) - count(l_orderkey) - count(l_linenumber) - count(qty) - count(disc) - count(flag) - count(shipped)) / (6 * count(*)), 2) as total_missing_pct from {LG}""")
def _(spark, sf):
    return clean.missing_totals(LI_GAPS.df(spark, sf))


@query("cln7_missing_patterns", f'select "column", pattern from ({EV_ENDS_SQL}) union all select \'event_id\', \'random\'')
def _(spark, sf):
    return clean.missing_patterns(EV_ENDS.df(spark, sf), ["event_id"])


@query("cln8_forward_fill", f"""select event_id, ts, user_id, last_value(event_type ignore nulls) over w as event_type, last_value(value ignore nulls) over w as value
  from {EG} window w as (order by ts, event_id rows between unbounded preceding and current row)""")
def _(spark, sf):
    return impute.forward_fill(EV_GAPS.df(spark, sf), ["ts", "event_id"], ["event_type", "value"])


@query("cln9_backward_fill", f"""select event_id, ts, user_id, first_value(event_type ignore nulls) over w as event_type, first_value(value ignore nulls) over w as value
  from {EG} window w as (order by ts, event_id rows between current row and unbounded following)""")
def _(spark, sf):
    return impute.backward_fill(EV_GAPS.df(spark, sf), ["ts", "event_id"], ["event_type", "value"])


@query("cln10_interpolate", f"""with r as (select event_id, value, row_number() over (order by ts, event_id) as i, ts from {EG}),
  m as (select *, last_value(case when value is not null then i end ignore nulls) over a as pi, last_value(value ignore nulls) over a as pv,
     first_value(case when value is not null then i end ignore nulls) over b as ni, first_value(value ignore nulls) over b as nv from r
     window a as (order by i rows between unbounded preceding and current row), b as (order by i rows between current row and unbounded following))
  select event_id, round(coalesce(value, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), pv, nv), 4) as value from m""")
def _(spark, sf):
    out = impute.interpolate(EV_GAPS.df(spark, sf), ["ts", "event_id"], ["value"])
    return tidy(out.select("event_id", "value"))


PART_GAPS = Fixture(
    "part",
    "p_partkey",
    "case when p_partkey % 7 = 0 then null else cast(p_size as double) end as size",
    "case when p_partkey % 10 = 3 then null else p_retailprice end as price",
    "cast(p_partkey % 100 as double) as slot",
)


def _knn_sql(c, cols):
    terms = " + ".join(
        f"(case when q.{k} is not null and d.{k} is not null then (q.{k} - d.{k}) * (q.{k} - d.{k}) else 0.0 end)" for k in cols
    )
    shared = " + ".join(f"(case when q.{k} is not null and d.{k} is not null then 1.0 else 0.0 end)" for k in cols)
    return f"""(select id, avg(v) as {c} from (select q.p_partkey as id, d.{c} as v,
      row_number() over (partition by q.p_partkey order by ({len(cols)} / ({shared})) * ({terms}), d.{c}) as rn
      from {PART_GAPS.sql} q join {PART_GAPS.sql} d on d.{c} is not null where q.{c} is null and ({shared}) > 0) where rn <= 5 group by id)"""


_knn_cols = ["size", "price", "slot"]


@query("cln11_impute_knn", f"""select p_partkey, round(coalesce(b.size, s.size), 4) as size, round(coalesce(b.price, p.price), 4) as price, round(slot, 4) as slot
  from {PART_GAPS.sql} b left join {_knn_sql('size', _knn_cols)} s on s.id = b.p_partkey left join {_knn_sql('price', _knn_cols)} p on p.id = b.p_partkey""")
def _(spark, sf):
    return tidy(impute.impute_knn(PART_GAPS.df(spark, sf), ["p_partkey"], _knn_cols))


INVALID = Fixture(
    "lineitem",
    "case when l_orderkey % 101 = 0 then -999.0 when l_orderkey % 103 = 0 then 0.0 else l_quantity end as qty",
    "case when l_orderkey % 97 = 0 then cast('Infinity' as double) else l_extendedprice end as price",
    "case when l_orderkey % 50 = 0 then '' when l_orderkey % 51 = 0 then ' A' else l_returnflag end as flag",
    "l_discount",
)


@query("cln12_detect_invalid_values", f"""with s as (select count(*) as n, count(*) filter (trim(flag) = '') as e, count(*) filter (trim(flag) <> flag) as p,
   count(*) filter (isinf(price)) as i, count(*) filter (qty in (-999, -9999, -1, 0)) as q, count(*) filter (l_discount in (-999, -9999, -1, 0)) as d from {INVALID.sql})
  select * from (select 'flag' as "column", 'empty' as issue, e as count, null as examples from s union all select 'flag', 'padded', p, null from s
  union all select 'price', 'infinite', i, null from s union all select 'qty', 'sentinel', case when q < n * 0.1 then q end, '-999,0' from s
  union all select 'l_discount', 'sentinel', case when d < n * 0.1 then d end, '0' from s) where count > 0""")
def _(spark, sf):
    return clean.detect_invalid_values(INVALID.df(spark, sf))


LS = LI_SPIKES.sql


def _fence(c, src=LS):
    return f"(select q1 - (q3 - q1) * 1.5 as lo, q3 + (q3 - q1) * 1.5 as hi, m, s, mn, mx from (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3, avg({c}) as m, stddev_pop({c}) as s, min({c}) as mn, max({c}) as mx from {src}))"


@query("cln13_detect_outliers", "select * from (" + union_all(
    ["price", "qty", "l_discount", "l_orderkey", "l_quantity"],
    lambda c: f"""select '{c}' as "column", count(*) filter ({c} < lo or {c} > hi) as iqr_outliers, count(*) filter (abs(({c} - m) / s) > 3) as zscore_outliers,
    round(max(lo), 4) as lower_fence, round(max(hi), 4) as upper_fence, round(max(mn)::double, 4) as min, round(max(mx)::double, 4) as max from {LS}, {_fence(c)}""")
    + ") where iqr_outliers > 0 or zscore_outliers > 0")
def _(spark, sf):
    return tidy(clean.detect_outliers(LI_SPIKES.df(spark, sf)))


@query("cln14_treat_outliers_clip", f"select l_orderkey, l_quantity, l_discount, round(least(greatest(price, p.lo), p.hi), 4) as price, round(least(greatest(qty, q.lo), q.hi), 4) as qty from {LS}, {_fence('price')} p, {_fence('qty')} q")
def _(spark, sf):
    return tidy(clean.treat_outliers(LI_SPIKES.df(spark, sf), ["price", "qty"], "clip"))


@query("cln15_treat_outliers_remove", f"""with a as (select b.* from {LS} b, {_fence('price')} f where price between lo and hi)
  select a.* from a, {_fence('qty', 'a')} f where qty between lo and hi""")
def _(spark, sf):
    return clean.treat_outliers(LI_SPIKES.df(spark, sf), ["price", "qty"], "remove")


@query("cln16_treat_outliers_nan", f"select l_orderkey, l_quantity, l_discount, case when price between p.lo and p.hi then price end as price, case when qty between q.lo and q.hi then qty end as qty from {LS}, {_fence('price')} p, {_fence('qty')} q")
def _(spark, sf):
    return clean.treat_outliers(LI_SPIKES.df(spark, sf), ["price", "qty"], "nan")


@query("cln17_normalize_text", f"select c_custkey, regexp_replace(trim(regexp_replace(regexp_replace(lower(padded), '[^a-zA-Z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), '^$', '') as padded, lower(c_mktsegment) as c_mktsegment from {CU_PADDED.sql}")
def _(spark, sf):
    df = CU_PADDED.df(spark, sf).select("c_custkey", "padded", "c_mktsegment")
    return clean.normalize_text(clean.normalize_text(df, ["padded"], ["lowercase", "remove_special", "collapse_whitespace"]), ["c_mktsegment"])


@query("cln18_analyze_duplicates", f"select count(*) as total_rows, count(*) - d.k as duplicate_rows, round(100.0 * (count(*) - d.k) / count(*), 2) as duplicate_pct, d.k as unique_rows from {LI_DUP_SQL}, (select count(*) as k from (select distinct * from {LI_DUP_SQL})) d group by d.k")
def _(spark, sf):
    return tidy(clean.analyze_duplicates(li_dup(spark, sf)))


@query("cln18_duplicate_contributions", union_all(
    ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"],
    lambda c: f"""select '{c}' as "column", round(100.0 * (count(*) - count(distinct {c})) / count(*), 2) as duplicate_contribution from {LI_DUP_SQL}"""))
def _(spark, sf):
    return clean.duplicate_contributions(li_dup(spark, sf))


@query("cln19_cleaning_report", f"""with b as (select count(*) as r, count(*) - (select count(*) from (select distinct * from {LI_DUP_SQL})) as d from {LI_DUP_SQL}),
   a as (select count(*) as r from (select distinct * from {LI_DUP_SQL}))
  select metric, before, after, after - before as change, coalesce(round(100.0 * (after - before) / nullif(before, 0), 2), 0.0) as change_pct from (
   select 'rows' as metric, b.r as before, a.r as after from a, b union all select 'columns', 5, 5 union all select 'missing', 0, 0
   union all select 'duplicates', b.d, 0 from b)""")
def _(spark, sf):
    before = li_dup(spark, sf)
    return tidy(clean.cleaning_report(before, clean.drop_duplicates(before)))


AC = Fixture(
    "customer",
    "c_custkey",
    "case when c_custkey % 11 = 0 then null else concat(' ', c_mktsegment, '  ') end as segment",
    "case when c_custkey % 9 = 0 then null else c_acctbal end as balance",
)


@query("cln20_auto_clean", f"""with t as (select distinct c_custkey, trim(segment) as segment, balance from {AC.sql})
  select c_custkey, coalesce(segment, {_mode('segment', 't')}) as segment, round(coalesce(balance, (select median(balance) from t)), 4) as balance from t""")
def _(spark, sf):
    df = AC.df(spark, sf)
    return tidy(clean.auto_clean(df.unionAll(df.where("c_custkey % 4 = 0")))[0])


@query("cln20_auto_clean_log", f"""select 'strip_whitespace' as action, 'segment' as columns, null as strategy, null::bigint as affected
  union all select 'drop_duplicates', null, null, count(*) filter (c_custkey % 4 = 0) from {AC.sql}
  union all select 'fill_nulls', 'segment', 'mode', count(*) - count(segment) from {AC.sql}
  union all select 'fill_nulls', 'balance', 'median', count(*) - count(balance) from {AC.sql}""")
def _(spark, sf):
    df = AC.df(spark, sf)
    return clean.auto_clean(df.unionAll(df.where("c_custkey % 4 = 0")))[1]


# --- scalar text functions ---------------------------------------------------------------------------


def _scalar(name, fn, sql, source="part", key="p_partkey", col="concat(' ', p_name, '  x-', p_brand, '# ')"):
    @query(name, f"select {key}, {sql} as out from (select {key}, {col} as s from {source})")
    def _(spark, sf):
        return table(spark, sf, source).selectExpr(key, f"{col} as s").select(key, fn(F.col("s")).alias("out"))


_scalar("scl1_lower", text.OPERATIONS["lowercase"], "lower(s)")
_scalar("scl1_upper", text.OPERATIONS["uppercase"], "upper(s)")
_scalar(
    "scl2_title_case", text.OPERATIONS["title"],
    "array_to_string(list_transform(regexp_extract_all(s, '([A-Za-z]+|[^A-Za-z]+)'), lambda w: upper(w[1]) || lower(w[2:])), '')",
)
_scalar("scl3_strip", text.OPERATIONS["strip"], "trim(s)")
_scalar("scl4_remove_special", text.OPERATIONS["remove_special"], "regexp_replace(s, '[^a-zA-Z0-9\\s]', '', 'g')")
_scalar("scl5_collapse_whitespace", text.OPERATIONS["collapse_whitespace"], "trim(regexp_replace(s, '\\s+', ' ', 'g'))")
_scalar("scl6_capitalize_first", text.OPERATIONS["capitalize_first"], "upper(s[1]) || s[2:]", col="p_name")

CONTACT = Fixture(
    "customer",
    "c_custkey",
    "case when c_custkey % 10 = 0 then 'nobody' when c_custkey % 13 = 0 then '' else concat('user', cast(c_custkey as varchar(20)), '@mail.example.com') end as email",
    "case when c_custkey % 8 = 0 then 'ftp://x' else concat('HTTPS://example.com/', cast(c_custkey as varchar(20))) end as url",
    "case when c_custkey % 6 = 0 then 'call me' else concat('+1 (555) ', cast(1000000 + c_custkey as varchar(20))) end as phone",
    "concat('$', cast(c_custkey as varchar(20)), '.50') as money",
    "case when c_custkey % 15 = 0 then '  ' when c_custkey % 14 = 0 then '' when c_custkey % 2 = 0 then 'bad' else '12.5' end as amount",
    "c_acctbal",
    "cast(1.0 as double) as one",
    "c_nationkey",
    "c_nationkey as nation_copy",
)
CS = CONTACT.sql
_EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


@query("scl7_regex_match", f"select c_custkey, regexp_matches(email, '{_EMAIL}') as email, regexp_matches(url, '(?i)^https?://.+') as url, regexp_matches(phone, '^[\\d\\s\\-+()]+$') as phone, regexp_matches(money, '^[$€£¥₹][\\d,]+\\.?\\d*$') as money from {CS}")
def _(spark, sf):
    df = CONTACT.df(spark, sf)
    return df.select("c_custkey", text.is_email(F.col("email")).alias("email"), text.is_url(F.col("url")).alias("url"),
                     text.is_phone(F.col("phone")).alias("phone"), F.col("money").rlike(text.CURRENCY).alias("money"))


# --- quality -------------------------------------------------------------------------------------------

_AMOUNT_NUM = "regexp_matches(amount, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)\\s*$')"


def _one_check(name, check, column, sql):
    @query(name, f"select '{column}' as \"column\", count(*) filter ({sql}) as {check} from {CS}")
    def _(spark, sf):
        return quality.value_checks(CONTACT.df(spark, sf)).where(F.col("column") == column).select("column", check)


_one_check("qlt1_empty_strings", "empty_count", "amount", "amount = ''")
_one_check("qlt2_whitespace_only", "whitespace_count", "amount", "amount <> '' and trim(amount) = ''")
_one_check("qlt3_invalid_numbers", "invalid_numbers", "amount", f"not {_AMOUNT_NUM}")
_one_check("qlt5_invalid_emails", "invalid_emails", "email", f"trim(email) <> '' and not regexp_matches(trim(email), '{_EMAIL}')")
_one_check("qlt6_invalid_urls", "invalid_urls", "url", "not regexp_matches(url, '(?i)^https?://.+')")
_one_check("qlt7_invalid_phones", "invalid_phones", "phone", "not regexp_matches(phone, '^[\\d\\s\\-+()]+$')")
_one_check("qlt8_negative_values", "negative_count", "c_acctbal", "c_acctbal < 0")


@query("qlt4_invalid_dates", f"select 'date_text' as \"column\", count(*) filter (date_text = 'bad') as invalid_dates from {OR_TEXT.sql}")
def _(spark, sf):
    return quality.value_checks(OR_TEXT.df(spark, sf)).where("column = 'date_text'").select("column", "invalid_dates")


QCOLS = {
    "c_custkey": ("numeric", "0", "0", "0", "count(*) filter (c_custkey < 0)"),
    "email": ("categorical", "0", "count(*) filter (email = '')", "0", "0"),
    "amount": ("numeric", f"count(*) filter (not {_AMOUNT_NUM})", "count(*) filter (amount = '')", "count(*) filter (amount <> '' and trim(amount) = '')", "0"),
    "c_acctbal": ("numeric", "0", "0", "0", "count(*) filter (c_acctbal < 0)"),
    "one": ("numeric", "0", "0", "0", "0"),
    "c_nationkey": ("numeric", "0", "0", "0", "0"),
    "nation_copy": ("numeric", "0", "0", "0", "0"),
}


def _quality_sql(c, i):
    kind, inv, emp, ws, neg = QCOLS[c]
    return f"""select {i} as position, '{c}' as "column", '{kind}' as kind, count(*) - count({c}) as null_count, count(distinct {c}) as unique_count,
      round(100.0 * count(distinct {c}) / count(*), 2) as unique_pct, count(distinct {c}) <= 1 as is_constant,
      count(distinct {c}) <= greatest(2, floor(count(*) * 0.01)) as is_near_constant, count(distinct {c}) > floor(count(*) * 0.5) as is_high_cardinality,
      {inv} as invalid_count, {emp} as empty_count, {ws} as whitespace_count, {neg} as negative_count,
      greatest(0, round(100.0 - least(30, 100.0 * (count(*) - count({c})) / count(*)) - least(20, 100.0 * ({inv} + {emp} + {ws}) / count(*))
        - case when count(distinct {c}) <= 1 then 15 when count(distinct {c}) > count(*) * 0.8 then 10 else 0 end, 1))::double as quality_score, count(*) as n_rows from {CS}"""


QSQL = " union all ".join(_quality_sql(c, i) for i, c in enumerate(QCOLS))


def _qdf(spark, sf):
    return CONTACT.df(spark, sf).select(*QCOLS)


QKINDS = {c: v[0] for c, v in QCOLS.items()}
_SHOWN = ["column", "kind", "null_count", "unique_count", "unique_pct", "is_constant", "is_near_constant", "is_high_cardinality",
          "invalid_count", "empty_count", "whitespace_count", "negative_count"]


@query("qlt9_column_quality", f'select {", ".join(chr(34) + c + chr(34) for c in _SHOWN)} from ({QSQL})')
def _(spark, sf):
    return tidy(quality.column_quality(_qdf(spark, sf), QKINDS).select(_SHOWN))


@query("qlt10_column_quality_score", f'select "column", quality_score from ({QSQL})')
def _(spark, sf):
    return tidy(quality.column_quality(_qdf(spark, sf), QKINDS).select("column", "quality_score"))


@query("qlt11_duplicate_columns", f"select 'c_nationkey' as column1, 'nation_copy' as column2 from {CS} having bool_and(c_nationkey is not distinct from nation_copy)")
def _(spark, sf):
    return quality.duplicate_columns(CONTACT.df(spark, sf))


_TOTALS = f"""(select sum(n_rows) as cells, max(n_rows) as n, sum(null_count) as nulls, sum(invalid_count + empty_count + whitespace_count) as bad,
   count(*) filter (is_constant) as const, count(*) filter (is_high_cardinality) as high, avg(quality_score) as acc,
   max(n_rows) - (select count(*) from (select distinct {', '.join(QCOLS)} from {CS})) as dup from ({QSQL}))"""
_SCORE = """greatest(0, round(100.0 - least(30, 100.0 * nulls / cells * 0.3) - least(20, 100.0 * bad / cells * 0.5)
   - least(15, 100.0 * dup / n * 0.2 + const * 2) - least(10, high * 1.5), 1))::double"""


def _health(spark, sf):
    return quality.quality_report(_qdf(spark, sf), QKINDS)["health"]


@query("qlt12_health_score", f"select {_SCORE} as score from {_TOTALS}")
def _(spark, sf):
    return _health(spark, sf).select("score")


@query("qlt13_score_breakdown", f"""select round(greatest(0, 100 - 100.0 * nulls / cells), 1)::double as completeness, round(greatest(0, 100 - 200.0 * bad / cells), 1)::double as validity,
  round(least(100, greatest(0, 100 - 100.0 * dup / n - const * 3)), 1)::double as consistency, round(acc, 1) as accuracy from {_TOTALS}""")
def _(spark, sf):
    return tidy(_health(spark, sf).select("completeness", "validity", "consistency", "accuracy"))


@query("qlt14_status_band", f"select case when score >= 90 then 'Excellent' when score >= 75 then 'Good' when score >= 50 then 'Average' else 'Poor' end as status from (select {_SCORE} as score from {_TOTALS})")
def _(spark, sf):
    return _health(spark, sf).select("status")


@query("qlt15_dataset_overview", f"select count(*) as total_rows, 7::bigint as total_columns, 6::bigint as numeric_columns, 1::bigint as categorical_columns, 0::bigint as datetime_columns, 0::bigint as boolean_columns from {CS}")
def _(spark, sf):
    return quality.quality_report(_qdf(spark, sf), QKINDS)["overview"]


@query("qlt15_invalid_section", f"""select "column", kind, invalid_count, empty_count, whitespace_count, negative_count from ({QSQL}) where invalid_count + empty_count + whitespace_count + negative_count > 0""")
def _(spark, sf):
    return quality.quality_report(_qdf(spark, sf), QKINDS)["invalid"]


@query("qlt15_unique_section", f"""select "column", kind, unique_count, unique_pct, quality_score, case when is_constant then 'constant' when is_near_constant then 'near_constant' when is_high_cardinality then 'high_cardinality' end as state from ({QSQL})""")
def _(spark, sf):
    return tidy(quality.quality_report(_qdf(spark, sf), QKINDS)["unique_values"])


@query("qlt16_recommendations", f"""with q as ({QSQL}), f as (select string_agg("column", ', ' order by position) filter (is_constant) as const,
    (select string_agg("column", ', ' order by position) from (select * from q where is_high_cardinality order by position limit 5)) as high,
    string_agg("column", ', ' order by position) filter (invalid_count > 0) as invalid, string_agg("column", ', ' order by position) filter (whitespace_count > 0) as blank,
    string_agg("column", ', ' order by position) filter (whitespace_count > 0 or empty_count > 0) as unusable,
    (select string_agg("column", ', ' order by position) from (select * from q where kind = 'numeric' and unique_count > 1 order by position limit 5)) as num from q)
  select * from (select 2::bigint as rule, 'medium' as priority, 'duplicates' as category, '' as affected_columns union all select 3, 'high', 'constant_columns', const from f
   union all select 4, 'medium', 'high_cardinality', high from f union all select 5, 'high', 'duplicate_columns', 'c_nationkey' union all select 6, 'high', 'datatype', invalid from f
   union all select 7, 'low', 'whitespace', blank from f union all select 8, 'medium', 'invalid_values', unusable from f union all select 9, 'low', 'normalize', num from f) where affected_columns is not null""")
def _(spark, sf):
    return tidy(quality.quality_report(_qdf(spark, sf), QKINDS)["recommendations"].select("rule", "priority", "category", "affected_columns"))
