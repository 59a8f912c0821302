"""Sources, typing, projection, filters, profile and descriptive statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import (
    EV_GAPS,
    LI_ALL,
    LI_GAPS,
    LI_NUM,
    OR_TEXT,
    Fixture,
    query,
    scratch,
    table,
    tidy,
    union_all,
)
from lumenframe.operators import catalog, describe, filters, frequency, select
from lumenframe.sources import readers, writers
from lumenframe.sources.delimited import read_records
from lumenframe.streaming.ingest import ingest_delimited

CUSTOMER = "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, round(c_acctbal, 2) as c_acctbal, c_mktsegment from customer"


def _customer(df):
    return tidy(df.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), 2).withColumn(
        "c_custkey", F.col("c_custkey").cast("bigint")
    )


# --- sources and sinks ----------------------------------------------------------------------


def _as_csv(spark, sf, sep, codec="none", encoding="UTF-8"):
    path = scratch(spark)
    w = table(spark, sf, "customer").write.option("header", True).option("sep", sep).option("encoding", encoding)
    w.option("compression", codec).csv(path)
    return path


@query("src1_csv_sniffed_delimiter", CUSTOMER)
def _(spark, sf):
    return _customer(readers.read_delimited(spark, _as_csv(spark, sf, ";")))


@query("src2_tsv", CUSTOMER)
def _(spark, sf):
    return _customer(readers.read_delimited(spark, _as_csv(spark, sf, "\t"), sep="\t"))


_NOTES = """case when c_custkey % 3 = 0 then concat('line one of ', c_name, chr(10), 'and "two", ', c_mktsegment)
  when c_custkey % 3 = 1 then concat('"', c_mktsegment, '"', chr(10), chr(10), 'end') else c_mktsegment end as note"""
NOTES = f"select c_custkey, case when c_custkey % 10 = 7 then null else round(c_acctbal, 2) end as c_acctbal, {_NOTES} from customer where c_custkey % 10 <> 0"


def _notes_file(spark, sf):
    """Customers with quoted line breaks; every tenth record has too many fields, every tenth a balance that is no number."""
    path = scratch(spark)
    rows = table(spark, sf, "customer").selectExpr("c_custkey", "c_acctbal", _NOTES)
    cell = F.concat(F.lit('"'), F.replace("note", F.lit('"'), F.lit('""')), F.lit('"'))
    balance = F.when(F.col("c_custkey") % 10 == 7, F.lit("unknown")).otherwise(F.round("c_acctbal", 2).cast("string"))
    extra = F.when(F.col("c_custkey") % 10 == 0, F.lit(",more,fields")).otherwise(F.lit(""))
    rows.select(F.concat(F.col("c_custkey").cast("string"), F.lit(","), balance, F.lit(","), cell, extra).alias("value")).write.text(path)
    return path


_NOTES_SCHEMA = "c_custkey bigint, c_acctbal double, note string"


@query("src1_csv_quoted_line_breaks", NOTES)
def _(spark, sf):
    return tidy(readers.read_delimited(spark, _notes_file(spark, sf), ",", _NOTES_SCHEMA, header=False), 2)


@query("src1_csv_rows_of_any_projection", union_all(
    [("n_rows", "count(*)"), ("n_keys", "count(c_custkey)"), ("keys", "sum(c_custkey)"), ("n_balances", "count(c_acctbal)"), ("characters", "sum(length(note))")],
    lambda f: f"select '{f[0]}' as figure, cast({f[1]} as bigint) as n from ({NOTES})",
))
def _(spark, sf):
    """Each figure comes from a reading of its own column alone."""
    df = readers.read_delimited(spark, _notes_file(spark, sf), ",", _NOTES_SCHEMA, header=False)
    figures = {"n_rows": F.count(F.lit(1)), "n_keys": F.count("c_custkey"), "keys": F.sum("c_custkey"), "n_balances": F.count("c_acctbal"),
               "characters": F.sum(F.length("note"))}
    return reduce(DataFrame.unionByName, [df.agg(f.cast("long").alias("n")).withColumn("figure", F.lit(k)) for k, f in figures.items()])


@query("src8_rejected_records", """select 'too many fields' as reason, cast(5 as bigint) as fields, count(*) as records, cast(sum(c_custkey) as bigint) as keys
  from customer where c_custkey % 10 = 0 having count(*) > 0""")
def _(spark, sf):
    found = read_records(spark, _notes_file(spark, sf), ",", "UTF-8", _NOTES_SCHEMA, header=False)
    key = F.regexp_extract("record", "^[0-9]+", 0).cast("bigint")
    return tidy(found.rejects.groupBy("reason", "fields").agg(F.count(F.lit(1)).alias("records"), F.sum(key).alias("keys")))


def _json_lines(spark, sf, build):
    """Documents of at most 500 customers each, one per line."""
    path = scratch(spark)
    cu = table(spark, sf, "customer")
    rows = cu.groupBy(F.floor(F.col("c_custkey") / 500).alias("part")).agg(F.collect_list(F.struct(*cu.columns)).alias("rows"))
    rows.select(build(cu.columns).alias("value")).write.text(path)
    return path


@query("src3_json_array_of_records", CUSTOMER)
def _(spark, sf):
    path = _json_lines(spark, sf, lambda cols: F.to_json("rows"))
    return _customer(readers.read_json(spark, path, lines=True))


@query("src4_json_wrapper_object", CUSTOMER)
def _(spark, sf):
    path = _json_lines(spark, sf, lambda cols: F.to_json(F.struct(F.lit("ok").alias("status"), F.col("rows").alias("records"))))
    return _customer(readers.read_json(spark, path, lines=True, shape="wrapper"))


@query("src5_json_dict_of_columns", CUSTOMER)
def _(spark, sf):
    path = _json_lines(spark, sf, lambda cols: F.to_json(F.struct(*[F.col(f"rows.{c}").alias(c) for c in cols])))
    return _customer(readers.read_json(spark, path, lines=True, shape="columns"))


@query("src6_parquet", CUSTOMER)
def _(spark, sf):
    return _customer(readers.read_any(spark, f"{sf}/customer.parquet"))


@query("src7_gzip_csv", CUSTOMER)
def _(spark, sf):
    path = _as_csv(spark, sf, ",", "gzip")
    return _customer(readers.read_any(spark, path + "/*.csv.gz"))


@query("src8_large_delimited_bad_lines_skipped", "select o_orderkey, o_orderpriority from orders where o_orderkey % 10 <> 0")
def _(spark, sf):
    path = scratch(spark)
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority")
    bad = F.concat(line, F.lit(",extra,fields"))
    lines = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 10 == 0, bad).otherwise(line).alias("value"))
    lines.write.text(path)
    schema = "o_orderkey bigint, o_orderpriority string"
    return readers.read_delimited(spark, path, ",", schema, header=False)


@query("src8_incremental_ingest", "select o_orderkey, o_custkey, o_orderpriority from orders")
def _(spark, sf):
    source, target, state = scratch(spark), scratch(spark), scratch(spark)
    cols = ["o_orderkey", "o_custkey", "o_orderpriority"]
    table(spark, sf, "orders").select(cols).repartition(4).write.option("header", True).csv(source)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderpriority string"
    ingest_delimited(spark, source, schema, target, state, files_per_batch=2).awaitTermination()
    return spark.read.parquet(target).select(cols)


@query("src9_latin1_encoding", "select doc_id, lang, n_chars from documents")
def _(spark, sf):
    path = scratch(spark)
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("é"), "lang").alias("lang"), "n_chars")
    docs.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    back = readers.read_delimited(spark, path, schema="doc_id bigint, lang string, n_chars bigint")
    return back.select("doc_id", F.regexp_replace("lang", "^é", "").alias("lang"), "n_chars")


@query("src10_empty_data_check", "select false as is_empty, count(*) as n_rows from customer")
def _(spark, sf):
    df = readers.require_rows(table(spark, sf, "customer"))
    return df.agg(F.lit(False).alias("is_empty"), F.count(F.lit(1)).alias("n_rows"))


@query("snk1_write_csv", CUSTOMER)
def _(spark, sf):
    path = scratch(spark)
    writers.write_csv(table(spark, sf, "customer"), path)
    return _customer(spark.read.csv(path, header=True, inferSchema=True))


@query("snk2_write_json", CUSTOMER)
def _(spark, sf):
    path = scratch(spark)
    writers.write_json(table(spark, sf, "customer"), path)
    return _customer(spark.read.json(path))


# --- typing and projection --------------------------------------------------------------------

_num_re = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|Inf|Infinity)\s*$"


def _date_ok(c: str) -> str:
    return f"({c} is not null and regexp_matches({c}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') and try_cast({c} as date) is not null)"


@query(
    "typ1_column_kinds",
    f"""select * from (values (0, 'o_orderkey', 'numeric'), (1, 'num_text', 'categorical')) t(position, "column", kind)
    union all select 2, 'date_text', case when avg(case when {_date_ok('date_text')} then 1.0 else 0 end) >= 0.7 then 'datetime' else 'categorical' end from {OR_TEXT.sql}
    union all select * from (values (3, 'flag_text', 'categorical'), (4, 'mixed_text', 'categorical')) t(position, "column", kind)""",
)
def _(spark, sf):
    return catalog.kind_frame(OR_TEXT.df(spark, sf)).withColumn("position", F.col("position").cast("int"))


@query(
    "typ2_date_shares",
    union_all(
        ["num_text", "date_text", "flag_text", "mixed_text"],
        lambda c: f"""select '{c}' as "column", round(avg(case when {_date_ok(c)} then 1.0 else 0.0 end), 4) as share from {OR_TEXT.sql}""",
    ),
)
def _(spark, sf):
    return tidy(catalog.date_shares(OR_TEXT.df(spark, sf)))


@query(
    "typ3_suggested_datatype",
    f"""select 'o_orderkey' as "column", case when bool_and(o_orderkey = floor(o_orderkey)) then 'integer' else 'numeric' end as suggested from {OR_TEXT.sql}
    union all """
    + union_all(
        ["num_text", "date_text", "flag_text", "mixed_text"],
        lambda c: f"""select '{c}', case when avg(case when regexp_matches({c}, '{_num_re}') then 1.0 else 0 end) >= 0.9 then 'numeric'
        when avg(case when {_date_ok(c)} then 1.0 else 0 end) >= 0.9 then 'datetime'
        when bool_and(lower({c}) in ('true','false','1','0','yes','no')) then 'boolean' else 'categorical' end from {OR_TEXT.sql}""",
    ),
)
def _(spark, sf):
    return catalog.suggested_types(OR_TEXT.df(spark, sf)).select("column", "suggested")


@query(
    "typ4_mixed_type_flag",
    """select 'o_orderkey' as "column", false as mixed union all """
    + union_all(
        ["num_text", "date_text", "flag_text", "mixed_text"],
        lambda c: f"""select '{c}', count(distinct case when regexp_matches({c}, '^\\s*[+-]?\\d+\\s*$') then 1
          when regexp_matches({c}, '{_num_re}') then 2 when lower({c}) in ('true','false') then 3
          when {_date_ok(c)} then 4 else 5 end) > 1 from {OR_TEXT.sql}""",
    ),
)
def _(spark, sf):
    return catalog.suggested_types(OR_TEXT.df(spark, sf)).select("column", "mixed")


@query(
    "typ5_convert_datatypes",
    f"""select o_orderkey, try_cast(num_text as double) as num_text,
    case when {_date_ok('date_text')} then strftime(try_cast(date_text as date), '%Y-%m-%d') end as date_text,
    case when lower(flag_text) in ('true','yes','1') then true when lower(flag_text) in ('false','no','0') then false end as flag_text,
    case when try_cast(mixed_text as double) = floor(try_cast(mixed_text as double)) then cast(try_cast(mixed_text as double) as bigint) end as mixed_text
    from {OR_TEXT.sql}""",
)
def _(spark, sf):
    out = catalog.convert_types(
        OR_TEXT.df(spark, sf),
        {"num_text": "numeric", "date_text": "datetime", "flag_text": "boolean", "mixed_text": "integer"},
    )
    return out.withColumn("date_text", F.date_format("date_text", "yyyy-MM-dd"))


@query(
    "prj1_preview",
    "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as ts, user_id, event_type, round(value, 6) as value, props from events order by event_id limit 20",
)
def _(spark, sf):
    return select.preview(table(spark, sf, "events"), ["event_id"], 20)


@query("prj1_preview_counts", "select cast(least(count(*), 20) as bigint) as shown, count(*) as total from events")
def _(spark, sf):
    return select.preview_counts(table(spark, sf, "events"), 20)


@query("prj2_data_table", "select event_id, event_type, value from events order by value desc, event_id limit 50")
def _(spark, sf):
    ev = table(spark, sf, "events").withColumn("neg", -F.col("value"))
    return select.data_table(ev, ["neg", "event_id"], ["event_id", "event_type", "value"], 50)


@query("prj3_preview_sort", f"select event_id, value, row_number() over (order by value desc nulls last, event_id) <= 10 as top10 from {EV_GAPS.sql}")
def _(spark, sf):
    ev = EV_GAPS.df(spark, sf).select("event_id", "value")
    ranked = select.sorted_rows(ev, "value", descending=True)
    first = ranked.orderBy(F.col("value").desc_nulls_last(), "event_id").limit(10).select(F.col("event_id").alias("k"))
    return ranked.join(F.broadcast(first), F.col("event_id") == F.col("k"), "left").select(
        "event_id", "value", F.col("k").isNotNull().alias("top10")
    )


# --- filters -------------------------------------------------------------------------------------


def _filtered(name, filter_list, where, source=EV_GAPS, cols=("event_id", "event_type", "value")):
    @query(name, f"select {', '.join(cols)} from {source.sql} where {where}")
    def _(spark, sf):
        return filters.apply_filters(source.df(spark, sf), filter_list).select(*cols)


def _f(c, op, v):
    return {"column": c, "operator": op, "value": v}


_filtered("flt1_eq_text", [_f("event_type", "eq", "click")], "event_type = 'click'")
_filtered("flt1_eq_number", [_f("user_id", "eq", "7")], "user_id = 7")
_filtered("flt2_neq", [_f("event_type", "neq", "click")], "event_type is distinct from 'click'")
_filtered("flt3_gt", [_f("value", "gt", 50)], "value > 50")
_filtered("flt4_gte", [_f("value", "gte", "34.6")], "value >= 34.6")
_filtered("flt5_lt", [_f("value", "lt", 5)], "value < 5")
_filtered("flt6_lte", [_f("value", "lte", 5)], "value <= 5")
_filtered("flt7_contains", [_f("event_type", "contains", "^P|ICK")], "regexp_matches(event_type, '(?i)^P|ICK')")
_filtered("flt8_in", [_f("event_type", "in", ["view", "error"])], "event_type in ('view', 'error')")
_filtered(
    "flt9_composite_rows",
    [_f("event_type", "neq", "view"), _f("value", "gt", 10), _f("user_id", "lte", 60), _f("missing", "eq", 1), _f("ts", "eq", None)],
    "event_type is distinct from 'view' and value > 10 and user_id <= 60",
)


@query(
    "flt9_composite_profile",
    f"""with f as (select * from {EV_GAPS.sql} where event_type is distinct from 'view' and value > 10)
    select count(*) as n_rows, cast(5 as bigint) as n_cols,
      cast(5 * count(*) - count(event_id) - count(ts) - count(user_id) - count(event_type) - count(value) as bigint) as total_nulls,
      count(*) - (select count(*) from (select distinct * from f)) as duplicate_rows from f""",
)
def _(spark, sf):
    return describe.profile_summary(
        filters.apply_filters(EV_GAPS.df(spark, sf), [_f("event_type", "neq", "view"), _f("value", "gt", 10)])
    )


# --- profile ---------------------------------------------------------------------------------------


def _dup(src: str, cols: str, cond: str) -> str:
    return f"(select {cols} from {src} union all select {cols} from {src} where {cond})"


LI_DUP_COLS = "l_orderkey, l_linenumber, l_quantity, l_returnflag, l_shipdate"
LI_DUP_SQL = _dup("lineitem", LI_DUP_COLS, "l_orderkey % 10 = 0")


def li_dup(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_DUP_COLS.split(", "))
    return li.unionAll(li.where("l_orderkey % 10 = 0"))


@query(
    "prf1_profile_summary",
    f"""select count(*) as n_rows, cast(6 as bigint) as n_cols,
     cast(6 * count(*) - count(l_orderkey) - count(l_linenumber) - count(qty) - count(disc) - count(flag) - count(shipped) as bigint) as total_nulls,
     count(*) - (select count(*) from (select distinct * from {LI_GAPS.sql})) as duplicate_rows from {LI_GAPS.sql}""",
)
def _(spark, sf):
    return describe.profile(LI_GAPS.df(spark, sf)).summary


def _profile_number(c, i):
    return f"""select {i} as position, '{c}' as "column", 'numeric' as kind, count(*) - count({c}) as null_count, count({c}) as non_null,
      round(100.0 * (count(*) - count({c})) / count(*), 2) as null_pct, count(distinct {c}) as unique_count,
      round(min({c}), 4) as min, round(max({c}), 4) as max, round(avg({c}), 4) as mean, round(median({c}), 4) as median,
      round(stddev({c}), 4) as std, round(quantile_cont({c}, 0.25), 4) as q1, round(quantile_cont({c}, 0.75), 4) as q3,
      cast(null as varchar) as min_date, cast(null as varchar) as max_date, cast(null as bigint) as range_days from {LI_GAPS.sql}"""


def _profile_text(c, i):
    return f"""select {i}, '{c}', 'categorical', count(*) - count({c}), count({c}), round(100.0 * (count(*) - count({c})) / count(*), 2),
      count(distinct {c}), null, null, null, null, null, null, null, null, null, null from {LI_GAPS.sql}"""


def _profile_date(c, i):
    return f"""select {i}, '{c}', 'datetime', count(*) - count({c}), count({c}), round(100.0 * (count(*) - count({c})) / count(*), 2),
      count(distinct {c}), null, null, null, null, null, null, null, strftime(min({c}), '%Y-%m-%dT%H:%M:%S'),
      strftime(max({c}), '%Y-%m-%dT%H:%M:%S'), cast(floor((epoch(max({c})) - epoch(min({c}))) / 86400) as bigint) from {LI_GAPS.sql}"""


@query(
    "prf1_profile_columns",
    " union all ".join(
        [
            *[_profile_number(c, i) for i, c in enumerate(["l_orderkey", "l_linenumber", "qty", "disc"])],
            _profile_text("flag", 4),
            _profile_date("shipped", 5),
        ]
    ),
)
def _(spark, sf):
    out = describe.profile(LI_GAPS.df(spark, sf)).columns
    return tidy(out).withColumn("position", F.col("position").cast("int"))


@query(
    "prf2_null_counts",
    union_all(
        ["event_id", "ts", "user_id", "event_type", "value"],
        lambda c: f"""select '{c}' as "column", count(*) - count({c}) as null_count, count({c}) as non_null,
        round(100.0 * (count(*) - count({c})) / count(*), 2) as null_pct from {EV_GAPS.sql}""",
    ),
)
def _(spark, sf):
    return describe.null_counts(EV_GAPS.df(spark, sf))


LI_COLS = [*LI_ALL, "l_returnflag", "l_linestatus", "l_shipdate"]


@query(
    "prf3_distinct_counts",
    union_all(LI_COLS, lambda c: f"""select '{c}' as "column", count(distinct {c}) as unique_count from lineitem"""),
)
def _(spark, sf):
    return frequency.distinct_counts(table(spark, sf, "lineitem"), LI_COLS)


@query("prf3_distinct_counts_approx")
def _(spark, sf):
    return frequency.distinct_counts(table(spark, sf, "lineitem"), LI_COLS, approx=True)


@query(
    "prf4_numeric_summary",
    union_all(
        LI_ALL,
        lambda c: f"""select '{c}' as "column", round(cast(min({c}) as double), 4) as min, round(cast(max({c}) as double), 4) as max,
        round(avg({c}), 4) as mean, round(median({c}), 4) as median, round(stddev({c}), 4) as std,
        round(quantile_cont({c}, 0.25), 4) as q1, round(quantile_cont({c}, 0.75), 4) as q3 from lineitem""",
    ),
)
def _(spark, sf):
    out = describe.numeric_summary(table(spark, sf, "lineitem"), LI_ALL)
    return tidy(out.select("column", "min", "max", "mean", "median", "std", "q1", "q3"))


@query("prf4_numeric_summary_approx")
def _(spark, sf):
    out = describe.numeric_summary(table(spark, sf, "lineitem"), LI_NUM, approx=True)
    return tidy(out.select("column", "min", "max", "mean", "median", "std", "q1", "q3"))


@query(
    "prf5_datetime_range",
    """select 'o_orderdate' as "column", strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') as min_date,
    strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') as max_date,
    cast(floor((epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 86400) as bigint) as range_days from orders""",
)
def _(spark, sf):
    return describe.date_ranges(table(spark, sf, "orders"), ["o_orderdate"])


@query(
    "prf6_top_values",
    union_all(
        ["p_name", "p_brand", "p_type"],
        lambda c: f"""select * from (select '{c}' as "column", row_number() over (order by count(*) desc, {c}) as rank, {c} as value, count(*) as count
        from part group by {c}) where rank <= 10""",
    ),
)
def _(spark, sf):
    return tidy(frequency.top_values(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"], 10))


@query(
    "prf7_duplicate_rows",
    f"select count(*) - (select count(*) from (select distinct * from {LI_DUP_SQL})) as duplicate_rows from {LI_DUP_SQL}",
)
def _(spark, sf):
    return describe.profile_summary(li_dup(spark, sf)).select("duplicate_rows")


# --- descriptive statistics ----------------------------------------------------------------------------

DSC_COLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _mode(c, src):
    return f"(select {c} from {src} where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"


@query(
    "dsc1_descriptive_stats",
    union_all(
        DSC_COLS,
        lambda c: f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 4) as mean, round(median({c}), 4) as median,
        round(stddev({c}), 4) as std, round(var_samp({c}), 4) as variance, round(min({c})::double, 4) as min, round(max({c})::double, 4) as max,
        round((max({c}) - min({c}))::double, 4) as range, round(quantile_cont({c}, 0.25), 4) as q1, round(quantile_cont({c}, 0.75), 4) as q3,
        round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) as iqr, round(skewness({c}), 4) + 0.0 as skewness, round(kurtosis({c}), 4) as kurtosis,
        round(stddev({c}) / avg({c}), 4) as cv, round(stddev({c}) / sqrt(count({c})), 4) as sem, round({_mode(c, 'lineitem')}::double, 4) as mode from lineitem""",
    ),
)
def _(spark, sf):
    return tidy(describe.descriptive_stats(table(spark, sf, "lineitem"), DSC_COLS))


@query(
    "dsc2_distribution_stats",
    union_all(
        DSC_COLS,
        lambda c: f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 5) as mean, round(median({c}), 5) as median,
        round({_mode(c, 'lineitem')}::double, 5) as mode, round(min({c})::double, 5) as min, round(max({c})::double, 5) as max,
        round((max({c}) - min({c}))::double, 5) as range, round(var_samp({c}), 5) as variance, round(stddev({c}), 5) as std,
        round(stddev({c}) / sqrt(count({c})), 5) as std_error, round(quantile_cont({c}, 0.25), 5) as q1, round(median({c}), 5) as q2,
        round(quantile_cont({c}, 0.75), 5) as q3, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 5) as iqr,
        round(stddev({c}) / abs(avg({c})) * 100, 5) as cv from lineitem""",
    ),
)
def _(spark, sf):
    return tidy(describe.distribution_stats(table(spark, sf, "lineitem"), DSC_COLS, digits=9), 5)


@query(
    "dsc3_report_stats",
    union_all(
        ["value", "user_id"],
        lambda c: f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 4) as mean, round(median({c}), 4) as median,
        round(min({c})::double, 4) as min, round(max({c})::double, 4) as max, round(stddev({c}), 4) as std, round(var_samp({c}), 4) as variance,
        round(skewness({c}), 4) as skewness, round(kurtosis({c}), 4) as kurtosis, round(quantile_cont({c}, 0.25), 4) as q1,
        round(median({c}), 4) as q2, round(quantile_cont({c}, 0.75), 4) as q3,
        round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) as iqr from {EV_GAPS.sql}""",
    ),
)
def _(spark, sf):
    return tidy(describe.report_stats(EV_GAPS.df(spark, sf), ["value", "user_id"]))


@query(
    "dsc4_percentiles",
    union_all(
        LI_NUM,
        lambda c: f"""select '{c}' as "column", """
        + ", ".join(f"round(quantile_cont({c}, {p / 100}), 4) as p{p}" for p in (1, 5, 10, 25, 50, 75, 90, 95, 99))
        + " from lineitem",
    ),
)
def _(spark, sf):
    return tidy(describe.percentiles(table(spark, sf, "lineitem"), LI_NUM))


SHAPE = """case when n < 8 then 'Insufficient data' when abs(s) <= 0.5 and abs(k) <= 1 then 'Symmetric'
 when s > 0.5 then case when abs(s) <= 1 then 'Right Skewed' else 'Highly Right Skewed' end
 when s < -0.5 then case when abs(s) <= 1 then 'Left Skewed' else 'Highly Left Skewed' end
 when k > 1 then 'Leptokurtic (Peaked)' when k < -1 then 'Platykurtic (Flat)' else 'Approximately Symmetric' end"""
SH = Fixture("events", "value", "user_id", "ln(value + 1) as log_value", "cast(event_id as double) as event_no", "-value * value as left_value")
SH_COLS = ["value", "user_id", "log_value", "event_no", "left_value"]


@query(
    "dsc5_shape_class",
    "select \"column\", round(s, 4) + 0.0 as skewness, round(k, 4) as kurtosis, " + SHAPE + " as shape from ("
    + union_all(SH_COLS, lambda c: f"""select '{c}' as "column", count({c}) as n, skewness({c}) as s, kurtosis({c}) as k from {SH.sql}""")
    + ")",
)
def _(spark, sf):
    return tidy(describe.shapes(SH.df(spark, sf), SH_COLS))


def _compact(c, src):
    return f"""select '{c}' as "column", round(avg({c}), 4) as mean, round(median({c}), 4) as median, round(stddev({c}), 4) as std,
      round(min({c})::double, 4) as min, round(max({c})::double, 4) as max, round(skewness({c}), 4) as skewness, round(kurtosis({c}), 4) as kurtosis,
      round(max(q1), 4) as q1, round(max(q3), 4) as q3, round(max(q3 - q1), 4) as iqr,
      count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outlier_count,
      round(100.0 * count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) / count({c}), 2) as outlier_pct,
      count(*) filter ({c} = 0) as zeros, count(*) filter ({c} < 0) as negatives
      from {src}, (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {src})"""


@query("dsc6_compact_numeric_stats", union_all(["value", "user_id"], lambda c: _compact(c, "events")) + " union all " + _compact("c_acctbal", "customer"))
def _(spark, sf):
    ev = describe.compact_numeric_stats(table(spark, sf, "events"), ["value", "user_id"])
    return tidy(ev.unionByName(describe.compact_numeric_stats(table(spark, sf, "customer"), ["c_acctbal"])))


@query(
    "dsc7_compact_text_stats",
    union_all(
        ["event_type"],
        lambda c: f"""with g as (select {c} as v, count(*) as n from {EV_GAPS.sql} where {c} is not null group by 1)
        select '{c}' as "column", (select count(*) from g) as unique_count, (select v from g order by n desc, v limit 1) as top_value,
        (select max(n) from g) as top_count, round(100.0 * (select max(n) from g) / count(*), 2) as concentration,
        count(*) - count({c}) as null_count,
        (select string_agg(v || '=' || n, ', ' order by n desc, v) from (select * from g order by n desc, v limit 5)) as top_values from {EV_GAPS.sql}""",
    ),
)
def _(spark, sf):
    return tidy(describe.compact_text_stats(EV_GAPS.df(spark, sf), ["event_type"]))


@query(
    "dsc8_date_span",
    """select 'ts' as "column", strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') as min_date, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') as max_date,
    cast(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) as bigint) as range_days from events""",
)
def _(spark, sf):
    return describe.date_ranges(table(spark, sf, "events"), ["ts"])


@query(
    "dsc9_compare_summary",
    union_all(
        ["l_quantity", "l_discount", "l_tax"],
        lambda c: f"""select '{c}' as "column", round(avg({c}), 4) as mean, round(median({c}), 4) as median, round(stddev({c}), 4) as std,
        round(min({c}), 4) as min, round(max({c}), 4) as max from lineitem""",
    ),
)
def _(spark, sf):
    return tidy(describe.compare_stats(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))


@query(
    "dsc10_missing_summary",
    'select * from ('
    + union_all(
        ["qty", "disc", "flag", "shipped", "l_orderkey"],
        lambda c: f"""select '{c}' as "column", count(*) - count({c}) as null_count, round(100.0 * (count(*) - count({c})) / count(*), 2) as null_pct from {LI_GAPS.sql}""",
    )
    + ") where null_count > 0",
)
def _(spark, sf):
    return describe.missing_summary(LI_GAPS.df(spark, sf))


@query("prf_text_table_top_values", """select * from (select 'lang' as "column", row_number() over (order by count(*) desc, lang) as rank, lang as value, count(*) as count from documents group by lang) where rank <= 10
 union all select * from (select 'source' as "column", row_number() over (order by count(*) desc, source) as rank, source as value, count(*) as count from documents group by source) where rank <= 10""")
def _(spark, sf):
    return tidy(frequency.top_values(table(spark, sf, "documents"), ["lang", "source"], 10))


