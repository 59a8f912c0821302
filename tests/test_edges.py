"""Edge frames, readers, writers and the rules the code base keeps."""

import gzip
import json
import math
import os
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import text
from lumenframe.operators import catalog, charts, clean, correlation, describe, distribution, features, filters, hypothesis, quality
from lumenframe.plans import eda, insights
from lumenframe.plans.rules import pinned
from lumenframe.session import FREE_SHUFFLES, settle
from lumenframe.sources import readers, writers
from lumenframe.streaming.ingest import ingest_delimited

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, float(i), 1.0, None, "x" if i % 2 else "", None if i == 3 else True) for i in range(12)]
    return spark.createDataFrame(rows, "id int, v double, one double, gone double, t string, b boolean")


def test_profile_of_empty_single_and_odd_frames(spark, odd):
    empty = odd.where("id < 0")
    assert describe.profile(empty).summary.first().asDict() == {"n_rows": 0, "n_cols": 6, "total_nulls": 0, "duplicate_rows": 0}
    assert describe.profile(empty).columns.count() == 6
    single = describe.profile(odd.limit(1)).columns.where("column = 'v'").first()
    assert single["std"] is None and single["mean"] == 0.0
    cols = {r["column"]: r for r in describe.profile(odd).columns.collect()}
    assert cols["gone"]["null_count"] == 12 and cols["gone"]["unique_count"] == 0 and cols["gone"]["mean"] is None
    assert cols["b"]["kind"] == "categorical" and cols["one"]["unique_count"] == 1


def test_nan_is_missing_and_infinity_is_a_value(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert describe.null_counts(df).first()["null_count"] == 2
    found = clean.detect_invalid_values(df).collect()
    assert [(r["issue"], r["count"]) for r in found] == [("infinite", 1)]


def test_reports_survive_degenerate_tables(spark, odd):
    for df in (odd, odd.select("t"), odd.select("gone", "one")):
        report = eda.eda_report(df)
        assert report["health"].first()["score"] <= 100
        stats = insights.dataset_statistics(df)
        assert insights.statistical_insights(stats).count() >= 0
    assert correlation.pair_report(odd.select("v", "one")).count() == 0
    assert distribution.column_report(odd.select("one")).first()["shape"] is not None


def test_statistics_are_computed_when_asked_for(spark, odd, monkeypatch):
    stats = insights.dataset_statistics(odd)
    assert all(stats[name] is not None for name in stats)

    def unwanted(*args, **kwargs):
        raise AssertionError("not asked for")

    for name in ("boolean_like", "compact_numeric_stats", "compact_text_stats", "kpi_candidates", "target_candidates", "totals"):
        monkeypatch.setattr(insights, name, unwanted)
    assert insights.dataset_statistics(odd)["pairs"].count() >= 0


def test_reports_of_all_types_share_sections(spark, monkeypatch):
    made, column_report = [], distribution.column_report
    monkeypatch.setattr(distribution, "column_report", lambda *a, **k: made.append(1) or column_report(*a, **k))
    df = spark.createDataFrame([(float(i), float(i * i % 7)) for i in range(30)], "a double, b double")
    reports = eda.eda_reports(df)
    assert [n for n, r in reports.items() if "distribution" in r] == ["full", "technical"] and list(reports) == list(eda.PROFILES)
    assert all(r["distribution"].count() == 2 for r in reports.values() if "distribution" in r) and len(made) == 1
    assert 3 in [r["rule"] for r in reports["full"]["insights"].collect()]
    assert 3 not in [r["rule"] for r in reports["quick"]["insights"].collect()]
    assert "distribution" in eda.eda_report(df.select("a")) and "correlation" not in eda.eda_report(df.select("a"))


def test_outlier_counts_in_one_aggregate(spark):
    rows = [(float(i), 5.0, float("inf") if i == 3 else float(i), None) for i in range(40)] + [(1000.0, 5.0, float("nan"), None)]
    df = spark.createDataFrame(rows, "a double, flat double, wild double, gone double")
    stats = pinned(describe.numeric_summary(df))
    found = describe.outlier_counts(df, stats, df.columns)
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["column"]: (r["iqr_outliers"], r["zscore_outliers"]) for r in found.collect()}
    assert got["a"] == (1, 1) and got["flat"] == (0, 0) and got["wild"][0] == 1 and "gone" not in got


def test_scalers_keep_flat_columns_finite(spark, odd):
    for fn in (features.scale_standard, features.scale_minmax, features.scale_robust):
        assert all(math.isfinite(r["one"]) for r in fn(odd, ["one"]).select("one").collect())
    binned = features.create_binning(odd.select("one"), "one", 4).distinct().collect()
    assert len(binned) == 1


def test_onehot_refuses_instead_of_cutting(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("k"))
    with pytest.raises(ValueError):
        features.encode_onehot(df, ["k"], max_categories=5)


def test_text_functions_on_non_ascii(spark):
    df = spark.createDataFrame([("  o'neil-smith éTÉ ", ), (None,)], "s string")
    r = df.select(text.title(F.col("s")).alias("t"), text.strip(F.col("s")).alias("s")).collect()
    assert r[0]["t"] == "  O'Neil-Smith Été "
    assert r[0]["s"] == "o'neil-smith éTÉ"
    assert r[1]["t"] is None


def test_number_text(spark):
    df = spark.createDataFrame([(v,) for v in ("1", " 1e3 ", "1d", "5f", "0x1F", "1,000", "-.5", "inf", "abc", "")], "s string")
    got = [r[0] for r in df.select(filters.number(df, "s")).collect()]
    assert got == [1.0, 1000.0, None, None, None, None, -0.5, float("inf"), None, None]


def test_date_text_kinds(spark):
    rows = [("2024-01-0%d" % i, "%d/2/2024" % i, str(i)) for i in range(1, 10)] + [("bad", "bad", "bad")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    assert catalog.column_kinds(df) == {"a": "datetime", "b": "datetime", "c": "categorical"}


def test_filters_skip_unknown_columns_and_null_values(spark, odd):
    spec = [{"column": "nope", "operator": "eq", "value": 1}, {"column": "v", "operator": "gt", "value": None}]
    assert filters.apply_filters(odd, spec).count() == 12
    assert filters.apply_filters(odd, [{"column": "b", "operator": "neq", "value": "true"}]).count() == 1


def test_filters_reach_the_scan(spark, sf, capsys):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    spec = [{"column": "l_quantity", "operator": "gt", "value": 10}, {"column": "l_returnflag", "operator": "eq", "value": "A"}]
    filters.apply_filters(li, spec).select("l_orderkey").explain()
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", capsys.readouterr().out).group(1)
    assert "GreaterThan(l_quantity,10.0)" in pushed and "EqualTo(l_returnflag,A)" in pushed
    nan = spark.createDataFrame([(float("nan"),), (11.0,), (None,)], "v double")
    assert filters.apply_filters(nan, [{"column": "v", "operator": "gte", "value": 10}]).count() == 1


def test_sorted_rows_put_missing_last_both_ways(spark):
    from lumenframe.operators.select import sorted_rows

    df = spark.createDataFrame([(None,), (2.0,), (1.0,)], "v double")
    assert [r["v"] for r in sorted_rows(df, "v").collect()] == [1.0, 2.0, None]
    assert [r["v"] for r in sorted_rows(df, "v", descending=True).collect()] == [2.0, 1.0, None]


def test_short_series(spark):
    three = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0)], "x int, y double")
    assert charts.forecast(three, "x", "y").count() == 0
    assert [r["trend"] for r in charts.time_series(three, "x", "y").orderBy("i").collect()][0] is None
    assert hypothesis.mann_whitney(three, "x", "y").count() == 0
    assert hypothesis.chi_square(three.withColumn("c", F.lit("k")), "c", "x").count() == 0


def test_duplicate_columns_pair_with_the_first(spark):
    df = spark.createDataFrame([(1, 1, 1, 2), (3, 3, 3, 3), (1, 1, 1, 2)], "a int, b int, c int, d int")
    rows = {(r["column1"], r["column2"]) for r in quality.duplicate_columns(df).collect()}
    assert rows == {("a", "b"), ("a", "c")}


def test_json_documents_and_delimiters(spark, tmp_path):
    records = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    shapes = {"array": records, "wrap": {"meta": 1, "rows": records}, "cols": {"a": [1, 2], "b": ["x", None]}}
    for name, doc in shapes.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(doc, indent=1))
        got = sorted((r["a"], r["b"] or "") for r in readers.read_any(spark, str(path)).collect())
        assert got == [(1, "x"), (2, "")], name
    for sep in ",\t;|":
        path = tmp_path / f"d{ord(sep)}.csv"
        path.write_text(f"a{sep}b\n1{sep}x\n2{sep}y\n")
        assert readers.sniff_delimiter(spark, str(path)) == sep
    packed = tmp_path / "z.csv.gz"
    packed.write_bytes(gzip.compress(b"a,b\n1,x\n2,y\n"))
    assert readers.read_any(spark, str(packed)).count() == 2
    latin = tmp_path / "l.csv"
    latin.write_bytes("a\nétage\n".encode("latin-1"))
    assert readers.read_any(spark, str(latin)).first()["a"] == "étage"
    blank = tmp_path / "e.csv"
    blank.write_text("a,b\n")
    with pytest.raises(readers.EmptyDataError):
        readers.read_any(spark, str(blank))


def test_bad_lines_are_skipped(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("a,b\n1,2\n1,2,3,4\n5,6\n")
    assert readers.read_delimited(spark, str(path)).collect() == readers.read_delimited(spark, str(path), sep=",").collect()
    assert sorted(r["a"] for r in readers.read_delimited(spark, str(path), schema="a int, b int").collect()) == [1, 5]


def test_ingest_resumes_without_repeating(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    spark.range(5).write.mode("append").option("header", True).csv(src)
    ingest_delimited(spark, src, "id bigint", out, state).awaitTermination()
    spark.range(5, 8).write.mode("append").option("header", True).csv(src)
    ingest_delimited(spark, src, "id bigint", out, state).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(8))


def test_export_sections_round_trip(spark, tmp_path, odd):
    writers.export_sections({"one": odd.select("id", "gone")}, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/one").count() == 12


def test_no_unbounded_patterns_in_the_library():
    """No cross joins, no local checkpoints, no row-at-a-time UDFs."""
    banned = re.compile(r"crossJoin|localCheckpoint|F\.udf\(|\.rdd\b|toLocalIterator")
    hits = [str(p) for p in (ROOT / "lumenframe").rglob("*.py") if banned.search(p.read_text())]
    assert hits == []


def test_report_sections_are_computed(spark, sf, monkeypatch):
    """The query says what the sections hold, not what their names promise."""
    from __spark_entry__ import queries
    from lumenframe.plans import eda

    nothing = spark.createDataFrame([], "column string")
    monkeypatch.setattr(eda.correlation, "pair_report", lambda *a, **b: nothing)
    got = {r["profile"]: (r["has_correlation"], r["has_distribution"]) for r in queries()["eda7_report_sections"](spark, sf).collect()}
    assert got["full"] == got["technical"] == (False, True) and got["quick"] == (False, False)


def test_settle_leaves_no_shuffle_files(spark):
    """What a settled table was shuffled through is gone with its write, and later queries have the session's own setting."""

    def shuffles():
        folder = Path(os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", "/tmp"))
        return set(folder.glob("blockmgr-*/*/shuffle_*"))

    keyed = spark.range(1000).selectExpr("id % 10 AS k", "id")
    keyed.groupBy("k").count().collect()
    before, own = shuffles(), spark.conf.get(FREE_SHUFFLES)
    assert before
    settled = settle(keyed.groupBy("k").count().groupBy("count").agg(F.count(F.lit(1)).alias("n")))
    until = time.time() + 3  # files are removed in the background
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before
    assert spark.conf.get(FREE_SHUFFLES) == own and [tuple(r) for r in settled.collect()] == [(100, 10)]
    with pytest.raises(Exception, match="[Dd]ivi"):
        settle(spark.range(1).select(F.expr("raise_error('division')")))
    assert spark.conf.get(FREE_SHUFFLES) == own
