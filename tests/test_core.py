"""Order, ranks, quantiles, fills, joins and correlation against brute force on small frames."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import correlation, frequency, impute, joins, order, quantiles
from lumenframe.operators.distribution import histogram, kde, qq_points


def frame(spark, values, schema="i int, v double"):
    return spark.createDataFrame(values, schema)


@pytest.mark.parametrize("inline_rows", [3, 50, 10**6])
def test_quantiles_do_not_depend_on_the_bracket_limit(spark, inline_rows):
    rng = np.random.default_rng(1)
    # A third of the rows is one value; the rest is continuous.
    data = np.concatenate([np.full(300, 5.0), rng.normal(5, 3, 600)])
    rows = [("a", float(x)) for x in data] + [("b", float(x)) for x in rng.integers(0, 4, 200)]
    long = spark.createDataFrame(rows, "column string, value double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.5001, 0.75, 0.99, 1.0]
    got = {r["column"]: r["q"] for r in quantiles.quantile_frame(long, probs, inline_rows=inline_rows).collect()}
    np.testing.assert_allclose(got["a"], np.quantile(data, probs), rtol=1e-12)
    np.testing.assert_allclose(got["b"], np.quantile([v for k, v in rows if k == "b"], probs), rtol=1e-12)


def test_summary_is_the_same_beyond_the_inline_limit(spark, sf, monkeypatch):
    from lumenframe.operators import describe

    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice"]
    want = {r["column"]: r.asDict() for r in describe.numeric_summary(li, cols).collect()}
    monkeypatch.setattr(describe, "INLINE_ROWS", 10)
    got = {r["column"]: r.asDict() for r in describe.numeric_summary(li, cols).collect()}
    assert got.keys() == want.keys()
    for c in cols:
        for k in ("count", "mean", "q1", "median", "q3", "kurtosis"):
            assert got[c][k] == pytest.approx(want[c][k], rel=1e-9)


def test_row_numbers_with_a_hot_first_key(spark):
    rows = [(7 if i % 3 else i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    out = order.number_rows(df, ["a", "b"], rows_per_bucket=100).collect()
    expect = {t: n + 1 for n, t in enumerate(sorted(rows))}
    assert {(r["a"], r["b"]): r["row_no"] for r in out} == expect


def test_rank_values_across_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [("x", float(v)) for v in rng.integers(0, 400, 2000)] + [("y", float(v)) for v in rng.normal(size=500)]
    freq = spark.createDataFrame(rows, "column string, value double").groupBy("column", "value").count()
    freq = freq.withColumnRenamed("count", "n")
    for per in (50, 10**6):
        got = {(r["column"], r["value"]): (r["before"], r["total"]) for r in order.rank_values(freq, "column", rows_per_bucket=per).collect()}
        for c in ("x", "y"):
            values = sorted(v for k, v in rows if k == c)
            for v in set(values):
                assert got[(c, v)] == (np.searchsorted(values, v), len(values))


@pytest.mark.parametrize("per", [2, 3, 10**6])
def test_fills_and_interpolation(spark, per):
    values = [None, 1.0, None, None, 4.0, None]
    df = frame(spark, list(enumerate(values))).repartition(3)

    def run(fn):
        return [r["v"] for r in fn(df, ["i"], ["v"], rows_per_bucket=per).orderBy("i").collect()]

    assert run(impute.forward_fill) == [None, 1.0, 1.0, 1.0, 4.0, 4.0]
    assert run(impute.backward_fill) == [1.0, 1.0, 4.0, 4.0, 4.0, None]
    assert run(impute.interpolate) == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def brute_knn(rows, cols, k):
    out = [list(r) for r in rows]
    for i, r in enumerate(rows):
        for t in range(cols):
            if r[t] is None:
                found = []
                for d in rows:
                    shared = [j for j in range(cols) if r[j] is not None and d[j] is not None]
                    if d[t] is not None and shared:
                        found.append((cols / len(shared) * sum((r[j] - d[j]) ** 2 for j in shared), d[t]))
                found.sort()
                best = [v for _, v in found[:k]]
                present = [d[t] for d in rows if d[t] is not None]
                out[i][t] = sum(best) / len(best) if best else sum(present) / len(present)
    return out


@pytest.mark.parametrize("cells,per_cell,directory", [(1, 512, 99), (64, 5, 10**6), (64, 5, 3)])
def test_knn_matches_brute_force_with_copies(spark, monkeypatch, cells, per_cell, directory):
    monkeypatch.setattr(impute, "CELL_ROWS", per_cell)
    monkeypatch.setattr(impute, "MAX_DIRECTORY", directory)
    monkeypatch.setattr(impute, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(5)
    rows = [(1.0, 2.0, 3.0)] * 40  # a third of the table is copies
    rows += [tuple(float(x) for x in rng.integers(0, 30, 3)) for _ in range(80)]
    rows = [tuple(None if rng.random() < 0.15 else x for x in r) for r in rows]
    rows[0] = (None, None, None)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double, c double")
    out = impute.impute_knn(df, ["id"], ["a", "b", "c"], 5, max_cells=cells).orderBy("id").collect()
    np.testing.assert_allclose([[r["a"], r["b"], r["c"]] for r in out], brute_knn(rows, 3, 5), rtol=1e-9)


def brute_tau(x, y):
    s = tx = ty = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        s, tx, ty = s + a * b, tx + abs(a), ty + abs(b)
    return s / (tx * ty) ** 0.5


@pytest.mark.parametrize("per", [7, 40, 10**6])
def test_kendall_with_heavy_values(spark, per):
    rng = np.random.default_rng(4)
    x = np.where(np.arange(150) % 3 == 0, 5.0, rng.integers(0, 12, 150)).astype(float)
    y = x + rng.integers(-6, 7, 150)
    y[::4] = 9.0
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    got = correlation.kendall_tau(df, "x", "y", rows_per_bucket=per).first()
    assert got["tau"] == pytest.approx(brute_tau(x, y), abs=1e-12)


@pytest.mark.parametrize("hot", ["left", "right", "both", "none"])
@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "semi", "anti"])
def test_merge_equals_plain_join(spark, monkeypatch, hot, how):
    """Keys hot on either side, with repeated rows, are spread; the result stays that of the plain join."""
    many = [(1, 5)] * 40 + [(1, 6)] * 3 + [(77, 1)] * 30
    left = [(None if i % 10 == 0 else i, i) for i in range(60)] + (many if hot in ("left", "both") else [])
    right = [(i % 40, i) for i in range(50)] + [(None, -1), (500, 5)] + (many if hot in ("right", "both") else [])
    left, right = spark.createDataFrame(left, "k int, a int"), spark.createDataFrame(right, "k int, b int")
    monkeypatch.setattr(joins.skew_join, "__defaults__", ("inner", 7 if hot != "none" else 10**6))
    got = joins.merge_datasets(left, right, ["k"], how)
    spark_how = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
    expect = left.join(right, ["k"], spark_how).select(got.columns)

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    assert rows(got) == rows(expect)


@pytest.mark.parametrize("limit", [100_000, 2])
def test_lookup_keeps_rows_and_nulls(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", 2), (None, 3), ("z", 4)], "k string, v int")
    table = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "key string, code int")
    got = sorted((tuple(r) for r in joins.lookup(df, table, "k", "key", "code", "k").collect()), key=str)
    assert got == sorted([(10, 1)] * 50 + [(20, 2), (None, 3), (None, 4)], key=str)


def test_top_values_and_modes_break_ties_by_value(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 1.0), ("b", 1.0), ("a", 2.0), ("c", None)], "t string, v double")
    top = frequency.top_values(df, ["t"], 2).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in top] == [("a", 2), ("b", 2)]
    assert frequency.modes(df, ["t", "v"]) == {"t": "a", "v": 1.0}


def test_pair_aggregates_in_several_jobs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    data = pd.DataFrame(rng.normal(size=(60, 5)), columns=list("abcde"))
    want = data.corr()
    df = spark.createDataFrame(data)
    monkeypatch.setattr(correlation, "PAIRS_PER_JOB", 3)
    for fn in (correlation.pairwise_pearson, correlation.complete_pearson):
        rows = fn(df, list("abcde")).collect()
        assert len(rows) == 10
        for r in rows:
            assert r["r"] == pytest.approx(want.loc[r["feature_a"], r["feature_b"]], abs=1e-12)


def test_shapiro_uses_every_value(spark, monkeypatch):
    from lumenframe.operators import hypothesis

    monkeypatch.setattr(hypothesis, "RUN", 50)
    rng = np.random.default_rng(3)
    data = {"v": rng.gamma(4.0, size=900), "w": rng.integers(0, 6, 900).astype(float), "flat": np.ones(900)}
    df = spark.createDataFrame(pd.DataFrame(data)).repartition(5)
    for r in hypothesis.shapiro(df).collect():
        w, p = hypothesis.shapiro_wilk(data[r["column"]])
        assert (r["sample_size"], r["p_extrapolated"]) == (900, False)
        assert r["statistic"] == pytest.approx(w, rel=1e-9) and r["p_value"] == pytest.approx(p, rel=1e-6, abs=1e-12)
    for n in (3, 4, 5, 6, 12):
        small = df.limit(n)
        values = [r["v"] for r in small.collect()]
        got = hypothesis.shapiro(spark.createDataFrame([(x,) for x in values], "v double")).first()
        assert got["statistic"] == pytest.approx(hypothesis.shapiro_wilk(np.array(values))[0], rel=1e-9)
    two = hypothesis.shapiro(spark.createDataFrame([(1.0,), (2.0,)], "v double")).first()
    assert two["statistic"] is None and two["sample_size"] == 2


def test_kde_and_histogram_against_numpy(spark):
    rng = np.random.default_rng(8)
    data = rng.gamma(2.0, 3.0, 500)
    long = spark.createDataFrame([("v", float(x)) for x in data], "column string, value double").repartition(4)
    pts = kde(long, 50).orderBy("point").collect()
    h = len(data) ** -0.2 * data.std(ddof=1)
    grid = np.linspace(data.min(), data.max(), 50)
    want = np.exp(-0.5 * ((grid[:, None] - data) / h) ** 2).sum(axis=1) / (len(data) * h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose([r["density"] for r in pts], want, rtol=1e-9)
    counts = [r["count"] for r in histogram(long, 20).orderBy("bin").collect()]
    assert counts == np.histogram(data, 20)[0].tolist()


def test_qq_points_write_out_every_copy(spark, monkeypatch):
    from lumenframe.operators import distribution

    monkeypatch.setattr(distribution, "COPIES", 3)
    df = spark.createDataFrame([(2.0,)] * 10 + [(1.0,), (3.0,)], "v double")
    rows = qq_points(df, "v").orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(1, 13))
    assert [r["sample"] for r in rows] == [1.0] + [2.0] * 10 + [3.0]
    assert rows[0]["theoretical"] == pytest.approx(-rows[-1]["theoretical"])
    assert df.agg(F.count("*")).first()[0] == 12


def test_kendall_places_rows_without_a_shuffle(spark, monkeypatch):
    """However many rows a problem has, they don't meet their cuts in one task."""
    plans, settle = [], correlation.settle

    def kept(frame):
        if "bx" in frame.columns:
            plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return settle(frame)

    monkeypatch.setattr(correlation, "settle", kept)
    df = spark.range(400).select((F.col("id") * 7 % 400).cast("double").alias("x"), (F.col("id") * 11 % 397).cast("double").alias("y"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        correlation.kendall_tau(df, "x", "y", rows_per_bucket=300)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plans and not any("Exchange hashpartitioning" in p or "SortMergeJoin" in p for p in plans)


def test_knn_searches_for_distinct_rows_and_few_cells(spark, monkeypatch):
    """Copies of a row with gaps are searched for once, and only in cells within reach of the k-th donor found."""
    visited, settle = [], impute.settle

    def kept(frame):
        out = settle(frame)
        if "slice" in frame.columns:
            visited.append(out.count())
        return out

    monkeypatch.setattr(impute, "settle", kept)
    monkeypatch.setattr(impute, "CELL_ROWS", 5)
    rows = [(float(i % 40), float(i // 40), float(i)) for i in range(1600)] + [(7.0, 7.0, None)] * 50 + [(33.0, 4.0, None)] * 50
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double, c double")
    out = impute.impute_knn(df, ["id"], ["a", "b", "c"], 5).orderBy("id").collect()
    want = brute_knn([*rows[:1600], rows[1600], rows[1650]], 3, 5)
    assert [r["c"] for r in out[1600:]] == pytest.approx([want[1600][2]] * 50 + [want[1601][2]] * 50)
    assert visited and sum(visited) < 100  # of 320 cells for each of 100 rows
