"""Chart, target, KPI and feature recommendations from the column profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.numbers import is_numeric, number, quoted
from lumenframe.operators import catalog
from lumenframe.operators.correlation import complete_pearson
from lumenframe.operators.describe import null_counts, numeric_summary
from lumenframe.operators.frequency import distinct_counts

# Name fragments that mark a key figure, in order of precedence.
KPI_WORDS = {
    "revenue": ["revenue", "sales", "amount", "total", "income"],
    "profit": ["profit", "margin", "gain", "net"],
    "cost": ["cost", "expense", "spend", "price"],
    "count": ["count", "quantity", "orders", "transactions", "units"],
    "rate": ["rate", "ratio", "percent", "conversion", "growth"],
    "customer": ["customer", "user", "client", "subscriber"],
    "date": ["date", "time", "period", "month", "year", "day"],
}

# Two-valued columns read as booleans.
BOOLEAN_LIKE = ["true", "false", "yes", "no", "0", "1"]


def _by_kind(df: DataFrame, kinds: dict[str, str] | None):
    kinds = kinds or catalog.column_kinds(df)
    return [catalog.columns_of(df, k, kinds) for k in ("numeric", "categorical", "datetime")]


def suggest_charts(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """``position, priority, chart_type, x, y, agg`` from column kinds alone, best first."""
    num, cat, date = _by_kind(df, kinds)
    found = [(3, "histogram", x, None, None) for x in num[:4]]
    found += [(1, "scatter", num[i], num[i + 1], None) for i in range(min(len(num) - 1, 3))]
    if cat and num:
        found.append((2, "bar", cat[0], num[0], "mean"))
    if date and num:
        found.append((1, "line", date[0], num[0], None))
    if cat and num:
        found.append((4, "box", cat[0], num[0], None))
    rows = [(i + 1, *r) for i, r in enumerate(sorted(found, key=lambda r: r[0]))]
    return df.sparkSession.createDataFrame(
        rows, "position int, priority int, chart_type string, x string, y string, agg string"
    )


def recommend_charts(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """``position, confidence, category, chart_type, x, y, agg, metric``, most confident first.

    ``metric`` is the number behind the advice: distinct values, skewness or correlation.
    """
    num, cat, date = _by_kind(df, kinds)
    first_cats, first_nums = cat[:2], num[:3]
    unique = {r["column"]: r["unique_count"] for r in distinct_counts(df, first_cats).collect()} if cat else {}
    skew = {r["column"]: r["skewness"] for r in numeric_summary(df, first_nums).collect()} if num else {}
    r = {}
    if len(num) >= 2:
        pairs = complete_pearson(df, num[:4]).collect()
        r = {(p["feature_a"], p["feature_b"]): p["r"] for p in pairs}
    found = []
    for d in date[:2]:
        found += [(95, "trend", "line", d, n, None, None) for n in num[:2]]
    for c in first_cats:
        k = unique.get(c, 0)
        if k <= 8:
            found.append((85, "composition", "pie", c, None, None, float(k)))
        found.append((90, "comparison", "bar", c, num[0] if num else None, "count", None))
    found += [(88, "comparison", "bar", c, n, "mean", None) for c in first_cats for n in num[:2]]
    found += [(90, "distribution", "histogram", n, None, None, skew.get(n)) for n in first_nums]
    for i in range(min(len(num) - 1, 3)):
        value = r.get((num[i], num[i + 1]))
        sure = value is not None and abs(value) > 0.3
        found.append((85 if sure else 70, "relationship", "scatter", num[i], num[i + 1], None, value))
    if cat and num and unique.get(cat[0], 0) <= 15:
        found.append((82, "distribution", "box", cat[0], num[0], None, None))
    rows = [(i + 1, *f) for i, f in enumerate(sorted(found, key=lambda f: -f[0]))]
    return df.sparkSession.createDataFrame(
        rows,
        "position int, confidence int, category string, chart_type string, x string, y string, agg string, metric double",
    )


def target_candidates(df: DataFrame, cols: list[str] | None = None, uniques: DataFrame | None = None) -> DataFrame:
    """``column, unique_values, task``: classification for few values, regression for many."""
    cols = cols or catalog.numeric_columns(df)
    n = df.count()
    u = F.col("unique_count")
    task = F.when(u.between(2, min(20, n * 0.05)), "classification").when((u > 20) & (u > n * 0.05), "regression")
    counts = distinct_counts(df, cols) if uniques is None else uniques.where(F.col("column").isin(cols))
    return counts.select("column", u.alias("unique_values"), task.alias("task")).where("task is not null")


def kpi_kind(name: Column) -> Column:
    """Kind of key figure a column name points to, or NULL."""
    expr = None
    for kind, words in KPI_WORDS.items():
        hit = F.lower(name).rlike("|".join(words))
        expr = F.when(hit, kind) if expr is None else expr.when(hit, kind)
    return expr


def kpi_candidates(df: DataFrame, nulls: DataFrame | None = None) -> DataFrame:
    """``position, column, kpi_kind, non_null`` of the columns whose name marks a key figure and that have values.

    ``nulls`` is the table's ``null_counts`` where it is known already.
    """
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "position int, column string")
    marked = names.withColumn("kpi_kind", kpi_kind(F.col("column"))).where("kpi_kind is not null")
    present = (null_counts(df) if nulls is None else nulls).select("column", "non_null").where("non_null > 0")
    return marked.join(F.broadcast(present), "column").select("position", "column", "kpi_kind", "non_null")


def boolean_like(df: DataFrame) -> DataFrame:
    """``column``: booleans, and columns whose two values are a yes/no pair."""
    scalar = [f for f in df.schema.fields if not isinstance(f.dataType, catalog.COMPLEX)]
    aggs, cells = [], []
    for i, f in enumerate(scalar):
        c = F.col(quoted(f.name))
        if f.dataType.simpleString() == "boolean":
            ok = F.lit(True)
            aggs.append(F.count(c).alias(f"n{i}"))
        else:
            word = number(df, f.name).cast("int").cast("string") if is_numeric(f.dataType) else F.lower(c.cast("string"))
            exact = (number(df, f.name).isin(0.0, 1.0)) if is_numeric(f.dataType) else word.isin(BOOLEAN_LIKE)
            aggs += [
                F.bool_and(exact).alias(f"b{i}"),
                F.min(word).alias(f"lo{i}"),
                F.max(word).alias(f"hi{i}"),
                F.collect_set(F.when(exact, c.cast("string"))).alias(f"s{i}"),
            ]
            ok = F.col(f"b{i}") & (F.size(f"s{i}") == 2)
        cells.append(F.struct(F.lit(f.name).alias("column"), ok.alias("ok")))
    return df.agg(*aggs).select(F.inline(F.array(*cells))).where("ok").select("column")


def recommend_features(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """``position, operation, columns, priority, unique_count``: feature steps worth taking."""
    num, cat, date = _by_kind(df, kinds)
    unique = {r["column"]: r["unique_count"] for r in distinct_counts(df, cat).collect()} if cat else {}
    gaps = {r["column"] for r in null_counts(df).where("null_count > 0").collect()}
    found = []
    for c in cat:
        k = unique.get(c, 0)
        if k <= 10:
            found.append(("onehot", c, "medium", k))
        elif k <= 50:
            found.append(("label", c, "low", k))
    if num:
        found.append(("standardize", ", ".join(num[:5]), "medium", None))
    found += [("date_features", c, "high", None) for c in date]
    found += [("missing_indicator", c, "low", None) for c in num if c in gaps]
    found += [("binning", c, "low", None) for c in num[:3]]
    rows = [(i + 1, *f) for i, f in enumerate(found)]
    return df.sparkSession.createDataFrame(
        rows, "position int, operation string, columns string, priority string, unique_count bigint"
    )
