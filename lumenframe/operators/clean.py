"""Cleaning: filling, duplicates, outliers, text, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions import text
from lumenframe.functions.dates import to_moment
from lumenframe.functions.numbers import number, percent, quoted, safe_round
from lumenframe.operators import catalog
from lumenframe.operators.describe import null_counts, numeric_summary, outlier_counts
from lumenframe.operators.frequency import distinct_counts, distinct_rows, duplicate_rows, modes
from lumenframe.operators.frequency import numeric_frequencies, numeric_modes
from lumenframe.operators.order import key_struct
from lumenframe.operators.quantiles import fences, fit_quantiles
from lumenframe.plans.rules import pinned

# Numbers commonly used to stand for a missing one.
SENTINELS = [-999.0, -9999.0, -1.0, 0.0]


class History:
    """A table with its cleaning steps; ``reset`` drops them and keeps the original."""

    def __init__(self, original: DataFrame):
        self.original, self.current, self.actions = original, original, []

    def apply(self, action: str, step, *args, **kwargs) -> DataFrame:
        self.current = step(self.current, *args, **kwargs)
        self.actions.append(action)
        return self.current

    def reset(self) -> DataFrame:
        self.current = self.original
        self.actions.append("reset")
        return self.current


def _mode_literal(df: DataFrame, name: str, value):
    """A mode from a frequency table as a literal of the column's own type."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_micros(F.lit(value)).cast(dtype)
    if isinstance(dtype, T.DateType):
        return F.date_from_unix_date(F.lit(value).cast("int"))
    return F.lit(value).cast(dtype)


def fill_nulls(
    df: DataFrame, strategy: str = "mean", columns: list[str] | None = None, kinds: dict[str, str] | None = None
) -> DataFrame:
    """Fill numbers by mean, median or mode, everything else by mode.

    One job per kind of statistic fits the fill values; the fill itself is a projection.
    """
    df = catalog.missing_as_null(df)
    kinds = kinds or catalog.column_kinds(df)
    columns = [c for c in (columns or df.columns) if c in df.columns and kinds[c] != "complex"]
    numeric = [c for c in columns if kinds[c] == "numeric"]
    other = [c for c in columns if kinds[c] != "numeric"]
    out = {}
    fitted: dict[str, float | None] = {}
    if numeric and strategy == "mean":
        row = df.agg(*[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(numeric)]).first()
        fitted = {c: row[f"m{i}"] for i, c in enumerate(numeric)}
    elif numeric and strategy == "median":
        fitted = {c: q[0] for c, q in fit_quantiles(df, numeric, [0.5]).items()}
    elif numeric:
        rows = numeric_modes(numeric_frequencies(df, numeric)).collect()
        fitted = {r["column"]: r["mode"] for r in rows}
    for c, v in fitted.items():
        if v is not None:
            out[c] = F.coalesce(number(df, c), F.lit(float(v)))
    for c, v in (modes(df, other) if other else {}).items():
        if kinds[c] == "datetime" and isinstance(df.schema[c].dataType, T.StringType):
            moment = to_moment(F.col(quoted(c)), T.StringType())
            out[c] = F.coalesce(moment, to_moment(F.lit(v), T.StringType()))
        else:
            out[c] = F.coalesce(F.col(quoted(c)), _mode_literal(df, c, v))
    return df.withColumns(out) if out else df


def drop_duplicates(df: DataFrame) -> DataFrame:
    return distinct_rows(df)


def drop_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return catalog.missing_as_null(df).dropna("any", subset=columns)


def strip_whitespace(df: DataFrame) -> DataFrame:
    return normalize_text(df, None, ["strip"])


def normalize_text(df: DataFrame, columns: list[str] | None = None, operations: list[str] | None = None) -> DataFrame:
    """Apply text operations in order to text columns (``lowercase, strip`` by default)."""
    texts = catalog.text_columns(df)
    out = {}
    for c in columns or texts:
        if c in texts:
            expr = F.col(quoted(c))
            for op in operations or ["lowercase", "strip"]:
                expr = text.OPERATIONS[op](expr)
            out[c] = expr
    return df.withColumns(out) if out else df


def missing_patterns(df: DataFrame, order_by: list[str]) -> DataFrame:
    """``column, pattern``: where in the order the missing values sit.

    The first k rows are all missing exactly when the last missing key comes before the
    first present one, so two extreme keys per column decide it; no window is needed.
    """
    df = catalog.missing_as_null(df)
    key = key_struct(order_by)
    aggs, cells = [], []
    for i, name in enumerate(df.columns):
        gone = F.col(quoted(name)).isNull()
        aggs += [
            F.min(F.when(gone, key)).alias(f"g0{i}"),
            F.max(F.when(gone, key)).alias(f"g1{i}"),
            F.min(F.when(~gone, key)).alias(f"p0{i}"),
            F.max(F.when(~gone, key)).alias(f"p1{i}"),
        ]
        pattern = (
            F.when(F.col(f"p0{i}").isNull(), "all_missing")
            .when(F.col(f"g1{i}") < F.col(f"p0{i}"), "top_rows")
            .when(F.col(f"g0{i}") > F.col(f"p1{i}"), "bottom_rows")
            .otherwise("random")
        )
        cells.append(F.struct(F.lit(name).alias("column"), pattern.alias("pattern")))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def analyze_missing(df: DataFrame, order_by: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """Columns with missing values: count, share, pattern and a recommended strategy."""
    kinds = kinds or catalog.column_kinds(df)
    base = catalog.kind_frame(df, kinds).join(F.broadcast(null_counts(df)), "column")
    advice = (
        F.when(F.col("kind") != "numeric", "mode")
        .when(F.col("null_pct") < 5, "mean")
        .when(F.col("null_pct") < 20, "median")
        .otherwise("knn")
    )
    return (
        base.where(F.col("null_count") > 0)
        .join(F.broadcast(missing_patterns(df, order_by)), "column")
        .select("column", "kind", "null_count", "null_pct", "pattern", advice.alias("recommendation"))
    )


def missing_totals(df: DataFrame) -> DataFrame:
    """``total_missing, total_cells, total_missing_pct``."""
    n = null_counts(df).agg(
        F.sum("null_count").alias("total_missing"), F.sum(F.col("null_count") + F.col("non_null")).alias("total_cells")
    )
    return n.withColumn("total_missing_pct", percent(F.col("total_missing"), F.col("total_cells")))


def detect_invalid_values(df: DataFrame) -> DataFrame:
    """``column, issue, count, examples``: empty or padded text, infinities, sentinels.

    Sentinels count only below a tenth of the rows; at most five distinct ones exist.
    """
    aggs, cells = [F.count(F.lit(1)).alias("rows")], []

    def add(name, issue, i, condition, examples, guard=None):
        key = f"{issue}{i}"
        aggs.append(F.count_if(condition).alias(key))
        keep = F.col(key) > 0 if guard is None else (F.col(key) > 0) & guard(F.col(key))
        cells.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(issue).alias("issue"),
                F.when(keep, F.col(key)).alias("count"),
                examples.alias("examples"),
            )
        )

    none = F.lit(None).cast("string")
    for i, f in enumerate(df.schema.fields):
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, T.StringType):
            add(f.name, "empty", i, text.strip(c) == "", none)
            add(f.name, "padded", i, text.strip(c) != c, none)
        elif isinstance(f.dataType, T.NumericType):
            x = number(df, f.name)
            add(f.name, "infinite", i, F.abs(x) == F.lit(float("inf")), none)
            present = [F.max(F.when(x == s, F.lit(f"{s:.0f}"))).alias(f"s{i}_{j}") for j, s in enumerate(SENTINELS)]
            aggs += present
            listed = F.concat_ws(",", *[F.col(f"s{i}_{j}") for j in range(len(SENTINELS))])
            add(f.name, "sentinel", i, x.isin(SENTINELS), listed, lambda k: k < F.col("rows") * 0.1)
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, issue string, count bigint, examples string")
    return df.agg(*aggs).select(F.inline(F.array(*cells))).where(F.col("count").isNotNull())


def detect_outliers(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Columns with IQR or z-score outliers, from at least ten values; z uses the population spread."""
    cols = cols or catalog.numeric_columns(df)
    stats = pinned(numeric_summary(df, cols).where(F.col("count") >= 10))
    out = outlier_counts(df, stats, cols, "pop_std")
    return out.where((F.col("iqr_outliers") > 0) | (F.col("zscore_outliers") > 0)).select(
        "column",
        "iqr_outliers",
        "zscore_outliers",
        *[safe_round(F.col(c)).alias(c) for c in ("lower_fence", "upper_fence", "min", "max")],
    )


def treat_outliers(df: DataFrame, columns: list[str] | None = None, method: str = "clip") -> DataFrame:
    """Clip outliers to the fences, drop their rows, or blank them.

    ``remove`` works column by column: later fences are fitted on the surviving rows.
    """
    columns = columns or catalog.numeric_columns(df)
    if method == "remove":
        for c in columns:
            fitted = fit_quantiles(df, [c], [0.25, 0.75])
            if c in fitted:
                lo, hi = fences(*fitted[c])
                x = number(df, c)
                df = df.where(x.between(lo, hi) | x.isNull())
        return df
    if method not in ("clip", "nan"):
        raise ValueError(f"unknown outlier treatment {method!r}")
    out = {}
    for c, (q1, q3) in fit_quantiles(df, columns, [0.25, 0.75]).items():
        lo, hi = fences(q1, q3)
        x = number(df, c)
        if method == "clip":
            out[c] = F.when(x < lo, lo).when(x > hi, hi).otherwise(x)
        else:
            out[c] = F.when(x.between(lo, hi), F.col(quoted(c)))
    return df.withColumns(out)


def analyze_duplicates(df: DataFrame) -> DataFrame:
    """``total_rows, duplicate_rows, duplicate_pct, unique_rows``."""
    d = duplicate_rows(df)
    total = F.count(F.lit(1))
    return df.agg(total.alias("total_rows")).select(
        "total_rows",
        F.lit(d).cast("bigint").alias("duplicate_rows"),
        percent(F.lit(d), F.col("total_rows")).alias("duplicate_pct"),
        (F.col("total_rows") - d).alias("unique_rows"),
    )


def duplicate_contributions(df: DataFrame, k: int = 10) -> DataFrame:
    """Share of rows that repeat an earlier value, per column; only when rows repeat at all.

    The top ``k`` columns, ties by name. Missing counts as one value.
    """
    schema = "column string, duplicate_contribution double"
    if duplicate_rows(df) == 0:
        return df.sparkSession.createDataFrame([], schema)
    scalar = [f.name for f in df.schema.fields if not isinstance(f.dataType, catalog.COMPLEX)]
    n = null_counts(df.select([F.col(quoted(c)) for c in scalar]))
    joined = n.join(F.broadcast(distinct_counts(df, scalar)), "column", "left")
    rows = F.col("null_count") + F.col("non_null")
    values = F.coalesce("unique_count", F.lit(0)) + (F.col("null_count") > 0).cast("int")
    share = percent(rows - values, rows)
    return (
        joined.select("column", share.alias("duplicate_contribution"))
        .orderBy(F.col("duplicate_contribution").desc(), "column")
        .limit(k)
    )


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """``metric, before, after, change, change_pct`` for rows, columns, missing, duplicates."""

    def totals(df: DataFrame, label: str) -> DataFrame:
        n = null_counts(df).agg(
            F.max(F.col("null_count") + F.col("non_null")).alias("rows"),
            F.count(F.lit(1)).alias("columns"),
            F.sum("null_count").alias("missing"),
        )
        n = n.withColumn("duplicates", F.lit(duplicate_rows(df)).cast("bigint"))
        return n.unpivot([], ["rows", "columns", "missing", "duplicates"], "metric", label)

    both = totals(before, "before").join(totals(after, "after"), "metric")
    change = F.col("after") - F.col("before")
    return both.select("metric", "before", "after", change.alias("change"), percent(change, F.col("before")).alias("change_pct"))


def auto_clean(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trim text, drop duplicates, fill the gaps. Returns the table and its action log."""
    spark = df.sparkSession
    log = []
    out = catalog.missing_as_null(df)
    texts = catalog.text_columns(out)
    if texts:
        out = normalize_text(out, texts, ["strip", "collapse_whitespace"])
        log.append(("strip_whitespace", ",".join(texts), None, None))
    removed = duplicate_rows(out)
    out = distinct_rows(out)
    if removed:
        log.append(("drop_duplicates", None, None, removed))
    kinds = catalog.column_kinds(out)
    gaps = {r["column"]: r["null_count"] for r in null_counts(out).where(F.col("null_count") > 0).collect()}
    fillable = [c for c in out.columns if c in gaps and kinds[c] != "complex"]
    have = {r["column"] for r in null_counts(out).where(F.col("non_null") > 0).collect()}
    for c in fillable:
        if c in have:
            log.append(("fill_nulls", c, "median" if kinds[c] == "numeric" else "mode", gaps[c]))
    if fillable:
        out = fill_nulls(out, "median", fillable, kinds)
    return out, spark.createDataFrame(log, "action string, columns string, strategy string, affected bigint")
