"""Statistical insights: compact statistics of a table and the rules read from them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.numbers import band, percent
from lumenframe.operators import catalog, correlation, distribution
from lumenframe.operators.describe import Facts, compact_numeric_stats, compact_text_stats, date_ranges, shapes
from lumenframe.plans.recommend import boolean_like, kpi_candidates, target_candidates
from lumenframe.plans.rules import emit, fixed, pinned
from lumenframe.plans.sections import Sections

FIELDS = ["id", "category", "title", "detail", "priority", "impact_score", "evidence", "action"]
EXPORT = ["category", "title", "priority", "impact", "detail", "evidence", "action"]


def quality_score(missing_pct: Column, duplicate_pct: Column) -> Column:
    return F.greatest(F.lit(0.0), 100 - missing_pct * 2 - duplicate_pct)


def totals(facts: Facts) -> DataFrame:
    """``rows, columns, total_missing_pct, duplicate_rows, duplicate_pct, score, status``."""
    d = facts.duplicates
    n = facts.nulls.agg(
        F.max(F.col("null_count") + F.col("non_null")).alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        percent(F.sum("null_count"), F.sum(F.col("null_count") + F.col("non_null"))).alias("total_missing_pct"),
    )
    n = n.withColumn("duplicate_rows", F.lit(d).cast("bigint")).withColumn("duplicate_pct", percent(F.lit(d), F.col("rows")))
    n = n.withColumn("score", quality_score(F.col("total_missing_pct"), F.col("duplicate_pct")))
    return n.withColumn("status", band(F.col("score"), (90, "excellent"), (70, "good"), (50, "fair"), otherwise="poor"))


def dataset_statistics(df: DataFrame, max_numeric: int | None = None, max_text: int | None = None) -> Sections:
    """All compact statistics as pinned frames, each computed when it is asked for. Column caps are optional arguments."""
    df = catalog.missing_as_null(df)
    numeric = catalog.numeric_columns(df)[:max_numeric]
    texts = catalog.text_columns(df)[:max_text]
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    facts = Facts(df)

    def stats() -> DataFrame:
        return facts.summary.where(F.col("column").isin(numeric))

    def placed_shapes() -> DataFrame:
        places = df.sparkSession.createDataFrame(list(enumerate(numeric)), "position int, column string")
        return pinned(shapes(df, numeric, stats()).join(F.broadcast(places), "column"))

    out = Sections()
    out.add("totals", lambda: pinned(totals(facts)))
    out.add("missing", lambda: facts.nulls.where("null_count > 0").select("column", "null_count", "null_pct"))
    out.add("kpis", lambda: pinned(kpi_candidates(df, facts.nulls)))
    out.add("booleans", lambda: pinned(boolean_like(df)))
    out.add("dates", lambda: pinned(date_ranges(df, dates)))
    if texts:
        out.add("text", lambda: pinned(compact_text_stats(df, texts)))
    if numeric:
        out.add("numeric", lambda: pinned(compact_numeric_stats(df, numeric, stats())))
        out.add("shapes", placed_shapes)
        out.add("targets", lambda: pinned(target_candidates(df, numeric, facts.uniques)))
    if len(numeric) >= 2:
        out.add("pairs", lambda: pinned(correlation.pair_report(df, "pearson", numeric)))
        out.add("collinear", lambda: correlation.multicollinear(out["pairs"]))
    return out


def distribution_summary(df: DataFrame) -> DataFrame:
    """The distribution report of all numeric columns with shape and quality score, in column order."""
    numeric = catalog.numeric_columns(df)
    places = df.sparkSession.createDataFrame(list(enumerate(numeric)), "position int, column string")
    return distribution.column_report(df, numeric).join(F.broadcast(places), "column").orderBy("position")


def _record(category, id_, title, detail, priority, impact, evidence, action) -> dict:
    values = (id_, category, title, detail, priority, impact, evidence, action)
    return dict(zip(FIELDS, values))


def _join(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def statistical_insights(stats: Mapping[str, DataFrame]) -> DataFrame:
    """Insights from thresholds on missing data, duplicates, outliers, correlation, skew and KPIs.

    Skew is looked at in the first five columns of the distribution summary, which holds numeric columns only.
    """
    c = F.col
    out = []
    affected = stats["missing"].count()
    missing, dup = c("total_missing_pct"), c("duplicate_pct")
    whole = [
        (missing > 10, _record(
            "quality", "quality_missing", _join("High Missing Data: ", missing.cast("string"), "% overall"),
            _join(missing.cast("string"), "% of all cells are missing."),
            F.when(missing > 30, "critical").otherwise("high"),
            F.least(F.lit(10), F.floor(missing / 5)).cast("int"),
            f"{affected} columns have gaps.", "Impute the gaps or drop what has them.",
        )),
        (dup > 5, _record(
            "quality", "quality_duplicates",
            _join("Duplicate Records: ", c("duplicate_rows").cast("string"), " (", dup.cast("string"), "%)"),
            "Repeated rows inflate counts and sums.",
            F.when(dup > 10, "high").otherwise("medium"),
            F.least(F.lit(10), F.floor(dup)).cast("int"),
            _join(c("duplicate_rows").cast("string"), " rows repeat an earlier one."), "Check whether the repeats are real.",
        )),
    ]
    out.append(emit(stats["totals"], whole))
    if "numeric" in stats:
        pct = c("outlier_pct")
        rule = (pct > 5, _record(
            "outlier", _join("outlier_", c("column")), _join("Outliers Detected in ", c("column")),
            _join(c("outlier_count").cast("string"), " outliers (", pct.cast("string"), "%), range ", fixed(c("min"), 2), " to ", fixed(c("max"), 2), "."),
            F.when(pct > 10, "high").otherwise("medium"),
            F.least(F.lit(10), F.floor(pct)).cast("int"),
            _join("Outside [", fixed(c("q1") - c("iqr") * 1.5, 2), ", ", fixed(c("q3") + c("iqr") * 1.5, 2), "]."),
            "Decide whether they are errors.",
        ))
        out.append(emit(stats["numeric"], [rule]))
        skew = c("skewness")
        rule = (F.abs(skew) > 1, _record(
            "distribution", _join("dist_", c("column")), _join("Heavily Skewed Distribution: ", c("column")),
            _join(F.when(skew > 0, "right").otherwise("left"), "-skewed, skewness ", fixed(skew, 2), "."),
            "medium", F.lit(5), _join("Skewness ", fixed(skew, 4), ", kurtosis ", fixed(c("kurtosis"), 4), "."),
            "Try a log or Box-Cox transform.",
        ))
        out.append(emit(stats["shapes"].where(c("position") < 5), [rule]))
        kpis = stats["kpis"].orderBy("position").limit(5).join(stats["numeric"], "column")
        rule = (F.lit(True), _record(
            "kpi", _join("kpi_", c("column")), _join("Key Metric Detected: ", c("column")),
            _join(c("kpi_kind"), ": ", fixed(c("min"), 2), " to ", fixed(c("max"), 2), ", mean ", fixed(c("mean"), 2), "."),
            "medium", F.lit(6), _join("The name points to ", c("kpi_kind"), "."), "Watch it as a key figure.",
        ))
        out.append(emit(kpis, [rule]))
    if "pairs" in stats:
        top = stats["pairs"].orderBy(c("abs_value").desc(), "feature_a", "feature_b").limit(5)
        r = c("value")
        rule = (F.abs(r) > 0.7, _record(
            "correlation", _join("corr_", c("feature_a"), "_", c("feature_b")),
            _join("Strong ", c("direction"), " Correlation: ", c("feature_a"), " - ", c("feature_b")),
            _join(c("strength"), ", r = ", fixed(r, 4), "."),
            "high", F.lit(7), _join("Pearson ", fixed(r, 4), "."), "Look for the cause.",
        ))
        out.append(emit(top, [rule]))
    frame = out[0]
    for other in out[1:]:
        frame = frame.unionByName(other)
    return frame.select(*FIELDS)


def risks(stats: Mapping[str, DataFrame]) -> DataFrame:
    """``title, severity, description, impact, mitigation``: missing data above 5 percent."""
    m = F.col("total_missing_pct")
    rule = (m > 5, {
        "title": "High Missing Data",
        "severity": F.when(m > 30, "critical").when(m > 10, "high").otherwise("medium"),
        "description": _join(m.cast("string"), "% of all cells are missing."),
        "impact": "Less reliable, possibly biased results.",
        "mitigation": "Impute or remove.",
    })
    return emit(stats["totals"], [rule]).drop("rule")


def kpi_rows(stats: Mapping[str, DataFrame]) -> DataFrame:
    """``name, value, kind, trend, status`` of the first five key figures."""
    top = stats["kpis"].orderBy("position").limit(5)
    if "numeric" in stats:
        top = top.join(stats["numeric"].select("column", "mean"), "column", "left")
    else:
        top = top.withColumn("mean", F.lit(None).cast("double"))
    return top.select(
        F.col("column").alias("name"), F.col("mean").alias("value"), F.col("kpi_kind").alias("kind"),
        F.lit("stable").alias("trend"), F.lit("good").alias("status"),
    )


def export_rows(insights: DataFrame, risk_frame: DataFrame, kpis: DataFrame) -> DataFrame:
    """Insights, risks and key figures in the seven export columns."""
    c = F.col
    none = F.lit(None).cast("string")
    a = insights.select("category", "title", "priority", c("impact_score").cast("string").alias("impact"), "detail", "evidence", "action")
    b = risk_frame.select(
        F.lit("risk").alias("category"), "title", c("severity").alias("priority"), none.alias("impact"),
        c("description").alias("detail"), c("impact").alias("evidence"), c("mitigation").alias("action"),
    )
    shown = F.coalesce(c("value").cast("string"), F.lit("N/A"))
    k = kpis.select(
        F.lit("kpi").alias("category"), c("name").alias("title"), c("status").alias("priority"), none.alias("impact"),
        _join("Value: ", shown, " | Trend: ", c("trend")).alias("detail"), none.alias("evidence"), none.alias("action"),
    )
    return a.unionByName(b).unionByName(k)
