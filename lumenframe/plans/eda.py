"""The exploratory report: sections over shared, pinned statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions import text
from lumenframe.functions.numbers import band, number, percent, quoted, ratio, safe_round
from lumenframe.operators import catalog, correlation, distribution, quality
from lumenframe.operators.describe import Facts, column_profile, numeric_summary, outlier_counts, percentiles, report_stats
from lumenframe.plans.rules import emit, first_names, fixed, pinned
from lumenframe.plans.sections import Sections

# Sections each report profile asks for.
PROFILES = {
    "full": "all",
    "quick": "overview,quality,stats,charts,insights",
    "technical": "overview,quality,stats,distribution,correlation,outliers,ml,charts",
    "business": "overview,quality,charts,insights,business,ml",
    "executive": "overview,charts,business,insights",
}

# Words and name fragments behind the semantic tags.
BOOLEAN_VALUES = ["true", "false", "1", "0", "yes", "no", "t", "f", "y", "n"]
SENSITIVE_NAMES = ["password", "ssn", "social", "credit", "card", "secret", "token", "key"]
LOCATION_NAMES = ["city", "state", "country", "address", "zip", "lat", "lon", "location"]


def column_intelligence(
    df: DataFrame, kinds: dict[str, str] | None = None, facts: Facts | None = None
) -> DataFrame:
    """``column, kind, tags, unique_count, unique_pct``: semantic tags, comma separated.

    Format shares are taken over all present values.
    """
    facts = facts or Facts(df, kinds)
    df, kinds = facts.df, facts.kinds
    scalar = [f for f in df.schema.fields if kinds[f.name] != "complex"]
    aggs, cells = [], []
    formats = {"emails": text.EMAIL, "urls": text.URL, "phone_numbers": text.PHONE_LONG, "currency": text.CURRENCY}
    for i, f in enumerate(scalar):
        c = F.col(quoted(f.name))
        shown = c.cast("string")
        if isinstance(f.dataType, T.NumericType):
            x = number(df, f.name)
            # Whole doubles read '1.0' in text; only integer types can be boolean words.
            is_word = x.isin(0.0, 1.0) if isinstance(f.dataType, T.IntegralType) else F.when(x.isNotNull(), F.lit(False))
            present = F.count(x)
        else:
            is_word, present = F.lower(shown).isin(BOOLEAN_VALUES), F.count(c)
        aggs += [present.alias(f"n{i}"), F.bool_and(is_word).alias(f"b{i}")]
        cell = [F.lit(f.name).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"b{i}").alias("all_boolean")]
        for tag, pattern in formats.items():
            if kinds[f.name] == "categorical":
                aggs.append(F.count_if(shown.rlike(pattern)).alias(f"{tag}{i}"))
                cell.append(F.col(f"{tag}{i}").alias(tag))
            else:
                cell.append(F.lit(0).cast("bigint").alias(tag))
        cells.append(F.struct(*cell))
    found = df.agg(*aggs).select(F.inline(F.array(*cells)))
    base = (
        catalog.kind_frame(df, kinds)
        .join(F.broadcast(found), "column")
        .join(F.broadcast(facts.uniques), "column", "left")
        .fillna(0, ["unique_count"])
    )
    n, u = F.col("n"), F.col("unique_count")
    is_text, is_num = F.col("kind") == "categorical", F.col("kind") == "numeric"
    name = F.lower("column")

    def tag(label: str, condition: Column) -> Column:
        return F.when(condition, label)

    tags = F.array_compact(
        F.array(
            tag("identifier", is_text & (u == n)),
            tag("possible_id", is_num & (u == n)),
            tag("boolean", F.col("all_boolean")),
            *[tag(t, is_text & (F.col(t) > n * 0.5)) for t in formats],
            tag("datetime", F.col("kind") == "datetime"),
            tag("numeric", is_num),
            tag("categorical", is_text & (u < 50)),
            tag("high_cardinality", is_text & (u > n * 0.5)),
            tag("sensitive", name.rlike("|".join(SENSITIVE_NAMES))),
            tag("location", name.rlike("|".join(LOCATION_NAMES))),
        )
    )
    joined = F.when(n == 0, "").when(F.size(tags) == 0, F.col("kind")).otherwise(F.array_join(tags, ","))
    return base.orderBy("position").select(
        "column",
        F.when(n == 0, "empty").otherwise(F.col("kind")).alias("kind"),
        joined.alias("tags"),
        "unique_count",
        percent(u, n).alias("unique_pct"),
    )


def outlier_analysis(df: DataFrame, cols: list[str] | None = None, stats: DataFrame | None = None) -> DataFrame:
    """IQR and z-score outliers (sample spread) with severity, from four values on."""
    cols = cols or catalog.numeric_columns(df)
    stats = pinned(numeric_summary(df, cols)) if stats is None else stats
    s = outlier_counts(df, stats.where("count >= 4"), cols)
    pct = percent(F.col("iqr_outliers"), F.col("count"))
    return s.select(
        "column",
        "iqr_outliers",
        "zscore_outliers",
        pct.alias("percentage"),
        safe_round(F.col("lower_fence")).alias("lower_fence"),
        safe_round(F.col("upper_fence")).alias("upper_fence"),
        band(pct, (10, "high"), (5, "medium"), otherwise="low", strict=True).alias("severity"),
    )


def ml_facts(profile: DataFrame, duplicates: int) -> DataFrame:
    """One row of what the readiness rules need, from a column profile."""

    def names(condition: Column) -> Column:
        hits = F.collect_list(F.when(condition, F.struct("position", "column")))
        return F.transform(F.array_sort(hits), lambda s: s["column"])

    c = F.col
    rows = F.max(c("null_count") + c("non_null"))
    base = profile.withColumn("rows", c("null_count") + c("non_null"))
    share = ratio(c("unique_count"), c("rows"))
    return base.agg(
        rows.alias("n_rows"),
        F.count(F.lit(1)).alias("n_cols"),
        percent(F.sum("null_count"), F.sum("rows"), 10).alias("missing_pct"),
        names(c("kind") == "numeric").alias("numeric"),
        names(c("kind") == "categorical").alias("categorical"),
        names((c("kind") == "numeric") & (share > 0.01) & (share < 0.8)).alias("targets"),
        names(c("unique_count") <= 1).alias("constant"),
        names((c("kind") == "categorical") & (c("unique_count") > c("rows") * 0.5)).alias("high_card"),
    ).withColumn("duplicate_pct", percent(F.lit(duplicates), c("n_rows"), 10))


def ml_readiness(facts: DataFrame) -> DataFrame:
    """``score, status`` and what modelling would need."""
    c = F.col

    def deduct(value: Column, *steps) -> Column:
        expr = None
        for limit, points in steps:
            expr = F.when(value > limit, points) if expr is None else expr.when(value > limit, points)
        return expr.otherwise(0.0)

    score = (
        F.lit(100.0)
        - deduct(c("missing_pct"), (30, 30.0), (10, 15.0), (5, 5.0))
        - deduct(c("duplicate_pct"), (20, 15.0), (5, 5.0))
        - F.size("constant") * 5
        - F.size("high_card") * 3
        - F.when(c("n_rows") < 100, 20.0).when(c("n_rows") < 1000, 10.0).otherwise(0.0)
        - F.when(F.size("numeric") == 0, 20.0).otherwise(0.0)
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(score, 1)))
    return facts.select(
        score.alias("score"),
        band(score, (80, "Excellent"), (60, "Good"), (40, "Fair"), otherwise="Poor").alias("status"),
        F.size("numeric").alias("numeric_features"),
        F.size("categorical").alias("categorical_features"),
        first_names(c("targets"), 5).alias("target_candidates"),
        first_names(c("constant")).alias("constant_features"),
        first_names(c("high_card")).alias("high_cardinality_features"),
        band(c("missing_pct"), (20, "high"), (5, "medium"), otherwise="low", strict=True).alias("missing_impact"),
        (F.size("categorical") > 0).alias("encoding_needed"),
        (F.size("numeric") > 1).alias("scaling_needed"),
    )


def ml_recommendations(facts: DataFrame) -> DataFrame:
    """Six rules: ``rule, priority, topic, detail``."""
    c = F.col
    rules = [
        (c("missing_pct") > 5, {"priority": "high", "topic": "missing", "detail": F.concat(fixed(c("missing_pct"), 1), F.lit("% of cells to fill"))}),
        (c("duplicate_pct") > 5, {"priority": "high", "topic": "duplicates", "detail": F.concat(fixed(c("duplicate_pct"), 1), F.lit("% of rows repeat"))}),
        (F.size("constant") > 0, {"priority": "medium", "topic": "constant", "detail": first_names(c("constant"), 5)}),
        (F.size("high_card") > 0, {"priority": "medium", "topic": "high_cardinality", "detail": first_names(c("high_card"), 5)}),
        (F.size("numeric") > 1, {"priority": "low", "topic": "scaling", "detail": "standard or robust"}),
        (c("n_rows") < 1000, {"priority": "medium", "topic": "small_data", "detail": "cross-validate simple models"}),
    ]
    return emit(facts, rules)


def report_insights(report: dict[str, DataFrame]) -> DataFrame:
    """Eight sentence rules over the finished sections: ``rule, insight``."""
    spark = report["overview"].sparkSession
    out = []
    o, h = report["overview"].first(), report["health"].first()
    out.append((1, f"{o['rows']} rows and {o['columns']} columns, {o['numeric_columns']} numeric and {o['categorical_columns']} categorical."))
    out.append((2, f"Quality {h['score']}/100 ({h['status']}), {o['missing_pct']}% of cells missing, {o['duplicate_pct']}% of rows repeated."))
    if "correlation" in report:
        pairs = report["correlation"]
        top = pairs.orderBy(F.col("abs_value").desc(), "feature_a", "feature_b").first()
        if top:
            out.append((3, f"Strongest pair: {top['feature_a']} and {top['feature_b']}, r = {top['value']:.3f} ({top['strength']})."))
        ends = correlation.multicollinear(pairs).select(F.explode(F.array("feature_a", "feature_b")).alias("c"))
        names = [r["c"] for r in ends.distinct().orderBy("c").limit(5).collect()]
        if names:
            out.append((4, f"{correlation.multicollinear(pairs).count()} collinear pairs among {', '.join(names)}."))
    if "distribution" in report:
        d = report["distribution"].orderBy("column")
        skewed = [r["column"] for r in d.where(F.col("shape").contains("Skewed")).limit(3).collect()]
        normal = [r["column"] for r in d.where("total_tests > 0 and normal_tests = total_tests").limit(3).collect()]
        if skewed:
            out.append((5, f"Skewed: {', '.join(skewed)}."))
        if normal:
            out.append((6, f"Normal: {', '.join(normal)}."))
    gap = report["missing"].orderBy(F.col("null_count").desc(), "column").first()
    if gap:
        out.append((7, f"{gap['column']} misses most: {gap['null_count']} values, {gap['null_pct']}%."))
    wide = report["columns"].where("is_high_cardinality").orderBy("position").limit(3).collect()
    if wide:
        out.append((8, f"Mostly distinct: {', '.join(r['column'] for r in wide)}."))
    return spark.createDataFrame(out, "rule int, insight string")


def business_summary(report: dict[str, DataFrame]) -> DataFrame:
    """``section, position, entry``: situation, observations, risks, opportunities, next steps."""
    spark = report["overview"].sparkSession
    o, score = report["overview"].first(), report["health"].first()["score"]
    rows = [("situation", f"{o['rows']} records, {o['columns']} attributes, quality {score}/100, {o['missing_pct']}% missing.")]
    rows += [("observation", r["insight"]) for r in report["insights"].orderBy("rule").limit(5).collect()]
    if o["missing_pct"] > 10:
        rows.append(("risk", "Missing data may bias results."))
    if score < 60:
        rows.append(("risk", "Data quality is low; clean before use."))
    if o["numeric_columns"] >= 3:
        rows.append(("opportunity", f"{o['numeric_columns']} numeric features allow multivariate models."))
    if o["missing_pct"] < 5 and score >= 80:
        rows.append(("opportunity", "Quality supports reliable statistics and models."))
    rows += [("next_step", s) for s in ("clean", "explore key features", "build baseline models", "validate with experts")]
    return spark.createDataFrame([(s, i, t) for i, (s, t) in enumerate(rows)], "section string, position int, entry string")


def column_details(profile: DataFrame, intelligence: DataFrame) -> DataFrame:
    """Profile rows joined with their semantic tags."""
    return profile.select("position", "column", "kind", "non_null", "null_count", "null_pct", "unique_count").join(
        F.broadcast(intelligence.select("column", "tags")), "column", "left"
    )


def overview(shared: Facts) -> DataFrame:
    """One row of counts: rows, columns by kind, and the shares of missing cells and repeated rows."""
    df, kinds = shared.df, list(shared.kinds.values())
    cells = F.col("null_count") + F.col("non_null")
    booleans = sum(isinstance(f.dataType, T.BooleanType) for f in df.schema.fields)
    counts = {
        "columns": len(df.columns), "numeric_columns": kinds.count("numeric"), "categorical_columns": kinds.count("categorical"),
        "datetime_columns": kinds.count("datetime"), "boolean_columns": booleans,
    }
    base = shared.nulls.agg(F.max(cells).alias("rows"), percent(F.sum("null_count"), F.sum(cells)).alias("missing_pct"))
    return base.select(
        "rows", *[F.lit(n).cast("bigint").alias(name) for name, n in counts.items()], "missing_pct",
        percent(F.lit(shared.duplicates), F.col("rows")).alias("duplicate_pct"),
    )


def eda_report(df: DataFrame, report_type: str = "full") -> Sections:
    """The sections of a report by name; each is computed when it is asked for.

    Correlation and distribution exist only where the report type has them.
    """
    return _narrowed(_sections(df), report_type)


def eda_reports(df: DataFrame) -> dict[str, Sections]:
    """Reports of all types by type. A section that several have is computed once."""
    every = _sections(df)
    return {report_type: _narrowed(every, report_type) for report_type in PROFILES}


def _narrowed(every: Sections, report_type: str) -> Sections:
    """The sections that a report type has; sentences follow from its own sections."""
    wanted = PROFILES.get(report_type, PROFILES["full"])
    needs = {"correlation": "correlation", "distribution": "distribution", "percentiles": "distribution"}
    report = Sections()
    for name in every:
        if wanted == "all" or name not in needs or needs[name] in wanted:
            report.add(name, lambda name=name: every[name])
    report.add("insights", lambda: report_insights(report))
    report.add("business", lambda: business_summary(report))
    return report


def _sections(df: DataFrame) -> Sections:
    shared = Facts(df)
    df, numeric = shared.df, shared.numeric
    shared_parts = Sections()
    shared_parts.add("quality", lambda: quality.quality_report(df, facts=shared))
    shared_parts.add("profile", lambda: pinned(column_profile(df, facts=shared)))
    shared_parts.add("facts", lambda: pinned(ml_facts(shared_parts["profile"], shared.duplicates)))
    report = Sections()
    for name in quality.SECTIONS:
        report.add(name, lambda name=name: shared_parts["quality"][name])
    report.add("overview", lambda: pinned(overview(shared)))
    if numeric:
        report.add("statistics", lambda: report_stats(df, numeric, shared.summary))
        report.add("outliers", lambda: pinned(outlier_analysis(df, numeric, shared.summary)))
    if len(numeric) >= 2:
        report.add("correlation", lambda: pinned(correlation.pair_report(df, "pearson", numeric)))
    if numeric:
        report.add("distribution", lambda: pinned(distribution.column_report(df, numeric, shared.summary)))
        report.add("percentiles", lambda: pinned(percentiles(df, numeric)))
    report.add("intelligence", lambda: pinned(column_intelligence(df, facts=shared)))
    report.add("ml_readiness", lambda: ml_readiness(shared_parts["facts"]))
    report.add("ml_recommendations", lambda: ml_recommendations(shared_parts["facts"]))
    report.add("insights", lambda: report_insights(report))
    report.add("business", lambda: business_summary(report))
    report.add("column_details", lambda: column_details(shared_parts["profile"], report["intelligence"]))
    return report
