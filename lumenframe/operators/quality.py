"""Data-quality checks, scores and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions import text
from lumenframe.functions.dates import to_moment
from lumenframe.functions.numbers import band, number, percent, quoted, ratio, to_number
from lumenframe.operators import catalog
from lumenframe.operators.describe import Facts
from lumenframe.plans.rules import emit, first_names, pinned

CHECKS = [
    "empty_count",
    "whitespace_count",
    "invalid_numbers",
    "invalid_dates",
    "invalid_emails",
    "invalid_urls",
    "invalid_phones",
    "negative_count",
]


def value_checks(df: DataFrame) -> DataFrame:
    """Counts of suspicious values, one row per column, from one pass.

    The format checks (numbers, dates, emails, URLs, phones) count the present values of a
    text column that do not have the format; read the one that fits the column.
    """
    aggs, cells = [], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(quoted(f.name))
        values: dict[str, Column] = {}
        if isinstance(f.dataType, T.StringType):
            bare = text.strip(c)
            filled = c.isNotNull() & (bare != "")
            values = {
                "empty_count": c == "",
                "whitespace_count": (c != "") & (bare == ""),
                "invalid_numbers": c.isNotNull() & to_number(c).isNull(),
                "invalid_dates": c.isNotNull() & to_moment(c, f.dataType).isNull(),
                "invalid_emails": filled & ~text.is_email(bare),
                "invalid_urls": filled & ~text.is_url(bare),
                "invalid_phones": filled & ~text.is_phone(bare),
            }
        elif isinstance(f.dataType, T.NumericType):
            values = {"negative_count": number(df, f.name) < 0}
        cell = [F.lit(f.name).alias("column")]
        for check in CHECKS:
            key = f"{check}_{i}"
            if check in values:
                aggs.append(F.count_if(values[check]).alias(key))
                cell.append(F.col(key).alias(check))
            else:
                cell.append(F.lit(0).cast("bigint").alias(check))
        cells.append(F.struct(*cell))
    base = df.agg(*aggs) if aggs else df.agg(F.count(F.lit(1)).alias("n"))
    return base.select(F.inline(F.array(*cells)))


def quality_score(nulls: Column, unique: Column, invalid: Column, rows: Column) -> Column:
    """Column score: 100 less nulls (30), invalid values (20), and extreme cardinality (15 or 10)."""
    score = (
        F.lit(100.0)
        - F.least(F.lit(30.0), ratio(nulls, rows) * 100)
        - F.least(F.lit(20.0), ratio(invalid, rows) * 100)
        - F.when(unique <= 1, 15.0).when(unique > rows * 0.8, 10.0).otherwise(0.0)
    )
    return F.when(rows == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.round(score, 1)))


def column_quality(df: DataFrame, kinds: dict[str, str] | None = None, facts: Facts | None = None) -> DataFrame:
    """Full quality row per column. ``kinds`` may declare a text column numeric or datetime."""
    facts = facts or Facts(df, kinds)
    df, kinds = facts.df, facts.kinds
    frame = catalog.kind_frame(df, kinds)
    for part in (facts.nulls, facts.uniques, value_checks(df), catalog.suggested_types(df, kinds).drop("kind")):
        frame = frame.join(F.broadcast(part), "column", "left")
    rows = F.col("null_count") + F.col("non_null")
    unique = F.coalesce(F.col("unique_count"), F.lit(0))
    invalid = (
        F.when(F.col("kind") == "numeric", F.col("invalid_numbers"))
        .when(F.col("kind") == "datetime", F.col("invalid_dates"))
        .otherwise(0)
    )
    reason = F.when(invalid > 0, F.concat(F.lit("invalid_"), F.when(F.col("kind") == "numeric", "numbers").otherwise("dates")))
    bad = invalid + F.col("empty_count") + F.col("whitespace_count")
    return frame.select(
        "position",
        "column",
        "kind",
        "null_count",
        "null_pct",
        unique.alias("unique_count"),
        percent(unique, rows).alias("unique_pct"),
        (unique <= 1).alias("is_constant"),
        (unique <= F.greatest(F.lit(2), F.floor(rows * 0.01))).alias("is_near_constant"),
        (unique > F.floor(rows * 0.5)).alias("is_high_cardinality"),
        invalid.cast("bigint").alias("invalid_count"),
        reason.alias("invalid_reason"),
        "empty_count",
        "whitespace_count",
        F.when(F.col("kind") == "numeric", F.col("negative_count")).otherwise(0).alias("negative_count"),
        "suggested",
        "mixed",
        quality_score(F.col("null_count"), unique, bad, rows).alias("quality_score"),
        rows.alias("n_rows"),
    )


def duplicate_columns(df: DataFrame) -> DataFrame:
    """``column1, column2``: columns whose text equals that of an earlier column in every row.

    A digest per column proposes groups: the sum of hashes of the cells, each with its whole row, so that neither row order nor
    repeated rows matter. A second pass compares every column with the first of its group, value by value.
    """
    schema = "column1 string, column2 string"
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, catalog.COMPLEX)]
    as_text = {c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit("\u0000null")) for c in names}
    row = F.xxhash64(*as_text.values())
    wide = "decimal(38,0)"
    digests = df.agg(*[F.sum(F.xxhash64(row, as_text[c]).cast(wide)).alias(f"d{i}") for i, c in enumerate(names)]).first()
    groups: dict[object, list[str]] = {}
    for i, c in enumerate(names):
        groups.setdefault(digests[f"d{i}"], []).append(c)
    first_of: dict[str, str] = {}
    # Columns that turn out different although their digests agree start a group of their own.
    waiting = [g for g in groups.values() if len(g) > 1]
    while waiting:
        pairs = [(g[0], c) for g in waiting for c in g[1:]]
        same = df.agg(*[F.bool_and(as_text[a] == as_text[b]).alias(f"e{i}") for i, (a, b) in enumerate(pairs)]).first()
        equal = {pair: same[f"e{i}"] is not False for i, pair in enumerate(pairs)}
        first_of.update({b: a for (a, b), yes in equal.items() if yes})
        left = [[c for c in g[1:] if not equal[g[0], c]] for g in waiting]
        waiting = [g for g in left if len(g) > 1]
    rows = [(first_of[c], c) for c in names if c in first_of]
    return df.sparkSession.createDataFrame(rows, schema)


def dataset_totals(columns: DataFrame, duplicates: int) -> DataFrame:
    """One row of sums over a column-quality frame."""
    return columns.agg(
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_cols"),
        F.sum("n_rows").alias("total_cells"),
        F.sum("null_count").alias("total_nulls"),
        F.sum("invalid_count").alias("total_invalid"),
        F.sum("empty_count").alias("total_empty"),
        F.sum("whitespace_count").alias("total_whitespace"),
        F.sum("negative_count").alias("total_negative"),
        F.count_if(F.col("is_constant")).alias("constant_columns"),
        F.count_if(F.col("is_high_cardinality")).alias("high_cardinality_columns"),
        F.avg("quality_score").alias("mean_quality"),
    ).withColumn("duplicate_rows", F.lit(duplicates).cast("bigint"))


def health_status(score: Column) -> Column:
    return band(score, (90, "Excellent"), (75, "Good"), (50, "Average"), otherwise="Poor")


def health(totals: DataFrame) -> DataFrame:
    """``score, status`` and the breakdown into completeness, validity, consistency, accuracy."""
    null_pct = F.coalesce(ratio(F.col("total_nulls"), F.col("total_cells")) * 100, F.lit(0.0))
    bad = F.col("total_invalid") + F.col("total_empty") + F.col("total_whitespace")
    bad_pct = F.coalesce(ratio(bad, F.col("total_cells")) * 100, F.lit(0.0))
    dup_pct = F.coalesce(ratio(F.col("duplicate_rows"), F.col("n_rows")) * 100, F.lit(0.0))
    const, high = F.col("constant_columns"), F.col("high_cardinality_columns")
    score = (
        F.lit(100.0)
        - F.least(F.lit(30.0), null_pct * 0.3)
        - F.least(F.lit(20.0), bad_pct * 0.5)
        - F.least(F.lit(15.0), dup_pct * 0.2 + const * 2)
        - F.least(F.lit(10.0), high * 1.5)
    )
    empty = F.col("n_rows") == 0
    score = F.when(empty, 100.0).otherwise(F.greatest(F.lit(0.0), F.round(score, 1)))
    zero = F.lit(0.0)
    return totals.select(
        score.alias("score"),
        health_status(score).alias("status"),
        F.round(F.greatest(zero, 100 - null_pct), 1).alias("completeness"),
        F.round(F.greatest(zero, 100 - bad_pct * 2), 1).alias("validity"),
        F.when(empty, 100.0).otherwise(F.round(F.least(F.lit(100.0), F.greatest(zero, 100 - dup_pct - const * 3)), 1)).alias(
            "consistency"
        ),
        F.round(F.coalesce("mean_quality", F.lit(100.0)), 1).alias("accuracy"),
    )


def recommendations(columns: DataFrame, duplicate_cols: DataFrame, score: float) -> DataFrame:
    """Ten rules over the column frame: ``rule, priority, category, title, description, affected_columns``.

    The duplicate-row rule always fires.
    """

    def names(condition: Column) -> Column:
        hits = F.collect_list(F.when(condition, F.struct("position", "column")))
        return F.transform(F.array_sort(hits), lambda s: s["column"])

    c = F.col
    facts = columns.agg(
        F.count(F.lit(1)).alias("n_cols"),
        names(c("null_count") > 0).alias("nulls"),
        names(c("is_constant")).alias("constant"),
        names(c("is_high_cardinality")).alias("high"),
        names(c("invalid_count") > 0).alias("invalid"),
        names(c("whitespace_count") > 0).alias("blank"),
        names((c("empty_count") > 0) | (c("whitespace_count") > 0)).alias("unusable"),
        names((c("kind") == "numeric") & (c("unique_count") > 1)).alias("numeric"),
    )
    copies = [r["column1"] for r in duplicate_cols.collect()]
    facts = facts.withColumn("copies", F.array(*[F.lit(x) for x in copies]).cast("array<string>"))

    def rule(condition, priority, category, title, tail, affected, k=None):
        count = F.size(affected).cast("string")
        return condition, {
            "priority": priority,
            "category": category,
            "title": title,
            "description": F.concat(count, F.lit(tail)),
            "affected_columns": first_names(affected, k),
        }

    def present(name):
        return F.size(name) > 0

    none = F.array().cast("array<string>")
    general = {"affected_columns": F.array_join(none, ", ")}
    rules = [
        rule(
            present("nulls") & (F.size("nulls") >= c("n_cols") * 0.3),
            "high", "missing_values", "Handle missing values", " columns hold missing values.", c("nulls"), 5,
        ),
        (F.lit(True), {
            "priority": "medium", "category": "duplicates", "title": "Check for duplicate rows",
            "description": "Repeated rows weaken consistency.", **general,
        }),
        rule(present("constant"), "high", "constant_columns", "Remove constant columns", " columns hold one value at most.", c("constant")),
        rule(present("high"), "medium", "high_cardinality", "Review high-cardinality columns", " columns are mostly distinct values.", c("high"), 5),
        rule(present("copies"), "high", "duplicate_columns", "Remove duplicate columns", " columns repeat another column.", c("copies")),
        rule(present("invalid"), "high", "datatype", "Fix data type issues", " columns hold values that do not fit their type.", c("invalid")),
        rule(present("blank"), "low", "whitespace", "Strip whitespace from text columns", " columns hold blank text.", c("blank")),
        rule(present("unusable"), "medium", "invalid_values", "Handle invalid values", " columns hold empty or blank text.", c("unusable"), 5),
        rule(F.size("numeric") > 1, "low", "normalize", "Normalize numeric data", " numeric columns differ in scale.", c("numeric"), 5),
        (F.lit(score < 50), {
            "priority": "critical", "category": "overall_quality", "title": "Dataset quality is poor",
            "description": "The overall score is below 50.", **general,
        }),
    ]
    return emit(facts, rules)


#: Names of the sections of a quality report.
SECTIONS = (
    "columns", "overview", "missing", "missing_total", "duplicates", "duplicate_columns", "datatypes", "unique_values", "invalid",
    "invalid_totals", "health", "recommendations",
)


def quality_report(
    df: DataFrame, kinds: dict[str, str] | None = None, facts: Facts | None = None
) -> dict[str, DataFrame]:
    """All sections of the quality report over one pinned column frame."""
    facts = facts or Facts(df, kinds)
    df = facts.df
    columns = pinned(column_quality(df, facts=facts))
    totals = pinned(dataset_totals(columns, facts.duplicates))
    copies = duplicate_columns(df)
    scores = pinned(health(totals))
    c = F.col
    booleans = sum(isinstance(f.dataType, T.BooleanType) for f in df.schema.fields)

    def kind_count(k: str) -> Column:
        return F.count_if(c("kind") == k)

    overview = columns.agg(
        F.max("n_rows").alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        kind_count("numeric").alias("numeric_columns"),
        kind_count("categorical").alias("categorical_columns"),
        kind_count("datetime").alias("datetime_columns"),
        F.lit(booleans).cast("bigint").alias("boolean_columns"),
    )
    flagged = (c("invalid_count") > 0) | c("kind").isin("numeric", "datetime") | c("mixed")
    dirty = (c("invalid_count") > 0) | (c("empty_count") > 0) | (c("whitespace_count") > 0) | (c("negative_count") > 0)
    state = (
        F.when(c("is_constant"), "constant")
        .when(c("is_near_constant"), "near_constant")
        .when(c("is_high_cardinality"), "high_cardinality")
    )
    return {
        "columns": columns,
        "overview": overview,
        "missing": columns.where(c("null_count") > 0)
        .select("column", "null_count", "null_pct")
        .orderBy(c("null_count").desc(), "column"),
        "missing_total": totals.select(
            "total_nulls", percent(c("total_nulls"), c("total_cells")).alias("overall_null_pct")
        ),
        "duplicates": totals.select(
            "duplicate_rows", percent(c("duplicate_rows"), c("n_rows")).alias("duplicate_pct")
        ),
        "duplicate_columns": copies,
        "datatypes": columns.where(flagged).select(
            "column", "kind", "suggested", "mixed", "invalid_count", "invalid_reason"
        ),
        "unique_values": columns.select(
            "column", "kind", "unique_count", "unique_pct", "quality_score", state.alias("state")
        ).orderBy("quality_score", "column"),
        "invalid": columns.where(dirty).select(
            "column", "kind", "invalid_count", "empty_count", "whitespace_count", "negative_count"
        ),
        "invalid_totals": totals.select("total_invalid", "total_empty", "total_whitespace", "total_negative"),
        "health": scores,
        "recommendations": recommendations(columns, copies, scores.first()["score"]),
    }
