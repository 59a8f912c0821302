"""Feature engineering: encodings, scalings, transforms and derived columns."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.dates import calendar_parts, to_moment
from lumenframe.functions.numbers import number, quoted
from lumenframe.operators import catalog
from lumenframe.operators.distribution import _box_cox, _yeo_johnson, box_cox_lambda, yeo_johnson_lambda
from lumenframe.operators.joins import lookup
from lumenframe.operators.order import number_rows
from lumenframe.operators.quantiles import fit_quantiles

def _text(name: str) -> Column:
    return F.col(quoted(name)).cast("string")


def _categories(df: DataFrame, col: str) -> DataFrame:
    return df.select(_text(col).alias("value")).where("value is not null").distinct()


def encode_onehot(df: DataFrame, columns: list[str], max_categories: int | None = None) -> DataFrame:
    """One 0/1 column ``col_value`` per value, sorted; the source column is dropped.

    As many columns as values; where that is too wide a table, ``onehot_long`` has the same content in rows. A caller may set
    ``max_categories``; a column with more values is then refused rather than cut short.
    """
    flags = []
    for c in columns:
        found = _categories(df, c)
        values = [r["value"] for r in (found if max_categories is None else found.limit(max_categories + 1)).collect()]
        if max_categories is not None and len(values) > max_categories:
            raise ValueError(f"{c} has more than {max_categories} values; use onehot_long, label or frequency encoding")
        flags += [
            F.coalesce((_text(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in sorted(values)
        ]
    kept = [F.col(quoted(c)) for c in df.columns if c not in columns]
    return df.select(*kept, *flags)


def onehot_long(df: DataFrame, id_columns: list[str], columns: list[str]) -> DataFrame:
    """One-hot encoding in long form: ``id_columns, feature`` of the ones; every other pair is zero.

    ``feature`` is ``col_value`` as in the wide form; missing values have no row. Any number of values.
    """
    cells = F.array(*[F.when(_text(c).isNotNull(), F.concat(F.lit(f"{c}_"), _text(c))) for c in columns])
    return df.select(*[F.col(quoted(c)) for c in id_columns], F.explode(F.array_compact(cells)).alias("feature"))


def encode_label(df: DataFrame, columns: list[str]) -> DataFrame:
    """Index of each value in sorted text order; missing stays missing."""
    for c in columns:
        if c in df.columns:
            codes = number_rows(_categories(df, c), ["value"], "code").withColumn("code", F.col("code") - 1)
            df = lookup(df.withColumn(c, _text(c)), codes, c, "value", "code", c)
    return df


def encode_ordinal(df: DataFrame, columns: list[str], order: dict[str, list[str]] | None = None) -> DataFrame:
    """Position in a given order (sorted order without one); unknown values become NULL."""
    out, rest = {}, []
    for c in columns:
        if c not in df.columns:
            continue
        if order and c in order:
            expr = F.lit(None).cast("bigint")
            for i, v in reversed(list(enumerate(order[c]))):
                expr = F.when(_text(c) == v, F.lit(i).cast("bigint")).otherwise(expr)
            out[c] = expr
        else:
            rest.append(c)
    if out:
        df = df.withColumns(out)
    return encode_label(df, rest)


def encode_frequency(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of each value among the present ones."""
    for c in columns:
        if c in df.columns:
            counts = df.where(F.col(quoted(c)).isNotNull()).groupBy(F.col(quoted(c)).alias("value")).agg(
                F.count(F.lit(1)).alias("n")
            )
            present = df.agg(F.count(quoted(c))).first()[0]
            df = lookup(df, counts.withColumn("share", F.col("n") / F.lit(present)), c, "value", "share", c)
    return df


def encode_target(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Mean of a numeric target per value."""
    if target not in df.columns:
        return df
    source = df
    for c in columns:
        if c in df.columns:
            means = (
                source.where(F.col(quoted(c)).isNotNull())
                .groupBy(F.col(quoted(c)).alias("value"))
                .agg(F.avg(number(source, target)).alias("mean"))
            )
            df = lookup(df, means, c, "value", "mean", c)
    return df


def _zero(df: DataFrame, c: str) -> Column:
    return F.coalesce(number(df, c), F.lit(0.0))


def scale_standard(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Zero mean, unit population spread; missing counts as 0, a flat column keeps scale 1."""
    columns = columns or catalog.numeric_columns(df)
    aggs = [f(_zero(df, c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    r = df.agg(*aggs).first()
    return df.withColumns(
        {c: (_zero(df, c) - F.lit(r[f"m{i}"] or 0.0)) / (r[f"s{i}"] or 1.0) for i, c in enumerate(columns)}
    )


def scale_minmax(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rescale to [0, 1]; missing counts as 0."""
    columns = columns or catalog.numeric_columns(df)
    aggs = [f(_zero(df, c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("a", F.min), ("b", F.max))]
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(columns):
        lo, hi = r[f"a{i}"] or 0.0, r[f"b{i}"] or 0.0
        out[c] = (_zero(df, c) - F.lit(lo)) / ((hi - lo) or 1.0)
    return df.withColumns(out)


def scale_robust(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Center on the median, scale by the interquartile range; missing counts as 0."""
    columns = columns or catalog.numeric_columns(df)
    filled = df.select([_zero(df, c).alias(c) for c in columns])
    out = {}
    for c, (q1, q2, q3) in fit_quantiles(filled, columns, [0.25, 0.5, 0.75]).items():
        out[c] = (_zero(df, c) - F.lit(q2)) / ((q3 - q1) or 1.0)
    return df.withColumns(out)


def transform_log(df: DataFrame, columns: list[str]) -> DataFrame:
    """log(1 + x) with negatives taken as 0."""
    return _mapped(df, columns, lambda x: F.log1p(F.greatest(x, F.lit(0.0))))


def transform_sqrt(df: DataFrame, columns: list[str]) -> DataFrame:
    """Square root with negatives taken as 0."""
    return _mapped(df, columns, lambda x: F.sqrt(F.greatest(x, F.lit(0.0))))


def _mapped(df: DataFrame, columns: list[str], fn) -> DataFrame:
    out = {}
    for c in columns:
        if c in df.columns:
            x = number(df, c)
            out[c] = F.when(x.isNotNull(), fn(x))
    return df.withColumns(out)


def transform_power(df: DataFrame, columns: list[str], method: str = "yeojohnson") -> DataFrame:
    """Power transform with a fitted λ, then standardised; missing counts as 0.

    Box-Cox needs positive values: if any chosen column has others, nothing changes.
    """
    columns = [c for c in columns if c in df.columns]
    if method == "boxcox":
        lows = df.agg(*[F.min(_zero(df, c)) for c in columns]).first()
        if any(v is None or v <= 0 for v in lows):
            return df.withColumns({c: number(df, c) for c in columns})
    out = {}
    for c in columns:
        values = df.select(_zero(df, c).alias("value"))
        if method == "boxcox":
            y = _box_cox(_zero(df, c), box_cox_lambda(values))
        else:
            y = _yeo_johnson(_zero(df, c), yeo_johnson_lambda(values))
        out[c] = y
    return scale_standard(df.withColumns(out), columns)


def create_date_features(df: DataFrame, date_column: str) -> DataFrame:
    """Year, month, day, weekday (Monday 0), quarter, weekend flag and ISO week."""
    if date_column not in df.columns:
        return df
    moment = to_moment(F.col(quoted(date_column)), df.schema[date_column].dataType)
    return df.withColumns({f"{date_column}_{k}": v for k, v in calendar_parts(moment).items()})


def create_polynomial(df: DataFrame, columns: list[str], degree: int = 2) -> DataFrame:
    """All monomials up to a degree, named ``a^2`` and ``a b``; missing counts as 0."""
    columns = [c for c in columns if c in df.columns]
    out = {}
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(range(len(columns)), d):
            powers = {i: combo.count(i) for i in combo}
            name = " ".join(columns[i] if p == 1 else f"{columns[i]}^{p}" for i, p in powers.items())
            if name not in df.columns:
                expr = F.lit(1.0)
                for i, p in powers.items():
                    for _ in range(p):
                        expr = expr * _zero(df, columns[i])
                out[name] = expr
    return df.withColumns(out)


def create_interactions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise products ``a_x_b`` of the numeric columns."""
    numeric = [c for c in columns if c in catalog.numeric_columns(df)]
    return df.withColumns({f"{a}_x_{b}": number(df, a) * number(df, b) for a, b in combinations(numeric, 2)})


def create_binning(df: DataFrame, column: str, bins: int = 5, labels: list[str] | None = None) -> DataFrame:
    """Equal-width right-closed bins, ``Bin_1`` onward or with given labels."""
    if column not in df.columns:
        return df
    labels = labels or [f"Bin_{i + 1}" for i in range(bins)]
    x = number(df, column)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return df.withColumn(f"{column}_binned", F.lit(None).cast("string"))
    if hi == lo:
        pad = abs(lo) * 0.001 if lo else 0.001
        lo, hi = lo - pad, hi + pad
    at = F.least(F.greatest(F.ceil((x - F.lit(lo)) / ((hi - lo) / bins)), F.lit(1)), F.lit(bins))
    names = F.array(*[F.lit(v) for v in labels])
    return df.withColumn(f"{column}_binned", F.when(x.isNotNull(), F.get(names, (at - 1).cast("int"))))


def create_missing_indicator(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``col_is_missing`` for every column that has missing values."""
    df = catalog.missing_as_null(df)
    columns = [c for c in (columns or df.columns) if c in df.columns]
    found = df.agg(*[F.count_if(F.col(quoted(c)).isNull()) for c in columns]).first()
    return df.withColumns(
        {f"{c}_is_missing": F.col(quoted(c)).isNull().cast("int") for c, k in zip(columns, found) if k}
    )
