"""Column kinds: numeric, datetime, categorical, complex, and conversions between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.dates import to_moment
from lumenframe.functions.numbers import is_numeric, number, quoted, ratio, to_number

DATE_SHARE = 0.7
SUGGEST_SHARE = 0.9
COMPLEX = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)

# Words read as booleans.
TRUE_WORDS = ["true", "yes", "1"]
FALSE_WORDS = ["false", "no", "0"]
BOOLEAN_WORDS = ["true", "false", "1", "0", "yes", "no"]


def missing_as_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL once, so that every later operator sees one missing marker."""
    out = []
    for f in df.schema.fields:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name)
        out.append(c)
    return df.select(out)


def date_shares(df: DataFrame) -> DataFrame:
    """Share of all rows that parse as a date, one row per text column (``column, share``)."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs = [
        F.avg(to_moment(F.col(quoted(n)), T.StringType()).isNotNull().cast("double")).alias(f"s{i}")
        for i, n in enumerate(names)
    ]
    pairs = [F.struct(F.lit(n).alias("column"), F.col(f"s{i}").alias("share")) for i, n in enumerate(names)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, share double")
    return df.agg(*aggs).select(F.inline(F.array(*pairs)))


def column_kinds(df: DataFrame) -> dict[str, str]:
    """Kind of every column. Only text columns need a pass over the data."""
    kinds = {}
    for f in df.schema.fields:
        if is_numeric(f.dataType):
            kinds[f.name] = "numeric"
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kinds[f.name] = "datetime"
        elif isinstance(f.dataType, COMPLEX):
            kinds[f.name] = "complex"
        else:
            kinds[f.name] = "categorical"
    if any(isinstance(f.dataType, T.StringType) for f in df.schema.fields):
        for row in date_shares(df).where(F.col("share") >= DATE_SHARE).collect():
            kinds[row["column"]] = "datetime"
    return kinds


def columns_of(df: DataFrame, kind: str, kinds: dict[str, str] | None = None) -> list[str]:
    kinds = kinds or column_kinds(df)
    return [c for c in df.columns if kinds[c] == kind]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def kind_frame(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """``position, column, kind``: the catalog as a table, one row per column of the schema."""
    kinds = kinds or column_kinds(df)
    rows = [(i, c, kinds[c]) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, kind string")


def suggested_types(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Better-fitting type per column, and whether text mixes lexical classes.

    Columns: ``column, kind, suggested, mixed``.
    """
    kinds = kinds or column_kinds(df)
    aggs, rows = [], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, T.StringType):
            num, moment = to_number(c), to_moment(c, f.dataType)
            is_bool = F.lower(c).isin(BOOLEAN_WORDS)
            whole = c.rlike(r"^\s*[+-]?\d+\s*$")
            classes = [
                F.count_if(whole),
                F.count_if(num.isNotNull() & ~whole),
                F.count_if(F.lower(c).isin("true", "false")),
                F.count_if(moment.isNotNull()),
                F.count_if(
                    c.isNotNull() & num.isNull() & moment.isNull() & ~F.lower(c).isin("true", "false")
                ),
            ]
            aggs += [
                F.count(c).alias(f"n{i}"),
                F.count(num).alias(f"num{i}"),
                F.count(moment).alias(f"dt{i}"),
                F.count_if(is_bool).alias(f"b{i}"),
                sum(((k > 0).cast("int") for k in classes[1:]), (classes[0] > 0).cast("int")).alias(f"k{i}"),
            ]
            n = F.col(f"n{i}")
            suggested = (
                F.when(n == 0, kinds[f.name])
                .when(ratio(F.col(f"num{i}"), n) >= SUGGEST_SHARE, "numeric")
                .when(ratio(F.col(f"dt{i}"), n) >= SUGGEST_SHARE, "datetime")
                .when(F.col(f"b{i}") == n, "boolean")
                .otherwise(kinds[f.name])
            )
            mixed = F.col(f"k{i}") > 1
        elif is_numeric(f.dataType):
            x = number(df, f.name)
            aggs += [F.count(x).alias(f"n{i}"), F.count_if(x == F.floor(x)).alias(f"w{i}")]
            suggested = F.when(
                (F.col(f"n{i}") > 0) & (F.col(f"w{i}") == F.col(f"n{i}")), "integer"
            ).otherwise("numeric")
            mixed = F.lit(False)
        else:
            suggested, mixed = F.lit(kinds[f.name]), F.lit(False)
        rows.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(kinds[f.name]).alias("kind"),
                suggested.alias("suggested"),
                mixed.alias("mixed"),
            )
        )
    base = df.agg(*aggs) if aggs else df.agg(F.count(F.lit(1)).alias("n"))
    return base.select(F.inline(F.array(*rows)))


def convert_types(df: DataFrame, conversions: dict[str, str]) -> DataFrame:
    """Convert columns to numeric, categorical, datetime, boolean or integer.

    A value that does not convert becomes NULL; missing stays missing.
    """
    out = {}
    for name, target in conversions.items():
        if name not in df.columns:
            continue
        c, dtype = F.col(quoted(name)), df.schema[name].dataType
        word = F.lower(c.cast("string"))
        if target == "numeric":
            out[name] = to_number(c, dtype)
        elif target == "categorical":
            out[name] = c.cast("string")
        elif target == "datetime":
            out[name] = to_moment(c, dtype)
        elif target == "boolean":
            out[name] = F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)
        elif target == "integer":
            x = to_number(c, dtype)
            out[name] = F.when(x == F.floor(x), x.try_cast("bigint"))
    return df.withColumns(out)
