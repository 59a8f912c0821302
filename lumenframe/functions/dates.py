"""Date parsing and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO_SHAPE = r"^\s*\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}.*)?\s*$"

# Non-ISO layouts tried in order, each with the shape that admits it.
LAYOUTS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
]


def to_moment(col: Column, dtype: T.DataType | None = None) -> Column:
    """Timestamp value of a column, NULL where it is no date. Numbers are never dates."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col.cast("timestamp")
    if dtype is not None and not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp")
    out = F.when(col.rlike(ISO_SHAPE), F.trim(col).try_cast("timestamp"))
    for shape, layout in LAYOUTS:
        out = out.when(col.rlike(shape), F.try_to_timestamp(col, F.lit(layout)))
    return out


def iso_text(col: Column) -> Column:
    """ISO text of a timestamp, with a fraction only when there is one."""
    whole = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.unix_micros(col.cast("timestamp")) % 1000000 == 0, whole).otherwise(
        F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def calendar_parts(col: Column) -> dict[str, Column]:
    """The seven calendar features of a timestamp; Monday is day 0."""
    weekday = F.weekday(col)
    return {
        "year": F.year(col),
        "month": F.month(col),
        "day": F.dayofmonth(col),
        "dayofweek": weekday,
        "quarter": F.quarter(col),
        "is_weekend": (weekday >= 5).cast("int"),
        "week": F.weekofyear(col),
    }
