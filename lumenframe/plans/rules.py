"""Rule tables: each rule is a condition and the record it emits, evaluated as one array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.session import settle

#: Rows that a report frame may hold in the plan itself.
PAGE = 10_000

def pinned(frame: DataFrame) -> DataFrame:
    """Write a report frame (one row per column or column pair) once, so that several rules read it without running the statistics again.

    What fits a first page of rows stays in the plan as literals; a larger frame goes to the shared folder.
    """
    rows = frame.limit(PAGE + 1).collect()
    return settle(frame) if len(rows) > PAGE else frame.sparkSession.createDataFrame(rows, frame.schema)


def emit(frame: DataFrame, rules: list[tuple[Column, dict]], keep: list[str] = ()) -> DataFrame:
    """Rows of every rule that holds, numbered by rule. Values are columns or constants."""
    records = []
    for i, (condition, record) in enumerate(rules):
        fields = [F.lit(i + 1).alias("rule")]
        for name, value in record.items():
            fields.append((value if isinstance(value, Column) else F.lit(value)).alias(name))
        records.append(F.when(condition, F.struct(*fields)))
    return frame.select(*keep, F.explode(F.array_compact(F.array(*records))).alias("r")).select(*keep, "r.*")


def fixed(value: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals and no thousands separator."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


def first_names(names: Column, k: int | None = None) -> Column:
    """Comma-separated names, the first ``k`` of an array."""
    return F.array_join(names if k is None else F.slice(names, 1, k), ", ")
