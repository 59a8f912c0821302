"""Total order without a single-task window.

A window ordered over a whole table would put every row in one task. Rows are instead laid out once: Spark
range-partitions them by their keys, and the number of the partition is written with them to the shared folder. Each range is
then one window partition, and a table with one row per range carries the prefix from range to range. As the
numbers are read back and never computed again, a retried task or a second reading finds the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.functions.numbers import quoted
from lumenframe.session import settle

#: Rows of one value that get a range of their own where equal values must stay together.
HEAVY_ROWS = 100_000


def key_struct(keys: list[str]) -> Column:
    return F.struct(*[F.col(quoted(k)).alias(f"k{i}") for i, k in enumerate(keys)])


def _pieces(df: DataFrame, rows_per_bucket: int | None) -> int | None:
    """Number of ranges asked for; without a wish Spark chooses by size."""
    return None if rows_per_bucket is None else max(1, -(-df.count() // rows_per_bucket))


def lay_out(df: DataFrame, keys: list[str], rows_per_bucket: int | None = None) -> DataFrame:
    """``df`` written in key ranges, with ``_bucket`` (ascending with the keys) and ``_tie``.

    Keys are compared as a tuple, then by position in the input (``_tie``), so neither a first key nor a
    whole key tuple that holds a third of all rows makes a range larger than the others.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    columns = [*[F.col(quoted(k)) for k in keys], F.col("_tie")]
    n = _pieces(df, rows_per_bucket)
    ranged = tied.repartitionByRange(n, *columns) if n else tied.repartitionByRange(*columns)
    return settle(ranged.withColumn("_bucket", F.spark_partition_id()))


def value_ranges(df: DataFrame, key: str, name: str, rows_per_bucket: int | None = None, heavy: int = HEAVY_ROWS) -> DataFrame:
    """``df`` written with a range number ``name`` of ``key``; equal values share a range.

    A value with more than ``heavy`` rows has a range of its own.
    """
    n = _pieces(df, rows_per_bucket)
    heavy = heavy if rows_per_bucket is None else min(heavy, rows_per_bucket)
    k = F.col(quoted(key))
    ranged = settle((df.repartitionByRange(n, k) if n else df.repartitionByRange(k)).withColumn(name, F.spark_partition_id()))
    many = ranged.groupBy(name, k.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy)
    # A range has few such values, as each of them has many rows.
    many = many.groupBy(F.col(name).alias("_b")).agg(F.sort_array(F.collect_list("_v")).alias("_heavy"))
    placed = ranged.join(many, F.col(name) == F.col("_b"), "left")
    inner = 2 * F.size(F.filter("_heavy", lambda v: v < k)) + F.array_contains("_heavy", k).cast("int")
    number = F.col(name).cast("long") * (1 << 24) + F.when(F.col("_heavy").isNull(), 0).otherwise(inner)
    return placed.withColumn(name, number).drop("_b", "_heavy")


def number_rows(
    df: DataFrame, order_by: list[str], name: str = "row_no", rows_per_bucket: int | None = None, keep_layout: bool = False
) -> DataFrame:
    """Add a 1-based position in the total order of ``order_by``."""
    laid = lay_out(df, order_by, rows_per_bucket)
    keys = [*[F.col(quoted(k)) for k in order_by], F.col("_tie")]
    local = laid.withColumn(name, F.row_number().over(W.partitionBy("_bucket").orderBy(*keys)).cast("long"))
    sizes = laid.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    joined = local.join(F.broadcast(offsets), F.col("_bucket") == F.col("_b"))
    joined = joined.withColumn(name, F.col(name) + F.col("_offset")).drop("_b", "_offset")
    return joined if keep_layout else joined.drop("_bucket", "_tie")


def rank_values(
    freq: DataFrame, key: str, value: str = "value", weight: str = "n", rows_per_bucket: int | None = None
) -> DataFrame:
    """Prefix sums over a frequency table with one row per (key, value).

    Adds ``before`` (weight of smaller values) and ``total`` (weight of the key). The number of distinct keys must be
    small: it is one per analysed column.
    """
    w = F.col(weight)
    laid = lay_out(freq, [key, value], rows_per_bucket)
    inside = W.partitionBy(key, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    local = laid.withColumn("before", F.coalesce(F.sum(w).over(inside), F.lit(0)))
    sizes = laid.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_b")).agg(F.sum(w).alias("_w"))
    per_key = W.partitionBy("_key")
    earlier = per_key.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_key",
        "_b",
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_w").over(per_key).alias("total"),
    )
    joined = local.join(
        F.broadcast(offsets), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b"))
    )
    return joined.withColumn("before", F.col("before") + F.col("_offset")).drop("_bucket", "_tie", "_b", "_key", "_offset")
