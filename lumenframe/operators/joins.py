"""Joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.numbers import quoted

#: Bytes of a table (measured, not estimated) up to which it is broadcast.
BROADCAST_BYTES = 64 << 20
#: Rows of one key that one task should meet; a key with more is spread.
ROWS_PER_TASK = 1_000_000
#: Hot keys of a side at most, and items that the sketch follows.
MOST_HOT, TRACKED = 1_000, 20_000


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all cells, text by its length and everything else as its JSON text or eight bytes."""
    cells = []
    for f in df.schema.fields:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            cells.append(F.octet_length(c))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cells.append(F.octet_length(F.to_json(F.struct(c))))
        else:
            cells.append(F.lit(8))
    width = reduce(lambda x, y: x + y, [F.coalesce(c, F.lit(0)).cast("long") + 8 for c in cells])
    return df.agg(F.sum(width)).first()[0] or 0


def _key_hash(df: DataFrame, on: list[str]) -> Column:
    """A number that equal keys share, integers and fractions of any width."""
    cells = []
    for c in on:
        kind = df.schema[c].dataType
        wide = "long" if isinstance(kind, T.IntegralType) else "double" if isinstance(kind, T.FractionalType) else None
        cells.append(F.col(quoted(c)).cast(wide) if wide else F.col(quoted(c)))
    return F.xxhash64(*cells)


def _same_kinds(left: DataFrame, right: DataFrame, on: list[str]) -> bool:
    def kind(df: DataFrame, c: str):
        t = df.schema[c].dataType
        return T.IntegralType if isinstance(t, T.IntegralType) else T.FractionalType if isinstance(t, T.FractionalType) else t

    return all(kind(left, c) == kind(right, c) for c in on)


def hot_hashes(df: DataFrame, on: list[str], rows_per_task: int) -> dict[int, int]:
    """Hash of each key with more rows than a task should meet, and into how many parts to spread them.

    One pass with a mergeable sketch of ``TRACKED`` items finds at most ``MOST_HOT`` keys: all with a share of the rows that is well above
    1 / TRACKED. Keys that it misses are hot by number but not by share; they are many, and no task meets more than a few.
    """
    sketch = F.expr(f"approx_top_k(_h, {MOST_HOT}, {TRACKED})")
    found = df.dropna(subset=on).select(_key_hash(df, on).alias("_h")).agg(sketch.alias("top")).first()["top"]
    return {r["item"]: -(-r["count"] // rows_per_task) for r in found or [] if r["count"] > rows_per_task}


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Equi-join in which either side may have hot keys; result of the plain join.

    Rows of keys hot on either side are split off. The left rows of such a key are dealt to as many parts as its left count asks for,
    the right rows to as many as theirs; every left part meets every right part once. Parts are dealt by position, not content,
    so equal rows are spread too. Rows with a missing key match nothing and are not shuffled. For inner, left, semi and anti; a left join is
    the inner one and the left rows without a match, a semi or anti join needs each right key once. The table of hot keys that is
    broadcast has at most ``2 * MOST_HOT`` rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join does not support {how!r}")
    out_columns = left.join(right, on, how).columns
    whole = left.dropna(subset=on)
    if how in ("left_semi", "left_anti"):
        right = right.select([F.col(quoted(c)) for c in on]).distinct()  # one row of a key says as much as all
    keys = [F.col(quoted(c)) for c in on]
    lefts, rights = (hot_hashes(d, on, rows_per_task) if _same_kinds(left, right, on) else {} for d in (left, right))
    hot = left.sparkSession.createDataFrame([(h, lefts.get(h, 1), rights.get(h, 1)) for h in {**lefts, **rights}], "_h long, _l long, _r long")
    if not lefts and not rights:
        parts = [whole.join(right, on, how)]
    else:
        def hashed(df: DataFrame) -> DataFrame:
            return df.withColumn("_h", _key_hash(df, on))

        def deal(df: DataFrame, own: str, other: str) -> DataFrame:
            """Rows of hot keys with their own part, once for each part of the other side."""
            dealt = hashed(df).join(F.broadcast(hot), "_h")
            dealt = dealt.withColumn(f"_p{own}", F.pmod(F.monotonically_increasing_id(), F.col(own)).cast("int"))
            dealt = dealt.withColumn(f"_p{other}", F.explode(F.sequence(F.lit(0), F.col(other).cast("int") - 1)))
            return dealt.drop("_l", "_r", "_h")

        marks = [*on, "_p_l", "_p_r"]
        matched = deal(whole, "_l", "_r").join(deal(right, "_r", "_l"), marks, "inner" if how == "left" else how)
        hot_keys = F.broadcast(hot.select("_h"))
        rest = hashed(whole).join(hot_keys, "_h", "left_anti").drop("_h")
        parts = [matched.drop("_p_l", "_p_r"), rest.join(right, on, how)]
        if how == "left":
            split_off = hashed(whole).join(hot_keys, "_h", "left_semi").drop("_h")
            parts.append(split_off.join(right.select(*keys).distinct(), on, "left_anti"))
    if how in ("left", "left_anti"):
        missing = reduce(or_, [F.col(quoted(c)).isNull() for c in on])
        parts.append(left.where(missing))
    out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return out.select([F.col(quoted(c)) for c in out_columns])


def lookup(df: DataFrame, table: DataFrame, col: str, key: str, value: str, out: str, size: int | None = None) -> DataFrame:
    """Map a column through a ``key -> value`` table; values absent from it become NULL.

    ``table`` has one row per key. It is broadcast only when its checked size is small; ``size``, in bytes, saves the measurement where known.
    """
    small = table.select(F.col(quoted(key)).alias("_key"), F.col(quoted(value)).alias("_value"))
    if (measured_bytes(small) if size is None else size) <= BROADCAST_BYTES:
        joined = df.join(F.broadcast(small), F.col(quoted(col)) == F.col("_key"), "left")
    else:
        joined = skew_join(df.withColumn("_key", F.col(quoted(col))), small, ["_key"], "left")
    kept = [F.col(quoted(c)) for c in df.columns if c != out]
    order = [F.col("_value").alias(out) if c == out else F.col(quoted(c)) for c in df.columns]
    return joined.select(*(order if out in df.columns else [*kept, F.col("_value").alias(out)]))


def keep_top(df: DataFrame, col: str, k: int) -> DataFrame:
    """Rows whose value is among the ``k`` most frequent (at most ``k`` broadcast rows)."""
    from lumenframe.operators.frequency import most_frequent

    top = most_frequent(df, col, k).select(F.col("value").alias("_top"))
    return df.join(F.broadcast(top), F.col(quoted(col)) == F.col("_top"), "left_semi")


def merge_datasets(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """Merge two tables on shared columns, with suffixes for other name clashes."""
    clash = [c for c in left.columns if c in right.columns and c not in on]
    semi = how in ("left_semi", "left_anti", "semi", "anti")
    if not semi:
        left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
        right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    how = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
    if how in ("inner", "left", "left_semi", "left_anti"):
        return skew_join(left, right, on, how)
    if how == "right":
        out = skew_join(right, left, on, "left")
        return out.select(*[F.col(quoted(c)) for c in (*left.columns, *[c for c in right.columns if c not in on])])
    if how in ("full", "outer"):
        matched = skew_join(left, right, on, "left")
        unmatched = skew_join(right, left, on, "left_anti")
        return matched.unionByName(unmatched, allowMissingColumns=True)
    raise ValueError(f"unknown join type {how!r}")


def concat(frames: list[DataFrame]) -> DataFrame:
    """Stack tables by column name; columns a table lacks are NULL."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
