"""Exact quantiles with linear interpolation, in two scans.

The built-in exact ``percentile`` holds a key's distinct values in one task, so it is
used only for keys whose checked row count is small. For larger keys:

1. One scan counts the rows of every key and sketches its distribution, once for all wanted quantiles. The sketch is mergeable and its
   error is bounded, so it gives a bracket of values around each wanted rank.
2. One scan counts, per bracket, the values below it and each value inside it. What lies inside is a small share of the rows; it
   is laid out in ranges, and prefix sums over the ranges find the value of each rank.

The counts also tell whether a bracket holds its rank; if one does not, it is widened and counted again. So the result does not
depend on the sketch's accuracy.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.frequency import SMALL_ROWS, numeric_long
from lumenframe.operators.order import rank_values
from lumenframe.session import settle

INLINE_ROWS = SMALL_ROWS
SKETCH = 10_000
#: Half the width of a bracket, as a share of the rows: twice the sketch's error. Keys of fewer rows than this has room for ranks are one bracket.
MARGIN = 2 / SKETCH


def quantile_frame(
    long: DataFrame,
    probs: list[float],
    key: str = "column",
    inline_rows: int = INLINE_ROWS,
    approx: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """``key, q`` with ``q`` an array of quantiles in the order of ``probs``.

    ``long`` has columns ``key`` and ``value``; keys must be few (columns or top categories).
    ``rows``, where known, is a checked upper bound of rows per key and saves a count.
    """
    if approx:
        return long.groupBy(key).agg(F.percentile_approx("value", probs, SKETCH).alias("q"))
    exact = F.percentile("value", F.array(*[F.lit(p) for p in probs])).alias("q")
    if rows is not None and rows <= inline_rows:
        return long.groupBy(key).agg(exact)
    ends = [e for p in probs for e in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    sketch = F.percentile_approx("value", ends, SKETCH).alias("ends")
    found = long.groupBy(key).agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), sketch).collect()
    found = [r for r in found if r["n"]]
    if not found or max(r["n"] for r in found) <= inline_rows:
        return long.groupBy(key).agg(exact)
    return _selected(long, probs, key, found)


def _selected(long: DataFrame, probs: list[float], key: str, found: list) -> DataFrame:
    spark = long.sparkSession
    key_type = long.schema[key].dataType.simpleString()
    wanted = {(r[key], rank): i for r in found for i, p in enumerate(probs) for rank in _ranks(p, r["n"])}
    values: dict = {}
    widen = False
    while wanted:
        brackets: dict = {}  # (key, lo, hi) -> ranks in it
        for r in found:
            whole = widen or MARGIN * r["n"] < 2
            for (k, rank), i in wanted.items():
                if k == r[key]:
                    lo, hi = (r["lo"], r["hi"]) if whole else (r["ends"][2 * i], r["ends"][2 * i + 1])
                    brackets.setdefault((k, float(lo), float(hi)), []).append(rank)
        box = spark.createDataFrame([(k, lo, hi, i) for i, (k, lo, hi) in enumerate(brackets)], f"_k {key_type}, _lo double, _hi double, _box int")
        inside = long.join(F.broadcast(box), (F.col(key) == F.col("_k")) & (F.col("value") <= F.col("_hi")))  # one row per key and quantile
        counted = inside.groupBy("_box", F.when(F.col("value") >= F.col("_lo"), F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        counted = settle(counted)
        below = {r["_box"]: r["n"] for r in counted.where("value is null").collect()}
        places = [(i, rank - below.get(i, 0)) for i, ranks in enumerate(brackets.values()) for rank in ranks]
        at = spark.createDataFrame(places, "_b int, _at long")
        ranked = rank_values(counted.where("value is not null"), "_box")
        hit = ranked.join(F.broadcast(at), (F.col("_box") == F.col("_b")) & (F.col("_at") >= F.col("before")) & (F.col("_at") < F.col("before") + F.col("n")))
        names = list(brackets)
        for r in hit.select("_b", "_at", "value").collect():
            values[names[r["_b"]][0], r["_at"] + below.get(r["_b"], 0)] = r["value"]
        wanted = {t: i for t, i in wanted.items() if t not in values}
        widen = True
    out = []
    for r in found:
        q = []
        for p in probs:
            h = p * (r["n"] - 1)
            lo, hi = (values[r[key], rank] for rank in (math.floor(h), math.ceil(h)))
            q.append(float(lo + (h - math.floor(h)) * (hi - lo)))
        out.append((r[key], q))
    return spark.createDataFrame(out, f"{key} {key_type}, q array<double>")


def _ranks(p: float, n: int) -> set[int]:
    h = p * (n - 1)
    return {math.floor(h), math.ceil(h)}


def fit_quantiles(df: DataFrame, cols: list[str], probs: list[float], approx: bool = False) -> dict[str, list[float]]:
    """Quantiles per numeric column as driver scalars, for fitted parameters."""
    rows = None if approx else df.count()
    frame = quantile_frame(numeric_long(df, cols, rows), probs, approx=approx, rows=rows)
    return {r["column"]: list(r["q"]) for r in frame.collect()}


def fences(q1, q3):
    """Tukey fences at 1.5 interquartile ranges."""
    return q1 - (q3 - q1) * 1.5, q3 + (q3 - q1) * 1.5
