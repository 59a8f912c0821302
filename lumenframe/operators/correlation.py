"""Pearson, Spearman and Kendall correlation, pair reports and trend lines."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.numbers import band, number, quoted, ratio
from lumenframe.operators import catalog
from lumenframe.operators.frequency import numeric_frequencies
from lumenframe.operators.joins import lookup
from lumenframe.operators.order import rank_values
from lumenframe.plans.rules import emit, first_names, fixed, pinned
from lumenframe.session import settle


def strength(r: Column) -> Column:
    return band(
        F.abs(r), (0.9, "Very Strong"), (0.7, "Strong"), (0.5, "Moderate"), (0.3, "Weak"), otherwise="Very Weak"
    )


def direction(r: Column) -> Column:
    return F.when(r > 0, "Positive").when(r < 0, "Negative").otherwise("None")


def zero_filled(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numbers with missing as 0, without the rows that have none at all."""
    return df.select([number(df, c).alias(c) for c in cols]).dropna("all").fillna(0.0)


PAIRS_PER_JOB = 300
#: A value and its rank, with what a row has besides.
RANK_BYTES = 32
#: Rows of a counting problem that one task takes, and ranges into which a larger one is cut.
LEAF_ROWS, FAN = 200_000, 64


def _per_pair(df: DataFrame, cols: list[str], aggregate) -> DataFrame:
    """``feature_a, feature_b, r`` with one aggregate for every few hundred pairs of columns.

    ``aggregate(i, j)`` gives the named aggregates of a pair and the expression of r on them.
    """
    pairs = list(combinations(range(len(cols)), 2))
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_JOB):
        aggs, cells = {}, []
        for i, j in pairs[start : start + PAIRS_PER_JOB]:
            named, r = aggregate(i, j)
            aggs.update(named)
            cells.append(
                F.struct(F.lit(cols[i]).alias("feature_a"), F.lit(cols[j]).alias("feature_b"), r.alias("r"))
            )
        parts.append(df.agg(*[v.alias(k) for k, v in aggs.items()]).select(F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)


def pairwise_pearson(df: DataFrame, cols: list[str]) -> DataFrame:
    """``feature_a, feature_b, r`` of complete numeric columns."""

    def aggregate(i: int, j: int):
        named = {f"s{k}": F.stddev_pop(quoted(cols[k])) for k in (i, j)}
        named[f"c{i}_{j}"] = F.covar_pop(quoted(cols[i]), quoted(cols[j]))
        return named, ratio(F.col(f"c{i}_{j}"), F.col(f"s{i}") * F.col(f"s{j}"))

    return _per_pair(df, cols, aggregate)


def average_ranks(df: DataFrame, cols: list[str], rows_per_bucket: int | None = None) -> DataFrame:
    """Replace numbers by their average rank, through one frequency table for all columns."""
    ranked = rank_values(numeric_frequencies(df, cols), "column", rows_per_bucket=rows_per_bucket)
    # Written once; every column then looks its ranks up in the same table. One job measures the ranks of all columns.
    ranked = settle(ranked.select("column", "value", (F.col("before") + (F.col("n") + 1) / 2).alias("rank")))
    sizes = {r["column"]: r["count"] * RANK_BYTES for r in ranked.groupBy("column").count().collect()}
    out = df
    for c in cols:
        out = lookup(out, ranked.where(F.col("column") == c), c, "value", "rank", c, sizes.get(c, 0))
    return out


def _inversions(y: np.ndarray, w: np.ndarray) -> float:
    """Weighted count of pairs i < j with y[i] > y[j], bit by bit over the ranks."""
    _, r = np.unique(y, return_inverse=True)
    total = 0.0
    bits = int(r.max()).bit_length() if len(r) else 0
    for b in range(bits):
        group = r >> (b + 1)
        order = np.argsort(group, kind="stable")
        g, bit, ww = group[order], (r[order] >> b) & 1, w[order]
        ones = np.cumsum(np.where(bit == 1, ww, 0.0))
        start = np.searchsorted(g, g, side="left")
        base = np.where(start > 0, ones[np.maximum(start - 1, 0)], 0.0)
        total += float(np.sum(np.where(bit == 0, ww * (ones - base), 0.0)))
    return total


def _inverted(rows: pd.DataFrame) -> pd.DataFrame:
    """Weight of the pairs of rows with x ascending and y descending, of one problem."""
    rows = rows.sort_values(["x", "y"], kind="stable")
    return pd.DataFrame({"pair": [int(rows["pair"].iloc[0])], "d": [_inversions(rows["y"].to_numpy(), rows["w"].to_numpy())]})


def _below(column: str):
    return lambda cut: cut < F.col(column)


def _discordant(cells: DataFrame, leaf: int, fan: int) -> DataFrame:
    """``pair, d``: weight of discordant pairs among ``pair, x, y, w``, in parts.

    Dominance counting by a tree with ``fan`` branches. A problem of more than ``leaf`` rows is cut into ranges of x and of y. Its pairs of
    rows lie in different ranges of both, which the small range-by-range table tells; or in one range of x, which is a
    smaller problem; or in one range of y only, which is another one with ranges for x. All problems of a level, of all pairs of
    columns, are handled by the same jobs, and no problem that one task gets has more than ``leaf`` or ``fan ** 2`` rows. A problem with one x or
    one y has no such pairs, so copies of a value are never gathered.
    """
    probs = [i / fan for i in range(1, fan)]
    todo, parts = cells.withColumn("id", F.col("pair").cast("string")), []
    while True:
        todo = settle(todo.groupBy("id", "pair", "x", "y").agg(F.sum("w").alias("w")))
        sizes = todo.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
        sizes = settle(sizes.where("lox < hix and loy < hiy").select("id", "rows"))
        few = todo.join(sizes.where(F.col("rows") <= leaf).select("id"), "id", "left_semi")
        parts.append(few.groupBy("id").applyInPandas(_inverted, "pair int, d double"))
        large = sizes.where(F.col("rows") > leaf).select("id")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        # There are at most rows / leaf large problems, so their cuts are few; rows never meet them by a shuffle, which would bring a problem to one task.
        many = todo.join(F.broadcast(large), "id", "left_semi")
        cuts = settle(many.groupBy("id").agg(*[F.percentile_approx(c, probs, 4 * fan).alias(f"cut_{c}") for c in "xy"]))
        at = [F.size(F.filter(f"cut_{c}", _below(c))).alias(f"b{c}") for c in "xy"]
        placed = settle(many.join(F.broadcast(cuts), "id").select("id", "pair", "x", "y", "w", *at))
        grid = placed.groupBy("id", "pair", F.col("bx").cast("double").alias("x"), F.col("by").cast("double").alias("y")).agg(F.sum("w").alias("w"))
        parts.append(grid.groupBy("id").applyInPandas(_inverted, "pair int, d double"))
        same_x = placed.select(F.concat_ws("x", "id", "bx").alias("id"), "pair", "x", "y", "w")
        same_y = placed.select(F.concat_ws("y", "id", "by").alias("id"), "pair", F.col("bx").cast("double").alias("x"), "y", "w")
        todo = same_x.unionByName(same_y)


def kendall_pairs(df: DataFrame, pairs: list[tuple[str, str]], leaf: int = LEAF_ROWS, fan: int = FAN) -> DataFrame:
    """Exact tau-b of pairs of columns, all in the same jobs: ``feature_a, feature_b, tau, n, concordant, discordant``.

    Rows where either value is missing don't count for a pair. Equal rows are merged first; discordant pairs are counted without forming pairs.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), number(df, a).alias("x"), number(df, b).alias("y")) for i, (a, b) in enumerate(pairs)])
    long = df.select(F.inline(cells)).where("x is not null and y is not null")
    freq = settle(long.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w")))
    tied = F.sum(F.col("w") * (F.col("w") - 1) / 2)
    both = freq.groupBy("pair").agg(F.sum("w").alias("n"), tied.alias("txy"))
    ties = [freq.groupBy("pair", c).agg(F.sum("w").alias("w")).groupBy("pair").agg(tied.alias(f"t{c}")) for c in "xy"]
    inverted = _discordant(freq, leaf, fan).groupBy("pair").agg(F.sum("d").alias("d"))
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, feature_a string, feature_b string")
    out = reduce(lambda left, right: left.join(right, "pair", "left"), [names, both, *ties, inverted])
    n, d = F.coalesce("n", F.lit(0.0)), F.coalesce("d", F.lit(0.0))
    out = out.withColumns({"n": n, "d": d, **{c: F.coalesce(c, F.lit(0.0)) for c in ("tx", "ty", "txy")}})
    every = F.col("n") * (F.col("n") - 1) / 2
    concordant = every - F.col("tx") - F.col("ty") + F.col("txy") - F.col("d")
    scale = F.sqrt((every - F.col("tx")) * (every - F.col("ty")))
    out = out.withColumn("concordant", concordant)
    tau = (F.col("concordant") - F.col("d")) / F.nullif(scale, F.lit(0.0))
    return out.select("feature_a", "feature_b", tau.alias("tau"), F.col("n").cast("long").alias("n"), "concordant", F.col("d").alias("discordant"))


def kendall_tau(df: DataFrame, a: str, b: str, rows_per_bucket: int | None = None) -> DataFrame:
    """Exact tau-b of two columns: ``tau, n, concordant, discordant``."""
    return kendall_pairs(df, [(a, b)], rows_per_bucket or LEAF_ROWS).drop("feature_a", "feature_b")


def correlations(df: DataFrame, method: str = "pearson", cols: list[str] | None = None) -> DataFrame:
    """Unrounded ``feature_a, feature_b, r`` by the chosen method over zero-filled rows."""
    cols = cols or catalog.numeric_columns(df)
    if len(cols) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    ready = zero_filled(df, cols)
    if method == "pearson":
        return pairwise_pearson(ready, cols)
    if method == "spearman":
        return pairwise_pearson(average_ranks(ready, cols), cols)
    if method == "kendall":
        found = kendall_pairs(ready, list(combinations(cols, 2)))
        return found.select("feature_a", "feature_b", F.col("tau").alias("r"))
    raise ValueError(f"unknown method {method!r}")


def pair_report(df: DataFrame, method: str = "pearson", cols: list[str] | None = None) -> DataFrame:
    """``feature_a, feature_b, value, abs_value, strength, direction``, strongest first."""
    r = F.col("r")
    pairs = correlations(df, method, cols).where(r.isNotNull())
    return pairs.select(
        "feature_a",
        "feature_b",
        F.round(r, 4).alias("value"),
        F.round(F.abs(r), 4).alias("abs_value"),
        strength(r).alias("strength"),
        direction(r).alias("direction"),
    ).orderBy(F.col("abs_value").desc(), "feature_a", "feature_b")


def top_pairs(pairs: DataFrame, which: str, k: int = 10) -> DataFrame:
    """The ``k`` strongest ``positive`` or ``negative`` pairs, or the most ``independent`` ones."""
    if which == "independent":
        return pairs.orderBy("abs_value", "feature_a", "feature_b").limit(k)
    chosen = pairs.where(F.col("direction") == which.capitalize())
    return chosen.orderBy(F.col("abs_value").desc(), "feature_a", "feature_b").limit(k)


def influence(pairs: DataFrame) -> DataFrame:
    """``column, avg_corr``: mean absolute correlation with all other columns."""
    ends = pairs.select(F.explode(F.array("feature_a", "feature_b")).alias("column"), "abs_value")
    return (
        ends.groupBy("column")
        .agg(F.round(F.avg("abs_value"), 4).alias("avg_corr"))
        .orderBy(F.col("avg_corr").desc(), "column")
    )


def multicollinear(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("abs_value") > 0.9)


def network_edges(pairs: DataFrame) -> DataFrame:
    """``source, target, value, abs_value, width`` of pairs at or above 0.3."""
    return pairs.where(F.col("abs_value") >= 0.3).select(
        F.col("feature_a").alias("source"),
        F.col("feature_b").alias("target"),
        "value",
        "abs_value",
        F.greatest(F.lit(1.0), F.col("abs_value") * 5).alias("width"),
    )


def network_nodes(pairs: DataFrame) -> DataFrame:
    """``id, degree``: the features of the pairs and how many edges each has."""
    ends = pairs.select(F.explode(F.array("feature_a", "feature_b")).alias("id"), (F.col("abs_value") >= 0.3).alias("edge"))
    return ends.groupBy("id").agg(F.count_if("edge").alias("degree"))


def matrix(pairs: DataFrame, cols: list[str]) -> DataFrame:
    """Square matrix: ``column`` plus one value column per feature."""
    mirrored = pairs.select(F.col("feature_a").alias("column"), F.col("feature_b").alias("other"), "value").unionByName(
        pairs.select(F.col("feature_b").alias("column"), F.col("feature_a").alias("other"), "value")
    )
    diagonal = pairs.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "column string, other string, value double")
    return mirrored.unionByName(diagonal).groupBy("column").pivot("other", cols).agg(F.first("value"))


def complete_pearson(df: DataFrame, cols: list[str]) -> DataFrame:
    """``feature_a, feature_b, r`` over the rows where both columns are present."""

    def aggregate(i: int, j: int):
        x, y = number(df, cols[i]), number(df, cols[j])
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        named = {
            f"c{i}_{j}": F.covar_pop(x, y),
            f"x{i}_{j}": F.stddev_pop(x),
            f"y{i}_{j}": F.stddev_pop(y),
        }
        return named, ratio(F.col(f"c{i}_{j}"), F.col(f"x{i}_{j}") * F.col(f"y{i}_{j}"))

    return _per_pair(df, cols, aggregate)


def trend_fit(df: DataFrame, a: str, b: str) -> DataFrame:
    """``slope, intercept, r_squared, x_min, x_max, n`` of b on a over complete rows."""
    x, y = number(df, a), number(df, b)
    work = df.select(x.alias("x"), y.alias("y")).dropna()
    return work.agg(
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.coalesce(F.regr_r2("y", "x"), F.lit(0.0)).alias("r_squared"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
        F.count(F.lit(1)).alias("n"),
    )


def trend_line(df: DataFrame, a: str, b: str, points: int = 100) -> DataFrame:
    """``x, y`` of the fitted line on an even grid."""
    fit = trend_fit(df, a, b)
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    x = F.col("x_min") + F.col("i") * (F.col("x_max") - F.col("x_min")) / (points - 1)
    return fit.select("*", grid).select(x.alias("x"), (F.col("slope") * x + F.col("intercept")).alias("y"))


def scatter_points(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(number(df, a).alias("x"), number(df, b).alias("y")).dropna()


def _facts(pairs: DataFrame) -> DataFrame:
    """One row with what the sentence rules need, from a pinned pair frame."""
    p = F.struct("feature_a", "feature_b", "value", "abs_value", "direction")
    strong_first = F.struct(-F.col("abs_value"), F.col("feature_a"), F.col("feature_b"))
    weak_first = F.struct(F.col("abs_value"), F.col("feature_a"), F.col("feature_b"))

    def ends(condition: Column) -> Column:
        both = F.flatten(F.collect_list(F.when(condition, F.array("feature_a", "feature_b"))))
        return F.array_sort(F.array_distinct(both))

    dup = F.col("abs_value") > 0.9
    low = F.col("abs_value") < 0.1
    ordered = F.array_sort(F.collect_list(F.when(dup, F.struct(strong_first.alias("k"), p.alias("p")))))
    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(p, strong_first).alias("top"),
        F.min_by(p, F.when(F.col("direction") == "Negative", strong_first)).alias("neg"),
        F.min_by(p, weak_first).alias("weak"),
        F.min_by(p, F.when(low, strong_first)).alias("apart"),
        F.count_if(dup).alias("n_dup"),
        ends(dup).alias("dup_columns"),
        F.transform(ordered, lambda s: s["p"]).alias("dups"),
        ends(low).alias("low_columns"),
        F.count_if(F.col("abs_value") >= 0.7).alias("n_strong"),
    )


def insights(pairs: DataFrame) -> DataFrame:
    """Seven sentence rules over the pair report: ``rule, insight``."""
    pairs = pinned(pairs)
    leaders = influence(pairs).agg(F.min_by("column", F.struct(-F.col("avg_corr"), F.col("column"))).alias("lead"), F.max("avg_corr").alias("lead_corr"))
    leader = leaders.first()
    f = _facts(pairs)

    def named(p: str) -> Column:
        return F.concat(F.col(f"{p}.feature_a"), F.lit(" and "), F.col(f"{p}.feature_b"))

    def r(p: str) -> Column:
        return fixed(F.col(f"{p}.value"), 3)

    rules = [
        (F.col("top.direction") == "Positive", {"insight": F.concat(named("top"), F.lit(" rise together most strongly (r = "), r("top"), F.lit(")."))}),
        (F.col("neg").isNotNull(), {"insight": F.concat(named("neg"), F.lit(" move against each other most strongly (r = "), r("neg"), F.lit(")."))}),
        (F.col("n") > 2, {"insight": F.concat(named("weak"), F.lit(" are closest to independent (r = "), r("weak"), F.lit(")."))}),
        (F.col("n_dup") > 0, {"insight": F.concat(F.col("n_dup").cast("string"), F.lit(" pairs exceed |r| = 0.90: "), first_names(F.col("dup_columns"), 5), F.lit("."))}),
        (F.lit(leader["lead"] is not None), {"insight": F.lit(f"{leader['lead']} has the highest mean |r|, {leader['lead_corr'] or 0:.3f}.")}),
        (F.col("apart").isNotNull(), {"insight": F.concat(named("apart"), F.lit(" are practically uncorrelated (r = "), r("apart"), F.lit(")."))}),
        (
            F.col("n_strong") > 0,
            {
                "insight": F.concat(
                    F.col("n_strong").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" pairs ("),
                    fixed(ratio(F.col("n_strong"), F.col("n")) * 100, 0), F.lit("%) are strong."),
                )
            },
        ),
    ]
    return emit(f.where(F.col("n") > 0), rules)


def recommendations(pairs: DataFrame) -> DataFrame:
    """Four rule families: ``rule, priority, category, title, description, affected_columns, action``."""
    pairs = pinned(pairs)
    leaders = [r["column"] for r in influence(pairs).limit(3).collect()]
    f = _facts(pairs)
    rules = []
    for i in range(3):
        d = F.get(F.col("dups"), F.lit(i))
        rules.append((
            d.isNotNull(),
            {
                "priority": "high", "category": "multicollinearity", "title": "Remove redundant feature",
                "description": F.concat(F.lit("r = "), fixed(d["value"], 3), F.lit(": one of the two is enough.")),
                "affected_columns": F.concat_ws(", ", d["feature_a"], d["feature_b"]), "action": "remove_feature",
            },
        ))
    d = F.get(F.col("dups"), F.lit(0))
    rules += [
        (
            d.isNotNull(),
            {
                "priority": "medium", "category": "feature_engineering", "title": "Merge highly correlated features",
                "description": "The pair could become one ratio, difference or component.",
                "affected_columns": F.concat_ws(", ", d["feature_a"], d["feature_b"]), "action": "merge_features",
            },
        ),
        (
            F.lit(bool(leaders)),
            {
                "priority": "medium", "category": "prediction", "title": "Best features for prediction",
                "description": "Highest mean correlation with the other columns.",
                "affected_columns": ", ".join(leaders), "action": "use_for_prediction",
            },
        ),
        (
            F.size("low_columns") > 0,
            {
                "priority": "low", "category": "feature_selection", "title": "Columns with little analytical value",
                "description": F.concat(F.size("low_columns").cast("string"), F.lit(" columns have a pair below |r| = 0.1.")),
                "affected_columns": first_names(F.col("low_columns"), 5), "action": "review_columns",
            },
        ),
    ]
    return emit(f, rules)
