"""Imputation along an order, and from nearest neighbours."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.numbers import number, quoted
from lumenframe.operators import catalog
from lumenframe.operators.order import key_struct, lay_out, number_rows
from lumenframe.operators.quantiles import fit_quantiles
from lumenframe.session import settle

MAX_CELLS = 1024
MAX_DIRECTORY = 16_384
CELL_ROWS = 512
BLOCK_ROWS = 4096
#: Distances of rows to cells that are bounded at once.
ROUTED = 1 << 19


def _carry(laid: DataFrame, order_by: list[str], columns: list[str], forward: bool) -> DataFrame:
    """A laid-out table whose missing cells of ``columns`` take the nearest earlier (later) present one."""
    # Backward is forward in reversed order: a frame that grows row by row costs
    # linear time, one that shrinks is evaluated anew for every row.
    ordered = [*[F.col(quoted(k)) for k in order_by], F.col("_tie")]
    frame = W.partitionBy("_bucket").orderBy(*[k if forward else k.desc() for k in ordered])
    frame = frame.rowsBetween(W.unboundedPreceding, 0)
    filled = laid.withColumns({c: F.last(F.col(quoted(c)), ignorenulls=True).over(frame) for c in columns})
    # One row per range: its last (first) present value, then the nearest earlier (later) range's.
    by = F.max_by if forward else F.min_by
    key = key_struct([*order_by, "_tie"])
    ends = laid.groupBy("_bucket").agg(
        *[
            by(F.struct(F.col(quoted(c)).alias("v")), F.when(F.col(quoted(c)).isNotNull(), key)).alias(f"_e{i}")
            for i, c in enumerate(columns)
        ]
    )
    span = W.orderBy(F.col("_bucket") if forward else F.col("_bucket").desc())
    span = span.rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(
        F.col("_bucket").alias("_b"),
        *[F.last(F.col(f"_e{i}.v"), ignorenulls=True).over(span).alias(f"_c{i}") for i in range(len(columns))],
    )
    filled = filled.join(F.broadcast(carry), F.col("_bucket") == F.col("_b"))
    filled = filled.withColumns({c: F.coalesce(F.col(quoted(c)), F.col(f"_c{i}")) for i, c in enumerate(columns)})
    return filled.drop("_b", *[f"_c{i}" for i in range(len(columns))])


def _thin(df: DataFrame, order_by: list[str], columns: list[str]) -> tuple[DataFrame, Column]:
    """What has to be put in order, and which rows have a gap: rows without one are laid out with their keys and ``columns`` alone.

    They only lend their values and go to the result as they are, without being shuffled.
    """
    gap = reduce(or_, [F.col(quoted(c)).isNull() for c in columns])
    rest = [c for c in df.columns if c not in columns and c not in order_by]
    return df.withColumns({c: F.when(gap, F.col(quoted(c))) for c in rest} | {"_gap": gap}), gap


def _fill(df: DataFrame, order_by: list[str], columns: list[str], forward: bool, rows_per_bucket: int | None) -> DataFrame:
    names = [F.col(quoted(c)) for c in df.columns]
    if not columns:
        return df
    plain = catalog.missing_as_null(df)
    thin, gap = _thin(plain, order_by, columns)
    filled = _carry(lay_out(thin, order_by, rows_per_bucket), order_by, columns, forward)
    return filled.where("_gap").select(names).unionByName(plain.where(~gap).select(names))


def forward_fill(
    df: DataFrame, order_by: list[str], columns: list[str] | None = None, rows_per_bucket: int | None = None
) -> DataFrame:
    """Previous present value in the stated order."""
    columns = columns or [c for c in df.columns if c not in order_by]
    return _fill(df, order_by, columns, True, rows_per_bucket)


def backward_fill(
    df: DataFrame, order_by: list[str], columns: list[str] | None = None, rows_per_bucket: int | None = None
) -> DataFrame:
    """Next present value in the stated order."""
    columns = columns or [c for c in df.columns if c not in order_by]
    return _fill(df, order_by, columns, False, rows_per_bucket)


def interpolate(
    df: DataFrame, order_by: list[str], columns: list[str] | None = None, rows_per_bucket: int | None = None
) -> DataFrame:
    """Linear interpolation by position; values beyond the ends repeat the nearest one."""
    columns = columns or [c for c in catalog.numeric_columns(df) if c not in order_by]
    plain = df.withColumns({c: number(df, c) for c in columns})
    if not columns:
        return plain
    thin, gap = _thin(plain, order_by, columns)
    numbered = number_rows(thin, order_by, "_i", rows_per_bucket, keep_layout=True)
    points = {}
    for i, c in enumerate(columns):
        point = F.when(F.col(quoted(c)).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(quoted(c)).alias("v")))
        points |= {f"_p{i}": point, f"_n{i}": point}
    # Written once more with positions, so that both directions read it instead of numbering again.
    marked = settle(numbered.withColumns(points))
    marked = _carry(marked, order_by, [f"_p{i}" for i in range(len(columns))], True)
    marked = _carry(marked, order_by, [f"_n{i}" for i in range(len(columns))], False)
    out = {}
    for i, c in enumerate(columns):
        p, n = F.col(f"_p{i}"), F.col(f"_n{i}")
        blend = p["v"] + (n["v"] - p["v"]) * (F.col("_i") - p["i"]) / F.nullif(n["i"] - p["i"], F.lit(0))
        out[c] = F.coalesce(F.col(quoted(c)), blend, p["v"], n["v"])
    names = [F.col(quoted(c)) for c in df.columns]
    return marked.where("_gap").withColumns(out).select(names).unionByName(plain.where(~gap).select(names))


# --- nearest neighbours -----------------------------------------------------------------


def _gap_bounds(x: np.ndarray, present: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int):
    """Squared-distance bounds between rows and boxes over the features both have."""
    shared = present[:, None, :] & ~np.isnan(lo)[None, :, :]
    count = shared.sum(axis=2)
    near = np.maximum(np.maximum(lo[None] - x[:, None], x[:, None] - hi[None]), 0.0)
    far = np.maximum(np.abs(x[:, None] - lo[None]), np.abs(hi[None] - x[:, None]))
    with np.errstate(invalid="ignore", divide="ignore"):
        scale = d / count
        lower = np.where(shared, near * near, 0.0).sum(axis=2) * scale
        upper = np.where(shared, far * far, 0.0).sum(axis=2) * scale
    return np.where(count > 0, lower, np.nan), np.where(count > 0, upper, np.nan)


def _block_nearest(q: np.ndarray, donors: np.ndarray, targets: np.ndarray, weights: np.ndarray, k: int):
    """Per query row: donor positions of the k nearest (by weight), nearest first, and all distances.

    Ties in distance go to the smaller target value.
    """
    d = q.shape[1]
    by_target = np.argsort(targets, kind="stable")
    total = np.zeros((len(q), len(donors)))
    count = np.zeros((len(q), len(donors)))
    for j in range(d):
        diff = q[:, j][:, None] - donors[by_target, j][None, :]
        ok = ~np.isnan(diff)
        total += np.where(ok, diff * diff, 0.0)
        count += ok
    with np.errstate(invalid="ignore", divide="ignore"):
        dist = (d / count) * total
    dist[count == 0] = np.nan
    # A weight is 1 or more, so that k donors are enough; those as far as the k-th one are sorted.
    reach = np.full(len(q), np.inf)
    if len(donors) > k:
        reach = np.partition(dist, k - 1, axis=1)[:, k - 1]  # NaN comes last
        reach[np.isnan(reach)] = np.inf
    for i in range(len(q)):
        near = np.flatnonzero(dist[i] <= reach[i])
        near = near[np.argsort(dist[i, near], kind="stable")][:k]
        stop = int(np.searchsorted(np.cumsum(weights[by_target[near]]), k)) + 1
        yield by_target[near[:stop]], dist[i, near[:stop]]


def impute_knn(
    df: DataFrame, id_columns: list[str], columns: list[str] | None = None, n_neighbors: int = 5, max_cells: int = MAX_CELLS
) -> DataFrame:
    """Fill numbers with the mean of the nearest rows that have them. Exact.

    Distances are nan-Euclidean: squared differences over shared features, scaled up to
    all of them. Donors are first collapsed to distinct vectors with a weight, and rows with
    gaps to distinct vectors, so copies cost nothing. A directory of at most ``max_cells`` cells
    per missing pattern (with a box and a weight each) bounds every row's distance to every cell.
    The cells that surely hold k donors are visited first; the k-th distance found there tells which
    other cells can still hold one of the k nearest. Cells are visited in blocks of bounded
    size. ``id_columns`` are no features.
    """
    spark = df.sparkSession
    columns = columns or [c for c in catalog.numeric_columns(df) if c not in id_columns]
    d = len(columns)
    base = df.withColumns({c: number(df, c) for c in columns})
    vec = base.select(*[F.col(quoted(c)).alias(f"x{j}") for j, c in enumerate(columns)])
    complete = vec.dropna().limit(n_neighbors).count()
    k = min(n_neighbors, complete)
    each = enumerate(columns)
    means = base.agg(*[f(F.col(quoted(c))).alias(f"{n}{j}") for j, c in each for n, f in (("m", F.avg), ("v", F.var_pop))]).first()
    if k == 0:
        return base.withColumns(
            {c: F.coalesce(F.col(quoted(c)), F.lit(means[f"m{j}"])) for j, c in enumerate(columns)}
        )
    xs = [f"x{j}" for j in range(d)]
    donors = settle(vec.dropna("all").groupBy(*xs).agg(F.count(F.lit(1)).alias("w")))
    # Equi-depth cuts of the features that vary most, as many as can be cut in two at least: they weigh most in the
    # distance, and with all features cut none would be. Patterns of presence split cells further.
    cells = max(1, min(max_cells, donors.count() // CELL_ROWS))
    cut_features = sorted(range(d), key=lambda j: -(means[f"v{j}"] or 0.0))[: max(1, cells.bit_length() - 1)]
    per_dim = max(1, int(math.floor(cells ** (1.0 / len(cut_features)) + 1e-9)))
    probs = [i / per_dim for i in range(1, per_dim)]
    cuts = fit_quantiles(df, [columns[j] for j in cut_features], probs) if probs else {}

    def bin_of(j: int):
        step = F.lit(0)
        for cut in sorted(set(cuts.get(columns[j], []))):
            step = step + (F.col(f"x{j}") > cut).cast("int")
        return F.when(F.col(f"x{j}").isNotNull(), step.cast("string")).otherwise("-")

    cell = F.concat_ws("|", *[bin_of(j) for j in range(d)])
    donors = donors.withColumn("cell", cell)
    boxes = donors.groupBy("cell").agg(
        F.sum("w").alias("w"),
        F.count(F.lit(1)).alias("n"),
        *[F.min(x).alias(f"lo{j}") for j, x in enumerate(xs)],
        *[F.max(x).alias(f"hi{j}") for j, x in enumerate(xs)],
    )
    # With very many missing patterns the directory would not be small: then nothing is pruned
    # and the blocks alone bound the work per task.
    loose = boxes.limit(MAX_DIRECTORY + 1).count() > MAX_DIRECTORY
    if loose:
        donors = donors.withColumn("cell", F.lit("all"))
        boxes = donors.groupBy("cell").agg(
            F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"),
            *[F.min(x).alias(f"lo{j}") for j, x in enumerate(xs)],
            *[F.max(x).alias(f"hi{j}") for j, x in enumerate(xs)],
        )
    directory = boxes.toPandas()
    lo = directory[[f"lo{j}" for j in range(d)]].to_numpy(dtype=float)
    hi = directory[[f"hi{j}" for j in range(d)]].to_numpy(dtype=float)
    names, cell_w = directory["cell"].tolist(), directory["w"].to_numpy(dtype=float)
    blocks = np.array([max(1, -(-int(n) // BLOCK_ROWS)) for n in directory["n"]])

    gaps = F.array_compact(F.array(*[F.when(F.col(x).isNull(), F.lit(j)) for j, x in enumerate(xs)]))
    queries = settle(vec.where(F.size(gaps) > 0).distinct().withColumn("id", F.monotonically_increasing_id()))
    n_queries = queries.count()
    n_slices = max(1, -(-n_queries // (4 * BLOCK_ROWS)))
    wanted = queries.repartition(max(1, -(-n_queries // BLOCK_ROWS))).select("id", *xs, F.explode(gaps).alias("target"))
    visit_schema = "id long, " + ", ".join(f"{x} double" for x in xs) + ", target int, cell int, block int, slice int"
    step = max(1, ROUTED // max(1, len(names)))

    def route(batches):
        for pdf in batches:
            for start in range(0, len(pdf), step):
                part = pdf.iloc[start : start + step]
                x = part[xs].to_numpy(dtype=float)
                near, far = _gap_bounds(x, ~np.isnan(x), lo, hi, d)
                if loose:
                    near, far = np.zeros_like(near), np.full_like(far, np.inf)
                usable = ~np.isnan(far) & ~np.isnan(lo[:, part["target"].to_numpy()]).T
                by_far = np.argsort(np.where(usable, far, np.inf), axis=1, kind="stable")
                weight = np.take_along_axis(usable * cell_w, by_far, axis=1)
                first = np.empty_like(usable)
                np.put_along_axis(first, by_far, np.cumsum(weight, axis=1) - weight < k, axis=1)
                if "reach" in part:
                    reach = part["reach"].fillna(np.inf).to_numpy(dtype=float)[:, None]
                    row, cell = np.nonzero(usable & ~first & (near <= reach * (1 + 1e-9)))
                else:
                    row, cell = np.nonzero(usable & first)
                times = blocks[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                out = part.iloc[row][["id", *xs, "target"]].reset_index(drop=True)
                out["cell"] = cell
                out["block"] = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
                out["slice"] = pd.util.hash_array(out["id"].to_numpy()) % n_slices
                yield out

    block_of = spark.createDataFrame(
        [(n, i, int(b)) for i, (n, b) in enumerate(zip(names, blocks))], "cell string, d_cell int, blocks int"
    )
    placed = donors.join(F.broadcast(block_of), "cell").drop("cell").withColumn(
        "d_block", F.pmod(F.xxhash64(*xs), F.col("blocks")).cast("int")
    )
    hit_schema = "id long, target int, dist double, value double, w long"

    def search(q: pd.DataFrame, don: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(don):
            dx, w = don[xs].to_numpy(dtype=float), don["w"].to_numpy(dtype=float)
            for t, part in q.groupby("target"):
                has = ~np.isnan(dx[:, t])
                pool, pw = dx[has], w[has]
                qx, ids = part[xs].to_numpy(dtype=float), part["id"].tolist()
                for start in range(0, len(qx), 256):
                    found = _block_nearest(qx[start : start + 256], pool, pool[:, t], pw, k)
                    for key, (order, dist) in zip(ids[start:], found):
                        out += [(key, int(t), float(e), float(pool[o, t]), int(pw[o])) for o, e in zip(order, dist)]
        return pd.DataFrame(out, columns=["id", "target", "dist", "value", "w"])

    def hits(rows: DataFrame) -> DataFrame:
        visits = settle(rows.mapInPandas(route, visit_schema))
        # A donor block is copied once per query slice that visits it, so both sides of a group
        # stay bounded.
        slices = visits.select(F.col("cell").alias("d_cell"), F.col("block").alias("d_block"), F.col("slice").alias("d_slice")).distinct()
        pool = placed.join(slices, ["d_cell", "d_block"]).select(*xs, "w", "d_cell", "d_block", "d_slice")
        return settle(
            visits.groupBy("cell", "block", "slice")
            .cogroup(pool.groupBy("d_cell", "d_block", "d_slice"))
            .applyInPandas(search, hit_schema)
        )

    nearest_first = W.partitionBy("id", "target").orderBy("dist", "value").rowsBetween(W.unboundedPreceding, 0)

    def ranked(rows: DataFrame) -> DataFrame:
        merged = rows.groupBy("id", "target", "dist", "value").agg(F.sum("w").alias("w"))
        return merged.withColumn("upto", F.sum("w").over(nearest_first))

    close = hits(wanted)
    reach = ranked(close).where(F.col("upto") >= k).groupBy("id", "target").agg(F.min("dist").alias("reach"))
    other = hits(wanted.join(reach, ["id", "target"], "left"))
    used = (
        ranked(close.unionByName(other))
        .withColumn("before", F.col("upto") - F.col("w"))
        .where(F.col("before") < k)
        .withColumn("take", F.least(F.col("w"), F.lit(k) - F.col("before")))
    )
    filled = used.groupBy("id").agg(
        *[
            (
                F.sum(F.when(F.col("target") == j, F.col("value") * F.col("take")))
                / F.sum(F.when(F.col("target") == j, F.col("take")))
            ).alias(f"f{j}")
            for j in range(d)
        ]
    )
    fills = queries.join(filled, "id").drop("id")
    gap = reduce(or_, [F.col(quoted(c)).isNull() for c in columns])
    same = reduce(and_, [F.col(quoted(c)).eqNullSafe(F.col(x)) for c, x in zip(columns, xs)])
    joined = base.where(gap).join(fills, same, "left").withColumns(
        {
            c: F.coalesce(F.col(quoted(c)), F.col(f"f{j}"), F.lit(means[f"m{j}"]).cast(T.DoubleType()))
            for j, c in enumerate(columns)
        }
    )
    out = [F.col(quoted(c)) for c in df.columns]
    return joined.select(out).unionByName(base.where(~gap).select(out))
