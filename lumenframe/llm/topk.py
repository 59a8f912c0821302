"""Exact top-k search by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. Sorted by that key, the table falls into blocks: a
bounded number of vectors of one pivot whose distances span an annulus. By the triangle inequality a vector at distance r
from pivot p is at least ``|d(q, p) - r|`` from a query q, and since ``2 q.v = |q|^2 + |v|^2 - d(q, v)^2``, a block has
an upper bound on its scores. Search:

1. A query first meets the block it lies in itself, which gives it a k-th best score.
2. Per pivot, that score leaves an interval of distances; only blocks that reach into it are joined.
3. Queries travel in blocks too. A block of queries takes its blocks in the order of the gap to their
   annuli, raising the k-th best scores, and stops when no later annulus can hold a better vector.

The table is sorted by (pivot, distance, row), so a pivot that attracts a third of all rows, or a
vector that many rows share, is cut into blocks like any other. Bounds are floating-point with slack; scores are exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.session import settle

PIVOTS = 32
BLOCK_ROWS = 2048
QUERY_ROWS = 1024
#: Blocks that one block of queries meets in one task.
SLICE = 32

_BLOCK = (
    "block long, pivot int, r_min double, r_max double, norm2 double, n int, row_ids binary, ids binary, vectors binary, "
    "query_at binary"
)
_QUERY = "row_id long, id long, pivot int, dist double, vector binary, tau double, own long, best_ids binary, best_scores binary"


def valid(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector.cast("array<double>"), finite)


def scaled(vector: Column, factor: int = 256) -> Column:
    """``floor(factor * x)`` of each component, computed in double precision."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(factor))).cast("long"))


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``dim``."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return values.reshape(-1, dim).astype(np.int64)
    out = np.zeros((len(sizes), dim), dtype=np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _products(a: np.ndarray, b: np.ndarray, exact_in_double: bool) -> np.ndarray:
    """Integer inner products of all rows; beyond double precision by Python integers, held at the ends of 64 bits."""
    if exact_in_double:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def _leading(scores: np.ndarray, usable: np.ndarray, ids: np.ndarray, tau: np.ndarray, k: int):
    """(row, column) of each row's k best usable scores that reach ``tau``, best first, ties to the smaller id."""
    floor = np.iinfo(np.int64).min
    held = np.where(usable, scores, floor)
    if held.shape[1] > k:
        least = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
    else:
        least = np.full(len(held), floor)
    r, c = np.nonzero(usable & (held >= least[:, None]) & (held >= tau[:, None]))
    order = np.lexsort((ids[c], -held[r, c].astype(np.float64), r)) if len(r) else np.array([], dtype=int)
    r, c = r[order], c[order]
    first = np.searchsorted(r, r)
    keep = np.arange(len(r)) - first < k
    return r[keep], c[keep]


def top_k(
    rows: DataFrame, id_column: str, vector: Column, is_query: Column, k: int = 5, pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """For each query row its k best other rows: ``query_id, rank, <id_column>, score``.

    * ``vector`` is an array of integers; rows where it is null take no part. Shorter vectors count as padded
      with zeros. ``id_column`` is an integer; rows with a null id take no part.
    * A row is not its own candidate, but rows that repeat it, or its id, are. A query row that occurs twice is answered twice.
    * Fewer than k other rows give fewer rows; an empty table, or one without queries, gives none.
    * Other columns are ignored.
    """
    base = rows.select(F.col(id_column).cast("long").alias("id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    base = base.where("id is not null and vector is not null").withColumn("row_id", F.monotonically_increasing_id())
    base = settle(base)
    spark = base.sparkSession
    size = base.agg(
        F.max(F.size("vector")).alias("dim"),
        F.max(F.greatest(F.array_max("vector"), -F.array_min("vector"))).alias("top"),
        F.count_if("asks").alias("queries"),
    ).first()
    result = f"query_id long, rank int, `{id_column}` long, score long"
    if not size["queries"]:
        return spark.createDataFrame([], result)
    dim, top, asked = max(1, size["dim"]), int(size["top"] or 0), size["queries"]
    small = dim * top * top < 1 << 53
    store = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"

    # A bounded sample, picked by hash, becomes the pivots.
    picked = base.orderBy(F.xxhash64("id", "vector"), "id").limit(pivots).select("vector").collect()
    centres = np.zeros((len(picked), dim))
    for i, r in enumerate(picked):
        centres[i, : len(r["vector"])] = r["vector"]

    def distances(points: np.ndarray) -> np.ndarray:
        p = points.astype(np.float64)
        d2 = (p**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * (p @ centres.T)
        return np.sqrt(np.maximum(d2, 0))

    def key(batches):
        for batch in batches:
            points = _matrix(batch.column(1), dim)
            d = distances(points)
            near = d.argmin(axis=1).astype(np.int32)
            data = [p.tobytes() for p in points.astype(store)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), batch.column(2), pa.array(near), pa.array(d[np.arange(len(d)), near]), pa.array(data, pa.binary())],
                names=["id", "row_id", "asks", "pivot", "dist", "vector"],
            )

    keyed = base.select("id", "vector", "asks", "row_id").mapInArrow(
        key, "id long, row_id long, asks boolean, pivot int, dist double, vector binary"
    )
    order = ["pivot", "dist", "row_id"]

    def pack(batches):
        """Consecutive rows of one pivot become blocks."""
        names, held, number = ["id", "row_id", "asks", "pivot", "dist", "vector"], [], 0
        part = TaskContext.get().partitionId()

        def block(rows):
            nonlocal number
            ids, row_ids, asks, pivot, dist, data = (list(c) for c in zip(*rows))
            points = np.frombuffer(b"".join(data), dtype=store).reshape(-1, dim).astype(np.float64)
            number += 1
            return ((part << 32) + number, pivot[0], min(dist), max(dist), float((points**2).sum(1).max()), len(rows),
                    np.array(row_ids, "<i8").tobytes(), np.array(ids, "<i8").tobytes(), b"".join(data),
                    np.nonzero(asks)[0].astype("<i4").tobytes())

        def out(rows):
            return pa.RecordBatch.from_pylist([dict(zip(fields, block(rows)))], schema=schema)

        fields = [f.split()[0] for f in _BLOCK.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _BLOCK.split(", ")])
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)):
                if held and (row[3] != held[0][3] or len(held) >= block_rows):
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    blocks = settle(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, _BLOCK))

    def arrays(b: dict):
        return (np.frombuffer(b["row_ids"], "<i8"), np.frombuffer(b["ids"], "<i8"),
                np.frombuffer(b["vectors"], store).reshape(-1, dim).astype(np.int64))

    def seed(batches):
        """Queries of a block with their best k inside it."""
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _QUERY.split(", ")])
        for batch in batches:
            for b in batch.to_pylist():
                row_ids, ids, points = arrays(b)
                at = np.frombuffer(b["query_at"], "<i4")
                for part in range(0, len(at), 256):
                    own = at[part : part + 256]
                    scores = _products(points[own], points, small)
                    usable = np.ones(scores.shape, dtype=bool)
                    usable[np.arange(len(own)), own] = False
                    r, c = _leading(scores, usable, ids, np.full(len(own), -np.inf), k)
                    dist = distances(points[own])
                    near = dist[:, b["pivot"]]
                    found = []
                    for i, q in enumerate(own):
                        mine = c[r == i]
                        found.append((row_ids[q], ids[q], b["pivot"], near[i], points[q].astype(store).tobytes(),
                                      float(scores[i, mine[-1]]) if len(mine) == k else -np.inf, b["block"],
                                      ids[mine].tobytes(), scores[i, mine].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*found), schema.types)], schema=schema)

    asking = settle(blocks.where(F.octet_length("query_at") > 0).mapInArrow(seed, _QUERY))

    def gather(batches):
        """Queries, sorted like the index, in blocks."""
        part, number, held = TaskContext.get().partitionId(), 0, []

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number], pa.int64()), *(pa.array([c], pa.list_(t)) for c, t in zip(zip(*held), kinds))],
                names=["query_block", *names],
            )

        names = ["row_id", "id", "vector", "tau", "own"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.int64()]
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)):
                held.append(row)
                if len(held) >= query_rows:
                    yield out()
                    number, held = number + 1, []
        if held:
            yield out()

    shape = "query_block long, row_id array<long>, id array<long>, vector array<binary>, tau array<double>, own array<long>"
    groups = -(-asked // query_rows)
    query_blocks = settle(asking.repartitionByRange(groups, *order).sortWithinPartitions(*order).mapInArrow(gather, shape))

    reach = blocks.groupBy("pivot").agg(F.max("norm2").alias("norm2"))
    widest = {r["pivot"]: r["norm2"] for r in reach.collect()}  # one row per pivot

    def intervals(batches):
        """Per pivot the distances at which some query of the block may still find a better vector."""
        for batch in batches:
            rows_out = []
            for b in batch.to_pylist():
                q = np.frombuffer(b"".join(b["vector"]), store).reshape(-1, dim)
                d, q2, tau = distances(q), (q.astype(np.float64) ** 2).sum(1), np.array(b["tau"])
                for p, m2 in widest.items():
                    wide = (q2 + m2) * (1 + 1e-9) + 1 - 2 * tau
                    s = np.sqrt(np.maximum(wide, 0))
                    some = wide >= 0
                    if some.any():
                        rows_out.append((b["query_block"], p, float((d[some, p] - s[some]).min()), float((d[some, p] + s[some]).max()),
                                         float(d[some, p].min()), float(d[some, p].max())))
            if rows_out:
                kinds = [pa.int64(), pa.int32(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows_out), kinds)], names=["query_block", "pivot", "lo", "hi", "d_min", "d_max"]
                )

    wanted = query_blocks.mapInArrow(intervals, "query_block long, pivot int, lo double, hi double, d_min double, d_max double")
    annuli = blocks.select("block", "pivot", "r_min", "r_max")
    pairs = wanted.join(annuli, "pivot").where("r_max >= lo and r_min <= hi")
    gap = F.greatest(F.lit(0.0), F.col("r_min") - F.col("d_max"), F.col("d_min") - F.col("r_max"))
    pairs = pairs.select("query_block", "block", gap.alias("gap"))
    nth = F.row_number().over(Window.partitionBy("query_block").orderBy("gap", "block")) - 1
    pairs = settle(pairs.withColumn("slice", F.floor(nth / SLICE)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """One block of queries against up to ``SLICE`` blocks, nearest annulus first."""
        b = left.to_pylist()[0] if left.num_rows else None
        out = ([], [], [], [])
        if b is not None:
            query_rows_, query_ids = np.array(b["row_id"]), np.array(b["id"])
            q = np.frombuffer(b"".join(b["vector"]), store).reshape(-1, dim).astype(np.int64)
            q2, d, tau, own = (q.astype(np.float64) ** 2).sum(1), distances(q), np.array(b["tau"]), np.array(b["own"])
            best = np.full((len(q), k), -np.inf)
            for t in sorted(right.to_pylist(), key=lambda t: (t["gap"], t["block"])):
                outermost = (q2 + max(widest.values()) - t["gap"] ** 2) / 2 * (1 + 1e-9) + 1
                if (outermost < tau).all():
                    break  # all later annuli are farther still
                apart = np.maximum(0, np.maximum(t["r_min"] - d[:, t["pivot"]], d[:, t["pivot"]] - t["r_max"]))
                ahead = ((q2 + t["norm2"] - apart**2) / 2 * (1 + 1e-9) + 1 >= tau) & (own != t["block"])
                at = np.nonzero(ahead)[0]
                if not len(at):
                    continue
                _, ids, points = arrays(t)
                scores = _products(q[at], points, small)
                r, c = _leading(scores, np.ones(scores.shape, dtype=bool), ids, tau[at], k)
                out[0].append(query_rows_[at[r]])
                out[1].append(query_ids[at[r]])
                out[2].append(ids[c])
                out[3].append(scores[r, c])
                fresh = np.full((len(at), k), -np.inf)
                fresh[r, np.arange(len(r)) - np.searchsorted(r, r)] = scores[r, c]
                best[at] = -np.sort(-np.concatenate([best[at], fresh], axis=1), axis=1)[:, :k]
                tau = np.maximum(tau, best[:, k - 1])
        columns = [np.concatenate(o) if o else np.array([], dtype=np.int64) for o in out]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["row_id", "query_id", "id", "score"])

    slices = pairs.groupBy(F.col("query_block").alias("for_block"), F.col("slice").alias("for_slice")).agg(F.lit(1).alias("one"))
    slices = slices.join(query_blocks, F.col("for_block") == F.col("query_block")).drop("one", "query_block")
    work = pairs.join(blocks.drop("query_at"), "block")
    found = slices.groupBy("for_block", "for_slice").cogroup(work.groupBy("query_block", "slice")).applyInArrow(
        search, "row_id long, query_id long, id long, score long"
    )

    def seeds(batches):
        for batch in batches:
            for b in batch.to_pylist():
                ids, scores = np.frombuffer(b["best_ids"], "<i8"), np.frombuffer(b["best_scores"], "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["row_id"]] * len(ids), pa.int64()), pa.array([b["id"]] * len(ids), pa.int64()), pa.array(ids), pa.array(scores)],
                    names=["row_id", "query_id", "id", "score"],
                )

    own_best = asking.mapInArrow(seeds, "row_id long, query_id long, id long, score long")
    ranked = Window.partitionBy("row_id").orderBy(F.desc("score"), "id")
    return (
        found.unionByName(own_best)
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_column), "score")
    )
