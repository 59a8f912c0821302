"""Merkle manifest of a dataset: leaves, subtrees, roots, proofs and their verification, by cogrouped subtree exchange.

Every group (a language, say) has a tree over its leaves in order; the roots of the groups, in order, are the leaves of one more tree.
A node is the hash of up to ``fanout`` consecutive nodes below; a level is built while several nodes remain.

1. Leaves are hashed in the scan and laid out in key ranges; a table with one row per range and group turns places in a range into
   places in the group.
2. Upwards: ``fanout ** LEVELS`` consecutive nodes are a superblock, reduced in one task to one node. Superblock nodes are the nodes of the
   next stage, so every stage is ``fanout ** LEVELS`` times smaller, and after two or three of them each group has one root.
3. Downwards: the nodes of a stage and what lies outside of them, the siblings on the way from their superblock to the root, are cogrouped
   by superblock. The group finishes the local reduction, joins local siblings and outer ones to whole proofs and, for leaves, folds
   the leaves presented for verification up to a root.

A superblock has a bounded number of rows and its outer nodes are one row, so neither a large group nor many groups make a large task. Nothing is
collected: the driver sees the number of stages.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import ascii_lower
from lumenframe.operators.order import lay_out
from lumenframe.session import settle

FANOUT = 8
#: Levels that one task reduces: a superblock has FANOUT ** LEVELS nodes.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value in a form that no other value has: ``-`` for null, else the number of its UTF-8 bytes, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """Hash of a row's values in order, as lower-case hex."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(nodes: list[str], total: int, fanout: int, levels: int) -> list[list[str]]:
    """The nodes of a superblock level by level, the topmost (one node) last, of a tree with ``total`` nodes in this stage."""
    out = [nodes]
    while total > 1 and len(out) <= levels:
        nodes = [_digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        out.append(nodes)
        total = -(-total // fanout)
    return out


def _stage_up(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """One node per superblock: ``tree, place, hash, total`` of the next stage."""
    size = fanout**levels

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        total = int(rows["total"].iloc[0])
        top = _levels(rows["hash"].tolist(), total, fanout, levels)[-1]
        return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "hash": top, "total": [-(-total // size)]})

    blocks = nodes.select("tree", "place", "hash", "total", F.floor(F.col("place") / size).cast("long").alias("block"))
    return blocks.groupBy("tree", "block").applyInPandas(reduce, "tree string, place long, hash string, total long")


def _upwards(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The stages above ``nodes`` (``tree, place, hash, total``), at least one; in the last every tree has one node."""
    stages = []
    while True:
        nodes = settle(_stage_up(nodes, fanout, levels))
        stages.append(nodes)
        if (nodes.agg(F.max("total")).first()[0] or 1) <= 1:
            return stages


_PATH = ("outer_places", "outer_siblings")


def _stage_down(nodes: DataFrame, outer: DataFrame, fanout: int, levels: int, presented: str | None = None) -> DataFrame:
    """Whole paths of the nodes of a stage from the paths of their superblocks.

    ``outer`` has ``tree, place`` of a superblock, its path and columns that its nodes take over. Per node: its columns but ``total``,
    ``outer_places`` and ``outer_siblings``, one element per level, and the columns taken over. With ``presented``, a column of hashes,
    also ``folded_root``, the root that the presented hash leads to.
    """
    size = fanout**levels
    width = 64  # hex digits of a hash
    own = [c for c in nodes.columns if c not in ("tree", "total")]
    taken = [c for c in outer.columns if c not in ("tree", "place", "hash", *_PATH)]
    kinds = {f.name: f.dataType.simpleString() for f in [*outer.schema, *nodes.schema]}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["tree", *own, *_PATH, *taken]) + (", folded_root string" if presented else "")

    def finish(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        up = above.iloc[0]
        local = _levels(rows["hash"].tolist(), int(rows["total"].iloc[0]), fanout, levels)[:-1]
        # From the top down: nodes below share what lies above them.
        paths = [([int(x) for x in up["outer_places"]], list(up["outer_siblings"]))]
        for level in reversed(local):
            runs = ["".join(level[i : i + fanout]) for i in range(0, len(level), fanout)]
            below = []
            for i in range(len(level)):
                at, run = i % fanout, runs[i // fanout]
                places, siblings = paths[i // fanout]
                below.append(([at, *places], [run[: at * width] + run[(at + 1) * width :], *siblings]))
            paths = below
        out = rows[["tree", *own]].copy()
        out["outer_places"], out["outer_siblings"] = [p for p, _ in paths], [s for _, s in paths]
        for c in taken:
            out[c] = up[c]
        if presented:
            out["folded_root"] = [fold(h, p, s) for h, (p, s) in zip(rows[presented], paths)]
        return out

    block = F.floor(F.col("place") / size).cast("long")
    left = nodes.withColumn("block", block).groupBy("tree", "block")
    right = outer.withColumnRenamed("place", "block").groupBy("tree", "block")
    return left.cogroup(right).applyInPandas(finish, schema)


def fold(own: str, places: list[int], siblings: list[str]) -> str:
    """The root that a leaf leads to: level by level it is put in its place among its siblings and hashed with them."""
    for place, others in zip(places, siblings):
        cut = place * len(own)
        own = _digest(others[:cut] + own + others[cut:])
    return own


def _place_in_group(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``tree`` (number of the group), ``place`` in the group's order and ``total``, the group's rows."""
    laid = lay_out(rows, [group, *order])
    inside = Window.partitionBy("_bucket", group).orderBy(*order, "_tie")
    parts = laid.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("__n"))
    # One row per range and group.
    each = Window.partitionBy(group)
    parts = parts.select(
        F.col(group).alias("__group"),
        F.col("_bucket").alias("__bucket"),
        (F.sum("__n").over(each.orderBy("_bucket")) - F.col("__n")).alias("__before"),
        F.sum("__n").over(each).alias("total"),
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
    )
    placed = laid.withColumn("__nth", F.row_number().over(inside) - 1)
    joined = placed.join(parts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("_bucket") == F.col("__bucket")))
    joined = joined.withColumn("place", (F.col("__nth") + F.col("__before")).cast("long"))
    return joined.drop("_bucket", "_tie", "__nth", "__before", "__group", "__bucket")


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_column: str = "doc_id", group: str = "lang", presented: Column | None = None,
    fanout: int = FANOUT, levels: int = LEVELS,
) -> DataFrame:
    """Per row: ``id_column, group, leaf, subroot, root, places, siblings, folded_root, verified``.

    ``leaf`` hashes the ``fields`` in order. Leaves of a group ascend by id (null first), then by leaf: repeated rows are leaves each.
    A null group is a group of its own and the first one; groups ascend by UTF-8 bytes. ``places`` and ``siblings`` are the proof, level by
    level from the leaf to the root: the place among the run's nodes and the hashes of the others, concatenated. ``presented`` is the
    leaf to verify, the row's own by default; ``folded_root`` is the root it leads to, and ``verified`` says whether that is the root.
    Columns besides the fields are ignored; an empty table has no rows and no root.
    """
    own = leaf([F.col(c) for c in fields])
    presented = own if presented is None else presented
    rows = settle(docs.select(F.col(id_column).alias("__id"), F.col(group).alias("__key"), own.alias("hash"), presented.alias("__presented")))
    leaves = settle(_place_in_group(rows, "__key", ["__id", "hash"]))
    stages = _upwards(leaves.select("tree", "place", "hash", "total"), fanout, levels)

    # The tree over the groups' roots.
    keys = leaves.where("place = 0").select(F.col("tree").alias("__tree"), "__key")
    roots = stages[-1].select(F.col("tree").alias("__tree"), "hash").join(keys, "__tree").withColumn("__all", F.lit(0))
    roots = settle(_place_in_group(roots, "__all", ["__key"]).select("tree", "place", "hash", "total", "__tree"))
    top = _upwards(roots.drop("__tree"), fanout, levels)
    none = [F.array().cast("array<int>").alias(_PATH[0]), F.array().cast("array<string>").alias(_PATH[1])]
    path = top[-1].select("tree", "place", *none, F.col("hash").alias("root"))
    for nodes in [*reversed(top[:-1]), roots]:
        path = settle(_stage_down(nodes, path, fanout, levels))
    path = path.select(F.col("__tree").alias("tree"), F.lit(0).cast("long").alias("place"), *_PATH, F.col("hash").alias("subroot"), "root")

    # Down through the stages of the groups.
    for nodes in reversed(stages[:-1]):
        path = settle(_stage_down(nodes, path, fanout, levels))
    finished = _stage_down(leaves, path, fanout, levels, "__presented")
    return finished.select(
        F.col("__id").alias(id_column),
        F.col("__key").alias(group),
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        F.col("outer_places").alias("places"),
        F.col("outer_siblings").alias("siblings"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def lowered(fields: tuple[str, ...] = FIELDS, text: str = "text") -> Column:
    """The leaf of a row whose text was tampered with: its A-Z lower-cased."""
    return leaf([ascii_lower(F.col(c)) if c == text else F.col(c) for c in fields])
