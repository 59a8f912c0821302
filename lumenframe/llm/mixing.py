"""Mixing overlapping sources to target weights by a minimum-cost flow.

1. Documents are aggregated by membership pattern, the sorted set of sources they belong to. What
   reaches the driver is one row per pattern.
2. Source quotas come from weights by water-filling: a share of all words by weight, stopped at
   ``max_repeats`` times the source's size, the excess shared again among the rest.
3. A flow routes word capacity from patterns to source quotas. The r-th pass over a pattern is an
   arc of its own with a higher price than the pass before (convex costs), so the cheapest flow
   repeats as little as it can, and repeats evenly.
4. Whole passes go to every document of a pattern. The rest of a pattern's words goes to documents
   in seeded hash order, found through sums by hash bucket; only the bucket in which the rest ends is
   ordered document by document. The gap to the document that overshoots is closed in the same way, from the unused documents that
   fit in it, until none does.

Documents are never collected; a source that holds a third of all rows is cut by hash buckets.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import WORD
from lumenframe.session import settle

#: Hash buckets of a pattern; the last, partial pass is settled inside one of them.
BUCKETS = 4096
#: The seeded order of documents, with types.
CUT = {"bucket": "int", "hash": "long", "size": "long", "tie": "long", "row": "long"}


class Mix(NamedTuple):
    """What the mix takes of each document, and the words and quota of each source."""

    rows: DataFrame
    sizes: dict
    targets: dict

    def source_table(self) -> DataFrame:
        """One row per source: ``source``, ``source_size``, ``target``."""
        rows = [(s, int(n), float(self.targets[s])) for s, n in self.sizes.items()]
        return self.rows.sparkSession.createDataFrame(rows, "source string, source_size long, target double")


def count_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quotas(sizes: dict, weights: dict, max_repeats: int = 3, total: float | None = None) -> dict:
    """Words wanted of each source: shares of ``total`` by weight, none above ``max_repeats`` times its size."""
    left = float(sum(sizes.values()) if total is None else total)
    wanted: dict = {s: 0.0 for s in sizes}
    free = {s for s in sizes if weights[s] > 0 and sizes[s] > 0}
    while free and left > 0:
        unit = left / sum(weights[s] for s in free)
        full = {s for s in free if weights[s] * unit > max_repeats * sizes[s]}
        if not full:
            wanted.update({s: weights[s] * unit for s in free})
            break
        for s in full:
            wanted[s] = float(max_repeats * sizes[s])
            left -= wanted[s]
        free -= full
    return wanted


def min_cost_flow(supply: dict, members: dict, wanted: dict, prices: list[int]) -> dict:
    """Words of each pattern that go to each source: ``{(pattern, source): words}``.

    ``supply``: words of one pass over a pattern. ``members``: its sources. ``prices``: price of a
    word in the first, second, ... pass, ascending. Cheapest augmenting paths first: a path starts with
    the cheapest open pass of some pattern and may reroute words that already flow. All arcs but the
    passes are free, so a search per price level suffices.
    """
    flow: dict = defaultdict(int)
    need = dict(wanted)
    givers = defaultdict(set)  # source -> patterns that send words there
    taken = {p: 0 for p in supply}

    def augment(start) -> bool:
        """Send words from pattern ``start`` to a source with an open quota, by the fewest reroutings."""
        back: dict = {("p", start): None}
        queue = [(0, 0, ("p", start))]
        count = 0
        while queue:
            depth, _, node = heapq.heappop(queue)
            if node[0] == "s" and need[node[1]] > 0:
                path = [node]
                while back[path[-1]] is not None:
                    path.append(back[path[-1]])
                path.reverse()
                amount = min(need[node[1]], level[start] - taken[start])
                for a, b in zip(path, path[1:]):
                    if a[0] == "s":
                        amount = min(amount, flow[b[1], a[1]])
                for a, b in zip(path, path[1:]):
                    if a[0] == "p":
                        flow[a[1], b[1]] += amount
                        givers[b[1]].add(a[1])
                    else:
                        flow[b[1], a[1]] -= amount
                        if not flow[b[1], a[1]]:
                            givers[a[1]].discard(b[1])
                need[node[1]] -= amount
                taken[start] += amount
                return True
            if node[0] == "p":
                near = [("s", s) for s in members[node[1]]]
            else:
                near = [("p", p) for p in givers[node[1]]]
            for other in near:
                if other not in back:
                    back[other] = node
                    count += 1
                    heapq.heappush(queue, (depth + 1, count, other))
        return False

    for passes, _ in enumerate(sorted(prices), start=1):
        level = {p: passes * n for p, n in supply.items()}
        for p in sorted(supply, key=repr):
            while taken[p] < level[p] and augment(p):
                pass
    return {k: v for k, v in flow.items() if v}


def plan(patterns: list[tuple[list, int]], weights, max_repeats: int = 3) -> tuple[dict, dict, dict]:
    """Size and quota of each source, and the words to take of each pattern.

    ``patterns``: (sources, words). ``weights``: a function of the ordered list of sources.
    """
    members = {i: sources for i, (sources, _) in enumerate(patterns)}
    supply = {i: words for i, (_, words) in enumerate(patterns)}
    sizes: dict = defaultdict(int)
    for i, sources in members.items():
        for s in sources:
            sizes[s] += supply[i]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))  # by code point, null last
    total = sum(supply.values())
    wanted = quotas({s: sizes[s] for s in names}, weights(names), max_repeats, total)
    flow = min_cost_flow(supply, members, {s: round(w) for s, w in wanted.items()}, list(range(max_repeats)))
    taken: dict = defaultdict(int)
    for (p, _), words in flow.items():
        taken[p] += words
    return dict(sizes), wanted, {p: taken[p] for p in supply}


def repeating_weights(names: list) -> dict:
    """1, 2, 3, 1, 2, 3, ... in the order of the sources."""
    return {s: 1 + i % 3 for i, s in enumerate(names)}


def mix(
    docs: DataFrame, members: Column, size: Column, id_column: str = "doc_id", keep: tuple[str, ...] = (),
    weights=repeating_weights, max_repeats: int = 3, seed: int = 17,
) -> Mix:
    """The mixture: ``rows`` has one row per document: its id, the ``keep`` columns, and how much of it the mix takes.

    Columns: ``id_column``, ``keep``, ``members`` (sorted array of its sources), ``size``,
    ``copies`` (how often the whole document is taken, at most ``max_repeats``) and ``taken`` = size * copies.

    * ``members`` is an array of source names; a null array or null name counts as the source null.
    * ``size`` is a count of words, null counting as 0. A document of size 0 is never taken.
    * Whole documents are taken in the partial pass of a pattern: those inside the rest in seeded order, then
      unused ones that fit into the gap that is left, in seeded order until none fits, then the one nearest in size if that narrows the gap.
    * Order is by a seeded hash of the id, then id, size and kept columns. Rows equal in all of them are alike, so a
      rerun gives the same rows. Repeated rows are documents of their own.
    * An empty table gives an empty result. Columns not named are ignored, whatever they are called.
    * One row per pattern (distinct set of sources) reaches the driver, never documents.
    """
    sources = F.coalesce(members, F.array(F.lit(None).cast("string")))
    rows = docs.select(
        F.col(id_column).alias("__id"),
        *[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)],
        F.sort_array(F.array_distinct(sources), asc=False).alias("__members"),
        F.coalesce(size, F.lit(0)).cast("long").alias("__size"),
    )
    rows = rows.withColumn("__hash", F.xxhash64(F.lit(seed), "__id"))
    rows = rows.withColumn("__tie", F.xxhash64(*[f"__keep_{i}" for i in range(len(keep))]) if keep else F.lit(0))
    rows = rows.withColumn("__bucket", F.pmod(F.shiftright("__hash", 20), F.lit(BUCKETS)).cast("int"))
    rows = settle(rows.withColumn("__row", F.monotonically_increasing_id()))
    spark = rows.sparkSession

    # One row per pattern and hash bucket; the driver gets one row per pattern.
    by_bucket = rows.groupBy("__members", "__bucket").agg(F.sum("__size").alias("words"))
    by_bucket = settle(by_bucket)
    found = sorted(
        by_bucket.groupBy("__members").agg(F.sum("words").alias("words")).collect(),
        key=lambda r: [(s is None, s or "") for s in r[0]],
    )
    sizes, wanted, taken = plan([(list(r[0]), int(r[1])) for r in found], weights, max_repeats)

    passes = []
    for i, (sources_of, words) in enumerate(found):
        whole, rest = divmod(taken[i], int(words)) if words else (0, 0)
        passes.append((i, list(sources_of), int(whole), int(rest)))
    kinds = spark.createDataFrame(passes, "__pattern int, __members array<string>, whole int, rest long")
    kinds = F.broadcast(kinds)  # one row per pattern, made on the driver

    # Words of a pattern before each bucket: at most BUCKETS rows per window.
    order = Window.partitionBy("__members").orderBy("__bucket")
    before = by_bucket.withColumn("before", F.sum("words").over(order) - F.col("words"))
    edge = (
        before.join(kinds, _same_members(before, kinds))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select(kinds["__pattern"], F.col("__bucket").alias("edge"), (F.col("rest") - F.col("before")).alias("edge_rest"))
    )
    edge = {r["__pattern"]: (r["edge"], r["edge_rest"]) for r in edge.collect()}
    passes = [(*p, *edge.get(p[0], (0, 0))) for p in passes]
    kinds = spark.createDataFrame(
        passes, "__pattern int, __members array<string>, whole int, rest long, edge int, edge_rest long"
    )
    kinds = F.broadcast(kinds)
    placed = rows.join(kinds, _same_members(rows, kinds)).drop(kinds["__members"])

    # Documents of the edge buckets, one bucket per pattern, in seeded order.
    inside = Window.partitionBy("__pattern").orderBy("__hash", "__size", "__tie", "__row")
    at_edge = settle(
        placed.where(F.col("__bucket") == F.col("edge"))
        .withColumn("__until", F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__in", (F.col("__until") <= F.col("edge_rest")) & (F.col("__size") > 0))
        .drop("__until")
    )
    taken_there = F.sum(F.when(F.col("__in"), F.col("__size")).otherwise(0))
    gaps = {
        r["__pattern"]: r["gap"]
        for r in at_edge.groupBy("__pattern").agg((F.first("edge_rest") - taken_there).alias("gap")).collect()
    }
    # What the whole documents left open is filled from the documents not taken.
    key = F.struct(*[F.col(f"__{c}").cast(t).alias(c) for c, t in CUT.items()])
    thin = ["__pattern", "__bucket", "__row", "__size", "__hash", "__tie"]
    spare = settle(
        placed.where(F.col("__bucket") > F.col("edge")).select(*thin)
        .unionByName(at_edge.where(~F.col("__in")).select(*thin))
        .join(F.broadcast(spark.createDataFrame(list(gaps.items()), "__pattern int, gap long")), "__pattern")
        .where((F.col("__size") > 0) & (F.col("__size") < 2 * F.col("gap"))).select(*thin)
    )
    fills = _fill(spare, key, gaps)
    filled = F.exists("fills", lambda f: (F.col("__size") <= f["limit"]) & (key < f["cut"])) | F.col("__row").eqNullSafe(F.col("last"))
    filled = F.coalesce(filled, F.lit(False))
    at_edge, placed = at_edge.join(fills, "__pattern", "left"), placed.join(fills, "__pattern", "left")
    columns = ["__id", *[f"__keep_{i}" for i in range(len(keep))], "__members", "__size", "whole"]
    settled = at_edge.select(*columns, (F.col("__in") | filled).cast("int").alias("extra"))
    others = placed.where(F.col("__bucket") != F.col("edge")).select(
        *columns, ((F.col("__bucket") < F.col("edge")) | filled).cast("int").alias("extra")
    )
    copies = F.when(F.col("__size") > 0, F.col("whole") + F.col("extra")).otherwise(0)
    out = others.unionByName(settled).select(
        F.col("__id").alias(id_column),
        *[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)],
        F.col("__members").alias("members"),
        F.col("__size").alias("size"),
        copies.alias("copies"),
        (F.col("__size") * copies).alias("taken"),
    )
    return Mix(out, sizes, wanted)


def _fill(spare: DataFrame, key: Column, gaps: dict) -> DataFrame:
    """One row per pattern, to broadcast: ``__pattern``, ``fills``, ``last``. Documents of ``spare`` close the gaps.

    A fill is the seeded order over again, over unused documents no longer than the gap and up to the first that overshoots it
    (``cut``). It takes one document at least and leaves a gap below the size of the one at its cut, so the number of fills grows
    with the logarithm of the gap. When no unused document fits, ``last`` is the one nearest in size if it narrows the gap.
    The driver gets one row per pattern and fill.
    """
    spark, schema = spare.sparkSession, "__pattern int, fills array<struct<limit:long,cut:struct<" + ",".join(f"{c}:{t}" for c, t in CUT.items()) + ">>>"
    gaps = {p: int(g) for p, g in gaps.items()}
    fills: dict = {p: [] for p in gaps}

    def unused(patterns: set) -> DataFrame:
        known = F.broadcast(spark.createDataFrame([(p, fills[p], gaps[p]) for p in patterns], schema + ", gap long"))
        taken = F.exists("fills", lambda f: (F.col("__size") <= f["limit"]) & (key < f["cut"]))
        return spare.join(known, "__pattern").where(~taken).drop("fills")

    going = {p for p, g in gaps.items() if g > 0}
    while going:
        fitting = unused(going).where(F.col("__size") <= F.col("gap"))
        order = Window.partitionBy("__pattern").orderBy("__bucket")
        sums = fitting.groupBy("__pattern", "__bucket", "gap").agg(F.sum("__size").alias("words"))
        sums = sums.withColumn("before", F.sum("words").over(order) - F.col("words")).where(F.col("before") <= F.col("gap"))
        # The last bucket that begins inside the gap; where it ends inside too, all fitting documents are taken.
        ends = sums.groupBy("__pattern").agg(F.max(F.struct("__bucket", "before", "words")).alias("end"))
        ends = {r["__pattern"]: r["end"] for r in ends.collect()}
        open_ends = [(p, e["__bucket"], e["before"]) for p, e in ends.items() if e["before"] + e["words"] > gaps[p]]
        cuts = {}
        if open_ends:
            edges = F.broadcast(spark.createDataFrame(open_ends, "__pattern int, __bucket int, before long"))
            inside = Window.partitionBy("__pattern").orderBy("__hash", "__size", "__tie", "__row")
            until = F.col("before") + F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
            over = fitting.join(edges, ["__pattern", "__bucket"]).withColumn("until", until).where(F.col("until") > F.col("gap"))
            first = over.groupBy("__pattern").agg(F.min(F.struct(key.alias("cut"), (F.col("until") - F.col("__size")).alias("taken"))).alias("first"))
            cuts = {r["__pattern"]: r["first"] for r in first.collect()}
        for p, e in ends.items():
            cut, taken = (cuts[p]["cut"], cuts[p]["taken"]) if p in cuts else ((BUCKETS, 0, 0, 0, 0), e["before"] + e["words"])
            fills[p].append((gaps[p], tuple(cut)))
            gaps[p] -= taken
        going = {p for p in cuts if gaps[p] > 0}

    last = {}
    going = {p for p, g in gaps.items() if g > 0}
    if going:
        off = F.abs(F.col("gap") - F.col("__size"))
        best = unused(going).where(off < F.col("gap")).groupBy("__pattern")
        best = best.agg(F.min(F.struct(off.alias("off"), "__hash", "__size", "__tie", "__row")).alias("best"))
        last = {r["__pattern"]: r["best"]["__row"] for r in best.collect()}
    return F.broadcast(spark.createDataFrame([(p, fills[p], last.get(p)) for p in gaps], schema + ", last long"))


def _same_members(left: DataFrame, right: DataFrame) -> Column:
    """Arrays as text: null names have no equality, so they get a mark of their own."""
    text = lambda c: F.to_json(c)
    return text(left["__members"]) == text(right["__members"])
