"""MinHash near-duplicates with tensored banding and exact verification.

Banding wants many tables keyed by several minhashes. Here two collections of ``side`` small keys, each of
``small`` minhashes, are computed per document, and table (i, j) is keyed by the pair (i-th key of the first, j-th key of the
second): ``side**2`` tables from ``2 * side * small`` minhashes. Two texts of similarity s miss each other
with chance ``2 * (1 - s**small)**side``, at most: 9e-5 at s = 0.8.

1. One pass per text computes the set of shingles, its size, a digest of the set, and the small keys. Equal sets
   are one class; only a representative of each goes on.
2. Small keys that occur once can't be part of a shared table key and go before the pairs are formed.
3. In each bucket every member is compared with the most typical one (that with the most bucket mates), never all with
   all. Verification is on full sets.
4. Links give components. A bucket whose members fell into one component is settled. Members of the others that are in
   different components meet through their rarest shingles: of two similar sets, the first ``n - ceil(0.8 n) + 1`` shingles in order of
   rarity share one, and so early that enough shingles are left behind it. This is exact. Both kinds of links give the final components.

Nothing is capped: a group of any size costs rows in proportion to it in step 3, and only pairs across components after that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import wordhash
from lumenframe.llm.common import WORD
from lumenframe.llm.components import components
from lumenframe.session import settle

SIDE = 14
SMALL = 3


def signatures(docs: DataFrame, key: str, text: str, width: int, side: int = SIDE, small: int = SMALL) -> DataFrame:
    """``key, n, digest, left_keys, right_keys`` per row; the keys are empty for an empty set."""

    def run(batches):
        multipliers = wordhash.seeds(2 * side * small, 101) | np.uint64(1)
        shifts = wordhash.seeds(2 * side * small, 202)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, group in wordhash.groups(texts):
                sets, offsets = wordhash.shingles(wordhash.words(group), width)
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                least = np.zeros((len(full), 2 * side * small), dtype=np.uint64)
                for k in range(2 * side * small if len(full) else 0):
                    hashed = (sets ^ shifts[k]) * multipliers[k]
                    hashed ^= hashed >> np.uint64(29)
                    least[:, k] = np.minimum.reduceat(hashed, offsets[:-1][full])
                digest = np.zeros((len(sizes), 2), dtype=np.uint64)
                if len(full):
                    digest[full, 0] = np.add.reduceat(wordhash.mix(sets ^ np.uint64(0xA5A5)), offsets[:-1][full])
                    digest[full, 1] = np.add.reduceat(wordhash.mix(sets + np.uint64(0x1234567)), offsets[:-1][full])
                weights = wordhash.seeds(small, 303) | np.uint64(1)
                keys = np.zeros((len(full), 2 * side), dtype=np.uint64)
                for j in range(small):
                    keys += least[:, j::small] * weights[j]
                keys = wordhash.mix(keys).view(np.int64)
                ends = np.zeros(len(sizes), dtype=np.int64)
                ends[full] = side
                limits = pa.array(np.concatenate(([0], np.cumsum(ends))).astype(np.int32))
                sides = [pa.ListArray.from_arrays(limits, pa.array(keys[:, s].ravel())) for s in (slice(0, side), slice(side, None))]
                packed = [d.tobytes() for d in digest]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(group)), pa.array(sizes), pa.array(packed, pa.binary()), *sides],
                    names=[key, "n", "digest", "left_keys", "right_keys"],
                )

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n long, digest binary, left_keys array<long>, right_keys array<long>"
    )


def similar(common: int, a: int, b: int, percent: int) -> bool:
    """100 * intersection >= percent * union."""
    return 100 * common >= percent * (a + b - common)


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose full shingle sets are similar. ``texts``: ``id, text``, one row per id."""

    def run(batches):
        names = ["a", "b", "text_a", "text_b"]
        for batch in batches:
            a, b, ta, tb = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)
            at, linked = 0, []
            while at < len(a):
                until, size = at, 0
                while until < len(a) and (until == at or size < 1 << 20):
                    size += len(ta[until]) + len(tb[until])
                    until += 1
                both = list(dict.fromkeys(ta[at:until] + tb[at:until]))
                index = {t: i for i, t in enumerate(both)}
                sets, offsets = wordhash.shingles(wordhash.words([t.encode("utf-8", "surrogatepass") for t in both]), width)
                of = [sets[offsets[i] : offsets[i + 1]] for i in range(len(both))]
                for i in range(at, until):
                    x, y = of[index[ta[i]]], of[index[tb[i]]]
                    if similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                        linked.append(i)
                at = until
            if linked:
                taken = pa.array(linked, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(n)).take(taken) for n in ("a", "b")], names=["a", "b"]
                )

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(two, "b").join(one, "a").mapInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near-duplicates, and all without words.

    Of a group's rows with its smallest id the one with the smallest text hash stays, once. Groups of null ids, or several under
    one id, are groups of their own. Columns pass through.
    """
    found = near_duplicates(docs, id_column, text, width, percent, with_hash=True).where("kept")
    own = found.where("n_shingles > 0").groupBy("component").agg(F.first("component_id").alias("__id"), F.min("text_hash").alias("__hash"))
    own = own.drop("component")
    hashed = docs.withColumn("__own", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(WORD)
    some = hashed.where(~wordless).join(own, F.col(id_column).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")))
    some = some.dropDuplicates(["__id", "__hash"])
    return some.select(*docs.columns).unionByName(docs.where(wordless))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 4, percent: int = 80, with_hash: bool = False,
) -> DataFrame:
    """Per row: ``id_column, n_shingles, component_id, kept``, and where asked for ``text_hash`` and ``component``.

    ``component_id`` is the smallest id among the rows reachable over links, ``kept`` whether the row has that id. Rows without
    words (or text) have an empty set, link with nothing and are kept. Rows that repeat an id are members of one component where
    their sets are similar, and each is kept if its component has its id. A row with a null id takes part; as null sorts last, a
    component of null ids only has component_id null, and such rows are kept. ``component`` is the component's own number, null without
    words; ids can be those of several components. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", F.struct("doc", F.xxhash64("text").alias("hash")))
    signed = settle(signatures(rows, "row_key", "text", width))
    # One class per distinct set; its number is that of the set's digest, its text that of any of its rows.
    found = signed.where("n > 0").withColumn("class", F.xxhash64("digest"))
    classes = settle(
        found.groupBy("class").agg(
            F.min("row_key.doc").alias("least"), F.first("n").alias("n"), F.min_by(F.col("row_key"), F.to_json("row_key")).alias("one"),
            F.first("left_keys").alias("left_keys"), F.first("right_keys").alias("right_keys"),
        )
    )

    def shared(side: str) -> DataFrame:
        """Small keys of one side that more than one class has, gathered per class."""
        each = classes.select("class", F.posexplode(side).alias("i", "key"))
        often = each.groupBy("i", "key").count().where("count > 1").select("i", "key")
        pair = F.struct("i", "key")
        return each.join(often, ["i", "key"]).groupBy("class").agg(F.collect_list(pair).alias(side))

    tensored = (
        shared("left_keys")
        .join(shared("right_keys"), "class")
        .select("class", F.explode("left_keys").alias("l"), "right_keys")
        .select("class", "l", F.explode("right_keys").alias("r"))
        .select("class", F.xxhash64("l", "r").alias("bucket"))
    )
    tensored = settle(tensored)
    buckets = tensored.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    crowded = settle(tensored.join(buckets, "bucket"))
    typical = crowded.groupBy("class").agg(F.sum("members").alias("mates"))
    hubs = crowded.join(typical, "class").groupBy("bucket").agg(F.max(F.struct("mates", "class"))["class"].alias("hub"))
    members = settle(crowded.join(hubs, "bucket"))
    sizes = classes.select(F.col("class"), F.col("n"))

    def comparable(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow similarity, each once."""
        a, b = sizes.select(F.col("class").alias("a"), F.col("n").alias("na")), sizes.select(F.col("class").alias("b"), F.col("n").alias("nb"))
        fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        return pairs.distinct().join(a, "a").join(b, "b").where(fits).select("a", "b")

    stars = settle(comparable(members.where("class <> hub").select(F.col("hub").alias("a"), F.col("class").alias("b"))))
    # Texts of the classes that are compared at all.
    compared = members.select("class").distinct()
    ones = classes.join(compared, "class").select("class", "one")
    texts = rows.join(ones, F.col("row_key").eqNullSafe(F.col("one"))).groupBy("class").agg(F.first("text").alias("text"))
    texts = settle(texts.select(F.col("class").alias("id"), "text"))
    links = settle(verify(stars, texts, width, percent))

    joined = components(links)
    labelled = members.join(joined.withColumnRenamed("node", "class"), "class", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "class"))
    # Buckets of several components where not every pair has met: three members or more.
    open_buckets = (
        labelled.where("members > 2").groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    )
    unsettled = labelled.join(open_buckets, "bucket").select("class", "component").distinct()
    rest = settle(_through_rare_shingles(unsettled, texts, width, percent))
    more = settle(verify(rest, texts, width, percent))
    final = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    component = classes.select("class", "least").join(final.withColumnRenamed("node", "class"), "class", "left")
    component = component.withColumn("component", F.coalesce("component", "class"))
    lowest = component.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = component.join(lowest, "component").select("class", "component_id", "component")
    out = (
        found.select("row_key", "n", "class").join(of_class, "class").select("row_key.doc", "row_key.hash", "n", "component_id", "component")
    )
    empty = signed.where("n = 0").select(
        "row_key.doc", "row_key.hash", "n", F.col("row_key.doc").alias("component_id"), F.lit(None).cast("long").alias("component")
    )
    return out.unionByName(empty).select(
        F.col("doc").alias(id_column),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"),
        *([F.col("hash").alias("text_hash"), F.col("component")] if with_hash else []),
    )


def _through_rare_shingles(many: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` of classes of different components that share one of their rarest shingles (exact prefix filter)."""

    def listed(batches):
        for batch in batches:
            ids, comps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, group in wordhash.groups(batch.column(2).to_pylist()):
                sets, offsets = wordhash.shingles(wordhash.words(group), width)
                n = np.diff(offsets)
                own = slice(first, first + len(group))
                for at in range(0, len(sets), 100_000):
                    part = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids[own], n)[part]), pa.array(np.repeat(comps[own], n)[part]), pa.array(sets[part].view(np.int64))],
                        names=["class", "component", "shingle"],
                    )

    each = many.join(texts.withColumnRenamed("id", "class"), "class").select("class", "component", "text")
    each = settle(each.mapInArrow(listed, "class long, component long, shingle long"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n_sets")).where("n_sets > 1")
    # Shingles of one set only come first in the order; they count, but find no partner.
    known = each.join(often, "shingle", "left").withColumn("n_sets", F.coalesce("n_sets", F.lit(1)))
    ranked = known.groupBy("class", "component").agg(F.array_sort(F.collect_list(F.struct("n_sets", "shingle"))).alias("sorted"))
    n = F.size("sorted")
    prefix = F.slice("sorted", 1, n - F.ceil(n * percent / 100).cast("int") + 1)
    posted = ranked.select("class", "component", n.alias("n"), F.posexplode(prefix).alias("pos", "s")).where("s.n_sets > 1")
    # From its place on, a set has so many shingles that may be common.
    posted = settle(posted.select("class", "component", "n", (F.col("n") - F.col("pos")).alias("ahead"), F.col("s.shingle").alias("shingle")))
    # Lists whose sets are all of one component need no comparison.
    crossing = posted.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    posted = posted.join(crossing.select("shingle"), "shingle")
    one = posted.select("shingle", F.col("class").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("ahead").alias("ha"))
    two = posted.select("shingle", F.col("class").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("ahead").alias("hb"))
    # At their first common shingle, similar sets still have as many ahead as they must have in common.
    enough = (100 + percent) * F.least("ha", "hb") >= percent * (F.col("na") + F.col("nb"))
    return one.join(two, "shingle").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & enough).select("a", "b").distinct()
