"""Phrases whose words occur together more than apart, counted in suffix subtrees truncated at three words.

The occurrences of all phrases are the prefixes of the text's suffixes. The suffixes, cut off after ``DEPTH`` words, form a tree; it is
never built whole but in groups of word prefixes (vertical partitioning), each within a budget of occurrences:

1. Words are counted per language. Two bit maps of bounded size come from the counts: words frequent enough to be part of a phrase,
   and heavy words, whose occurrences would fill a good part of a group.
2. A suffix belongs to the group of its prefix: its first word; if that is heavy, its first two; if both are, all three. As a pair
   occurs no more often than either of its words, no prefix has more occurrences than the budget allows, except a whole truncated suffix,
   which is one leaf. Tasks add up equal suffixes before they send them, packed with their own dictionary.
3. Every group sorts its suffixes on its own and reads the counts of the nodes below off the leaf totals. Pairs whose leaves lie in
   several groups (both words heavy) are added up in one more step.
4. Counts meet by joins for scores; phrases contained in a longer one that occurs half as often or more go; the best of each language stay.

Words travel as 64-bit codes of language and word. That no two words share a code is checked; if they do, other codes are drawn.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm import wordhash
from lumenframe.session import settle

DEPTH = 3
MIN_COUNT, SHARE, TOP = 10, 50, 2000
#: Occurrences that a group of prefixes has, roughly.
BUDGET = 1_000_000
#: Bits of a map, at most.
MOST_BITS = 1 << 27
#: Bytes of text and tokens handled at once, and suffixes a task holds before it sends them.
GROUP_BYTES, SLICE_TOKENS, HELD = 1 << 21, 1 << 20, 1_500_000
#: Parts in which the best phrases of a language are sought first.
PARTS = 64

# A-Z lower-cased; characters between pieces, all of them a line feed.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)


def _token_groups(batch: pa.RecordBatch, salt: int):
    """(language, codes, words as (data, starts, ends), breaks) of texts of one language, about ``GROUP_BYTES`` at a time.

    ``breaks[i]`` says that a piece ends between the words i and i + 1.
    """
    languages = batch.column(0).dictionary_encode()
    order = np.argsort(languages.indices.to_numpy(zero_copy_only=False), kind="stable")
    number = languages.indices.to_numpy(zero_copy_only=False)[order]
    texts = batch.column(1).take(pa.array(order))
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(order):
        until, size = at, 0
        while until < len(order) and number[until] == number[at] and (until == at or size + sizes[until] <= GROUP_BYTES):
            size += int(sizes[until])
            until += 1
        name = languages.dictionary[int(number[at])].as_py()
        own = [(t or b"").translate(_BYTES) + b"\n" for t in texts.slice(at, until - at).to_pylist()]
        at = until
        w = wordhash.words(own, salt)
        if not len(w.hashes):
            continue
        seed = np.uint64(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))
        codes = wordhash.mix(w.hashes ^ seed)
        codes[codes == 0] = 1  # 0 stands for no word
        lines = np.cumsum(w.data == 10, dtype=np.int32)
        breaks = np.append(lines[w.starts[1:]] != lines[w.ends[:-1] - 1], True)
        yield name, codes, w, breaks


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").cast("binary").alias("text"))


def count_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, int]:
    """``lang, code, word, n`` of all words, written, and the salt under which no two of them share a code."""
    salt = 0
    while True:
        words = settle(_counted(_rows(docs, text, lang), salt).groupBy("lang", "code", "word").agg(F.sum("n").alias("n")))
        if words.groupBy("code").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
            return words, salt
        salt += 1


def _counted(rows: DataFrame, salt: int) -> DataFrame:
    letters = wordhash.seeds(256, 41)

    def run(batches):
        for batch in batches:
            for name, codes, w, _ in _token_groups(batch, salt):
                every, first, which, n = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
                # Words that share a code differ in the sum of their letters: they get rows of their own, which the check finds.
                sums = np.cumsum(letters[w.data], dtype=np.uint64)
                sums = sums[w.ends - 1] - np.where(w.starts > 0, sums[w.starts - 1], np.uint64(0))
                other = np.flatnonzero(sums != sums[first][which])
                every, first, n = np.append(every, codes[other]), np.append(first, other), np.append(n, np.ones(len(other), dtype=n.dtype))
                data = w.data.tobytes()
                found = [data[a:b] for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(every), pa.string()), pa.array(every.view(np.int64)), pa.array(found, pa.binary()).cast(pa.string()), pa.array(n)],
                    names=["lang", "code", "word", "n"],
                )

    return rows.mapInArrow(run, "lang string, code long, word string, n long")


def _bit_map(codes: DataFrame, bits: int) -> np.ndarray:
    """A map of ``bits`` bits with the bit of each ``code`` set; the driver gets at most ``bits / 64`` numbers, whatever the codes."""
    place = F.expr(f"shiftrightunsigned(code, 6) & {bits // 64 - 1}")
    found = codes.select(place.alias("place"), F.expr("shiftleft(1L, cast(code & 63 as int))").alias("bit"))
    found = found.groupBy("place").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found["place"].to_numpy(dtype=np.int64)] = found["bit"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _marked(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which codes have their bit set: all that are meant, and a few others."""
    own = bits[(codes >> np.uint64(6)) & np.uint64(len(bits) - 1)]
    return (own >> (codes & np.uint64(63))) & np.uint64(1) == 1


def _bits_for(n: int) -> int:
    return min(MOST_BITS, 1 << max(12, (16 * n).bit_length()))


def _squeeze(numbers: np.ndarray) -> bytes:
    """Small numbers, compressed byte plane by byte plane."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _stretch(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack(vocabulary: np.ndarray, columns: list[np.ndarray]) -> bytes:
    parts = [vocabulary.astype("<u8").tobytes(), *map(_squeeze, columns)]
    return struct.pack("<5I", *map(len, parts)) + b"".join(parts)


def _unpack(data: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    sizes, at, parts = struct.unpack_from("<5I", data), 20, []
    for size in sizes:
        parts.append(data[at : at + size])
        at += size
    return np.frombuffer(parts[0], dtype="<u8"), [_stretch(p) for p in parts[1:]]


def truncated_suffixes(docs: DataFrame, salt: int, frequent: np.ndarray, heavy: np.ndarray, groups: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """``group, data``: suffixes of two words or more, cut after three or before an infrequent word, packed by group.

    Groups from ``groups`` on hold suffixes whose first two words are heavy.
    """
    shared = docs.sparkSession.sparkContext.broadcast((frequent, heavy))  # at most MOST_BITS each

    def run(batches):
        frequent, heavy = shared.value
        codes_held, starts_held, three_held, size, tokens = [], [], [], 0, 0

        def send():
            codes = np.concatenate(codes_held)
            vocabulary, ids = np.unique(codes, return_inverse=True)
            ids = np.append(ids, [0, 0]).astype(np.int64) + 1  # 0: no word
            starts, three = np.concatenate(starts_held), np.concatenate(three_held)
            packed = (ids[starts] << 42) | (ids[starts + 1] << 21) | np.where(three, ids[starts + 2], 0)
            packed, n = np.unique(packed, return_counts=True)
            a, b, c = packed >> 42, (packed >> 21) & 0x1FFFFF, packed & 0x1FFFFF
            vocabulary = np.append(np.zeros(1, dtype=np.uint64), vocabulary)
            big = _marked(heavy, vocabulary)
            big[0] = False
            two, whole = big[a], big[a] & big[b]
            prefix = vocabulary[a]
            prefix = np.where(two, wordhash.mix(prefix * np.uint64(0x9E3779B97F4A7C15) + vocabulary[b]), prefix)
            prefix = np.where(whole, wordhash.mix(prefix * np.uint64(0xD6E8FEB86659FD93) + vocabulary[c]), prefix)
            group = (wordhash.mix(prefix) % np.uint64(groups)).astype(np.int64) + np.where(whole, groups, 0)
            order = np.argsort(group, kind="stable")
            a, b, c, n, group = (x[order] for x in (a, b, c, n, group))
            limits = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            rows: list[tuple[int, bytes]] = []
            filled = 0
            for x, y in zip(limits, limits[1:]):
                used, at = np.unique(np.concatenate((a[x:y], b[x:y], c[x:y])), return_inverse=True)
                data = _pack(vocabulary[used], [*at.reshape(3, -1), n[x:y]])
                rows.append((int(group[x]), data))
                filled += len(data)
                if filled > 4 << 20 or y == len(group):
                    yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], names=["group", "data"])
                    rows, filled = [], 0

        for batch in batches:
            for _, codes, _, breaks in _token_groups(batch, salt):
                often = _marked(frequent, codes)
                second = often & ~breaks & np.append(often[1:], False)
                third = second & np.append(second[1:], False)
                # Slices overlap by the two words that the last suffix may reach into.
                for at in range(0, len(codes), SLICE_TOKENS):
                    own = slice(at, at + SLICE_TOKENS)
                    starts = np.flatnonzero(second[own])
                    if not len(starts):
                        continue
                    codes_held.append(codes[at : at + SLICE_TOKENS + 2])
                    starts_held.append(starts + tokens)
                    three_held.append(third[own][starts])
                    tokens += len(codes_held[-1])
                    size += len(starts)
                    if size >= HELD or tokens + SLICE_TOKENS + 2 >= (1 << 21) - 2:
                        yield from send()
                        codes_held, starts_held, three_held, size, tokens = [], [], [], 0, 0
        if size:
            yield from send()

    return _rows(docs, text, lang).mapInArrow(run, "group long, data binary")


def node_counts(packed: DataFrame, groups: int, min_count: int = MIN_COUNT) -> DataFrame:
    """``c1, c2, c3, n`` of the subtrees' nodes of two words (``c3`` 0) and three with ``min_count`` occurrences or more.

    Nodes of two heavy words come in parts of any count.
    """

    def subtree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for data in rows["data"]:
            vocabulary, (a, b, c, n) = _unpack(data)
            found.append((vocabulary[a], vocabulary[b], vocabulary[c], n.astype(np.int64)))
        c1, c2, c3, n = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((c3, c2, c1))
        c1, c2, c3, n = (x[order] for x in (c1, c2, c3, n))
        new2 = np.append(True, (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]))
        leaves = np.flatnonzero(new2 | np.append(True, c3[1:] != c3[:-1]))
        total = np.add.reduceat(n, leaves)  # per leaf
        inner = np.flatnonzero(new2[leaves])
        pairs = np.add.reduceat(total, inner)  # per node of two words, from its leaves
        keep2 = (pairs >= min_count) | (int(key[0]) >= groups)
        keep3 = (total >= min_count) & (c3[leaves] != 0)
        at2, at3 = leaves[inner][keep2], leaves[keep3]
        columns = {
            "c1": np.concatenate((c1[at2], c1[at3])), "c2": np.concatenate((c2[at2], c2[at3])),
            "c3": np.concatenate((np.zeros(len(at2), dtype=np.uint64), c3[at3])),
        }
        return pd.DataFrame({k: v.view(np.int64) for k, v in columns.items()} | {"n": np.concatenate((pairs[keep2], total[keep3]))})

    return packed.groupBy("group").applyInPandas(subtree, "c1 long, c2 long, c3 long, n long")


def score(a: str, left: str, right: str) -> Column:
    """``floor(1000000 * a * a / (left * right))`` of three counts below 10**15, exactly."""
    wide = [f"cast({c} as decimal(15, 0))" for c in (a, left, right)]
    return F.expr(f"({wide[0]} * {wide[0]} * 1000000BD) div ({wide[1]} * {wide[2]})")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, share: int = SHARE, top: int = TOP,
    budget: int = BUDGET,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of two or three words of each language.

    A word is what stands between spaces and tabs, A-Z lower-cased; phrases do not reach across ``. , ; : ! ?`` or a line break, nor from one
    row to another. ``a`` is the phrase's number of occurrences, ``min_count`` at least, ``l`` and ``r`` those of its two parts at the cut with
    the lowest ``score`` (the first of equals), ``n`` all words of the language. A phrase goes if a longer one of ``min_count`` occurrences
    contains it and has ``share`` percent of its occurrences or more. Equal scores: more occurrences first, then by UTF-8 bytes.

    A null language is ``und``, together with rows that say so; null and empty texts have no words; every repeated row counts; texts of
    any length are taken whole. Other columns are ignored. An empty table gives an empty result.
    """
    words, salt = count_words(docs, text, lang)
    totals = words.agg(
        F.sum("n").alias("n"), F.count_if(F.col("n") >= min_count).alias("frequent"), F.count_if(F.col("n") > budget // 4).alias("heavy")
    ).first()
    groups = max(1, -(-(totals["n"] or 0) // budget))
    often = words.where(F.col("n") >= min_count)
    frequent = _bit_map(often, _bits_for(totals["frequent"]))
    heavy = _bit_map(words.where(F.col("n") > budget // 4), _bits_for(totals["heavy"]))
    nodes = settle(node_counts(truncated_suffixes(docs, salt, frequent, heavy, groups, text, lang), groups, min_count))

    one = often.select(F.col("code").alias("c1"), "lang", F.col("word").alias("w1"), F.col("n").alias("f1"))
    two = often.select(F.col("code").alias("c2"), F.col("word").alias("w2"), F.col("n").alias("f2"))
    pairs = nodes.where("c3 = 0").groupBy("c1", "c2").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)
    pairs = settle(pairs.join(one, "c1").join(two, "c2"))
    ahead = pairs.select("c1", "c2", "lang", "w1", "w2", "f1", F.col("a").alias("f12"))
    behind = pairs.select(F.col("c1").alias("c2"), F.col("c2").alias("c3"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
    triples = nodes.where("c3 <> 0").withColumnRenamed("n", "a")
    triples = settle(triples.join(ahead, ["c1", "c2"]).join(behind, ["c2", "c3"]))

    longer = triples.select("a", F.explode(F.array(F.struct("c1", "c2"), F.struct(F.col("c2").alias("c1"), F.col("c3").alias("c2")))).alias("p"))
    longer = longer.groupBy("p.c1", "p.c2").agg(F.max("a").alias("most"))
    alone = pairs.join(longer, ["c1", "c2"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    short = alone.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score("a", "f1", "f2").alias("score"))
    scored = triples.withColumn("s1", score("a", "f1", "f23")).withColumn("s2", score("a", "f12", "f3"))
    first = F.col("s1") <= F.col("s2")
    long = scored.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = short.unionByName(long).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return found.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
