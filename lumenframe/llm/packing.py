"""Best-fit packing of documents into sequences after Martello-Toth dominance reduction.

Only lengths matter for the plan, and there are at most ``capacity`` of them. So Spark counts pieces by length, the
driver plans on that histogram (at most ``capacity`` rows, whatever the corpus), and the plan, a
table of runs "pieces number a to b of length w go to sequences s, s + 1, ...", is joined back to the
pieces through their number within their length.

The plan:

1. Dominance: a set of pieces around the longest one is fixed for good where it provably dominates every other set
   that could hold that piece: the piece alone if nothing fits beside it, a pair that fills the
   sequence or whose partner outweighs any two others that fit, a triple that no other pair can beat.
2. What is left is packed best-fit, longest first.

Pieces are numbered within (length, hash bucket), so a length that a third of all pieces share is spread out.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import worker_cache
from lumenframe.session import settle

#: Pieces of one length and hash bucket, roughly; they are numbered in one task.
BUCKET_ROWS = 2_000
#: Words that a worker remembers with their ids.
REMEMBERED = 200_000

PIECES = "piece int, start long, length int, ids binary"
#: White space other than a space, before a space.
_ODD_SPACE = re.compile(r"[^\S ] ")
#: Latin script, digits and punctuation.
_LATIN = re.compile("[\x00-\u024f]*")
#: A space that follows a non-space.
_CUT = re.compile(r"(?<=\S) ")


class Encoder:
    """Token ids of texts, as the tokenizer file gives them without added special tokens.

    A byte-level BPE of this kind never merges across a space that follows a non-space, so texts are cut there, and
    the ids of a cut are remembered. Where the file of ranks of the same vocabulary is given, new cuts in Latin script
    go through the faster library, on which both agree.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        if self.fast is not None and _LATIN.fullmatch(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
        return self._encode_full(text)

    def _encode_full(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._encode_full(text)
        words = text.split(" ")
        if "" in words or _ODD_SPACE.search(text):
            words = _CUT.split(text)
        known = self.known
        out = [self._encode(words[0])]
        for word in words[1:]:
            ids = known.get(word)
            if ids is None:
                ids = self._encode(" " + word)
                if len(word) < 40:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = ids
            out.append(ids)
        return b"".join(out)


def _encoder(path: str, ranks_path: str | None) -> Encoder:
    cache = worker_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path, ranks_path)
    return cache["encoder", path]


def cut(docs: DataFrame, tokenizer: str, ranks: str | None = None, text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: the other columns of ``docs``, then ``piece, start, length, ids``.

    A document is the ids of its whole text (null: none) and ``end_id``. Longer ones are cut into pieces of
    ``capacity`` ids, of which the first may be shorter. ``start`` counts the document's ids before the piece; ``ids`` is
    little-endian unsigned 32-bit. ``tokenizer`` and ``ranks`` are file paths on the workers. Columns named like the
    new ones are replaced; an empty table gives an empty result.
    """
    import pyarrow as pa

    new = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int32(), "ids": pa.binary()}
    kept = [c for c in docs.columns if c != text and c not in new]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + [PIECES])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = _encoder(tokenizer, ranks)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__text"))
            rows, parts, size = [], [], 0

            def packed():
                taken = batch.select(kept).take(pa.array(rows, pa.int64()))
                piece, start, length, ids = zip(*parts)
                arrays = [pa.array(v, t) for v, t in zip((piece, start, length, ids), new.values())]
                return pa.RecordBatch.from_arrays([*taken.columns, *arrays], names=[*kept, *new])

            for i in range(batch.num_rows):
                ids = encoder.encode(column[i].as_py() or "") + end
                n = len(ids) // 4
                first = n - (-(-n // capacity) - 1) * capacity
                at = 0
                while at < n:
                    until = first if at == 0 else at + capacity
                    rows.append(i)
                    parts.append((0 if at == 0 else (at - first) // capacity + 1, at, until - at, ids[4 * at : 4 * until]))
                    at = until
                size += len(ids)
                if size > 8 << 20:
                    yield packed()
                    rows, parts, size = [], [], 0
            if rows:
                yield packed()

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)


def dominant_sets(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets that may be fixed without needing more sequences than the best packing, and the lengths left.

    Returns ``[(lengths of the set, how many such sets)]`` and the remaining histogram. For the longest piece w
    of each length, sets are judged as follows; among pieces of equal length any will do.
    """
    left = {w: n for w, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(lengths: tuple[int, ...]) -> None:
        each = {w: lengths.count(w) for w in lengths}
        n = min(left[w] // k for w, k in each.items())
        fixed.append((lengths, n))
        for w, k in each.items():
            left[w] -= k * n
            if not left[w]:
                del left[w]

    def has(*lengths: int) -> bool:
        return all(left.get(w, 0) >= lengths.count(w) for w in lengths)

    changed = True
    while changed:
        changed = False
        for w in sorted(left, reverse=True):
            while w in left:
                chosen = _dominant(w, left, capacity, has)
                if chosen is None:
                    break
                fix(chosen)
                changed = True
    return fixed, left


def _dominant(w: int, left: dict[int, int], capacity: int, has) -> tuple[int, ...] | None:
    """A set with ``w`` that dominates all sets with ``w``, if one is found."""
    room = capacity - w
    if room > 0 and has(w, room):
        return (w, room)  # fills the sequence: a pair that does dominates
    others = dict(left)
    others[w] -= 1
    fits = sorted(x for x, n in others.items() if n > 0 and x <= room)
    if not fits:
        return (w,)
    smallest = [x for x in fits[:3] for _ in range(min(3, others[x]))]
    best = fits[-1]
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (w, best)  # nothing but one more piece fits
    if len(smallest) >= 3 and sum(smallest[:3]) <= room:
        return None  # sets of four or more are possible
    # At most two more pieces fit. The heaviest two that do:
    top, pair = 0, None
    lo, hi = 0, len(fits) - 1
    while lo <= hi:
        total = fits[lo] + fits[hi]
        if total > room or (lo == hi and others[fits[lo]] < 2):
            hi -= 1
            continue
        if total > top:
            top, pair = total, (fits[hi], fits[lo])
        lo += 1
    if pair is None or best >= top:
        return (w, best)
    a, b = pair
    if a == best:
        # Every other pair must have one piece up to b; the other is up to a. So no two pieces above b may fit besides one a.
        spare = dict(others)
        spare[a] -= 1
        above = [x for x in fits if x > b for _ in range(min(2, max(0, spare[x])))][:2]
        if len(above) < 2 or sum(above) > room:
            return (w, a, b)
    return None


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs ``(length, first, until, per_sequence, sequence, offset)`` and the number of sequences.

    Pieces number ``first <= r < until`` of ``length`` go, ``per_sequence`` at a time, to the sequences from ``sequence``
    on, the first of each at ``offset``. Sequences that hold the same lengths are handled together, so the work
    depends on the number of lengths, not of pieces.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    used = {w: 0 for w in counts}
    sequences = 0

    def put(w: int, n: int, per: int, sequence: int, offset: int) -> None:
        runs.append((w, used[w], used[w] + n, per, sequence, offset))
        used[w] += n

    fixed, left = dominant_sets(counts, capacity)
    for lengths, n in fixed:
        offset = 0
        for w in dict.fromkeys(lengths):
            per = lengths.count(w)
            put(w, per * n, per, sequences, offset)
            offset += per * w
        sequences += n
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, number of sequences)]
    for w in sorted(left, reverse=True):
        n = left[w]
        while n:
            room = min((r for r in groups if r >= w), default=None)
            if room is None:
                per = capacity // w
                groups.setdefault(capacity, []).append((sequences, -(-n // per)))
                sequences += -(-n // per)
                continue
            start, m = groups[room].pop()
            if not groups[room]:
                del groups[room]
            per = room // w
            full = min(m, n // per)
            if full:
                put(w, full * per, per, start, capacity - room)
                n -= full * per
                groups.setdefault(room - per * w, []).append((start, full))
            start, m = start + full, m - full
            if m and n:  # fewer than one sequence takes
                put(w, n, n, start, capacity - room)
                groups.setdefault(room - n * w, []).append((start, 1))
                start, m, n = start + 1, m - 1, 0
            if m:
                groups.setdefault(room, []).append((start, m))
    return runs, sequences


def place(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ()) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless places in as few sequences as the plan needs.

    ``pieces`` has a column ``length`` from 1 to ``capacity`` and should be cheap to read twice (a written table). ``order``
    names columns that tell pieces of one length apart; rows equal in all of them are alike and may swap places.
    """
    spark = pieces.sparkSession
    names = list(order) or [c for c in pieces.columns if c != "length"]
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}
    runs, _ = plan(counts, capacity)
    buckets = max(1, -(-max(counts.values(), default=0) // BUCKET_ROWS))
    rows = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.withColumn("__base", F.sum("n").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("n")).drop("n")
    number: Column = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(*names)) - 1
    numbered = rows.withColumn("__in_bucket", number).join(base, ["length", "__bucket"])
    numbered = numbered.withColumn("__number", F.col("__base") + F.col("__in_bucket"))
    # A few runs per length, at most a few times `capacity` rows.
    table = F.broadcast(
        spark.createDataFrame(runs, "run_length int, first long, until long, per long, sequence long, run_offset long")
    )
    inside = (F.col("length") == F.col("run_length")) & (F.col("__number") >= F.col("first")) & (F.col("__number") < F.col("until"))
    nth = F.col("__number") - F.col("first")
    return numbered.join(table, inside).select(
        *pieces.columns,
        (F.col("sequence") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + (nth % F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, text: str = "text", capacity: int = 2048) -> DataFrame:
    """Tokenize, cut and place in one go: the columns of ``cut`` with ``sequence_id`` and ``offset``."""
    pieces = settle(cut(docs, tokenizer, ranks, text, capacity))
    return place(pieces, capacity)
