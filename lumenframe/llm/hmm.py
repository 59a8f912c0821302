"""Language-model scoring by a hidden Markov model.

Each word is drawn in two steps: a latent state draws a word class, the class draws the word. The second step follows the
counts of the words in the training texts, smoothed by one; the first is learned by Baum-Welch. With q(w) the smoothed share
of word w, Q(c) the share of class c and B(s, c) the chance of class c in state s, a word has chance
``q(w) * B(s, class(w)) / Q(class(w))``, which sums to one over all words, unseen ones included. A class is a hash of a
word's ending, so the tables ``states x classes`` have a fixed size and are broadcast; the word counts,
which grow with the corpus, stay in Spark and meet the texts by joins.

Texts travel as blocks: a bounded number of tokens with the block's own dictionary of distinct words.

1. ``blocks``: texts to blocks. Words are hashed and replaced by their number in the block's dictionary.
2. ``count_words``: dictionaries are exploded and summed over all blocks in one shuffle, and the sums go back to their blocks.
3. ``train``: every pass sends expected counts of each partition (fixed size) to a sum; the sum makes the next model.
4. ``score``: scaled forward recursion over the whole text, all texts of a block side by side.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm import wordhash
from lumenframe.session import settle

STATES = 8
CLASSES = 4096
PASSES = 6
#: Tokens in a block, roughly; a longer text is a block of its own.
BLOCK_TOKENS = 1_000_000
#: In training, sequences are cut into windows of so many tokens; scoring never cuts.
WINDOW = 64
#: Windows whose expected counts are computed side by side.
WINDOWS = 2048
#: The end of a text as a token.
END_HASH = 0x5EED0F7E47A11D0E

_BLOCK = (
    "block long, doc_ids array<string>, held_out array<boolean>, learn array<boolean>, offsets binary, tokens binary, hashes binary, "
    "classes binary, train_counts binary"
)


class Model(NamedTuple):
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # states x classes


def _classes(w: wordhash.Words) -> np.ndarray:
    """Class of each word: a hash of its last two bytes and of whether it is short (up to four bytes: the whole word)."""
    length = w.ends - w.starts
    code = length.clip(max=5).astype(np.uint64)
    for back in range(1, 5):
        there = (length >= back) & ((back <= 2) | (length <= 4))
        byte = np.where(there, w.data[np.maximum(w.ends - back, 0)], 0).astype(np.uint64)
        code = code * np.uint64(257) + byte
    return (wordhash.mix(code) % np.uint64(CLASSES - 1) + np.uint64(1)).astype(np.uint16)  # class 0 is the end's


def _squeeze(numbers: np.ndarray) -> bytes:
    """Small 32-bit numbers, compressed byte plane by byte plane."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _stretch(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def blocks(docs: DataFrame, id_column: str, text: Column, learn: Column, held_out: Column, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Texts as blocks. ``learn`` marks the texts to learn from, ``held_out`` is passed through."""
    rows = docs.select(
        F.col(id_column).cast("string").alias("id"), text.alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: list = []
        size = 0

        def out():
            nonlocal number
            number += 1
            ids, flags, learn, hashes, classes = zip(*held)
            sizes = np.array([len(h) for h in hashes])
            every, first, at, often = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # frequent words get small numbers
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            every, first, at = every[order], first[order], place[at]
            from_all = np.repeat(np.array(learn), sizes)
            counts = np.bincount(at[from_all], minlength=len(every))
            row = ((part << 32) + number, list(ids), list(flags), list(learn), np.cumsum([0, *sizes]).astype("<i8").tobytes(),
                   _squeeze(at), every.astype("<u8").tobytes(), np.concatenate(classes)[first].astype("<u2").tobytes(),
                   _squeeze(counts))
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.binary(), pa.binary(),
                     pa.binary(), pa.binary(), pa.binary()]
            names = ["block", "doc_ids", "held_out", "learn", "offsets", "tokens", "hashes", "classes", "train_counts"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

        for batch in batches:
            ids, texts, learn, flags = (batch.column(i).to_pylist() for i in range(4))
            for first, group in wordhash.groups(texts):
                w = wordhash.words(group)
                classes = _classes(w)
                for i in range(len(group)):
                    a, b = w.offsets[i], w.offsets[i + 1]
                    tokens = np.append(w.hashes[a:b], np.uint64(END_HASH))
                    held.append((ids[first + i], flags[first + i], learn[first + i], tokens, np.append(classes[a:b], np.uint16(0))))
                    size += len(tokens)
                    if size >= block_tokens:
                        yield out()
                        held.clear()
                        size = 0
        if held:
            yield out()

    return rows.mapInArrow(run, _BLOCK)


class Counted(NamedTuple):
    blocks: DataFrame
    counts: DataFrame  # per block: the training count of each dictionary word over the whole corpus
    tokens: int  # training tokens
    words: int  # distinct training tokens
    class_words: np.ndarray  # distinct training words per class
    class_tokens: np.ndarray  # training tokens per class


def count_words(table: DataFrame) -> Counted:
    """Count every word over all blocks and bring the counts back to the blocks' dictionaries.

    A word costs one row per block it occurs in, moved once by word and once back by block. The driver gets sums per class.
    """

    def listed(batches):
        for batch in batches:
            for block, hashes, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words, n = np.frombuffer(hashes, "<i8"), _stretch(counts).astype(np.int32)
                for at in range(0, len(words), 100_000):
                    some = words[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), block)), pa.array(np.arange(at, at + len(some), dtype=np.int32)),
                         pa.array(some), pa.array(n[at : at + 100_000])],
                        names=["block", "number", "hash", "n"],
                    )

    def packed(batches):
        """Rows in order of block and number, as one row per block."""
        own, held = None, []

        def out():
            totals, firsts = (np.concatenate(c) for c in zip(*held))
            return pa.RecordBatch.from_arrays(
                [pa.array([own], pa.int64()), pa.array([totals.astype("<i8").tobytes()], pa.binary()), pa.array([np.packbits(firsts).tobytes()], pa.binary())],
                names=["block", "totals", "firsts"],
            )

        for batch in batches:
            block = batch.column(0).to_numpy()
            totals, firsts = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(block)) + 1
            for a, b in zip([0, *edges], [*edges, len(block)]):
                if a == b:
                    continue
                if held and block[a] != own:
                    yield out()
                    held = []
                own = int(block[a])
                held.append((totals[a:b].copy(), firsts[a:b].copy()))
        if held:
            yield out()

    seen = table.select("block", "hashes", "train_counts").mapInArrow(listed, "block long, number int, hash long, n int")
    word = Window.partitionBy("hash")
    totals = seen.select(
        "block", "number", F.sum("n").over(word).alias("total"), (F.min("block").over(word) == F.col("block")).alias("first")
    )
    counts = settle(totals.repartition("block").sortWithinPartitions("block", "number").mapInArrow(packed, "block long, totals binary, firsts binary"))

    def by_class(batches):
        """Every word counts in the first block that has it."""
        words, tokens = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            for classes, totals, firsts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                of, n = np.frombuffer(classes, "<u2"), np.frombuffer(totals, "<i8")
                once = np.unpackbits(np.frombuffer(firsts, np.uint8), count=len(n)).astype(bool) & (n > 0)
                words += np.bincount(of[once], minlength=CLASSES)
                np.add.at(tokens, of[once], n[once])
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(words[some]), pa.array(tokens[some])], names=["class", "words", "tokens"]
        )

    found = table.select("block", "classes").join(counts, "block").select("classes", "totals", "firsts")
    sums = found.mapInArrow(by_class, "class int, words long, tokens long").groupBy("class").agg(F.sum("words"), F.sum("tokens"))
    class_words, class_tokens = np.zeros(CLASSES), np.zeros(CLASSES)
    for of, words, tokens in sums.collect():  # one row per class
        class_words[of], class_tokens[of] = words, tokens
    return Counted(table, counts.select("block", "totals"), int(class_tokens.sum()), int(class_words.sum()), class_words, class_tokens)


def _sequences(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Token classes of a block and the offsets of its texts."""
    classes = np.frombuffer(row["classes"], "<u2")
    return classes[_stretch(row["tokens"])], np.frombuffer(row["offsets"], "<i8")


def _expect(model: Model, seen: np.ndarray, lengths: np.ndarray):
    """Expected counts over windows of equal width, of which the first ``lengths`` tokens are real.

    Only real tokens are laid out, step by step, windows from the longest to the shortest, so that a step's windows come first among those
    of the step before. States are rows: sums over them add up whole rows.
    """
    order = np.argsort(-lengths, kind="stable")
    seen, lengths = seen[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left").tolist()  # windows longer than t
    at = np.cumsum([0, *active]).tolist()
    flat = np.concatenate([seen[:k, t] for t, k in enumerate(active)])
    chance = model.emit.take(flat, axis=1)  # states x tokens
    weight = np.empty_like(chance)  # forward chances, then those of the states
    back = np.ascontiguousarray(model.move.T)
    for t, k in enumerate(active):
        own = slice(at[t], at[t] + k)
        alpha = (back @ weight[:, at[t - 1] : at[t - 1] + k] if t else model.start[:, None]) * chance[:, own]
        scale = 1 / alpha.sum(0)
        np.multiply(alpha, scale, out=weight[:, own])
        chance[:, own] *= scale
    states = len(model.start)
    moves = np.zeros((states, states))
    ahead = None
    for t in range(len(active) - 1, -1, -1):
        own = slice(at[t], at[t + 1])
        if ahead is not None:
            going = slice(at[t], at[t] + active[t + 1])  # windows that go on, all others end here
            moves += weight[:, going] @ ahead.T
            beta = model.move @ ahead
            weight[:, going] *= beta
            ahead = chance[:, own].copy()
            ahead[:, : active[t + 1]] *= beta
        else:
            ahead = chance[:, own]
    emitted = np.stack([np.bincount(flat, own, minlength=CLASSES) for own in weight])
    return weight[:, : at[1]].sum(1), moves * model.move, emitted


def train(counted: Counted, states: int = STATES, passes: int = PASSES, seed: int = 5) -> Model:
    """Baum-Welch over all training texts of all blocks.

    Each pass is one Spark job: a partition adds up expected counts for its blocks and sends ``states x classes`` cells, Spark
    sums the cells, the driver normalizes them with a small prior. Training texts are cut into windows of ``WINDOW`` tokens.
    """
    base = (counted.class_tokens + counted.class_words + 1e-3) / (counted.class_tokens + counted.class_words + 1e-3).sum()
    noise = np.random.default_rng(seed)
    emit = base[None] * noise.uniform(0.5, 1.5, (states, CLASSES))
    model = Model(
        np.full(states, 1 / states),
        np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 if states > 1 else 1.0),
        emit / emit.sum(1, keepdims=True),
    )
    model = Model(model.start, model.move / model.move.sum(1, keepdims=True), model.emit)
    spark = counted.blocks.sparkSession
    for _ in range(passes if counted.tokens else 0):
        shared = spark.sparkContext.broadcast(tuple(model))

        def expect(batches):
            own = Model(*shared.value)
            start, move, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((states, CLASSES))
            for batch in batches:
                for row in batch.to_pylist():
                    classes, offsets = _sequences(row)
                    learned = np.array(row["learn"], dtype=bool)
                    cuts = [np.arange(a, b, WINDOW) for a, b, yes in zip(offsets[:-1], offsets[1:], learned) if yes]
                    if not cuts:
                        continue
                    first = np.concatenate(cuts)
                    ends = np.repeat(offsets[1:][learned], [len(c) for c in cuts])
                    lengths = np.minimum(WINDOW, ends - first)
                    for at in range(0, len(first), WINDOWS):
                        f, n = first[at : at + WINDOWS], lengths[at : at + WINDOWS]
                        index = np.minimum(f[:, None] + np.arange(WINDOW)[None], len(classes) - 1)
                        a, b, c = _expect(own, classes[index], n)
                        start, move, emitted = start + a, move + b, emitted + c
            cells = np.concatenate([start, move.ravel(), emitted.ravel()])
            at = np.flatnonzero(cells)
            for part in range(0, len(at), 10_000):
                some = at[part : part + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(cells[some])], names=["cell", "n"])

        learning = counted.blocks.select("offsets", "tokens", "classes", "learn")
        sums = learning.mapInArrow(expect, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        cells = np.zeros(states + states * states + states * CLASSES)
        for r in sums:  # at most one row per cell
            cells[r["cell"]] = r["n"]
        start, move = cells[:states] + 1, cells[states : states + states**2].reshape(states, states) + 1
        emitted = cells[states + states**2 :].reshape(states, CLASSES) + base[None]
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emitted / emitted.sum(1, keepdims=True))
        shared.unpersist()
    return model


def _likelihood(model: Model, emit: np.ndarray, classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 of the chance of each text's classes, relative to ``emit``'s scale, by scaled forward recursion over whole texts."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = offsets[:-1][order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")  # texts longer than t
    total = np.zeros(len(order))
    alpha = np.tile(model.start, (len(order), 1))
    for t, n in enumerate(active):
        alpha = alpha[:n] @ model.move if t else alpha[:n]
        alpha = alpha * emit[classes[starts[:n] + t]]
        scale = alpha.sum(1)
        total[:n] += np.log10(scale)
        alpha /= scale[:, None]
    out = np.empty(len(order))
    out[order] = total
    return out


def score(counted: Counted, model: Model, id_type: str = "long", id_column: str = "doc_id") -> DataFrame:
    """Per text: ``id_column, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` is the sum of log10 of the smoothed shares q(w), ``score`` log10 of the exact chance of the whole text under
    the model. With no training text every token has q = 1 and so has every text.
    """
    total = counted.tokens + counted.words + 1
    # Share of each class among all words, the one unseen word included; an unseen word has the class of its ending, and a
    # class gets an equal part of the unseen word's share.
    share = (counted.class_tokens + counted.class_words + 1 / CLASSES) / total
    ratio = np.ascontiguousarray((model.emit / share[None]).T) if counted.tokens else np.ones((CLASSES, len(model.start)))
    shared = counted.blocks.sparkSession.sparkContext.broadcast((tuple(model), ratio, counted.tokens, total))

    def run(batches):
        parts, emit, trained, size = shared.value
        own = Model(*parts)
        for batch in batches:
            for row in batch.to_pylist():
                classes, offsets = _sequences(row)
                counts = np.frombuffer(row["totals"], "<i8")[_stretch(row["tokens"])]
                base = np.add.reduceat(np.log10((counts + 1) / size), offsets[:-1])
                known = np.add.reduceat((counts > 0).astype(np.int64), offsets[:-1])
                full = base + (_likelihood(own, emit, classes, offsets) if trained else 0.0)
                n = len(base)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.string()), pa.array(row["held_out"], pa.bool_()), pa.array(np.diff(offsets)),
                     pa.array(known), pa.array(np.full(n, trained, dtype=np.int64)), pa.array(base), pa.array(full)],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    rows = counted.blocks.select("block", "doc_ids", "held_out", "offsets", "tokens", "classes").join(counted.counts, "block")
    scored = rows.mapInArrow(
        run, "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return scored.select(F.col("id").cast(id_type).alias(id_column), *scored.columns[1:])
