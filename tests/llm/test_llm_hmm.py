"""Hidden Markov scores against sums over all state paths and against plain counting."""

import itertools
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import hmm
from lumenframe.llm.queries import QUERIES
from lumenframe.session import settle


def test_forward_equals_all_paths():
    rnd = np.random.default_rng(0)
    model = hmm.Model(*(x / x.sum(-1, keepdims=True) for x in (rnd.random(3), rnd.random((3, 3)), rnd.random((3, 5)))))
    classes, offsets = np.array([0, 4, 2, 2, 1, 3, 0]), np.array([0, 4, 5, 7])
    got = hmm._likelihood(model, np.ascontiguousarray(model.emit.T), classes, offsets)
    for i in range(3):
        seen = classes[offsets[i] : offsets[i + 1]]
        total = 0.0
        for path in itertools.product(range(3), repeat=len(seen)):
            p = model.start[path[0]] * model.emit[path[0], seen[0]]
            for t in range(1, len(seen)):
                p *= model.move[path[t - 1], path[t]] * model.emit[path[t], seen[t]]
            total += p
        assert got[i] == pytest.approx(math.log10(total))


def test_expected_counts_equal_all_paths(monkeypatch):
    monkeypatch.setattr(hmm, "CLASSES", 5)
    rnd = np.random.default_rng(1)
    model = hmm.Model(*(x / x.sum(-1, keepdims=True) for x in (rnd.random(2), rnd.random((2, 2)), rnd.random((2, 5)))))
    seen, lengths = np.array([[1, 3, 0, 2], [4, 4, 0, 0]]), np.array([4, 2])
    start, move, emit = hmm._expect(model, seen, lengths)
    want = [np.zeros(2), np.zeros((2, 2)), np.zeros((2, 5))]
    for row, n in zip(seen, lengths):
        paths = list(itertools.product(range(2), repeat=int(n)))
        chance = []
        for path in paths:
            p = model.start[path[0]] * model.emit[path[0], row[0]]
            for t in range(1, n):
                p *= model.move[path[t - 1], path[t]] * model.emit[path[t], row[t]]
            chance.append(p)
        for path, p in zip(paths, np.array(chance) / sum(chance)):
            want[0][path[0]] += p
            for t in range(n):
                want[2][path[t], row[t]] += p
                if t:
                    want[1][path[t - 1], path[t]] += p
    for got, expected in zip((start, move, emit), want):
        assert np.allclose(got, expected)


def test_expected_counts_lay_out_real_tokens_only(monkeypatch):
    """Short windows among long ones, in any order: the same sums as window by window, and no array over their padding."""
    monkeypatch.setattr(hmm, "CLASSES", 50)
    rnd = np.random.default_rng(2)
    model = hmm.Model(*(x / x.sum(-1, keepdims=True) for x in (rnd.random(8), rnd.random((8, 8)), rnd.random((8, 50)))))
    lengths = rnd.permutation(np.append(rnd.integers(1, 4, 3000), [64, 64, 1]))
    seen = rnd.integers(0, 50, (len(lengths), 64))
    tracemalloc.start()
    got = hmm._expect(model, seen, lengths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    single = [hmm._expect(model, seen[i : i + 1, :n], lengths[i : i + 1]) for i, n in enumerate(lengths)]
    for part, sums in zip(got, zip(*single), strict=True):
        assert np.allclose(part, sum(sums))
    assert got[0].sum() == pytest.approx(len(lengths)) and got[2].sum() == pytest.approx(lengths.sum())
    assert peak < 2 * seen.nbytes  # one state's chances of padded windows are as many bytes


def tokens(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() + ["\n"]


def test_query_counts_and_gain(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    fold = {d: zlib.crc32(str(d).encode()) % 7 for d in docs}
    counts = Counter(t for d, x in docs.items() if fold[d] != 2 for t in tokens(x))
    total, words = sum(counts.values()), len(counts)
    got = QUERIES["op10_hidden_markov_scores"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        own = tokens(docs[r["doc_id"]])
        assert r["held_out"] == (fold[r["doc_id"]] == 2) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(own), sum(counts[t] > 0 for t in own))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (total + words + 1)) for t in own))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_is_a_distribution_and_passes_raise_the_likelihood(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counted = hmm.count_words(settle(hmm.blocks(docs, "doc_id", F.col("text"), F.lit(True), F.lit(False), block_tokens=5000)))
    assert counted.blocks.count() > 5
    sums = []
    for passes in (1, 3):
        model = hmm.train(counted, states=4, passes=passes)
        assert np.allclose(model.emit.sum(1), 1) and np.allclose(model.move.sum(1), 1) and np.isclose(model.start.sum(), 1)
        sums.append(hmm.score(counted, model).agg(F.sum("score")).first()[0])
    assert sums[1] > sums[0]


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "Word word", "a"), (3, "Word word", "a"), (None, "x", "a"), (4, "w " * 50_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    for learn in (F.col("doc_id") < 4, F.lit(False)):
        counted = hmm.count_words(settle(hmm.blocks(docs, "doc_id", F.col("text"), learn, F.lit(False))))
        got = hmm.score(counted, hmm.train(counted, states=2, passes=2)).collect()
        assert len(got) == 6 and all(math.isfinite(r["score"]) for r in got)
        by = {r["doc_id"]: r for r in got}
        assert by[1]["n_tokens"] == 1 and by[4]["n_tokens"] == 50_001 and by[1]["score"] == pytest.approx(by[2]["score"])
    empty = hmm.count_words(settle(hmm.blocks(docs.limit(0), "doc_id", F.col("text"), F.lit(True), F.lit(False))))
    assert hmm.score(empty, hmm.train(empty)).count() == 0
