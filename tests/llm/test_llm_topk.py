"""Top-k search against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import topk


def brute(rows, asks, k):
    out = []
    for i, (q, v) in enumerate(rows):
        if not asks(q):
            continue
        found = sorted(((-sum(a * b for a, b in zip(v, w)), c) for j, (c, w) in enumerate(rows) if j != i))[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=5, **settings):
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumn("score", F.lit("clash")).withColumn("pivot", F.lit(0))
    got = topk.top_k(df.repartition(3), "vec_id", F.col("v"), F.col("vec_id") % 4 == 0, k, **settings)
    return sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("shape", ["random", "clustered", "ties", "wide"])
def test_equals_brute_force(spark, shape):
    rnd = random.Random(shape)
    if shape == "ties":
        rows = [(i, [rnd.randint(-1, 1) for _ in range(3)]) for i in range(150)]
    elif shape == "clustered":
        centres = [[rnd.randint(-200, 200) for _ in range(6)] for _ in range(5)]
        rows = [(i, [x + rnd.randint(-3, 3) for x in centres[i * i % 5]]) for i in range(300)]
    elif shape == "wide":
        rows = [(i, [rnd.randint(-(2**40), 2**40) for _ in range(2)]) for i in range(40)]
        rows = [(i, [x // 2**10 for x in v]) for i, v in rows]
    else:
        rows = [(i, [rnd.randint(-100, 100) for _ in range(8)]) for i in range(200)]
    got = run(spark, rows, pivots=6, block_rows=16, query_rows=8)
    assert got == brute(rows, lambda q: q % 4 == 0, 5)


def test_fewer_rows_repeats_and_ragged(spark):
    rows = [(0, [1, 2]), (1, [1]), (4, [3, 3])]
    assert run(spark, rows) == brute([(0, [1, 2]), (1, [1, 0]), (4, [3, 3])], lambda q: q % 4 == 0, 5)
    again = run(spark, [(0, [1, 2]), (0, [1, 2]), (1, [5, 5])], k=1)
    assert again == [(0, 1, 1, 15), (0, 1, 1, 15)]
    assert run(spark, [(0, [7])]) == []


def test_null_and_empty(spark):
    df = spark.createDataFrame(
        [(0, [0.5, 1.0]), (1, [float("nan"), 1.0]), (2, None), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (5, [-0.001, 0.25]), (None, [1.0, 1.0])],
        "vec_id long, e array<float>",
    )
    vector = F.when(topk.valid(F.col("e")), topk.scaled(F.col("e")))
    got = topk.top_k(df, "vec_id", vector, F.lit(True)).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 5, 128 * -1 + 256 * 64), (5, 1, 0, 128 * -1 + 256 * 64)]
    assert topk.top_k(df.limit(0), "vec_id", vector, F.lit(True)).count() == 0
    assert topk.top_k(df, "vec_id", vector, F.lit(False)).count() == 0
