"""Near duplicates against comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import components as stars
from lumenframe.llm import neardup
from lumenframe.llm.components import components
from lumenframe.llm.queries import QUERIES


def shingles(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(((doc, len(sets[i]), low[find(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def run(spark, rows, width=4, percent=80):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("class", F.lit(1))
    got = neardup.near_duplicates(df.repartition(4), width=width, percent=percent).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    """Chains of edits, a passage that many share, and copies."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(25):  # most of the text is one passage
        texts.append(passage + [word() for _ in range(rnd.randint(3, 30))])
    base = [word() for _ in range(120)]
    for _ in range(40):  # a walk of small edits away from a base
        base = list(base)
        base[rnd.randrange(len(base))] = word()
        texts.append(base)
        texts.append(list(base) if rnd.random() < 0.3 else base + [word()])
    texts += [[word() for _ in range(rnd.randint(1, 60))] for _ in range(30)]
    rows = [(1000 - i, " ".join(t)) for i, t in enumerate(texts)]
    assert run(spark, rows) == brute(rows, 4, 80)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, long), (8, long + " x"), (9, "É a b c"), (10, "é a b c"),
            (None, "one two"), (None, None), (4, "one two")]
    got = run(spark, rows)
    assert got == brute(rows, 4, 80)
    assert run(spark, []) == []


def test_one_of_each_group_stays(spark):
    text = "a b c d e f g"
    rows = [(1, text, "x"), (1, text, "x"), (2, text, "y"), (None, text, "z"), (3, "", "w"), (3, "", "w"), (4, None, "v"), (5, "else entirely", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, neardup.keep_one(df).collect()), key=str)
    assert got == sorted([(1, text, "x"), (3, "", "w"), (3, "", "w"), (4, None, "v"), (5, "else entirely", "u")], key=str)


def test_groups_under_null_ids_or_one_id_are_apart(spark):
    one, two = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    rows = [(None, one), (None, two), (None, two), (None, "third text here"), (7, one.upper() + " y z"), (7, "quite another text"), (7, "quite another text"), (8, "quite another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, neardup.keep_one(df).collect()), key=str)
    assert got == sorted([(None, two), (None, "third text here"), (7, rows[4][1]), (7, "quite another text")], key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (200, 200)]
    rnd = random.Random(0)
    rnd.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}

def test_components_stop_at_stars(spark, monkeypatch):
    """Links that are stars around their smallest nodes take no round, others none more than they need."""
    written, settle = [], stars.settle
    monkeypatch.setattr(stars, "settle", lambda frame: written.append(settle(frame)) or written[-1])
    cases = [
        ([(9, 1), (1, 5), (4, 2), (2, 2)], {9: 1, 5: 1, 1: 1, 4: 2, 2: 2}, 2),
        ([], {}, 2),
        ([(5, 1), (5, 2), (5, 3), (7, 6)], {5: 1, 1: 1, 2: 1, 3: 1, 7: 6, 6: 6}, 4),
    ]
    for edges, group, most in cases:
        written.clear()
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert sorted((r["node"], r["component"]) for r in got) == sorted(group.items())
        assert len(written) <= most



def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op9_tensored_minhash"](spark, sf).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(docs, 4, 80)


def test_signatures_hold_little_memory(spark):
    """Arrays of a worker are for a group of texts at a time, far below a batch of texts."""
    import tracemalloc

    import pyarrow as pa

    class Rows:
        dtypes = [("doc_id", "bigint")]

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    texts = [" ".join(f"w{(i * 7919 + k * k) % 50021}" for k in range(1000)) for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    run = neardup.signatures(Rows(), "doc_id", "text", 5)
    tracemalloc.start()
    try:
        assert sum(out.num_rows for out in run(iter([batch]))) == 400
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 20 << 20
