"""Sketches against exact sets."""

import hashlib

from pyspark.sql import functions as F

from lumenframe.llm import fingerprint as fp
from lumenframe.llm.queries import QUERIES


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_estimates_and_merging(spark):
    a = " ".join(f"w{i}" for i in range(3000))
    b = " ".join(f"w{i}" for i in range(1000, 4000))
    rows = [(a, b, " ".join(f"w{i}" for i in range(2000)), " ".join(f"w{i}" for i in range(1996, 3000)))]
    df = spark.createDataFrame(rows, "a string, b string, left string, right string")
    s = {c: fp.sketch(F.col(c), 512) for c in df.columns}
    r = df.select(
        fp.resemblance(s["a"], s["b"], 512).alias("r"), fp.containment(s["a"], s["b"], 512).alias("c"),
        fp.distinct_shingles(s["a"], 512).alias("n"), (fp.merge(s["left"], s["right"], 512) == s["a"]).alias("merged"),
        (fp.from_text(fp.to_text(s["a"])) == s["a"]).alias("text"),
    ).first()
    x, y = shingles(a), shingles(b)
    assert abs(r["r"] - len(x & y) / len(x | y)) < 0.08 and abs(r["c"] - len(x & y) / len(x)) < 0.09
    assert abs(r["n"] / len(x) - 1) < 0.15 and r["merged"] and r["text"]


def test_edges(spark):
    texts = [None, "", "  \n", "One two", "one TWO", "a b c d e", "été " * 30_000, "x" * 100_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, sketch string")
    got = {r["doc_id"]: r["sketch"] for r in fp.fingerprints(df).collect()}
    assert got[0] == got[1] == got[2] == [] and got[3] == got[4] and len(got[3]) == 1
    assert len(got[5]) == 1 and len(got[6]) == 1 and len(got[7]) == 1
    pair = spark.createDataFrame([([], []), ([], [1])], "a array<long>, b array<long>")
    assert [r[0] for r in pair.select(fp.resemblance(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]


def test_next_row_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 7)
    monkeypatch.setattr(fp, "COARSE", 3)
    ids = [*range(0, 90, 3), None, 5000, 41, 41]
    df = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(ids)], "doc_id long, text string").repartition(5)
    got = fp.with_next(df, "doc_id", ["text"]).collect()
    order = sorted(zip(ids, (f"t{i}" for i in range(len(ids)))), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {order[i][1]: order[(i + 1) % len(order)][1] for i in range(len(order))}
    assert {r["text"]: r["next_text"] for r in got} == want and len(got) == len(ids)
    assert fp.with_next(df.limit(0), "doc_id", ["text"]).count() == 0
    one = fp.with_next(df.where("doc_id = 5000"), "doc_id", ["text"]).collect()
    assert one[0]["next_text"] == one[0]["text"]


def test_query_against_plain_python(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: -r["doc_id"])
    texts = [r["text"] or "" for r in docs]
    got = {r["doc_id"]: r for r in QUERIES["op7_bottom_k_fingerprints"](spark, sf).collect()}
    off = []
    for i, r in enumerate(docs):
        own, following, g = texts[i], texts[(i + 1) % len(texts)], got[r["doc_id"]]
        third = len(own) // 3
        edited = own[: len(own) - third] + following[:third]
        assert g["n_chars"] == len(own) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        x, y = shingles(own), shingles(edited)
        off.append(abs(g["near_edited"] - (len(x & y) / len(x | y) if x | y else 1.0)))
        assert 0 <= g["near_next"] <= 1
    assert max(off) < 0.25 and sum(off) / len(off) < 0.04
    same = {}
    for r, t in zip(docs, texts):
        assert same.setdefault(t, got[r["doc_id"]]["fingerprint"]) == got[r["doc_id"]]["fingerprint"]
