"""Phrases against plain counting, for budgets that split prefixes once, twice and not at all."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import collocation, wordhash

KIND = "doc_id long, text string, lang string, phrase string, n string, code string"


def brute(rows, min_count, share=50, top=2000):
    counts, sizes = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for size in (1, 2, 3):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        scored = []
        for p, a in f.items():
            if len(p) == 1 or a < min_count:
                continue
            if any(len(q) > len(p) and b >= min_count and 100 * b >= share * a and p in (q[:2], q[1:]) for q, b in f.items()):
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


ROWS = [
    (1, "New York is big. New York is far, new\tyork is  BIG\x0bnew york", "en", "p", "q", "r"),
    (1, "New York is big. New York is far, new\tyork is  BIG\x0bnew york", "en", "p", "q", "r"),
    (2, "a a a a a a a a b a b", None, "p", "q", "r"), (3, "a a b", "und", "p", "q", "r"), (4, None, "en", "p", "q", "r"), (5, "", None, "p", "q", "r"),
    (None, "über den Berg über den Berg über den Berg", "de", "p", "q", "r"), (6, "the cat the dog the cat the dog " * 3000, "de", "p", "q", "r"),
    (7, " ,;. \n", "en", "p", "q", "r"), (8, "x y z x y", "", "p", "q", "r"), (9, "x y x y", "", "p", "q", "r"),
]


@pytest.mark.parametrize("budget", [4, 40, 1_000_000])
def test_like_plain_counting(spark, budget):
    docs = spark.createDataFrame(ROWS, KIND)
    for min_count, top in ((2, 2000), (3, 2)):
        found = collocation.collocations(docs, min_count=min_count, top=top, budget=budget)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, found.collect())) == brute(ROWS, min_count, top=top)


def test_empty_table(spark):
    assert collocation.collocations(spark.createDataFrame([], KIND)).collect() == []
    assert collocation.collocations(spark.createDataFrame(ROWS[-2:-1], KIND)).collect() == []


def test_slices_of_a_long_text(spark, monkeypatch, sf):
    """Suffixes reach across the slices in which tokens are handled, and across what a task sends at once."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    monkeypatch.setattr(collocation, "SLICE_TOKENS", 7)
    monkeypatch.setattr(collocation, "HELD", 500)
    monkeypatch.setattr(collocation, "GROUP_BYTES", 3000)
    assert sorted(map(tuple, collocation.collocations(docs, min_count=5, budget=3000).collect())) == brute(rows, 5)


def test_codes_that_collide_are_drawn_again(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, KIND)
    plain = wordhash.words

    def weak(texts, salt=0):
        w = plain(texts, salt)
        return w if salt else w._replace(hashes=w.hashes % 3)

    monkeypatch.setattr(wordhash, "words", weak)
    words, salt = collocation.count_words(docs)
    assert salt == 1 and words.groupBy("code").count().where("count > 1").isEmpty()


def test_score_is_exact(spark):
    cases = [(10, 10, 10), (10**14 + 7, 10**14 + 9, 10**14 + 7), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999), (7, 9, 11)]
    found = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", collocation.score("a", "l", "r").alias("s"))
    for r in found.collect():
        assert r["s"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"])
    assert dict(found.dtypes)["s"] == "bigint"


def test_bit_maps_hold_all_codes(spark):
    codes = spark.range(-5000, 5000).select((F.col("id") * 7919).alias("code"))
    import numpy as np

    bits = collocation._bit_map(codes, 1 << 12)
    assert collocation._marked(bits, (np.arange(-5000, 5000) * 7919).astype(np.int64).view(np.uint64)).all()
