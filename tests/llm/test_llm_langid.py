"""Language identification: held-out accuracy, pieces of long texts, edge cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import langid
from lumenframe.llm.queries import QUERIES

ENGLISH = "the cat sat on the mat and looked at the old house with the green door"
GERMAN = "der hund lief über die wiese und sah das alte haus mit der grünen tür"


def model(spark):
    rows = [(ENGLISH, "en"), (GERMAN, "de"), (ENGLISH, None), (None, "fr")]
    return langid.train(spark.createDataFrame(rows, "text string, lang string"), F.col("text"), F.col("lang"))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op4_language_id"](spark, sf).join(docs, "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark):
    m = model(spark)
    assert m.languages == ["de", "en"]
    texts = [None, "", "12 .. 34", "the house", "die tür", "the house " * 60_000]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id int, text string, score int").withColumn("to", F.lit(1))
    got = {r["id"]: (r["lang_pred"], r["score"], r["to"]) for r in langid.identify(docs, m).collect()}
    assert [got[i][0] for i in range(6)] == ["und", "und", "und", "en", "de", "en"]
    assert got[0][1] == 0 and got[5][1] > 0.99 and got[3][2] == 1
    assert langid.identify(docs.limit(0), m).count() == 0


def test_no_training_rows(spark):
    docs = spark.createDataFrame([("a", None)], "text string, lang string")
    m = langid.train(docs, F.col("text"), F.col("lang"))
    assert langid.identify(docs, m).collect()[0]["lang_pred"] == "und"


def plain_grams(text):
    """Buckets of a text's n-grams, one by one."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    while "  " in letters:
        letters = letters.replace("  ", " ")
    points = np.array([ord(c) for c in " " + (letters[1:] if letters.startswith(" ") else letters) + ("" if letters.endswith(" ") else " ")], dtype=np.uint32)
    return [int(langid._gram_hashes(points[i : i + n], n, langid.BUCKETS)[0]) for n in range(1, langid.MAX_N + 1) for i in range(len(points) - n + 1)]


def plain_bayes(training, texts):
    """Naive Bayes with dictionaries: log odds per language."""
    grams, docs = {}, Counter()
    for text, lang in training:
        grams.setdefault(lang, Counter()).update(plain_grams(text))
        docs[lang] += 1
    out = []
    for text in texts:
        odds = {}
        for lang in sorted(grams):
            size = sum(grams[lang].values()) + 0.5 * langid.BUCKETS
            odds[lang] = math.log(docs[lang] / len(training)) + sum(math.log((grams[lang][g] + 0.5) / size) for g in plain_grams(text))
        out.append(odds)
    return out


@pytest.mark.parametrize("labels, per_slice", [(3, 128), (7, 2), (300, 128)])
def test_like_plain_bayes_in_any_slices(spark, labels, per_slice):
    """Any number of labels, null ones left out, in slices of any size; labels that sort oddly among them."""
    rng = random.Random(labels)
    alphabets = ["abcde fgh", "nopq rstéü", "αβγδ ε", "a-1 b.c", "xyz"]
    names = ["", "Z", "a", "é", "zz", "日本", "𐀀"] + [f"l{i}" for i in range(labels)]
    training = [("".join(rng.choice(alphabets[i % 5]) for _ in range(40)) + names[i], names[i]) for i in range(labels) for _ in range(2)]
    docs = spark.createDataFrame([*training, (None, "a"), ("abc", None)], "text string, lang string")
    models = langid.train(docs, F.col("text"), F.col("lang"), per_slice=per_slice)
    assert models.languages == sorted({n for _, n in training}) and len(models.slices) == -(-labels // per_slice)
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(30)) + "q" for _ in range(12)] + ["a", "B -- b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    found = [(r["lang_pred"], r["score"]) for r in langid.identify(rows, models).orderBy("id").collect()]
    for (name, score), odds in zip(found, plain_bayes(training, texts), strict=True):
        best = max(odds.values())
        assert odds[name] > best - 1e-3  # the table has single precision
        assert score == pytest.approx(1 / sum(math.exp(x - best) for x in odds.values()), abs=1e-3)


def test_pieces_hold_every_gram_once(monkeypatch):
    texts = ["Ein Satz, mit 3 Zahlen; und noch einer! " * 30, "a", "kurz " * 9, "ab" * 200]
    for size in (1 << 18, 50, 7):
        monkeypatch.setattr(langid, "SLICE", size)
        found = [[] for _ in texts]
        for points, text, starts, owned in langid._batches(texts):
            for h, sizes in langid._grams(points, starts, owned, langid.BUCKETS):
                for i, g in zip(np.repeat(text, sizes).tolist(), h.tolist(), strict=True):
                    found[i].append(g)
        assert [sorted(f) for f in found] == [sorted(plain_grams(t)) for t in texts]
