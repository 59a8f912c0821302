"""Line templates: what recurs goes but for its first occurrence, variable fields included."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from lumenframe.llm import lines

LEGAL = "Copyright held by {} and others, all rights are reserved worldwide today"


def run(spark, rows, **settings):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    return lines.drop_recurring_lines(df, **settings).collect()


def test_variable_fields_are_generalised(spark):
    names = ["Anna", "Bert", "Cleo", "Dora"]
    rows = [(i, f"own words of document {'abcd'[i]} {'efgh'[i]}\n" + LEGAL.format(n), "x") for i, n in enumerate(names)]
    rows += [(9, "Copyright held by nobody at all, these words differ from the others in most", "x")]
    got = {r["doc_id"]: (r["text"].count("\n") + 1, r["n_lines"], r["n_dropped"]) for r in run(spark, rows)}
    assert got == {0: (2, 2, 0), 1: (1, 2, 1), 2: (1, 2, 1), 3: (1, 2, 1), 9: (1, 1, 0)}


def test_numbers_are_fields_and_two_documents_are_not_enough(spark):
    rows = [(i, f"Page {i} of 20 in this book\nshort\nsame words in two only {'ab'[i % 2] if i < 2 else 'zyx'[i - 2]}", "x") for i in range(4)]
    got = {r["doc_id"]: r["text"] for r in run(spark, rows, constant=1.0)}
    assert got[0].startswith("Page 0 of 20\nshort".replace("20", "20 in this book")) and got[3] == "same words in two only y"
    two = run(spark, [(0, "exactly the same line here", None), (1, "exactly the same line here", None)])
    assert all(r["n_dropped"] == 0 for r in two)


def test_repeats_inside_nulls_and_long(spark):
    line = "a passage that three documents share word for word"
    long = "\n".join(f"{w}{w} unique{w} line{w} number{w} here{w}" for w in ("".join(chr(97 + int(c)) for c in str(i)) for i in range(20_000)))
    rows = [(None, line, "x"), (1, line + "\n" + line, "x"), (2, long + "\n" + line, "x"), (3, None, "x"), (4, "", "x"), (2, "other text\n\n" + line, "x"), (5, line, "x"), (5, line, "x")]
    got = run(spark, rows)
    assert len(got) == 8
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["text"], r["n_lines"], r["n_dropped"]))
    assert by[1] == [(line, 2, 1)]  # the first occurrence stays, once
    assert by[None] == [("", 1, 1)] and by[3] == [(None, 0, 0)] and by[4] == [("", 1, 0)]
    assert by[5] == [("", 1, 1)] * 2
    assert sorted(t[0] for t in by[2]) == sorted([long, "other text\n"])


def test_short_lines_and_long_ones(spark):
    """Short lines count as they are; a long one recurs from two documents on, if it is equal but for white space."""
    passage = " ".join(f"{a}{b}" for a in "abcde" for b in "klmnopqrst")
    rows = [(i, f"own words {'abc'[i]} here {'xyz'[i]}\nAll rights reserved.\nPage {i}\n{p}", "x") for i, p in enumerate([passage, passage.replace(" ", "  "), passage + " 8"])]
    got = {r["doc_id"]: r["text"] for r in run(spark, rows)}
    assert got == {0: rows[0][1], 1: "own words b here y\nPage 1", 2: f"own words c here z\nPage 2\n{passage} 8"}


def test_copies_count_as_one_document(spark):
    """Lines that only copies share stay in all of them; lines shared beyond go from all but the first document's copies."""
    rows = [(i, f"{'one two three four five' if i < 3 else f'''other text {'uvw'[i - 3] * 3} here'''}\nshared line of them all\nshared line of them all", None) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    copies = docs.where("doc_id < 3").selectExpr("doc_id as doc", "xxhash64(text) as hash", "7L as component")
    got = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(docs, copies=copies).collect()}
    assert all(got[i] == "one two three four five\nshared line of them all" for i in range(3))
    assert all(got[i] == f"other text {'uvw'[i - 3] * 3} here" for i in range(3, 6))


def test_empty_table(spark):
    assert run(spark, []) == []


def test_pipeline_drops_short_lines(spark):
    """Lines below four tokens count, as they are: a number in them is no field."""
    own = ["alpha beta gamma delta", "one red house stood", "nobody came at noon", "so it went on"]
    rows = [(i, f"{w}\nAll rights reserved.\n\nLes.\nPage {i}\n{i}", "en", "s", 1) for i, w in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.drop_lines(spark, docs, "").collect()}
    assert got[0] == (rows[0][1], 1)
    for i in (1, 2, 3):
        text = f"{own[i]}\n\nPage {i}\n{i}"
        assert got[i] == (text, len(text))


def test_pipeline_drops_long_lines_of_two_documents(spark):
    """Equal but for white space; a long line that differs in a number, a short one, or a repeat in one document only stays."""
    passage = " ".join(f"{a}{b}" for a in "abcde" for b in "klmnopqrst")
    almost, only = passage + " 7", passage.replace("a", "x")
    rows = [(0, f"first own words here\n{passage}\na line of two documents", "en", "s", 1),
            (1, f"second text of its own\n{passage.replace(' ', '  ')}\na line of two documents\n{almost}", "en", "s", 1),
            (2, f"third with a number\n{passage} 8\n{only}\n{only}", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in cp.drop_lines(spark, docs, "").collect()}
    assert got == {0: rows[0][1], 1: f"second text of its own\na line of two documents\n{almost}", 2: rows[2][1]}


def test_lines_are_parsed_once(spark):
    """Tokens are counted without a list of them and white space is replaced in one place; white space of all kinds is single in the end."""
    texts = ["a b", " a b", "a b ", "a  b", "a\tb", "a\r", "\x0b", " ", "", "a\u00a0b c\u2028", "x \u2028", "é 1 b\x0cc 22", "w " * 60, "w\t" * 60, "a b c d", "a b c 4d"]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate([*texts, "\n".join(texts)])], "doc long, text string, hash long")
    parsed = lines._lines(rows, 1, 3, 50)
    want = []
    for i, t in enumerate([*texts, "\n".join(texts)]):
        for pos, line in enumerate(t.split("\n")):
            words = re.findall(r"[^\x20\x09-\x0D]+", line)
            masked = [lines.FIELD if len(words) >= lines.FIELD_TOKENS and re.search("[0-9]", w) else w for w in words]
            want += [(i, pos, len(words), " ".join(masked), len(words) >= 50)] * bool(words)
    got = parsed.select("doc", "pos", "tokens", "masked", F.col("own").isNotNull()).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert parsed.where("tokens = 60").select("own").distinct().count() == 1
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "regexp_count" not in plan and plan.count("regexp_replace(line") == 1
