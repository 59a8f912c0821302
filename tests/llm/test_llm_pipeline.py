"""The pipeline stage by stage on the small tables, and on rows with nulls, repeats and extra columns."""

import corpus_pipeline as cp
from lumenframe.llm.queries import ORACLE, QUERIES
from lumenframe.session import settle


def test_registered_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in (1, 2, 4, 5, 3, 7, 8, 10, 9, 6, 11, 12, 13)]
    assert set(ORACLE) <= set(QUERIES) and cp.QUERIES["pipeline"] is cp.run


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = settle(stage(spark, docs, sf))
        assert docs.columns == cp.COLUMNS, name
        if name in ("language", "lines"):
            assert docs.count() >= 0.95 * before, name
    packed = cp.STAGES[-1][1](spark, docs, sf).collect()
    words = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in packed} == words
    assert max(r["offset"] + r["length"] for r in packed) <= 2048


def test_odd_rows(spark, sf):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(1, text, "en", "a", 5, "x"), (1, text, "en", "a", 5, "x"), (2, None, "en", None, None, "x"), (None, "hallo welt und alle", "de", "b", 1, "x"),
            (3, "", None, None, 0, "x"), (4, "12 34", "en", "a", 5, "x"), (5, "wort " * 20_000, "de", "b", 1, "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies string")
    for docs in (odd, odd.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            docs = settle(stage(spark, docs, sf))
        packed = cp.STAGES[-1][1](spark, docs, sf).collect()
        assert not {2, 3, 4} & {r["doc_id"] for r in packed}


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_near_duplicates_are_found_after_line_dedup(spark):
    """What the rule finds in the raw texts, by brute force, goes; and copies don't empty each other."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*cp.COLUMNS)
    raw = {r["doc_id"]: shingles(r["text"].lower()) for r in rows.collect()}
    group = {i: i for i in raw}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    posted = {}
    for i, own in raw.items():
        for s in own:
            posted.setdefault(s, []).append(i)
    pairs = {(a, b) for ids in posted.values() for x, a in enumerate(ids) for b in ids[x + 1 :]}
    for a, b in pairs:
        if 100 * len(raw[a] & raw[b]) >= 80 * len(raw[a] | raw[b]):
            group[max(root(a), root(b))] = min(root(a), root(b))
    redundant = sum(group[i] != i for i in raw)
    cleaned = settle(cp.drop_lines(spark, rows, ""))
    left = cp.drop_near_duplicates(spark, cleaned, "")
    kept = [root(r["doc_id"]) for r in left.collect()]
    again = len(kept) - len(set(kept))
    assert redundant > 50 and again <= 0.1 * redundant
    assert len({root(i) for i in raw} - set(kept)) <= 0.005 * len(raw)  # texts that were alike but for a shared line
    assert cleaned.where("trim(text) = ''").count() <= rows.where("trim(text) = ''").count()
