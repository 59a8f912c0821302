"""Piece ids and decoded texts equal to the library's, on texts of all kinds and on the whole small table."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.llm import pieces
from lumenframe.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MERGER = pieces.Merger(pieces.read_model(PATH))


def same(texts):
    for text, data, ids in zip(texts, MERGER.encode(texts), LIBRARY.encode([t or "" for t in texts], num_threads=1)):
        assert np.frombuffer(data, dtype="<i4").tolist() == ids, text
        assert MERGER.decode(ids) == LIBRARY.decode(ids), text


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\t\n\x00aAthein.é日本"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text(text):
    same([text])


def test_long_words_and_runs():
    rng = random.Random(5)
    letters = ["abcdeilnorst", "ab", " a", "  ", "qwertz▁", "éè日本語ไทย😀"]
    same(["".join(rng.choice(a) for _ in range(rng.randrange(400))) for a in letters for _ in range(60)])
    same([None, "", " ", "x" + " " * 4000 + "y", "a" * 3000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))])


def test_forgetting_words(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    own = pieces.Merger(MERGER.vocabulary)
    texts = [f"the word{i} and the word{i + 1} of the end" for i in range(50)]
    for _ in range(2):
        for text in texts:
            assert np.frombuffer(own.encode([text])[0], dtype="<i4").tolist() == LIBRARY.encode(text)
    assert len(own.known) <= 16 and len(own.older) <= 16


def test_single_merges_where_ranks_go_backwards():
    """A union that brings up an earlier pair takes its symbols before a second place of its own rank does."""
    names = ["<unk>", "ab", "cab", "abc", "a", "b", "c"]
    kinds = [pieces.UNKNOWN, *[pieces.NORMAL] * 6]
    scores = np.array([0, -3, -1, -2, -9, -9, -9], dtype=np.float32)
    own = pieces.Merger(pieces.Vocabulary(names, kinds, scores, 0, False, False))
    for limit in (64, 1):
        pieces.LONG_PART, before = limit, pieces.LONG_PART
        for word in ("abcab", "abcabcab", "cabab", "ababc", "abxycab", "xx"):
            symbols, rank = list(word), dict(zip(names, -scores))
            while True:
                found = [(rank[x + y], i) for i, (x, y) in enumerate(zip(symbols, symbols[1:])) if x + y in rank]
                if not found:
                    break
                i = min(found)[1]
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            ids = [names.index(s) if s in names else 0 for s in symbols]
            ids = [x for i, x in enumerate(ids) if x or not i or ids[i - 1]]  # a run of unknown symbols is one
            assert np.frombuffer(own.merge([word])[0], dtype="<i4").tolist() == ids, word
        pieces.LONG_PART = before


@pytest.mark.parametrize("ids", [[227], [229, 133], [195, 178, 260], [1, 28705, 28705, 2], [0, 5], [229, 133, 175, 28705], [240, 163, 131], []])
def test_decoding_any_ids(ids):
    assert MERGER.decode(ids) == LIBRARY.decode(ids)


def test_other_models_are_refused(tmp_path):
    (tmp_path / "unigram").write_bytes(b"\x0a\x07\x0a\x05<unk>\x12\x02\x18\x01\x1a\x04\x18\x01\x20\x00")
    with pytest.raises(ValueError):
        pieces.read_model(str(tmp_path / "unigram"))


def test_odd_rows(spark):
    rows = [(1, "Hello  wörld", "x"), (1, "Hello  wörld", "x"), (None, None, "x"), (3, "", "x"), (4, "Längs " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["ids"], r["decoded"]) for r in out) == sorted((i or 0, LIBRARY.encode(t or ""), t or "") for i, t, _ in rows)
    assert pieces.decode(pieces.encode(docs.limit(0), PATH), PATH).collect() == []


def test_query(spark, sf):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = LIBRARY.encode(r["text"] or "")
        expected.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    found = QUERIES["op12_piece_codec"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(expected)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.one_of(st.sampled_from(" ▁\n\n\x00aAthein.é日本"), st.characters(exclude_categories=["Cs"])), max_size=40)), max_size=6))
def test_columns_as_rows(texts):
    """Whole columns, sliced ones too, give what the library gives row by row."""
    found = MERGER.encode_column(pa.array(["x", *texts], pa.string()).slice(1))
    ids = [np.frombuffer(x, dtype="<i4").tolist() for x in found]
    assert ids == [LIBRARY.encode(t or "") for t in texts]
    assert MERGER.decode_column(pa.array([[5], *ids], pa.list_(pa.int32())).slice(1)) == [LIBRARY.decode(x) for x in ids]


def test_columns_of_any_ids():
    rows = [[229], [133], [195, 178, 260], [1, 28705, 28705, 2], [229, 1, 133, 175], None, [0, 5], [229, 133, 175, 28705], [240, 163, 131], []]
    assert MERGER.decode_column(pa.array(rows, pa.list_(pa.int32()))) == [LIBRARY.decode(x or []) for x in rows]
