"""Packing: the plan against plain best fit and small optima, tokens against the tokenizer, places without gaps."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lumenframe.llm import packing
from lumenframe.llm.queries import QUERIES

TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def fewest(items, capacity):
    """Fewest sequences, by search over sets of used room."""
    level = {(): 0}
    for x in sorted(items, reverse=True):
        after = {}
        for rooms in level:
            for i, r in enumerate(rooms):
                if r >= x:
                    after[tuple(sorted(rooms[:i] + (r - x,) + rooms[i + 1 :]))] = 0
            after[tuple(sorted(rooms + (capacity - x,)))] = 0
        level = after
    return min(map(len, level))


def test_dominant_sets_never_cost_a_sequence():
    rnd = random.Random(9)
    for _ in range(400):
        capacity = rnd.choice([10, 13, 20])
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 8))]
        counts = {x: items.count(x) for x in items}
        fixed, left = packing.dominant_sets(counts, capacity)
        rest = [w for w, n in left.items() for _ in range(n)]
        assert sorted(rest + [w for lengths, n in fixed for w in lengths * n]) == sorted(items)
        assert sum(n for _, n in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity)


def test_plan_fills_every_place_once():
    rnd = random.Random(1)
    for _ in range(500):
        capacity = rnd.choice([10, 17, 32, 100])
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 60))]
        counts = {x: items.count(x) for x in items}
        runs, n = packing.plan(counts, capacity)
        held, numbers = {}, {}
        for w, first, until, per, sequence, offset in runs:
            for r in range(first, until):
                numbers.setdefault(w, []).append(r)
                held.setdefault(sequence + (r - first) // per, []).append((offset + (r - first) % per * w, w))
        assert {w: sorted(v) for w, v in numbers.items()} == {w: list(range(k)) for w, k in counts.items()}
        assert sorted(held) == list(range(n))
        for places in held.values():
            at = 0
            for offset, w in sorted(places):
                assert offset == at
                at += w
            assert at <= capacity
        room = []
        for x in sorted(items, reverse=True):
            fits = [b for b in room if b[0] >= x]
            if fits:
                min(fits)[0] -= x
            else:
                room.append([capacity - x])
        assert n <= len(room) + 1


def test_ids_equal_the_tokenizer():
    full, own = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER, RANKS)
    rnd = random.Random(3)
    alphabet = list(" \n\t  ab'sé  \u0085\x1c漢ÿʰ²½🙂1,.") + ["<|endoftext|>", " the", " don't", "\r\n", " é", "\xa0", "\xad"]
    for _ in range(4000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == full.encode(text, add_special_tokens=False).ids


def test_documents_round_trip(spark):
    texts = [None, "", "one two", "word " * 9000, "one two", "été " * 700, "x" * 30_000]
    docs = spark.createDataFrame([(i // 2 if i else None, t, i) for i, t in enumerate(texts)], "doc_id int, text string, length int")
    got = packing.pack(docs, TOKENIZER, RANKS).collect()
    full = Tokenizer.from_file(TOKENIZER)
    want = sorted(full.encode(t or "", add_special_tokens=False).ids + [0] for t in texts)
    seen = {}
    for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["piece"])):
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] <= 2048 and (r["piece"] == 0 or r["length"] == 2048)
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seen.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    # Ids repeat here, so all ids together are compared.
    assert sum(r["length"] for r in got) == sum(map(len, want))
    assert sorted(i for r in got for i in np.frombuffer(bytes(r["ids"]), "<u4").tolist()) == sorted(i for w in want for i in w)
    assert packing.pack(docs.limit(0), TOKENIZER, RANKS).count() == 0


def test_query(spark, sf):
    rows = QUERIES["op5_best_fit_packing"](spark, sf).collect()
    full = Tokenizer.from_file(TOKENIZER)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(texts)
    for doc, pieces in by.items():
        ids = np.array(full.encode(texts[doc] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for number, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (number, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 2048) + 2
