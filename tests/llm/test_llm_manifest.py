"""Roots, proofs and verification against a plain computation."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import manifest
from lumenframe.llm.queries import QUERIES

KIND = "doc_id long, source string, lang string, n_chars long, text string, tree string, place string, hash string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows, fanout=8):
    """(row, tampered leaf) -> leaf, subroot, root, proof digest, folded root, computed one leaf at a time."""

    def tree(nodes):
        """Root and for each node the list of (place, siblings) to it."""
        paths = [[] for _ in nodes]
        above = list(range(len(nodes)))  # node of the present level over each leaf
        while len(nodes) > 1:
            for leaf, at in enumerate(above):
                run = nodes[at - at % fanout : at - at % fanout + fanout]
                paths[leaf].append((at % fanout, run[: at % fanout] + run[at % fanout + 1 :]))
            nodes = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
            above = [at // fanout for at in above]
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in order:
        made = sorted(((r[0] is not None, r[0] or 0), digest("".join(map(field, r[:5]))), r) for r in groups[k])
        trees[k] = (made, *tree([m[1] for m in made]))
    root, tops = tree([trees[k][1] for k in order])
    out = []
    for k, top in zip(order, tops):
        made, subroot, paths = trees[k]
        for (_, leaf, r), path in zip(made, paths):
            path = path + top
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            own = digest("".join(map(field, [*r[:4], text])))
            for at, others in path:
                own = digest("".join(others[:at] + [own] + others[at:]))
            proof = digest("".join("".join(others) for _, others in path))
            out.append((r[0], leaf, subroot, root, proof, own, own == root))
    return sorted(out, key=str)


def run(docs, **settings):
    presented = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, manifest.lowered()).otherwise(
        manifest.leaf([F.col(c) for c in manifest.FIELDS])
    )
    out = manifest.manifest(docs, presented=presented, **settings)
    proof = F.sha2(F.array_join("siblings", ""), 256).alias("proof")
    return sorted(map(tuple, out.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified").collect()), key=str)


ODD = [
    (1, "a", "en", 3, "Abc", "x", "y", "z"), (1, "a", "en", 3, "Abc", "x", "y", "z"), (1, "a", "en", 4, "other", "x", "y", "z"),
    (None, None, None, None, None, None, None, None), (None, "b", "en", 0, "", "x", "y", "z"), (3, "", "", 1, "Äé ABC" * 9000, "x", "y", "z"),
    (4, "a", "é", 1, "solo", "x", "y", "z"), (5, "a", "z", 1, "SOLO", "x", "y", "z"),
]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_stages_of_any_height(spark, levels):
    """With few levels per superblock small trees go through several stages, up and down."""
    rows = [(i, "s", "en" if i % 5 else "de", i, f"Text {i}", "", "", "") for i in range(700)] + ODD
    rows += [(1000 + i, "s", f"l{i}", 1, "x", "", "", "") for i in range(20)]  # more groups than a node has children
    assert run(spark.createDataFrame(rows, KIND), levels=levels) == brute(rows)


def test_odd_rows_and_empty_table(spark):
    docs = spark.createDataFrame(ODD, KIND)
    assert run(docs) == brute(ODD)
    assert run(docs.limit(0)) == []
    assert run(docs.where("doc_id = 5")) == brute([ODD[-1]])  # a lone leaf is the root


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*manifest.FIELDS).collect()]
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = QUERIES["op11_merkle_manifest"](spark, sf).select(*columns).collect()
    expected = brute(rows)
    assert sorted(map(tuple, found), key=str) == expected
    assert {r[-1] for r in expected} == {True, False}
