"""JSON documents in splits of any size."""

import json
import random

import pytest

from lumenframe.sources import json_documents, readers
from tests.test_delimited import small_splits  # noqa: F401

PLAIN = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]


def made(n, seed):
    rng = random.Random(seed)
    parts = ["a", "}", "{", '"', "\\", "],", "[", "é", "\n", ':"', ",", '\\"']
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
    return [{"id": i, "t": text(), "n": {"x": rng.random(), "l": [i, {"k": text()}]}, "f": rng.choice([None, True, 1.5])} for i in range(n)]


def plain(rows):
    return sorted(((r["id"], r["t"], r["n"]["x"], r["n"]["l"][0], json.loads(r["n"]["l"][1])["k"]) for r in rows), key=str)


def expected(rows):
    return sorted(((r["id"], r["t"], r["n"]["x"], str(r["n"]["l"][0]), r["n"]["l"][1]["k"]) for r in rows), key=str)


@pytest.mark.parametrize("size, indent", [(83, None), (300, 2)])
def test_records_whatever_the_splits(spark, tmp_path, small_splits, size, indent):  # noqa: F811
    rows = made(24, 3)
    shapes = {
        "array": rows,
        "wrapper": {"status": "ok", "note": {"deep": {"x": [{"id": -1}]}}, "tags": [1, 2], "results": rows, "other": [{"id": -2}], "n": 3},
    }
    small_splits(size)
    for name, doc in shapes.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(doc, indent=indent, ensure_ascii=False))
        df = readers.read_json(spark, str(path))
        assert plain(df.collect()) == expected(rows), name
        assert df.count() == df.select("id").count() == 24


@pytest.mark.parametrize("size", [150, 1 << 27])
def test_columns_whatever_the_splits(spark, tmp_path, small_splits, size):  # noqa: F811
    rng = random.Random(4)
    n = 20
    doc = {
        "num": [rng.choice([i, None, i + 0.5]) for i in range(n)], "txt": [rng.choice(['a,"b"', "]}", "x", "", None, '"k":[1']) for _ in range(n)],
        "nested": [[i, i + 1] for i in range(n)], "none": [None] * n, "obj": [{"k": [i], "s": "}"} for i in range(n)],
    }
    path = tmp_path / "c.json"
    path.write_text(json.dumps(doc, indent=1 if size == 150 else None))
    small_splits(size)
    rows = readers.read_json(spark, str(path)).collect()
    found = sorted(((r["obj"]["k"][0], r["num"], r["txt"], list(r["nested"]), r["none"], r["obj"]["s"]) for r in rows), key=str)
    assert found == sorted(((i, doc["num"][i], doc["txt"][i], doc["nested"][i], None, "}") for i in range(n)), key=str)


def test_tasks_grow_with_the_document(spark, tmp_path, small_splits):  # noqa: F811
    path = tmp_path / "a.json"
    path.write_text(json.dumps(made(60, 1)))
    small_splits(400)
    pieces = json_documents.text_lines(spark, str(path), "UTF-8", "}")
    assert pieces.select("block").distinct().count() > 10


def test_other_documents(spark, tmp_path):
    def read(doc, **options):
        path = tmp_path / f"d{abs(hash(str(doc)))}.json"
        path.write_text(doc if isinstance(doc, str) else json.dumps(doc))
        return readers.read_json(spark, str(path), **options)

    assert read([]).count() == 0
    assert read({"a": 5, "b": {"c": 1}}).first()["a"] == 5
    assert read({"tags": ["x"], "rows": PLAIN}).count() == 2
    assert read({"values": [{"q": 1}, {"q": 2}]}, shape="columns").count() == 2
    assert read([{"a": 1}, {"a": "x"}, {"a": [1]}]).dtypes == [("a", "string")]
    assert read([{"a: VOID": 1, "FLOAT": 2.5}]).first()["FLOAT"] == 2.5
    for bad in ('[{"a":1},{"a":2}', '[{"a":1},{a:2}]', '{"rows":[{"a":1}', "[1, 2]", "word"):
        with pytest.raises(ValueError):
            read(bad).collect()


def test_many_documents(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"data": [{"k": i, "j": j} for j in range(3)]}, indent=i))
    assert sorted((r["k"], r["j"]) for r in readers.read_json(spark, str(tmp_path)).collect()) == [(i, j) for i in range(4) for j in range(3)]
