"""Delimited files with quoted line breaks, bad records and bad cells, in splits of any size."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.sources import delimited, readers
from lumenframe.streaming.ingest import ingest_delimited


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def made(n, seed, longest=60):
    """Rows of text with quotes, separators and line breaks, and the file a CSV writer makes of them."""
    rng = random.Random(seed)
    alphabet = ["a", "b", " ", '"', ",", "\n", "\r\n", ";", "é", '""']
    rows = [[str(i), "".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))), f"x{i}"] for i in range(n)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["id", "note", "tag"])
    writer.writerows(rows)
    return rows, out.getvalue()


@pytest.mark.parametrize("size, longest, n", [(97, 16, 80), (300, 50, 200), (5000, 60, 400)])
def test_rows_whatever_the_splits(spark, tmp_path, small_splits, size, longest, n):
    rows, text = made(n, 7, longest)
    (tmp_path / "a.csv").write_text(text, newline="")
    small_splits(size)
    df = readers.read_delimited(spark, str(tmp_path / "a.csv"), ",")
    assert [t for _, t in df.dtypes] == ["bigint", "string", "string"]
    found = sorted((str(r["id"]), r["note"] or "", r["tag"]) for r in df.collect())
    assert found == sorted(map(tuple, rows))
    assert df.count() == df.select("id").count() == df.select("note").count() == n
    assert sorted(r["id"] for r in df.select("id").collect()) == list(range(n))


def test_same_fields_as_a_csv_parser(spark, tmp_path):
    """Stray quotes in the middle of a field, text after a closing quote, separators that are special in patterns."""
    for sep in ",|;\t":
        rng = random.Random(3)
        lines = ["".join(rng.choice(["a", '"', sep, " ", "x"]) for _ in range(rng.randrange(1, 12))) for _ in range(600)]
        own = [list(csv.reader(io.StringIO(line), delimiter=sep)) for line in lines]
        keep = [(line, fields[0]) for line, fields in zip(lines, own) if line.strip(" ") and not open_at_end(line, sep)]
        path = tmp_path / f"f{ord(sep)}"
        path.write_text("\n".join(line for line, _ in keep) + "\n")
        found = delimited.records(spark, str(path), sep).select("value", delimited._Rules(sep).fields(F.col("value")).alias("f")).collect()
        assert sorted((r["value"], r["f"]) for r in found) == sorted(keep)


def open_at_end(line, sep):
    return "\n" in list(csv.reader(io.StringIO(line + "\nx"), delimiter=sep))[0][-1]


def test_bad_records_and_bad_cells(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('id,n,s\n1,2,a\n2,x,b\n3,4,c,d\n\n4,5\n5,6,"e\nf,g"\n6,,""\n7,8,h,,\n')
    for schema in (None, "id int, n int, s string"):
        df = readers.read_delimited(spark, str(path), schema=schema, rejects_to=str(tmp_path / f"rejects{schema is None}"))
        assert df.count() == df.select("id").count() == len(df.collect()) == 5
        rejects = spark.read.parquet(str(tmp_path / f"rejects{schema is None}"))
        assert sorted((r["record"], r["fields"], r["reason"]) for r in rejects.collect()) == [
            ("3,4,c,d", 4, "too many fields"), ("7,8,h,,", 5, "too many fields"),
        ]
    assert {r["id"]: (r["n"], r["s"]) for r in df.collect()} == {1: (2, "a"), 2: (None, "b"), 4: (5, None), 5: (6, "e\nf,g"), 6: (None, None)}
    assert readers.read_delimited(spark, str(path), skip_bad_lines=False).count() == 7


def test_quotes_that_never_close(spark, tmp_path, small_splits):
    """Such a record is a reject, and so is one longer than the limit; the rows before and after it stay."""
    tail = tmp_path / "t.csv"
    tail.write_text('a,b\n1,x\n2,"open\n3,y\n')
    found = delimited.read_records(spark, str(tail), ",")
    assert [tuple(r) for r in found.rows.collect()] == [(1, "x")]
    assert [(r["reason"], r["record"]) for r in found.rejects.collect()] == [("open quote", '2,"open\n3,y')]
    long = tmp_path / "l.csv"
    long.write_text("a,b\n1,x\n2,\"" + "filler line\n" * 200 + '"\n3,y\n')
    small_splits(300)
    found = delimited.read_records(spark, str(long), ",", longest=1000)
    assert sorted(tuple(r) for r in found.rows.collect()) == [(1, "x"), (3, "y")]
    assert {r["reason"] for r in found.rejects.collect()} == {"too long"}
    assert sum(r["record"].count("filler") for r in found.rejects.collect()) == 200
    found = delimited.read_records(spark, str(long), ",")
    assert {r["a"]: len(r["b"]) for r in found.rows.collect()} == {1: 1, 2: 2400, 3: 1} and found.rejects.count() == 0


def test_many_files_and_empty_ones(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"p{i}.csv").write_text(f'k,v\n{i},"a\nb"\nk,v\n' if i % 2 else f"k,v\n{i},c\n")
    (tmp_path / "none.csv").write_text("")
    df = readers.read_delimited(spark, str(tmp_path))
    assert sorted((r["k"], r["v"]) for r in df.collect()) == [("0", "c"), ("1", "a\nb"), ("2", "c"), ("3", "a\nb"), ("4", "c"), ("k", "v"), ("k", "v")]
    (tmp_path / "other.csv").write_text("v,k\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_delimited(spark, str(tmp_path))


def test_types_from_all_cells(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("i,d,day,at,yes,s,e,m\n1,1.5,2020-01-02,2020-01-02 03:04:05,true,a,,1\n-7,2e3,2021-11-30,2021-01-02T00:00:00,False,1,,x\n")
    df = readers.read_delimited(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "date", "timestamp", "boolean", "string", "string", "string"]
    assert df.where("d = 2000").count() == 1


def test_delimiter_from_all_lines(spark, tmp_path):
    """The first lines agree on a comma that the rest of the file does not have."""
    path = tmp_path / "s.csv"
    path.write_text("a,b;c\n" * 5 + "1;2\n" * 200)
    assert readers.sniff_delimiter(spark, str(path)) == ";"
    path.write_text('a|"x,y,z,w"\n1|"p,q"\n')
    assert readers.sniff_delimiter(spark, str(path)) == "|"


def test_ingest_keeps_line_breaks_and_counts_bad_records(spark, tmp_path):
    src, out, state, bad = (str(tmp_path / n) for n in ("src", "out", "state", "bad"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.csv").write_text('id,s\n1,"x\ny"\nz,short\n3\n4,a,b\n')
    for _ in range(2):
        ingest_delimited(spark, src, "id bigint, s string", out, state, rejects=bad).awaitTermination()
        found = sorted(((r["id"] or 0, r["s"]) for r in spark.read.parquet(out).collect()), key=str)
        assert found == [(0, "short"), (1, "x\ny"), (3, None)]
        assert [r["record"] for r in spark.read.parquet(bad).collect()] == ["4,a,b"]
