"""Readers for delimited text, JSON shapes and Parquet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.numbers import quoted
from lumenframe.operators.catalog import missing_as_null
from lumenframe.sources.delimited import read_records
from lumenframe.sources.json_documents import WRAPPER_KEYS, read_document

DELIMITERS = [",", "\t", ";", "|"]


class EmptyDataError(ValueError):
    """The source has no data rows."""


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise EmptyDataError("the source contains no data rows")
    return df


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The candidate that most lines have as often as the first one, confirmed over all lines in one aggregate; comma otherwise.

    Quoted parts don't count. Candidates that agree equally often are told apart by their number in the first line.
    """
    lines = spark.read.text(path).where(F.length("value") > 0)
    head = lines.limit(1).collect()
    if not head:
        return ","
    bare = re.sub('"[^"]*"', "", head[0]["value"])
    counts = {d: bare.count(d) for d in DELIMITERS if d in bare}
    if not counts:
        return ","
    rest = F.regexp_replace("value", '"[^"]*+"', "")
    agree = lines.agg(*[F.avg((F.regexp_count(rest, F.lit(re.escape(d))) == n).cast("double")).alias(f"d{i}") for i, (d, n) in enumerate(counts.items())])
    shares = dict(zip(counts, agree.first()))
    return max(counts, key=lambda d: (shares[d], counts[d]))


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line is not valid UTF-8, then Latin-1."""
    text = spark.read.text(path)
    broken = text.where(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if broken else "UTF-8"


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    schema: T.StructType | str | None = None,
    encoding: str | None = None,
    skip_bad_lines: bool = True,
    header: bool = True,
    rejects_to: str | None = None,
) -> DataFrame:
    """Delimited text, with a header unless stated, read in splits of any number of rows; see ``delimited.read_records``.

    Line breaks inside quotes belong to their field. Without ``schema`` the types are inferred from all cells. A record
    with too many fields is left out (or cut off when ``skip_bad_lines`` is off); a cell that is not of its type is null. What is left out
    goes as a table of ``file, reason, fields, record`` to the folder ``rejects_to``, if given.
    """
    found = read_records(
        spark, path, sep or sniff_delimiter(spark, path), encoding or detect_encoding(spark, path), schema, header, keep_long=not skip_bad_lines
    )
    if rejects_to is not None:
        found.rejects.write.mode("append").parquet(rejects_to)
    return missing_as_null(found.rows)


def read_json(spark: SparkSession, path: str, lines: bool = False, shape: str | None = None) -> DataFrame:
    """JSON records, a wrapper around records, or a dict of columns.

    A document is recognised by its form: an array of records is rows as it stands; an
    object with records under ``data``, ``records``, ``rows`` or ``results`` is a wrapper;
    any other object of arrays only is a dict of columns. ``shape`` (``records``,
    ``wrapper``, ``columns``) states it instead. With ``lines`` every line is a document of
    its own, which lets Spark split the input; lines are taken as records unless stated.
    """
    if not lines:
        return read_document(spark, path, shape)
    df = spark.read.json(path)
    shape = shape or ("records" if lines else None)
    types = {f.name: f.dataType for f in df.schema.fields}
    if shape in (None, "wrapper"):
        for key in WRAPPER_KEYS:
            if isinstance(types.get(key), T.ArrayType) and isinstance(types[key].elementType, T.StructType):
                return df.select(F.inline(quoted(key)))
    if shape == "columns" or (
        shape is None and types and all(isinstance(t, T.ArrayType) for t in types.values())
    ):
        return df.select(F.inline(F.arrays_zip(*[F.col(quoted(c)) for c in df.columns])))
    return df


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader by extension, with ``.gz``/``.gzip`` in front of it handled by Spark's codec.

    A gzip file is a single split, so its rows are spread over tasks after reading.
    """
    name = path.lower()
    packed = name.endswith((".gz", ".gzip"))
    stem = name.rsplit(".", 1)[0] if packed else name
    if stem.endswith(".csv"):
        df = read_delimited(spark, path, **options)
    elif stem.endswith((".tsv", ".txt")):
        df = read_delimited(spark, path, sep="\t", **options)
    elif stem.endswith((".jsonl", ".ndjson")):
        df = read_json(spark, path, lines=True)
    elif stem.endswith(".json"):
        df = read_json(spark, path)
    elif stem.endswith(".parquet"):
        df = missing_as_null(spark.read.parquet(path))
    else:
        raise ValueError("supported types: csv, tsv, txt, json, jsonl, parquet")
    if packed:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return require_rows(df)


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    """Parquet tables of a folder, lazily."""
    return [spark.read.parquet(f"{folder}/{n}.parquet") for n in names]
