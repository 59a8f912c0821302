"""Whole JSON documents read by many tasks: an array of records, records under a key, or an object of columns.

A document is cut at every closing brace (for columns: at every comma) by the text reader, so that one document of any size comes in
splits. Where a piece stands in the document follows from all pieces before it:

1. Each piece has a number of quotes (odd: it begins inside a string and ends outside, or the other way round) and a change
   of nesting depth for either case. A task adds these up over its split: one row per split.
2. Prefix sums over the splits of a file give each one the state and the depth in which it begins.
3. With these, tasks find the pieces at which a record (a cell) ends, put together those of several pieces, and hand on
   what crosses the border of a split; such parts are stitched afterwards.

Names of the columns and their types come from one aggregate over all records.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.sources.delimited import HEAD, LONGEST, MIDDLE, TAIL, WHOLE, stitched, text_lines

#: Keys that may hold the records, in order of preference.
WRAPPER_KEYS = ["data", "records", "rows", "results"]
#: A string, perhaps cut off, or a bracket.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[\[\]{}]', re.S)
#: Key of what is no item.
NO_ITEM = ""


def _measured(pieces: DataFrame, end: str) -> DataFrame:
    """``pieces`` with ``odd`` (a quote stays open or is closed) and the depth change if it begins outside (``outer``) or inside a string (``inner``).

    The closing brace after a piece, if that is what cuts, is counted where it is outside of a string.
    """
    plain = F.regexp_replace("value", r"\\.", "")
    odd = F.regexp_count(plain, F.lit('"')) % 2 == 1

    def change(text: Column) -> Column:
        bare = F.regexp_replace(text, '"[^"]*+(?:"|\\z)', "")
        return F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]"))

    close = 1 if end == "}" else 0
    inner = change(F.regexp_replace(plain, '^[^"]*+(?:"|\\z)', ""))
    outer_close, inner_close = F.when(odd, 0).otherwise(close), F.when(odd, close).otherwise(0)
    return pieces.withColumns({"odd": odd, "outer": change(plain) - outer_close, "inner": inner - inner_close})


def _split_sums(pieces: DataFrame) -> DataFrame:
    """``file, block, odd, outer, inner`` over whole splits."""

    def add(batches):
        found: dict = {}
        for batch in batches:
            file, block = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            odd = batch.column(2).to_numpy(zero_copy_only=False)
            change = np.stack([batch.column(3).to_numpy(), batch.column(4).to_numpy()])
            new = [0, *[i for i in range(1, len(file)) if file[i] != file[i - 1] or block[i] != block[i - 1]], len(file)]
            for a, b in zip(new, new[1:]):
                inside = np.cumsum(odd[a:b]) - odd[a:b]  # quotes before each piece, within this run
                own = found.get((file[a], int(block[a])), (0, [0, 0]))
                depth = list(own[1])
                for start in (0, 1):
                    state = (start + own[0] + inside) % 2
                    depth[start] += int(change[state, np.arange(a, b)].sum())
                found[file[a], int(block[a])] = (own[0] + int(odd[a:b].sum()), depth)
        if found:
            rows = [(f, b, n % 2, d[0], d[1]) for (f, b), (n, d) in found.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                names=["file", "block", "odd", "outer", "inner"],
            )

    return pieces.select("file", "block", "odd", "outer", "inner").mapInArrow(add, "file string, block long, odd long, outer long, inner long")


def _starts(sums: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """(inside a string, depth) in which each split begins: one entry per split. A document that does not end outside at depth 0 is an error."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stated = sums.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    stated = stated.withColumn("change", F.when(F.col("inside") == 1, F.col("inner")).otherwise(F.col("outer")))
    stated = stated.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    found = stated.select("file", "block", "inside", "depth", "odd", "change").collect()
    last = {}
    for r in found:
        if r["block"] >= last.get(r["file"], (-1,))[0]:
            last[r["file"]] = (r["block"], (r["inside"] + r["odd"]) % 2, r["depth"] + r["change"])
    # A document that ends in no brace has one counted after it all the same.
    broken = sorted(f for f, (_, inside, depth) in last.items() if inside or depth not in (0, -1))
    if broken:
        raise ValueError(f"not a complete JSON document: {broken[0]}")
    return {(r["file"], r["block"]): (r["inside"], r["depth"]) for r in found}


def _last_object(text: str, depth: int, base: int) -> tuple[str | None, str | None]:
    """(key, record) of the object that ends ``text``: it must be an element of an array at depth ``base``; the key is that array's, if
    the text names it."""
    if depth == base and text[:1] == "{":
        return None, text
    openers: list[str | None] = [None] * max(0, depth)
    start, key, name = -1, None, None
    for token in _TOKEN.finditer(text):
        c = token.group()
        if c in "[{":
            if len(openers) == base:
                start = token.start()
            if len(openers) == 1 and base == 2:
                key = name if c == "[" else None
            openers.append(c)
        elif c in "]}":
            if openers:
                openers.pop()
        else:
            name = c[1:-1] if len(openers) == 1 else name
        # An opener that is not known lies before the text: then an element begins with a comma, a member with a name.
        if c in "[{" and len(openers) == base + 1 and openers[base - 1] is None and not re.fullmatch(r"[\s,]*", text[: token.start()]):
            start = -1 if '"' in text[: token.start()] else start
    if start < 0 or text[start] != "{" or (base and len(openers) > base - 1 and openers[base - 1] not in ("[", None)):
        return None, None
    return key, text[start:]


#: What comes out of the pieces: whole items, or their parts at the border of a split.
_ITEM = "value string, file string, block long, pos long, role int, key string"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["value", "file", "block", "pos", "role", "key"])


def _items(pieces: DataFrame, starts: dict, base: int, end: str, item) -> DataFrame:
    """Items that end where a piece ends outside of strings at depth ``base`` or above, with the key of their array, if the split names it.

    ``item(text, depth before it, depth after it)`` gives the key that the text names, or None, and the item, or None if there is none in it.
    """
    mark = end if end == "}" else ""  # a brace belongs to the item, a comma stands between two

    def run(batches):
        at, inside, depth, held, held_depth, first, cut, key = None, 0, 0, [], 0, 0, False, None

        def text():
            return end.join(held) + mark

        def rest():
            if not held:
                return []
            if cut:
                return [(text(), *at, first, MIDDLE, None)]
            name, own = item(text(), held_depth, base)
            return [("", *at, first, TAIL, NO_ITEM) if own is None else (own, *at, first, TAIL, name or key)]

        for batch in batches:
            rows, size = [], 0
            for value, file, block, pos, odd, outer, inner in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (file, block) != at:
                    rows += rest()
                    at, held, key = (file, block), [], None
                    inside, depth = starts[file, block]
                    cut = bool(inside) or depth > base
                if not held:
                    first, held_depth = pos, depth
                held.append(value)
                size += len(value)
                depth += inner if inside else outer
                inside ^= odd
                if inside or depth > base:
                    continue
                if cut:
                    rows.append((text(), file, block, first, HEAD, None))
                else:
                    name, own = item(text(), held_depth, depth)
                    if own is not None:
                        key = name or key
                        rows.append((own, file, block, first, WHOLE, name if name == NO_ITEM else key))
                held, cut = [], False
                if size > 4 << 20 and rows:
                    yield _packed(rows)
                    rows, size = [], 0
            if rows:
                yield _packed(rows)
        rows = rest()
        if rows:
            yield _packed(rows)

    return pieces.select("value", "file", "block", "pos", "odd", "outer", "inner").mapInArrow(run, _ITEM)


def _record(base: int):
    """Objects in an array at depth ``base``."""

    def item(text: str, before: int, after: int) -> tuple[str | None, str | None]:
        text = text.lstrip(", \t\r\n")
        return _last_object(text, before, base) if after >= base else (None, None)

    return item


_NAME = re.compile(r'\s*\{?\s*"((?:[^"\\]|\\.)*)"\s*:\s*\[', re.S)


def _cell(text: str, before: int, after: int) -> tuple[str | None, str | None]:
    """Elements of the arrays of an object; a member that is no array has the key of no item."""
    if before > 1:
        return None, text
    named = _NAME.match(text)
    if named:
        return named.group(1), text[named.end() :]
    return (None, None) if not text.strip("{} \t\r\n") else (NO_ITEM, text)


def _whole(parts: DataFrame, starts: dict, glue: str, longest: int) -> DataFrame:
    """Whole items: those that cross borders are put together, and one that names no key has that of the last one before it in its file."""
    out = parts.where(F.col("role") == WHOLE).drop("role")
    if len(starts) == len({file for file, _ in starts}):
        return out  # no file has two splits
    out = out.unionByName(stitched(parts.where(F.col("role") != WHOLE), longest, glue).drop("reason"))
    last = out.groupBy("file", "block").agg(F.max_by("key", F.when(F.col("key") != NO_ITEM, F.col("pos"))).alias("last"))  # one row per split
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = last.select("file", "block", F.last("last", ignorenulls=True).over(before).alias("earlier"))
    return out.join(earlier, ["file", "block"]).withColumn("key", F.coalesce("key", "earlier")).drop("earlier")


def _ddl(found: str) -> str:
    """A variant's schema as that of the columns to read: one number type for fractions, text for what has no type or several."""
    for old, new in ((r"DECIMAL\(\d+, ?\d+\)", "DOUBLE"), ("FLOAT", "DOUBLE"), ("VOID", "STRING"), ("VARIANT", "STRING"), ("OBJECT<", "STRUCT<")):
        found = re.sub(r"(?:(?<=: )|(?<=ARRAY<)|(?<=^))" + old, new, found)
    return found


def _rows_of(records: DataFrame) -> DataFrame:
    """Rows of JSON records (``value``)."""
    variant = F.try_parse_json("value")
    seen = records.agg(F.schema_of_variant_agg(variant).alias("kind"), F.count_if(variant.isNull()).alias("broken"), F.count(F.lit(1)).alias("n")).first()
    if seen["broken"]:
        raise ValueError(f"{seen['broken']} of {seen['n']} records are not JSON")
    if not seen["n"]:
        return records.sparkSession.createDataFrame([], T.StructType([]))
    return records.select(F.from_json("value", _ddl(seen["kind"])).alias("r")).select("r.*")


def _columns(spark: SparkSession, path: str, encoding: str, longest: int) -> DataFrame | None:
    """Rows of an object of columns; None if it is none, or one of its arrays is under a key that holds records."""
    pieces = _measured(text_lines(spark, path, encoding, ","), ",")
    starts = _starts(_split_sums(pieces))
    cells = _whole(_items(pieces, starts, 2, ",", _cell), starts, ",", longest)
    keys = sorted(r["key"] or NO_ITEM for r in cells.select("key").distinct().collect())
    if not keys or NO_ITEM in keys or any(k in WRAPPER_KEYS for k in keys):
        return None
    # Behind the last element of an array stand its bracket, and perhaps the object's brace.
    plain = F.regexp_replace(F.regexp_replace("value", r"\\.", ""), '"[^"]*+"', "")
    extra = F.regexp_count(plain, F.lit(r"[\]}]")) - F.regexp_count(plain, F.lit(r"[\[{]"))
    value = F.col("value")
    for n in (0, 1):
        value = F.when(extra > n, F.regexp_replace(value, r"[\]}]\s*\z", "")).otherwise(value)
    cells = cells.withColumn("value", F.regexp_replace(value, r"^\s+|\s+\z", "")).where("value <> ''")
    counts = cells.groupBy("file", "key", "block").agg(F.count(F.lit(1)).alias("n"))  # one row per split and column
    before = F.sum("n").over(Window.partitionBy("file", "key").orderBy("block")) - F.col("n")
    counts = counts.select("file", "key", "block", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("file", "key", "block").orderBy("pos"))
    placed = cells.withColumn("nth", nth).join(counts, ["file", "key", "block"])
    placed = placed.select("file", (F.col("nth") + F.col("before")).alias("row"), "key", "value", F.try_parse_json("value").alias("v"))
    seen = placed.groupBy("key").agg(F.schema_of_variant_agg("v").alias("kind"), F.count_if(F.col("v").isNull()).alias("broken")).collect()
    if any(r["broken"] for r in seen):
        raise ValueError("cells that are not JSON")
    kinds = {r["key"]: _ddl(r["kind"]) for r in seen}
    wide = placed.groupBy("file", "row").agg(*[F.first(F.when(F.col("key") == k, F.col("value")), ignorenulls=True).alias(f"c{i}") for i, k in enumerate(keys)])
    columns = []
    for i, k in enumerate(keys):
        cell = F.from_json(F.concat(F.lit('{"v":'), F.col(f"c{i}"), F.lit("}")), f"v {kinds[k]}")["v"] if k in kinds else F.lit(None).cast("string")
        columns.append(cell.alias(k))
    return wide.select(*columns)


def read_document(spark: SparkSession, path: str, shape: str | None = None, encoding: str = "UTF-8", longest: int = LONGEST) -> DataFrame:
    """Rows of JSON documents, one per file, each read in as many splits as it has.

    ``shape`` is ``records``, ``wrapper`` or ``columns``; without it the documents' first characters, and the names of their arrays, tell. Columns
    of an object of columns that are shorter than others end in nulls. An incomplete document, or a record that is no JSON, is an error.
    """
    head = "".join(r["value"] + "," for r in text_lines(spark, path, encoding, ",").select("value").limit(8).collect()).lstrip("﻿ \t\r\n")
    array_of_scalars = re.match(r'\{\s*"(?:[^"\\]|\\.)*"\s*:\s*\[\s*[^\s{]', head)
    if shape == "columns" or (shape is None and array_of_scalars):
        rows = _columns(spark, path, encoding, longest)
        if rows is not None:
            return rows
    if not head.startswith(("[", "{")) or (shape is None and head.startswith("[") and not re.match(r"\[\s*[{\]]", head)):
        raise ValueError("neither an array of records nor an object")
    base = 1 if head.startswith("[") else 2
    pieces = _measured(text_lines(spark, path, encoding, "}"), "}")
    starts = _starts(_split_sums(pieces))
    records = _whole(_items(pieces, starts, base, "}", _record(base)), starts, "", longest)
    if base == 2:
        keys = {r["key"] for r in records.select("key").distinct().collect()}
        key = next((k for k in WRAPPER_KEYS if k in keys), None)
        if key is None:
            return spark.read.json(path, multiLine=True)  # an object that is a record itself
        records = records.where(F.col("key") == key)
    return _rows_of(records.where(F.col("key").isNull() | (F.col("key") != NO_ITEM)))
