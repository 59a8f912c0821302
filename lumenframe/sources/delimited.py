"""Delimited text read in splits of any size, with quoted line breaks, a quarantine for bad records, and rows that never depend on
the columns asked for.

Spark hands a file over in splits that begin at any line, also inside a quoted field. Whether a line begins inside one follows
from all lines before it:

1. For each line the state at its end, inside or outside of a quoted field, is computed for both states it may begin in.
2. A task composes these functions over its split; that is one row per split. Prefixes over the splits of a file give the state in
   which each one begins.
3. Lines are joined to records, in the task of their split; the ends of records that cross a border are stitched afterwards.

Where no line leaves a quoted field open, which step 1 tells, every line is a record, and no data passes through Python.

Records are cut into fields by the same rules as in step 1: a quote opens a field only at its start, two quotes inside stand for one, text
after the closing quote belongs to the field.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.numbers import quoted
from lumenframe.session import settle

#: Inside of a quoted field: anything but a quote, and pairs of quotes.
_INNER = r'[^"]*+(?:""[^"]*+)*+'
#: Part of a record that a task has: all of it, or its end, beginning or middle, where it crosses the border of a split.
WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3
#: Characters of a record that crosses the border of a split, at most; a quote that is never closed would make one of the whole file.
LONGEST = 1 << 26


class Delimited(NamedTuple):
    """Rows, and what was left out: ``file, reason, fields, record``. ``rejects.count()`` counts it."""

    rows: DataFrame
    rejects: DataFrame


class _Rules:
    """Patterns for a separator of one character."""

    def __init__(self, sep: str):
        if len(sep) != 1 or sep in '"\n\r':
            raise ValueError("a separator is one character, no quote or line break")
        self.raw = sep
        s = self.sep = re.escape(sep)
        self.no_sep = f"[^{s}]"
        before = f'(?:"{_INNER}"{self.no_sep}*+{s}|[^"{s}]{self.no_sep}*+{s}|{s})*+'
        self.opens = f'^{before}"{_INNER}\\z'
        self.closes = f'^{_INNER}"'
        self.opens_again = f'^{_INNER}"{self.no_sep}*+{s}{before}"{_INNER}\\z'
        self.field = f'{s}(?:"{_INNER}"{self.no_sep}*+|{self.no_sep}*+)'

    def after_outside(self, line: Column) -> Column:
        """Whether the line ends inside a quoted field when it begins outside."""
        return F.contains(line, F.lit('"')) & line.rlike(self.opens)

    def after_inside(self, line: Column) -> Column:
        """Whether it ends inside when it begins inside."""
        return ~F.contains(line, F.lit('"')) | ~line.rlike(self.closes) | line.rlike(self.opens_again)

    def fields(self, record: Column) -> Column:
        """The fields of a record as an array of strings."""

        def unquoted(part: Column) -> Column:
            body = F.substring(part, 2, 1 << 30)
            inner = F.replace(F.regexp_extract(body, f'^"({_INNER})"', 1), F.lit('""'), F.lit('"'))
            return F.when(body.startswith('"'), F.concat(inner, F.regexp_replace(body, f'^"{_INNER}"', ""))).otherwise(body)

        # With a separator in front no match is empty.
        led = F.concat(F.lit(self.raw), record)
        plain = F.split(record, self.sep, -1)
        return F.when(F.contains(record, F.lit('"')), F.transform(F.regexp_extract_all(led, F.lit(self.field), F.lit(0)), unquoted)).otherwise(plain)


def text_lines(spark: SparkSession, path: str, encoding: str, end: str = "\n") -> DataFrame:
    """``value, file, block, pos`` of every line, or of what another character ends; ``file, block`` name the split, ``pos`` ascends within it."""
    value = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    return (
        spark.read.option("lineSep", end)
        .text(path)
        .select(
            value.alias("value"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
        )
    )


def _split_functions(lines: DataFrame) -> DataFrame:
    """``file, block, from_out, from_in, opened`` per split that has a line which changes the state."""

    def compose(batches):
        found: dict = {}
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(4))
            for file, block, out, inside in zip(*columns):
                own = found.get((file, block), (False, True, False))
                found[file, block] = (inside if own[0] else out, inside if own[1] else out, own[2] or out)
        if found:
            keys, values = zip(*found.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array(v, pa.bool_()) for v in zip(*values))],
                names=["file", "block", "from_out", "from_in", "opened"],
            )

    changing = lines.where("out or not inside").select("file", "block", "out", "inside")
    return changing.mapInArrow(compose, "file string, block long, from_out boolean, from_in boolean, opened boolean")


def split_states(functions: DataFrame) -> DataFrame:
    """``functions`` with the state each split begins (``start``) and ends (``end``) in; a file begins outside.

    A function is constant, or it swaps the states, or keeps them. So the state is that of the last constant before, swapped as
    often as there are swaps since.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    constant = F.col("from_out") == F.col("from_in")
    swap = (F.col("from_out") & ~F.col("from_in")).cast("int")
    marked = functions.withColumn("swaps", F.sum(swap).over(upto))
    last = F.last(F.when(constant, F.struct(F.col("from_out").cast("int").alias("state"), "swaps")), ignorenulls=True).over(before)
    total = F.coalesce(F.lag("swaps").over(Window.partitionBy("file").orderBy("block")), F.lit(0))
    state = F.coalesce(last["state"], F.lit(0)) + total - F.coalesce(last["swaps"], F.lit(0))
    marked = marked.withColumn("start", state % 2 == 1).drop("swaps")
    return marked.withColumn("end", F.when(F.col("start"), F.col("from_in")).otherwise(F.col("from_out")))


def _assemble(lines: DataFrame, inside: set[tuple[str, int]]) -> DataFrame:
    """``value, file, block, pos, role``: whole records, and parts of records that cross the border of a split."""

    def run(batches):
        key, state, held, head, first = None, False, [], False, 0

        def rows_of(found):
            value, file, block, pos, role = zip(*found)
            return pa.RecordBatch.from_arrays(
                [pa.array(value, pa.string()), pa.array(file, pa.string()), pa.array(block, pa.int64()), pa.array(pos, pa.int64()), pa.array(role, pa.int32())],
                names=["value", "file", "block", "pos", "role"],
            )

        def rest():
            """What is held when a split ends."""
            return [("\n".join(held), *key, first, MIDDLE if head else TAIL)] if held else []

        for batch in batches:
            value, file, block, pos, out, within = (batch.column(i) for i in range(6))
            same = key is not None and file[0].as_py() == file[-1].as_py() == key[0] and block[0].as_py() == block[-1].as_py() == key[1]
            if same and not state and not held and not out.to_numpy(zero_copy_only=False).any():
                yield pa.RecordBatch.from_arrays([value, file, block, pos, pa.array(np.zeros(len(value), dtype=np.int32))], names=["value", "file", "block", "pos", "role"])
                continue
            found, size = [], 0
            for v, f, b, p, o, w in zip(*(c.to_pylist() for c in (value, file, block, pos, out, within))):
                if (f, b) != key:
                    found += rest()
                    key, held = (f, b), []
                    head = state = key in inside
                if not held:
                    first = p
                held.append(v)
                state = w if state else o
                if not state:
                    found.append(("\n".join(held), f, b, first, HEAD if head else WHOLE))
                    held, head = [], False
                size += len(v)
                if size > 4 << 20 and found:
                    yield rows_of(found)
                    found, size = [], 0
            if found:
                yield rows_of(found)
        if held:
            yield rows_of(rest())

    wanted = lines.select("value", "file", "block", "pos", "out", "inside")
    return wanted.mapInArrow(run, "value string, file string, block long, pos long, role int")


def stitched(parts: DataFrame, longest: int, glue: str) -> DataFrame:
    """``value, file, block, pos, reason`` of records that cross borders. One that never ends, or is longer than ``longest``, is not
    stitched: its parts are bad, each by itself."""
    parts = settle(parts)  # about two a split
    order = Window.partitionBy("file").orderBy("block", "role")
    runs = parts.select("file", "block", "role", F.length("value").alias("size"))
    runs = runs.withColumn("run", F.sum((F.col("role") == TAIL).cast("int")).over(order))
    totals = runs.groupBy("file", "run").agg(F.max((F.col("role") == HEAD).cast("int")).alias("closed"), F.sum("size").alias("total"))
    why = F.when(F.col("closed") == 0, "open quote").when(F.col("total") > longest, "too long")
    judged = runs.join(totals, ["file", "run"]).select("file", "block", "role", "run", why.alias("reason"))
    known = parts.join(judged, ["file", "block", "role"])
    extra = [c for c in parts.columns if c not in ("value", "file", "block", "pos", "role")]  # taken from the first part
    part = F.struct("block", "role", "value", "pos", *extra)
    whole = known.where("reason is null").groupBy("file", "run").agg(F.sort_array(F.collect_list(part)).alias("p"))
    first = [F.col("p")[0][c].alias(c) for c in ("block", "pos", *extra)]
    good = whole.select(F.array_join("p.value", glue).alias("value"), "file", *first, F.lit(None).cast("string").alias("reason"))
    return good.unionByName(known.where("reason is not null").select("value", "file", "block", "pos", *extra, "reason"))


def records(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8", longest: int = LONGEST) -> DataFrame:
    """``value, file, block, pos, reason``: records without blank ones, ``reason`` telling why one can't be read (or null).

    The driver gets one row per split that has quotes across line ends, no data.
    """
    rules = _Rules(sep)
    lines = text_lines(spark, path, encoding)
    stated = lines.withColumns({"out": rules.after_outside(F.col("value")), "inside": rules.after_inside(F.col("value"))})
    states = split_states(_split_functions(stated)).collect()
    whole, crossing = lines, None
    if any(r["opened"] for r in states):
        inside = _inside_splits(lines, states)
        assembled = _assemble(stated, inside)
        whole = assembled.where(F.col("role") == WHOLE).drop("role")
        if inside or any(r["end"] for r in states):
            crossing = stitched(assembled.where(F.col("role") != WHOLE), longest, "\n")
    out = whole.withColumn("reason", F.lit(None).cast("string"))
    if crossing is not None:
        out = out.unionByName(crossing)
    return out.withColumn("value", F.regexp_replace("value", "\r\\z", "")).where(F.trim("value") != "")


def _inside_splits(lines: DataFrame, states: list) -> set[tuple[str, int]]:
    """Splits that begin inside a quoted field, also those without a quote of their own, which begin as the one before them ends."""
    inside = {(r["file"], r["block"]) for r in states if r["start"]}
    open_files = sorted({r["file"] for r in states if r["end"]})
    if open_files:
        known = {(r["file"], r["block"]): r["end"] for r in states}
        end = False
        rows = lines.where(F.col("file").isin(open_files)).select("file", "block").distinct().orderBy("file", "block").collect()
        for i, r in enumerate(rows):
            end = end if i and rows[i - 1]["file"] == r["file"] else False
            if end:
                inside.add((r["file"], r["block"]))
            end = known.get((r["file"], r["block"]), end)
    return inside


def _names(header: list[str | None]) -> list[str]:
    """Column names of a header: an empty one is ``_c`` and its number, a repeated one gets its number."""
    names = [n or f"_c{i}" for i, n in enumerate(header)]
    lowered = [n.lower() for n in names]
    return [n if lowered.count(n.lower()) == 1 else f"{n}{i}" for i, n in enumerate(names)]


#: Types in the order in which they are tried, with the form a cell must have.
_TYPES = [
    ("bigint", r"^\s*[+-]?\d+\s*$"),
    ("double", r"^\s*(?:[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|NaN|[+-]?Inf(?:inity)?)\s*$"),
    ("date", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("timestamp", r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d"),
    ("boolean", r"^(?i:true|false)$"),
]


def _cell(i: int) -> Column:
    return F.nullif(F.get("fields", F.lit(i)), F.lit(""))


def _infer(cut: DataFrame, names: list[str]) -> T.StructType:
    """The narrowest type that takes every cell of a column, in one aggregate; text for a column without a cell."""
    misses = []
    for i in range(len(names)):
        for kind, form in _TYPES:
            fits = _cell(i).rlike(form) & _cell(i).try_cast(kind).isNotNull()
            misses.append(F.count_if(_cell(i).isNotNull() & ~fits))
        misses.append(F.count(_cell(i)))
    found = cut.agg(*[m.alias(f"m{i}") for i, m in enumerate(misses)]).first()
    fields, width = [], len(_TYPES) + 1
    for i, name in enumerate(names):
        own = found[i * width : (i + 1) * width]
        kind = next((k for (k, _), missed in zip(_TYPES, own) if not missed), "string") if own[-1] else "string"
        fields.append(T.StructField(name, T._parse_datatype_string(kind)))
    return T.StructType(fields)


def read_records(
    spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8", schema: T.StructType | str | None = None, header: bool = True,
    keep_long: bool = False, longest: int = LONGEST,
) -> Delimited:
    """Rows and rejects of delimited files.

    The first record of every file is its header, unless there is none; files with different headers are an error. A
    record with fewer fields than columns ends in nulls; one with more is a reject, or is cut off if ``keep_long``. A cell that is
    not of its column's type is null and its row stays. An empty cell is null. Without ``schema`` all cells are looked at once.
    """
    found = records(spark, path, sep, encoding, longest)
    rules = _Rules(sep)
    names, own = None, None
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if header:
        # One row per file: where its first record stands.
        tops = found.where("block = 0").groupBy("file").agg(F.min_by(F.struct("value", "pos"), "pos").alias("top")).select("file", "top.value", "top.pos")
        tops = tops.withColumn("fields", rules.fields(F.col("value"))).orderBy("file").collect()
        if len({tuple(r["fields"]) for r in tops}) > 1:
            raise ValueError("the files have different headers")
        if tops:
            own = list(tops[0]["fields"])
            found = found.where(~F.col("pos").isin([r["pos"] for r in tops]))
    cut = found.withColumn("fields", F.when(F.col("reason").isNull(), rules.fields(F.col("value"))))
    if schema is not None:
        names = schema.fieldNames()
    elif own is not None:
        names = _names(own)
    else:
        width = cut.agg(F.max(F.size("fields"))).first()[0] or 0
        names = [f"_c{i}" for i in range(width)]
    fits = F.col("reason").isNull() & (F.lit(keep_long) | (F.size("fields") <= max(len(names), len(own or []))))
    good = cut.where(fits)
    schema = schema or _infer(good, names)
    rows = good.select(*[_cell(i).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])
    why = F.coalesce("reason", F.lit("too many fields"))
    rejects = cut.where(~fits).select("file", why.alias("reason"), F.size("fields").alias("fields"), F.col("value").alias("record"))
    return Delimited(rows.select(*[F.col(quoted(n)) for n in schema.fieldNames()]), rejects)
