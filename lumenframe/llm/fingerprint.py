"""Bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct shingle hashes of a text, each a uniform 48-bit number. Sketches of
parts merge into the sketch of the whole. From two sketches follow the resemblance, the containment and, from
one, the number of distinct shingles. As text a sketch is base64 of its hashes, six bytes each.

A shingle is ``width`` consecutive words (A-Z lower-cased); a text of fewer words is one shingle; one without words has none
and an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import ascii_lower

SKETCH = 128
WIDTH = 5
BITS = 48
#: Rows that are put in order in one task, roughly, and coarse ranges of their keys.
RANGE_ROWS, COARSE = 5_000, 64


def sketch(text: Column, size: int = SKETCH, width: int = WIDTH) -> Column:
    """The bottom-k sketch of a whole text; empty for null."""
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        whole = F.xxhash64(h, F.lit(width))
        many = F.transform(
            F.sequence(F.lit(1), n - (width - 1)),
            lambda i: F.xxhash64(*[F.element_at(h, i + j if j else i) for j in range(width)]),
        )
        return F.when(n >= width, many).when(n > 0, F.array(whole)).otherwise(F.array().cast("array<bigint>"))

    # A lambda's argument is computed once, where a column expression would be repeated.
    one = lambda value, use: F.transform(F.array(value), use)[0]
    least = one(hashed, lambda h: one(shingles(h), lambda s: F.transform(s, lambda x: F.shiftrightunsigned(x, 64 - BITS))))
    return F.slice(F.array_sort(F.array_distinct(least)), 1, size)


def merge(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Sketch of two parts together. Shingles that span the cut belong to neither part."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, size)


def distinct_shingles(s: Column, size: int = SKETCH) -> Column:
    """Estimated number of distinct shingles; exact below the sketch size."""
    estimate = (F.lit(size - 1) * F.lit(float(1 << BITS))) / F.element_at(s, -1).cast("double")
    return F.when(F.size(s) < size, F.size(s).cast("double")).otherwise(estimate)


def resemblance(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Estimated share of common shingles among all; exact when both sketches are whole sets together below ``size``.

    Two empty sketches are alike (1), an empty and another one are not (0).
    """
    joint = merge(a, b, size)
    both = F.size(F.array_intersect(F.array_intersect(joint, a), b))
    return F.when(F.size(joint) == 0, F.lit(1.0)).otherwise(both.cast("double") / F.size(joint))


def containment(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    joint = merge(a, b, size)
    of_a = F.size(F.array_intersect(joint, a))
    both = F.size(F.array_intersect(F.array_intersect(joint, a), b))
    return F.when(of_a == 0, F.lit(1.0)).otherwise(both.cast("double") / of_a)


def to_text(s: Column) -> Column:
    """The sketch as base64 of six bytes per hash; an empty string for an empty sketch."""
    packed = F.unhex(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), ""))
    return F.translate(F.base64(packed), "\r\n", "")  # on one line, whatever the session's setting


def from_text(text: Column) -> Column:
    """The sketch that ``to_text`` has written."""
    digits = F.hex(F.unbase64(text))
    step = BITS // 4
    count = F.floor(F.length(digits) / step).cast("int")
    parts = F.transform(
        F.sequence(F.lit(1), count), lambda i: F.conv(F.substring(digits, (i - 1) * step + 1, F.lit(step)), 16, 10).cast("long")
    )
    return F.when(count > 0, parts).otherwise(F.array().cast("array<bigint>"))


def with_next(rows: DataFrame, key: str, columns: list[str], prefix: str = "next_") -> DataFrame:
    """``rows`` with the ``columns`` of the next row in descending order of the numeric ``key``; after the last comes the first.

    Null keys come last; rows of equal keys are ordered by their columns. Rows are sorted in ranges of the key, of about
    ``RANGE_ROWS`` rows: quantiles cut the keys coarsely, equal steps cut each coarse range. Only the first row of each range
    crosses to another one.
    """
    order = [F.desc_nulls_last(key), *[F.col(c) for c in columns if c != key]]
    value = F.col(key).cast("double")
    marks = F.percentile_approx(value, [i / COARSE for i in range(COARSE + 1)], 10_000)
    size = rows.select(key).agg(F.count(key).alias("n"), marks.alias("marks")).first()
    marks = sorted(set(size["marks"] or [0.0]))
    steps = -(-size["n"] // (RANGE_ROWS * COARSE)) or 1
    literal = F.array(*[F.lit(m) for m in marks])
    coarse = F.greatest(F.size(F.filter(literal, lambda m: m <= value)), F.lit(1))  # from 1 on
    low = F.element_at(literal, coarse)
    wide = F.element_at(literal, F.least(coarse + 1, F.lit(len(marks)))) - low
    fine = F.when(wide > 0, F.least(F.floor((value - low) / wide * steps), F.lit(steps - 1))).otherwise(0)
    number = F.when(value.isNull(), F.lit(-1)).otherwise(coarse.cast("long") * steps + fine)
    ranged = rows.withColumn("__range", number.cast("long"))
    inside = Window.partitionBy("__range").orderBy(*order)
    led = ranged.withColumn("__nth", F.row_number().over(inside)).withColumns(
        {f"{prefix}{c}": F.lead(c).over(inside) for c in columns} | {"__more": F.lead(F.lit(True)).over(inside)}
    )
    # The first row of each range follows the last row of the range before; one thin row per range says which that is.
    firsts = ranged.withColumn("__nth", F.row_number().over(inside)).where("__nth = 1")
    thin = ranged.groupBy("__range").agg(F.lit(1).alias("__one"))
    downward = Window.orderBy(F.desc("__range"))
    wrap = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("__range").over(downward), F.last("__range").over(wrap))
    follow = thin.select("__range", before.alias("__before"))
    firsts = firsts.join(follow, "__range").select(
        F.col("__before").alias("__range"), *[F.col(c).alias(f"__first_{c}") for c in columns]
    )
    ends = led.where("__more is null").drop(*[f"{prefix}{c}" for c in columns]).join(firsts, "__range")
    ends = ends.withColumnsRenamed({f"__first_{c}": f"{prefix}{c}" for c in columns})
    names = [*rows.columns, *[f"{prefix}{c}" for c in columns]]
    return led.where("__more").select(*names).unionByName(ends.select(*names))


def spliced(text: Column, following: Column) -> Column:
    """The text with its last third (floor of its code points) replaced by as many from the start of the following text."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SKETCH, width: int = WIDTH) -> DataFrame:
    """Per row: ``id_column``, ``text`` (null: empty) and its ``sketch``. Other columns are left out."""
    whole = docs.select(id_column, F.coalesce(F.col(text), F.lit("")).alias(text))
    return whole.withColumn("sketch", sketch(F.col(text), size, width))
