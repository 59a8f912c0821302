"""Line deduplication with a log-template tree.

A line is parsed down a tree of fixed depth: its number of tokens, then its first ``depth`` tokens, where a token with a digit counts
as a variable field ``<*>``. In a leaf, a token is constant at its place when enough documents have it there, otherwise it is a variable field
too; what remains is the line's template. Templates that recur across documents are dropped, all but the first occurrence.

The tree is built by grouping, so the result does not depend on the order of lines, and no leaf is gathered anywhere:

1. One thin row per line: the document, the line's number, its leaf, the hash of its masked tokens.
2. Leaves seen in fewer than ``min_docs`` documents can't hold a recurring template and go at once.
3. Lines recurring as they are are templates. Leaves whose other lines reach enough documents are generalised: only their distinct
   lines are split into tokens, and token supports are summed per (leaf, place, token).
4. Long lines that are equal word for word recur from two documents on.
5. Recurring templates give the line numbers to drop per document; texts are rebuilt in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.session import settle

#: Documents in which a template must occur to be dropped, tokens a line must have, tokens that lead to a leaf, and the share of
#: its tokens that must be constant.
MIN_DOCS, MIN_TOKENS, DEPTH, CONSTANT = 3, 1, 3, 0.8
#: Lines of fewer tokens are compared as they are: their digits are no fields.
FIELD_TOKENS = 4
#: Documents from which on a long line recurs word for word, and its tokens.
LONG_DOCS, LONG_TOKENS = 2, 50
FIELD = "<*>"


def _lines(rows: DataFrame, min_tokens: int, depth: int, long_tokens: int | None) -> DataFrame:
    """Lines of at least ``min_tokens`` tokens with their leaf and masked text; ``own`` is the hash of a long line's words, or null."""
    each = rows.select("doc", "hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # Blank lines go first, by a pattern that ends at a line's first token: a filter on ``tokens`` would count them twice.
    each = each.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    # Most lines are single already, and finding out is much cheaper than replacing. Tokens are one more than the spaces between them.
    plain = ~F.col("line").rlike(r"[\x09-\x0D]|  |^ | $")
    single = F.trim(F.regexp_replace("line", r"[\x20\x09-\x0D]+", " "))
    each = each.select("doc", "hash", "pos", F.when(plain, F.col("line")).otherwise(single).alias("single"))
    spaces = F.octet_length("single") - F.octet_length(F.replace("single", F.lit(" "), F.lit("")))
    each = each.withColumn("tokens", spaces + 1)
    if min_tokens > 1:
        each = each.where(F.col("tokens") >= min_tokens)
    digits = F.regexp_replace("single", "[^ ]*[0-9][^ ]*", FIELD)
    each = each.withColumn("masked", F.when((F.col("tokens") >= FIELD_TOKENS) & F.col("single").rlike("[0-9]"), digits).otherwise(F.col("single")))
    return each.select(
        "doc", "hash", "pos", "tokens", "masked",
        F.xxhash64("tokens", F.substring_index("masked", " ", depth)).alias("leaf"),
        F.xxhash64("masked").alias("content"),
        F.when(F.lit(False) if long_tokens is None else F.col("tokens") >= long_tokens, F.xxhash64("single")).alias("own"),
    )


def recurring_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS,
    depth: int = DEPTH, constant: float = CONSTANT, long_tokens: int | None = LONG_TOKENS, copies: DataFrame | None = None,
) -> DataFrame:
    """``doc, hash, drops``: for each document (id and hash of its text) the sorted numbers of the lines to drop, from 0.

    With ``min_tokens`` 1 every line that is not blank counts. Lines of ``long_tokens`` tokens or more, if given, recur from two
    documents on where they are equal but for white space. ``copies``, if given, has ``doc, hash, component`` of documents that are copies
    of each other (one row each, or a null component): they count as one document, and all of them keep what the first one keeps.
    """
    rows = docs.select(F.col(id_column).alias("doc"), F.col(text).alias("text")).where("text is not null")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    full = _lines(rows, min_tokens, depth, long_tokens)
    thin = full.drop("masked").withColumn("document", F.xxhash64("doc", "hash"))
    if copies is not None:
        own = copies.select(F.col("doc").alias("__doc"), F.col("hash").alias("__hash"), "component").where("component is not null")
        thin = thin.join(own, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("hash") == F.col("__hash")), "left")
        thin = thin.withColumn("document", F.coalesce("component", "document")).drop("__doc", "__hash", "component")
    thin = settle(thin)

    # Leaves that enough documents reach, then how many documents have each of their lines.
    reached = thin.select("leaf", "document").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf")
    kept = settle(thin.drop("own").join(reached, "leaf"))
    by_line = kept.select("leaf", "content", "document").distinct().groupBy("leaf", "content").agg(F.count(F.lit(1)).alias("docs"))
    by_line = settle(by_line)
    exact = by_line.where(F.col("docs") >= min_docs).select("leaf", "content", F.xxhash64("leaf", "content").alias("template"))

    # Leaves to generalise: their other lines reach enough documents together.
    rare = F.sum(F.when(F.col("docs") < min_docs, F.col("docs")).otherwise(0))
    varied = by_line.groupBy("leaf").agg(rare.alias("rare")).where(F.col("rare") >= min_docs).select("leaf")
    wanted = by_line.join(varied, "leaf")
    # Texts are joined by sorting at every size, so that small tables show the plan of large ones.
    lines = full.select("leaf", "content", "tokens", "masked").join(
        wanted.select("leaf", "content").distinct().hint("merge"), ["leaf", "content"]
    )
    lines = lines.groupBy("leaf", "content").agg(F.first("tokens").alias("tokens"), F.first("masked").alias("masked"))
    lines = lines.join(wanted, ["leaf", "content"])
    placed = settle(
        lines.select("leaf", "content", "tokens", "docs", F.posexplode(F.split("masked", " ")).alias("place", "token")).withColumn(
            "word", F.when(F.col("token") != FIELD, F.xxhash64("token"))
        ).drop("token")
    )
    support = placed.where("word is not null").groupBy("leaf", "place", "word").agg(F.sum("docs").alias("support"))
    support = support.where(F.col("support") >= min_docs).select("leaf", "place", "word", F.lit(1).alias("fixed"))
    marked = placed.join(support, ["leaf", "place", "word"], "left")
    general = (
        marked.groupBy("leaf", "content", "tokens", "docs")
        .agg(
            F.sum(F.coalesce("fixed", F.lit(0))).alias("constants"),
            F.bit_xor(F.xxhash64("place", F.when(F.col("fixed") == 1, F.col("word")))).alias("shape"),
        )
        .where((F.col("docs") < min_docs) & (F.col("constants") >= constant * F.col("tokens")))
        .select("leaf", "content", F.xxhash64("leaf", "shape", F.lit(FIELD)).alias("template"))
    )

    # Occurrences of templates; those of recurring ones are dropped but for the first.
    templates = exact.unionByName(general)
    columns = ["template", "doc", "hash", "pos", "document", "needed"]
    occurring = kept.join(templates, ["leaf", "content"]).withColumn("needed", F.lit(min_docs)).select(*columns)
    if long_tokens is not None:
        # Long lines that fewer documents share word for word; such a group lies inside one template above, so first occurrences agree.
        long = thin.where("own is not null")
        few = long.select("leaf", "own", "document").distinct().groupBy("leaf", "own").count()
        few = few.where(F.col("count").between(LONG_DOCS, min_docs - 1)).select("leaf", "own")
        shared = long.join(few, ["leaf", "own"]).withColumn("template", F.xxhash64("leaf", "own", F.lit("long")))
        occurring = occurring.unionByName(shared.withColumn("needed", F.lit(LONG_DOCS)).select(*columns))
    # One row per template and document.
    each = settle(occurring.groupBy("template", "needed", "document", "doc", "hash").agg(F.collect_set("pos").alias("places")))
    number = each.select("template", "document", "needed").distinct().groupBy("template", "needed").count()
    number = number.where(F.col("count") >= F.col("needed")).select("template")
    place = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "hash", F.array_min("places").alias("pos"), "document")
    firsts = each.groupBy("template").agg(F.min(place)["document"].alias("first")).join(number, "template")
    own = F.array_remove("places", F.array_min("places"))
    dropped = each.join(firsts, "template").withColumn("places", F.when(F.col("document") == F.col("first"), own).otherwise(F.col("places")))
    dropped = dropped.where(F.size("places") > 0)
    return dropped.groupBy("doc", "hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("drops"))


def drop_recurring_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and ``n_lines`` and ``n_dropped``.

    Every row stays. A null text stays null (no lines); a text all of whose lines go becomes empty. Blank lines and lines of fewer than
    ``min_tokens`` tokens always stay. Rows equal in id and text count as one document and lose the same lines; the first occurrence is that
    in the smallest id (null last), then hash of the text, then line. Columns named ``n_lines`` or ``n_dropped`` are
    replaced, others pass through; an empty table gives an empty result.
    """
    drops = recurring_lines(docs, id_column, text, **settings).select(
        F.col("doc").alias("__doc"), F.col("hash").alias("__text_hash"), F.col("drops").alias("__drops")
    )
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*kept).withColumn("__hash", F.xxhash64(text))
    joined = rows.join(drops.hint("merge"), F.col(id_column).eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__text_hash")), "left")
    lines: Column = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drops"))
    joined = joined.withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"))
    joined = joined.withColumn("n_dropped", F.coalesce(F.size("__drops"), F.lit(0)).cast("long"))
    rebuilt = F.array_join(F.transform(F.array(lines), lambda own: F.transform(stay, lambda i: F.get(own, i)))[0], "\n")
    joined = joined.withColumn(text, F.when(F.col("__drops").isNull() | F.col(text).isNull(), F.col(text)).otherwise(rebuilt))
    return joined.select(*kept, "n_lines", "n_dropped")
