"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All but the last return the columns of
``documents``. Between stages the rows are written once as Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import langid, lines, mixing, neardup, packing
from lumenframe.llm.common import bound_batches
from lumenframe.session import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language is less likely than this is rejected, as is one without letters.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. The classifier learns from all labelled rows; labels are no input of a prediction.

    Without any labelled row there is nothing to judge by, and only documents without letters go.
    """
    bound_batches(spark)
    model = langid.train(docs, F.col("text"), F.col("lang"))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).select(*COLUMNS)
    known = langid.identify(docs.select(*COLUMNS), model, to="lang_pred", score="lang_score")
    return known.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines, short ones too, that recur across documents; ``n_chars`` follows the text. Every row stays.

    A line of 50 tokens or more recurs from two documents on. Near-duplicates count as one document here, so that their common lines
    stay and the next stage finds them whole. A null id is an id like others; repeated rows lose the same lines.
    """
    bound_batches(spark)
    docs = docs.select(*COLUMNS)
    groups = neardup.near_duplicates(docs, width=5, percent=80, with_hash=True)
    groups = groups.where("component is not null").select(F.col("doc_id").alias("doc"), F.col("text_hash").alias("hash"), "component").distinct()
    cleaned = lines.drop_recurring_lines(docs, copies=groups)
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", length).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    bound_batches(spark)
    return neardup.keep_one(docs.select(*COLUMNS), width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; sources weigh 1, 2, 3, repeating in the order of their names.

    A null source is the last one; null ids and repeated rows are documents like others; one without words is not taken.
    """
    mix = mixing.mix(docs, F.array("source"), mixing.count_words(F.col("text")), keep=("text", "lang", "source", "n_chars"))
    taken = mix.rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents with their places in sequences of 2048 tokens.

    A null text is empty; repeated rows are packed as often as they occur.
    """
    bound_batches(spark)
    pieces = packing.cut(
        docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )
    pieces = settle(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packing.place(pieces)


STAGES = [
    ("language", identify_language),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenization has no SQL form.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
