"""Incremental reading of delimited files that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lumenframe.functions.numbers import quoted
from lumenframe.sources.delimited import _Rules


def ingest_delimited(
    spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, sep: str = ",", files_per_batch: int = 100,
    rejects: str | None = None,
) -> StreamingQuery:
    """Append every new file of ``folder`` to a Parquet table, each exactly once.

    Runs until all present files are read, and carries on from ``checkpoint`` next time, also after a failure. There is no row limit. A
    record with too many fields is left out and goes to the Parquet table ``rejects`` (``file, fields, record, cells``), if given; one with too
    few ends in nulls, and a cell that is not of its type is null. Line breaks inside quotes belong to their field; so a file is
    read by one task, and many files by many.
    """
    kinds = T._parse_datatype_string(schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in kinds.fields] + [T.StructField("__record", T.StringType())])
    count = F.when(F.col("__record").isNotNull(), F.size(_Rules(sep).fields(F.col("__record"))))

    def stream() -> DataFrame:
        # All cells are read as text, so a record is malformed by its number of fields only, whatever columns are asked for.
        reader = spark.readStream.schema(text).option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True)
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__record").option("maxFilesPerTrigger", files_per_batch)
        return reader.csv(folder).withColumn("__fields", count)

    def start(rows: DataFrame, path: str, state: str) -> StreamingQuery:
        sink = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", state)
        return sink.trigger(availableNow=True).start()

    long = F.coalesce(F.col("__fields") > len(kinds.fields), F.lit(False))
    if rejects is not None:
        cells = F.array(*[F.col(quoted(f.name)) for f in kinds.fields]).alias("cells")
        bad = stream().where(long).select(F.input_file_name().alias("file"), F.col("__fields").alias("fields"), F.col("__record").alias("record"), cells)
        start(bad, rejects, f"{checkpoint}/rejects").awaitTermination()
    cells = [F.nullif(F.col(quoted(f.name)), F.lit("")).try_cast(f.dataType).alias(f.name) for f in kinds.fields]
    return start(stream().where(~long).select(*cells), target, checkpoint)
