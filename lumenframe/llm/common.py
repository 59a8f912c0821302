"""What several training-data operators share."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL twin, if it has one."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


#: Bytes of an Arrow batch; whole texts travel in them, so a number of rows alone is no bound.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches in bytes, where nobody has."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string")) % modulus


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else left as it is."""
    return F.translate(text, UPPER, LOWER)


def worker_cache() -> dict:
    """A dict of the Python worker process, kept from task to task while the worker is reused."""
    return sys.modules.setdefault("_lumenframe_worker", types.ModuleType("_lumenframe_worker")).__dict__
