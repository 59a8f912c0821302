"""Session defaults used by tests and the benchmark; clusters bring their own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Spark's setting for queries whose shuffle files nothing reads again.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", app: str = "lumenframe") -> SparkSession:
    """A local session with UTC time, AQE and as many shuffle partitions as cores."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark) -> str:
    """The folder that the driver and all executors share, named by ``spark.checkpoint.dir``.

    Only a local master, where one machine is everything, gets a folder of its own
    when the setting is missing; a cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="lumenframe-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df):
    """Cut lineage through reliable storage in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def settle(df):
    """Write ``df`` once as Parquet in the shared folder and return a reader of it.

    Lineage is cut, columns and row groups can be pruned when it is read again, and
    losing an executor loses nothing. The folder's owner clears it, as with checkpoints.
    Shuffle files of the write go when it has ended, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lumenframe-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
