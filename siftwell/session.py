"""Session helpers shared by tests, the benchmark and streaming jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Inputs above this are never dealt out again, however many cores there are.
SPREAD_LIMIT_BYTES = 8 * 1024**3


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siftwell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # Call sites are not recorded for every column expression; that takes longer than building it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in ``spark.checkpoint.dir``.

    A local session without one gets a scratch folder. On a cluster that would be another
    folder on each machine, so there the setting is required.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="siftwell-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a source too small to be split over them.

    A file is read by one task per split, so a few hundred megabytes of text can leave most
    cores idle in front of a pattern match. Only where the estimated input fills less than a
    quarter of the cores with splits, and is small in itself, are the rows dealt out again.
    Anything larger is returned as it is, without a shuffle.
    """
    spark = df.sparkSession
    if df.isStreaming:
        return df
    try:
        estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        # Spark Connect has no plan statistics on the client.
        return df
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if estimate < min(cores * split // 4, SPREAD_LIMIT_BYTES) else df
