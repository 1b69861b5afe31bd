"""The resume log: which items were already scanned on a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.paths import path_key
from siftwell.functions.text import strip

SCAN_LOG_SCHEMA = "path_key string, run_id string, scan_date date"


def read_scan_log(spark: SparkSession, path: str, scan_date: str | None = None) -> DataFrame:
    """The log table, pruned to one day partition when a date is given."""
    log = spark.read.schema(SCAN_LOG_SCHEMA).parquet(path)
    return log if scan_date is None else log.where(F.col("scan_date") == F.lit(scan_date).cast("date"))


def read_text_log(spark: SparkSession, path: str, style: str = "windows") -> DataFrame:
    """A plain log with one path per line: trimmed, blank lines ignored, normalised."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("path")).where("path <> ''")
    return lines.select(path_key(F.col("path"), style).alias("path_key")).dropDuplicates()
