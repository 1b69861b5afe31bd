"""Day-partitioned quarantine tables and bundles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.numbers import day_stamp, second_stamp

# Aim for files of this size in a bundle; a bundle below it is a single file.
BUNDLE_FILE_BYTES = 128 * 1024 * 1024


def partition_for(scan_date: str | Column) -> Column:
    """The folder name of a day, ``yyyyMMdd``."""
    day = F.lit(scan_date).cast("date") if isinstance(scan_date, str) else scan_date
    return day_stamp(day)


def write_quarantine(rows: DataFrame, target: str, scan_date: str, run_id: str) -> None:
    """Write ``rows`` under their day and run.

    Same-day runs share the day. A run that is repeated replaces its own rows and no others.
    """
    placed = rows.withColumn("scan_day", partition_for(scan_date)).withColumn("run_id", F.lit(run_id))
    (
        placed.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("scan_day", "run_id")
        .parquet(target)
    )


write_manifest = write_quarantine


def write_bundle(
    quarantined: DataFrame, target: str, run_ts: str, payload: str, compression: str = "zstd"
) -> str | None:
    """Write this run's flagged items as one compressed artefact named by its timestamp.

    Returns its folder, or None when there is nothing to bundle. The number of files
    follows the measured payload, so a large bundle is not squeezed through one task.
    """
    size = quarantined.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(F.col(payload))), F.lit(0)).alias("bytes")
    ).first()
    if not size.rows:
        return None
    stamp = quarantined.sparkSession.range(1).select(second_stamp(F.lit(run_ts).cast("timestamp"))).first()[0]
    folder = f"{target.rstrip('/')}/bundle={stamp}"
    files = max(math.ceil(size.bytes / BUNDLE_FILE_BYTES), 1)
    # A shuffle, so that a small bundle's contents are still read by many tasks.
    quarantined.repartition(files).write.mode("overwrite").option("compression", compression).parquet(folder)
    return folder
