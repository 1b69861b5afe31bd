"""Appending to the resume log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.paths import path_key


def scan_log_rows(
    outcomes: DataFrame, scan_date: str, run_id: str, path: str = "path", style: str = "windows"
) -> DataFrame:
    """Log rows of everything that was dealt with, flagged or not.

    Items that failed are left out, so that the next run tries them again.
    """
    dealt_with = outcomes.where(F.col("status") != "error") if "status" in outcomes.columns else outcomes
    return dealt_with.select(
        path_key(F.col(path), style).alias("path_key"),
        F.lit(run_id).alias("run_id"),
        F.lit(scan_date).cast("date").alias("scan_date"),
    )


def append_scan_log(
    outcomes: DataFrame, target: str, scan_date: str, run_id: str, path: str = "path", style: str = "windows"
) -> None:
    rows = scan_log_rows(outcomes, scan_date, run_id, path, style)
    rows.write.mode("append").partitionBy("scan_date").parquet(target)
