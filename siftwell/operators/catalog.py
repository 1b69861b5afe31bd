"""Catalog operators: dedupe, per-root summary, resume, batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.numbers import percent_done
from siftwell.functions.paths import path_key
from siftwell.operators.ordinals import beside, positions

# Fixed value: items per labelled batch.
BATCH_SIZE = 1000


def dedupe_first(catalog: DataFrame, key: str = "path", order: str = "ord") -> DataFrame:
    """One row per path, the first by ``order``.

    ``min`` over a struct led by the order column combines on the map side, so a path that
    occurs very often is reduced before the shuffle.
    """
    rest = [c for c in catalog.columns if c not in (key, order)]
    first = F.min(F.struct(order, *rest)).alias("_first")
    return catalog.groupBy(key).agg(first).select(key, *[F.col(f"_first.{c}").alias(c) for c in (order, *rest)])


def root_summary(catalog: DataFrame, max_bytes: int, root: str = "root", size: str = "size_bytes") -> DataFrame:
    """Files and oversize files found per root."""
    return catalog.groupBy(root).agg(
        F.count("*").alias("files"), F.count_if(F.col(size) > max_bytes).alias("oversize")
    )


def skip_scanned(catalog: DataFrame, scan_log: DataFrame, path: str = "path", style: str = "windows") -> DataFrame:
    """Drop files whose normalised path is in the log.

    The log is reduced to distinct keys first; that shares the join's partitioning and
    keeps a key that was logged very often from piling up.
    """
    seen = scan_log.select("path_key").dropDuplicates()
    keyed = catalog.withColumn("path_key", path_key(F.col(path), style))
    return keyed.join(seen, "path_key", "left_anti").drop("path_key")


def with_batch(catalog: DataFrame, size: int = BATCH_SIZE, order: str = "path") -> DataFrame:
    """Add ``batch_no``, ``size`` files per batch in path order, without a one-task window."""
    numbered = positions(catalog, [], [order], out="_pos")
    return numbered.withColumn("batch_no", F.floor(F.col("_pos") / F.lit(float(size))).cast("bigint")).drop("_pos")


def with_progress(results: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``completed`` (1, 2, ...), ``total`` and ``pct``, the whole percent completed."""
    counted = results.agg(F.count("*").alias("_total"))
    numbered = beside(positions(results, [], order, out="_pos"), counted, F.col("_total"))
    completed, total = F.col("_pos") + 1, F.col("_total")
    return numbered.select(
        *results.columns,
        completed.alias("completed"),
        total.alias("total"),
        percent_done(completed, total).alias("pct"),
    )
