"""File catalog: which files are there, how big, under which root."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.paths import ext_in, not_system_dir
from siftwell.functions.numbers import size_ok
from siftwell.sources.profiles import SUPPORTED_EXTENSIONS


def list_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """``(path, size_bytes, modified)`` of all files below the roots.

    Only metadata columns are selected, so no file is opened. Roots that overlap list a
    file twice; see ``dedupe_first``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def catalog_scan(
    spark: SparkSession,
    roots: Sequence[str],
    extensions: Sequence[str] = SUPPORTED_EXTENSIONS,
    max_bytes: int | None = None,
) -> DataFrame:
    """Files that should be scanned. The size bound is pushed into the listing."""
    files = list_files(spark, roots)
    if max_bytes is not None:
        files = files.where(F.col("size_bytes") <= max_bytes)
    wanted = ext_in(F.col("path"), extensions) & ~ext_in(F.col("path"), ["log"])
    return files.where(wanted & not_system_dir(F.col("path")))


def filter_catalog(
    catalog: DataFrame,
    extensions: Sequence[str] = SUPPORTED_EXTENSIONS,
    max_bytes: int | None = None,
    path: str = "path",
    size: str = "size_bytes",
) -> DataFrame:
    """The discovery filters over a catalog table: extension, size, system directories."""
    kept = catalog.where(F.col(path) != "").where(ext_in(F.col(path), extensions)).where(~ext_in(F.col(path), ["log"]))
    if max_bytes is not None:
        kept = kept.where(size_ok(F.col(size), max_bytes))
    return kept.where(not_system_dir(F.col(path)))
