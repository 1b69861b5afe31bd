"""How each file format is cut: chunk size, joiner, blank handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.paths import extension

# Fixed values, one row per extension:
#   kind         how the bytes become segments
#   chunk_size   segments per match call, null = the whole text at once
#   chunk_at     'segment' closes a chunk anywhere, 'unit' only at the end of a page or shape
#   count_blank  do blank segments use up the cap
#   drop_blank   are blank segments left out of the chunks
#   joiner       put between segments
PROFILE_SCHEMA = (
    "ext string, kind string, chunk_size int, chunk_at string, "
    "count_blank boolean, drop_blank boolean, joiner string"
)
PROFILES = (
    (".txt", "lines", 500, "segment", True, False, ""),
    (".md", "lines", 500, "segment", True, False, ""),
    (".csv", "records", 100, "segment", True, True, "\n"),
    (".docx", "parts", 200, "segment", True, False, "\n"),
    (".xlsx", "rows", 100, "segment", False, True, "\n"),
    (".xls", "rows", 100, "segment", False, True, "\n"),
    (".pptx", "units", 50, "unit", False, True, "\n"),
    (".pdf", "units", 5, "unit", False, True, "\n"),
    (".doc", "utf16", None, "segment", True, False, ""),
    (".wps", "streams", None, "segment", False, True, "\n"),
    (".ppt", "streams", None, "segment", False, True, "\n"),
    (".dps", "streams", None, "segment", False, True, "\n"),
    (".et", "rows", None, "segment", False, True, "\n"),
)
SUPPORTED_EXTENSIONS = tuple(row[0] for row in PROFILES)
# Lines per chunk of a PDF when a faster page reader is used.
PDF_FAST_CHUNK = 10


def profiles_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROFILES), PROFILE_SCHEMA)


def with_profile(
    catalog: DataFrame, path: str = "path", strict: bool = False, chunk_sizes: dict[str, int] | None = None,
    caps: dict[str, int] | None = None,
) -> DataFrame:
    """Add ``ext`` and the profile columns; an unknown extension gets nulls, hence no text.

    The profile table has thirteen fixed rows, so broadcasting it is safe at any scale.
    ``strict`` treats ``.md`` as a listed extension that is never read. ``chunk_sizes``
    replaces chunk sizes by extension; ``caps`` gives the segments to read, all by default,
    as ``segment_cap``.
    """
    spark = catalog.sparkSession
    table = profiles_df(spark)
    if strict:
        table = table.where(F.col("ext") != ".md")
    for ext, size in (chunk_sizes or {}).items():
        table = table.withColumn("chunk_size", F.when(F.col("ext") == ext, F.lit(size)).otherwise(F.col("chunk_size")))
    cap = F.lit(None).cast("int")
    for ext, n in (caps or {}).items():
        cap = F.when(F.col("ext") == ext, F.lit(n)).otherwise(cap)
    table = table.withColumn("segment_cap", cap)
    return catalog.withColumn("ext", extension(F.col(path))).join(F.broadcast(table), "ext", "left")
