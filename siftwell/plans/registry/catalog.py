r"""A file catalog derived from ``documents``, its filters, scalars and resume.

The paths are built from the document number so that drives, system directories, name
conflicts, literal ``_n`` names and all kinds of extensions occur, at any table size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import numbers, paths
from siftwell.operators import catalog as ops
from siftwell.plans.registry.base import query, table
from siftwell.sources.catalog import filter_catalog
from siftwell.sources.profiles import SUPPORTED_EXTENSIONS, with_profile

DRIVES = ("C:", "D:")
DIRS = ("\\Users\\a\\", "\\Windows\\", "\\Program Files\\x\\", "\\ProgramData\\", "\\Data\\")
EXTENSIONS = (*SUPPORTED_EXTENSIONS, ".log", ".exe", ".TXT", "")
MAX_BYTES = 4_000


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def derived_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, path, root, ord, size_bytes)``; every 41st size is unknown."""
    doc = F.col("doc_id")
    drive = _pick(DRIVES, doc % len(DRIVES))
    name = F.concat(
        F.lit("f"),
        (doc % 50).cast("string"),
        F.when(doc % 7 == 0, F.concat(F.lit("_"), (doc % 3 + 1).cast("string"))).otherwise(F.lit("")),
        _pick(EXTENSIONS, doc % len(EXTENSIONS)),
    )
    folder = F.concat(F.lit("d"), F.floor(doc / 50).cast("string"), F.lit("\\"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(drive, _pick(DIRS, doc % len(DIRS)), folder, name).alias("path"),
        F.concat(drive, F.lit("\\")).alias("root"),
        doc.alias("ord"),
        F.when(doc % 41 != 0, F.octet_length("text").cast("bigint")).alias("size_bytes"),
    )


def _list_sql(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


CATALOG_SQL = f"""
    catalog AS (
        SELECT doc_id,
               {_list_sql(DRIVES)}[doc_id % {len(DRIVES)} + 1] || {_list_sql(DIRS)}[doc_id % {len(DIRS)} + 1]
               || 'd' || (doc_id // 50) || '\\' || 'f' || (doc_id % 50)
               || CASE WHEN doc_id % 7 = 0 THEN '_' || (doc_id % 3 + 1) ELSE '' END
               || {_list_sql(EXTENSIONS)}[doc_id % {len(EXTENSIONS)} + 1] AS path,
               {_list_sql(DRIVES)}[doc_id % {len(DRIVES)} + 1] || '\\' AS root,
               doc_id AS ord,
               CASE WHEN doc_id % 41 <> 0 THEN octet_length(encode(text)) END AS size_bytes
        FROM documents)"""
BASE_SQL = r"regexp_extract(path, '([^\\/]*)$', 1)"
EXT_SQL = rf"regexp_extract({BASE_SQL}, '^\.*[^.].*?(\.[^.]*)$', 1)"
FIRST_DIR_SQL = r"lower(regexp_extract(path, '^[A-Za-z]:\\*([^\\]*)', 1))"
SYSTEM_SQL = "(" + ", ".join(f"'{d}'" for d in paths.SYSTEM_DIRS) + ")"
SUPPORTED_SQL = "(" + ", ".join(f"'{e}'" for e in SUPPORTED_EXTENSIONS) + ")"


@query(
    "catalog_filter",
    f"""WITH {CATALOG_SQL} SELECT path, size_bytes FROM catalog
    WHERE lower({EXT_SQL}) IN {SUPPORTED_SQL} AND lower({EXT_SQL}) <> '.log'
      AND (size_bytes IS NULL OR size_bytes <= {MAX_BYTES}) AND {FIRST_DIR_SQL} NOT IN {SYSTEM_SQL}""",
)
def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_catalog(derived_catalog(spark, sf_dir), max_bytes=MAX_BYTES).select("path", "size_bytes")


@query(
    "system_dir_filter",
    f"""WITH {CATALOG_SQL} SELECT path, {FIRST_DIR_SQL} NOT IN {SYSTEM_SQL} AS kept_always,
    NOT (lower(path) LIKE 'c:%' AND {FIRST_DIR_SQL} IN {SYSTEM_SQL}) AS kept_for_drive, true AS kept_for_folder FROM catalog""",
)
def system_dir_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return derived_catalog(spark, sf_dir).select(
        "path",
        paths.not_system_dir(path).alias("kept_always"),
        paths.not_system_dir_of_root(path, F.lit("C:")).alias("kept_for_drive"),
        paths.not_system_dir_of_root(path, F.lit("C:\\ProgramData")).alias("kept_for_folder"),
    )


@query(
    "under_root",
    f"WITH {CATALOG_SQL} SELECT path FROM catalog WHERE starts_with(lower(path), 'c:\\users\\')",
)
def under_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_catalog(spark, sf_dir).where(paths.under(F.col("path"), "C:/Users")).select("path")


@query(
    "size_filter",
    f"WITH {CATALOG_SQL} SELECT path, size_bytes / 1048576.0 AS size_mb FROM catalog WHERE size_bytes IS NULL OR size_bytes <= {MAX_BYTES}",
)
def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = derived_catalog(spark, sf_dir).where(numbers.size_ok(F.col("size_bytes"), MAX_BYTES))
    return kept.select("path", numbers.size_mb(F.col("size_bytes")).alias("size_mb"))


@query(
    "path_scalars",
    f"""WITH {CATALOG_SQL} SELECT path, {BASE_SQL} AS base, lower({EXT_SQL}) AS ext,
    substr({BASE_SQL}, 1, length({BASE_SQL}) - length({EXT_SQL})) AS stem,
    regexp_extract(path, '^(.*)\\\\[^\\\\]*$', 1) AS dir, lower(path) AS path_key FROM catalog""",
)
def path_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return derived_catalog(spark, sf_dir).select(
        "path",
        paths.base_name(path).alias("base"),
        paths.extension(path).alias("ext"),
        paths.stem(path).alias("stem"),
        paths.dir_name(path).alias("dir"),
        paths.path_key(path).alias("path_key"),
    )


@query(
    "normalized_roots",
    r"""SELECT url, rtrim(replace(url, '/', '\'), '\') || '\' AS root FROM pages""",
)
def normalized_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", paths.normalize_root(F.col("url")).alias("root"))


# Messy spellings of each path, all of which have the same key.
@query(
    "path_keys_folded",
    f"""WITH {CATALOG_SQL} SELECT doc_id, lower(path) AS key_dots, lower(path) AS key_slashes, lower(path) AS key_parent FROM catalog""",
)
def path_keys_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    dotted = F.regexp_replace(path, r"\\f", r"\\.\\\\f")
    slashed = F.replace(path, F.lit("\\"), F.lit("//"))
    parent = F.regexp_replace(path, r"^(..)\\", r"$1\\..\\gone\\..\\")
    return derived_catalog(spark, sf_dir).select(
        "doc_id",
        paths.path_key(dotted).alias("key_dots"),
        paths.path_key(slashed).alias("key_slashes"),
        paths.path_key(parent).alias("key_parent"),
    )


def duplicated_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog once more for the labelled documents, found under a second root."""
    catalog = derived_catalog(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct()
    again = catalog.join(labelled, "doc_id", "left_semi").withColumn("ord", F.col("ord") + 1_000_000_000)
    return catalog.unionByName(again.withColumn("root", F.lit("E:\\")))


DUPLICATED_SQL = f"""{CATALOG_SQL},
    catalog_dup AS (
        SELECT * FROM catalog UNION ALL
        SELECT doc_id, path, 'E:\\' AS root, ord + 1000000000 AS ord, size_bytes FROM catalog
        WHERE doc_id IN (SELECT doc_id FROM labels))"""


@query(
    "dedupe_first",
    f"""WITH {DUPLICATED_SQL} SELECT path, ord, root, size_bytes FROM (
        SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord) AS r FROM catalog_dup) WHERE r = 1""",
)
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dedupe_first(duplicated_catalog(spark, sf_dir).drop("doc_id"))


@query(
    "root_summary",
    f"""WITH {DUPLICATED_SQL} SELECT root, count(*) AS files, count(*) FILTER (WHERE size_bytes > {MAX_BYTES}) AS oversize
    FROM catalog_dup GROUP BY root""",
)
def root_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.root_summary(duplicated_catalog(spark, sf_dir), MAX_BYTES)


@query(
    "format_profiles",
    f"""WITH {CATALOG_SQL}, profile(ext, kind, chunk_size) AS (VALUES
        ('.txt', 'lines', 500), ('.md', 'lines', 500), ('.csv', 'records', 100), ('.docx', 'parts', 200), ('.xlsx', 'rows', 100),
        ('.xls', 'rows', 100), ('.pptx', 'units', 50), ('.pdf', 'units', 5), ('.doc', 'utf16', NULL), ('.wps', 'streams', NULL),
        ('.ppt', 'streams', NULL), ('.dps', 'streams', NULL), ('.et', 'rows', NULL))
    SELECT path, lower({EXT_SQL}) AS ext, kind, chunk_size
    FROM catalog LEFT JOIN profile ON profile.ext = lower({EXT_SQL})""",
)
def format_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_profile(derived_catalog(spark, sf_dir)).select("path", "ext", "kind", "chunk_size")


def scan_log_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resume log that holds the labelled documents, one line per label."""
    catalog = derived_catalog(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return catalog.join(labels, "doc_id").select(paths.path_key(F.col("path")).alias("path_key"))


@query(
    "skip_scanned",
    f"WITH {CATALOG_SQL} SELECT doc_id, path FROM catalog WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def skip_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo = ops.skip_scanned(derived_catalog(spark, sf_dir), scan_log_of_labels(spark, sf_dir))
    return todo.select("doc_id", "path")


@query(
    "with_batch",
    f"""WITH {CATALOG_SQL} SELECT path, (row_number() OVER (ORDER BY path) - 1) // 100 AS batch_no FROM catalog""",
)
def with_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_batch(derived_catalog(spark, sf_dir), 100).select("path", "batch_no")


@query(
    "with_progress",
    """SELECT event_id, row_number() OVER (ORDER BY event_id) AS completed, count(*) OVER () AS total,
    row_number() OVER (ORDER BY event_id) * 100 // count(*) OVER () AS pct FROM events""",
)
def with_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_progress(table(spark, sf_dir, "events").select("event_id"), ["event_id"])


@query(
    "scalar_stamps",
    """SELECT event_id, strftime(ts, '%Y%m%d') AS day, strftime(ts, '%Y%m%d_%H%M%S') AS second,
    CAST(ceil(event_id / 1000.0) AS BIGINT) AS batches, user_id * 100 // (user_id + event_id + 1) AS pct FROM events""",
)
def scalar_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        numbers.day_stamp(F.col("ts")).alias("day"),
        numbers.second_stamp(F.col("ts")).alias("second"),
        numbers.batch_count(F.col("event_id"), 1000).alias("batches"),
        numbers.percent_done(F.col("user_id"), F.col("user_id") + F.col("event_id") + 1).alias("pct"),
    )
