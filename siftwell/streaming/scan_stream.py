"""The scan as a stream: new files only, flagged items handled in the batch that finds them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siftwell.functions.numbers import size_mb
from siftwell.functions.paths import ext_in, not_system_dir
from siftwell.functions.rules import RuleSet
from siftwell.operators.matching import FUSED
from siftwell.operators.quarantine import build_manifest, resolve_names
from siftwell.operators.verdicts import classify
from siftwell.plans.scan import scan_contents
from siftwell.sinks.quarantine import partition_for
from siftwell.sinks.scan_log import scan_log_rows
from siftwell.sources.profiles import SUPPORTED_EXTENSIONS
from siftwell.sources.segments import Extractor
from siftwell.sources.settings import Settings

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


MANIFEST = (
    "seq bigint, src_path string, dest_path string, original_name string, backup_name string, renamed boolean, "
    "mode string, run_id string, scan_date date, scan_day string, batch_id bigint"
)


def _replace_batch(df: DataFrame, folder: str, day: str, batch_id: int) -> None:
    """Write one batch so that repeating it replaces its rows instead of adding them again."""
    placed = df.withColumn("scan_day", partition_for(day)).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_day", "batch_id").parquet(folder)


def _of_batch(spark: SparkSession, folder: str, batch_id: int, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(folder).where(F.col("batch_id") == batch_id)


def _there(read: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _day_of(spark: SparkSession, target: str, batch_id: int) -> str:
    """The day a batch was first scanned on, which stays its day when it is repeated; today for a new one."""
    seen = _there(lambda: spark.read.schema("scan_day string, batch_id bigint").parquet(f"{target}/verdicts"))
    row = None if seen is None else seen.where(F.col("batch_id") == batch_id).select("scan_day").first()
    return dt.date.today().isoformat() if row is None else dt.datetime.strptime(row.scan_day, "%Y%m%d").date().isoformat()


def foreach_batch_scan(
    target: str,
    rules: RuleSet,
    settings: Settings,
    scan_date: str | None = None,
    extractors: dict[str, Extractor] | None = None,
    mode: str = FUSED,
    style: str = "posix",
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over ``(path, length, content)`` batches.

    Writes ``verdicts``, ``manifest``, ``quarantine`` and ``scan_log`` below ``target``, by day and
    batch. The verdicts are written first and read back, so the text is matched once however
    many tables follow. Names in quarantine are unique within the day and manifest numbers go on
    from batch to batch: what other batches have claimed is read from the manifest itself. A
    batch that is repeated replaces its own rows. Without a ``scan_date`` it is the day on which
    a batch first ran.
    """

    def scan_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        day = scan_date or _day_of(spark, target, batch_id)
        folder = spark.range(1).select(partition_for(day)).first()[0]
        files = batch.where(not_system_dir(F.col("path"))).select("path", F.col("length").alias("size_bytes"), "content")
        judged = scan_contents(
            files.where(F.col("size_bytes") <= settings.max_bytes).select("path", "content"),
            rules,
            settings.match_threshold,
            extractors,
            mode,
        )
        outcome = files.select("path", "size_bytes").join(judged, "path", "left").select(
            "path",
            "size_bytes",
            size_mb(F.col("size_bytes")).alias("size_mb"),
            F.coalesce("is_sensitive", F.lit(False)).alias("is_sensitive"),
            "details",
            "error",
            classify(F.col("size_bytes"), F.col("is_sensitive"), settings.max_bytes, error=F.col("error")).alias("status"),
        )
        _replace_batch(outcome, f"{target}/verdicts", day, batch_id)
        written = _of_batch(spark, f"{target}/verdicts", batch_id)
        run_id = f"batch-{batch_id}"
        flagged = written.where("is_sensitive").select("path").dropDuplicates()
        if not flagged.isEmpty():
            manifest = _there(lambda: spark.read.schema(MANIFEST).parquet(f"{target}/manifest"))
            others = spark.createDataFrame([], MANIFEST) if manifest is None else manifest.where((F.col("scan_day") == folder) & (F.col("batch_id") != batch_id))
            last = others.where(F.col("batch_id") < batch_id).agg(F.max("seq")).first()[0]
            named = resolve_names(flagged, others.select(F.col("backup_name").alias("dest_name")))
            listed = build_manifest(named, f"{target}/{folder}/target", settings.mode, run_id, day, (last or 0) + 1)
            _replace_batch(listed, f"{target}/manifest", day, batch_id)
            mine = _of_batch(spark, f"{target}/manifest", batch_id, MANIFEST).select(F.col("src_path").alias("path"), "dest_path")
            _replace_batch(files.join(mine, "path"), f"{target}/quarantine", day, batch_id)
        _replace_batch(scan_log_rows(written, day, run_id, style=style), f"{target}/scan_log", day, batch_id)

    return scan_batch


def scan_stream(
    spark: SparkSession,
    directory: str,
    target: str,
    checkpoint: str,
    rules: RuleSet,
    settings: Settings | None = None,
    scan_date: str | None = None,
    extensions: Sequence[str] = SUPPORTED_EXTENSIONS,
    extractors: dict[str, Extractor] | None = None,
    max_files_per_trigger: int = 10_000,
) -> StreamingQuery:
    """Scan the files that are new since the last run, in batches of bounded length, then stop.

    The checkpoint remembers the files, so a run that follows opens none of them again.
    """
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True)
    files = reader.option("maxFilesPerTrigger", max_files_per_trigger).load(directory).where(ext_in(F.col("path"), extensions))
    scan_batch = foreach_batch_scan(target, rules, settings or Settings(), scan_date, extractors)
    return (
        files.writeStream.foreachBatch(scan_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
