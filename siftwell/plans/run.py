"""A whole run over files: discover, skip, scan, quarantine, list, log, bundle, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.rules import RuleSet, check_on_spark
from siftwell.operators.matching import FUSED
from siftwell.operators.quarantine import build_manifest, resolve_names
from siftwell.operators.reporting import run_report
from siftwell.operators.verdicts import DETAILS
from siftwell.plans.scan import scan_files
from siftwell.sinks.encryption import encrypt_payload
from siftwell.sinks.quarantine import partition_for, write_bundle, write_manifest, write_quarantine
from siftwell.sinks.scan_log import append_scan_log
from siftwell.sources.contents import read_contents
from siftwell.sources.profiles import SUPPORTED_EXTENSIONS
from siftwell.sources.scan_log import read_scan_log
from siftwell.sources.segments import Extractor
from siftwell.sources.settings import Settings

PLACED = "scan_day string, run_id string"
VERDICT_SCHEMA = (
    "path string, size_bytes bigint, size_mb double, is_sensitive boolean, "
    f"details {DETAILS}, error string, status string, {PLACED}"
)
MANIFEST_SCHEMA = (
    "seq bigint, src_path string, dest_path string, original_name string, backup_name string, renamed boolean, "
    f"mode string, scan_date date, {PLACED}"
)
QUARANTINE_SCHEMA = f"path string, content binary, dest_path string, {PLACED}"


@dataclass(frozen=True)
class Run:
    verdicts: DataFrame
    manifest: DataFrame
    report: DataFrame
    bundle: str | None

    def create_views(self, prefix: str = "scan_") -> None:
        """Offer the tables of the run to Spark SQL."""
        for name in ("verdicts", "manifest", "report"):
            getattr(self, name).createOrReplaceTempView(prefix + name)


def _if_there(read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def run_scan(
    spark: SparkSession,
    roots: Sequence[str],
    target: str,
    rules: RuleSet,
    settings: Settings,
    run_ts: str,
    run_id: str,
    extensions: Sequence[str] = SUPPORTED_EXTENSIONS,
    extractors: dict[str, Extractor] | None = None,
    mode: str = FUSED,
    style: str = "posix",
    key: str | None = None,
) -> Run:
    """Run once and write ``verdicts``, ``manifest``, ``quarantine``, ``scan_log`` and a bundle below ``target``.

    Every table is written before the next one is derived from it, so texts are matched
    once. The log comes last: a run that breaks off is repeated under the same ``run_id``
    and replaces what it had written. The files themselves are never deleted; in ``move``
    mode the manifest says so and ``verdicts`` tells what remains.
    """
    check_on_spark(spark, rules)
    day = run_ts[:10]
    folder = spark.range(1).select(partition_for(day)).first()[0]
    log = _if_there(lambda: read_scan_log(spark, f"{target}/scan_log", day))
    scanned = scan_files(spark, roots, rules, settings, log, extensions, extractors, mode, style)
    write_quarantine(scanned, f"{target}/verdicts", day, run_id)
    mine = (F.col("scan_day") == folder) & (F.col("run_id") == run_id)
    verdicts = spark.read.schema(VERDICT_SCHEMA).parquet(f"{target}/verdicts").where(mine)

    flagged = verdicts.where("is_sensitive").select("path")
    earlier = _if_there(lambda: spark.read.schema(MANIFEST_SCHEMA).parquet(f"{target}/manifest"))
    if earlier is None:
        taken = spark.createDataFrame([], "dest_name string")
    else:
        others = earlier.where((F.col("scan_day") == folder) & (F.col("run_id") != run_id))
        taken = others.select(F.col("backup_name").alias("dest_name"))
    named = resolve_names(flagged, taken)
    listed = build_manifest(named, f"{target}/{folder}/target", settings.mode, run_id, day)
    write_manifest(listed.drop("run_id"), f"{target}/manifest", day, run_id)
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{target}/manifest").where(mine)

    contents = read_contents(verdicts.where("is_sensitive").select("path", "size_bytes"))
    held = contents.select("path", "content").join(manifest.select(F.col("src_path").alias("path"), "dest_path"), "path")
    write_quarantine(held, f"{target}/quarantine", day, run_id)
    stored = spark.read.schema(QUARANTINE_SCHEMA).parquet(f"{target}/quarantine").where(mine)
    bundled = stored if key is None else encrypt_payload(stored, "content", key)
    bundle = write_bundle(bundled.select("path", "dest_path", "content"), f"{target}/{folder}", run_ts, "content")
    append_scan_log(verdicts, f"{target}/scan_log", day, run_id, style=style)
    return Run(verdicts, manifest, run_report(verdicts), bundle)
