"""Outcomes, reports, quarantine, manifest, restore, names, encryption, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.paths import base_name, raw_extension, stem
from siftwell.operators import matching as match_ops
from siftwell.operators.quarantine import build_manifest, quarantine, resolve_names, restore
from siftwell.operators.reporting import run_report, rule_summary
from siftwell.operators.verdicts import classify, discard_stale
from siftwell.plans.registry.base import (
    THRESHOLD,
    corpus_rules,
    early_ctes,
    hits_ctes,
    query,
    rule_name_sql,
    table,
)
from siftwell.plans.registry.catalog import BASE_SQL, CATALOG_SQL, EXT_SQL, MAX_BYTES, derived_catalog
from siftwell.plans.registry.matching import DOC, _documents
from siftwell.plans.scan import scan_text, with_verdicts
from siftwell.session import checkpointed, shared_folder
from siftwell.sinks.encryption import decrypt_payload, encrypt_payload
from siftwell.sinks.scan_log import scan_log_rows
from siftwell.streaming.accumulate import accumulate_stream

SCAN_DATE, RUN_ID, TARGET = "2024-06-01", "run-1", "quarantine/20240601/target"

_FOUND_SQL = f"{hits_ctes('documents', 'doc_id')}, {early_ctes('doc_id', 'pos')}"
_VERDICT_SQL = f"""{_FOUND_SQL},
    verdicts AS (
        SELECT d.doc_id, coalesce(bool_or(f.match_count >= {THRESHOLD}), false) AS is_sensitive
        FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.doc_id)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_text(_documents(spark, sf_dir), DOC, corpus_rules(), THRESHOLD).select("doc_id", "is_sensitive")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog, verdict and the time of the event with the document's number."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("value").alias("elapsed_ms"))
    joined = (
        derived_catalog(spark, sf_dir)
        .join(_verdicts(spark, sf_dir), "doc_id")
        .join(events, "doc_id", "left")
    )
    status = classify(F.col("size_bytes"), F.col("is_sensitive"), MAX_BYTES, F.col("elapsed_ms") * 10)
    return joined.select("doc_id", "path", status.alias("status"))


_OUTCOME_SQL = f"""{CATALOG_SQL}, {_VERDICT_SQL},
    outcomes AS (
        SELECT c.doc_id, c.path, CASE WHEN v.is_sensitive THEN 'sensitive' WHEN c.size_bytes IS NULL THEN 'unreadable'
            WHEN c.size_bytes > {MAX_BYTES} THEN 'oversize' WHEN e."value" * 10 <= 200 THEN 'quick' ELSE 'safe' END AS status
        FROM catalog c JOIN verdicts v ON v.doc_id = c.doc_id LEFT JOIN events e ON e.event_id = c.doc_id)"""


@query("classify", f"WITH {_OUTCOME_SQL} SELECT doc_id, path, status FROM outcomes")
def classify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir)


@query(
    "run_report",
    f"""WITH {_OUTCOME_SQL} SELECT 'scanned' AS metric, count(*) AS "value" FROM outcomes UNION ALL
    SELECT s.metric, count(o.status) FROM (VALUES ('sensitive'), ('error'), ('unreadable'), ('oversize'), ('quick'), ('safe')) s(metric)
    LEFT JOIN outcomes o ON o.status = s.metric GROUP BY s.metric""",
)
def run_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(_outcomes(spark, sf_dir))


@query(
    "rule_summary",
    f"""WITH {_FOUND_SQL} SELECT rule_idx, {rule_name_sql()} AS rule_name, CAST(sum(match_count) AS BIGINT) AS hits,
    count(*) AS documents FROM found GROUP BY rule_idx""",
)
def rule_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = corpus_rules()
    found = match_ops.row_findings(_documents(spark, sf_dir), DOC, rules, THRESHOLD)
    return rule_summary(match_ops.explode_findings(found, DOC, rules))


@query(
    "discard_stale",
    f"WITH {_VERDICT_SQL} SELECT doc_id, is_sensitive FROM verdicts WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def discard_stale_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    written_off = table(spark, sf_dir, "labels").where("toxic = 1")
    return discard_stale(_verdicts(spark, sf_dir), written_off, DOC)


@query(
    "scan_log_rows",
    f"WITH {_OUTCOME_SQL} SELECT lower(path) AS path_key, '{RUN_ID}' AS run_id, DATE '{SCAN_DATE}' AS scan_date FROM outcomes",
)
def scan_log_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_log_rows(_outcomes(spark, sf_dir), SCAN_DATE, RUN_ID)


@query(
    "quarantine_copy",
    f"WITH {_VERDICT_SQL} SELECT d.doc_id, d.text, d.lang, d.source FROM documents d JOIN verdicts v USING (doc_id) WHERE v.is_sensitive",
)
def quarantine_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "documents").drop("n_chars")
    return quarantine(source, _verdicts(spark, sf_dir), DOC, "copy")[0]


@query(
    "quarantine_move",
    f"WITH {_VERDICT_SQL} SELECT d.doc_id, d.text, d.lang, d.source FROM documents d JOIN verdicts v USING (doc_id) WHERE NOT v.is_sensitive",
)
def quarantine_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the source holds after the flagged rows have moved out."""
    source = table(spark, sf_dir, "documents").drop("n_chars")
    return quarantine(source, _verdicts(spark, sf_dir), DOC, "move")[1]


@query(
    "quarantine_in_place",
    f"WITH {_VERDICT_SQL} SELECT d.doc_id, d.text, d.lang, d.source FROM documents d JOIN verdicts v USING (doc_id) WHERE NOT v.is_sensitive",
)
def quarantine_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same split with the verdict beside the row, so that no text is shuffled by key."""
    judged = with_verdicts(table(spark, sf_dir, "documents").drop("n_chars"), corpus_rules(), THRESHOLD)
    return quarantine(judged, None, DOC, "move")[1].drop("is_sensitive", "details")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged paths with their names in the quarantine folder."""
    flagged = derived_catalog(spark, sf_dir).join(_verdicts(spark, sf_dir).where("is_sensitive"), "doc_id", "left_semi")
    return checkpointed(resolve_names(flagged, _earlier_names(spark, sf_dir)))


def _earlier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names an earlier run of the day has taken: those of the labelled documents, numbered."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    name = base_name(F.col("path"))
    numbered = F.concat(stem(name), F.lit("_"), (F.col("quality") + 2).cast("string"), raw_extension(name))
    return derived_catalog(spark, sf_dir).join(labels, "doc_id").select(numbered.alias("dest_name"))


# The number of an item is looked up among all free numbers of its name, counted out one by one.
_NAMED_SQL = f"""{CATALOG_SQL}, {_VERDICT_SQL},
    taken AS (
        SELECT DISTINCT substr({BASE_SQL}, 1, length({BASE_SQL}) - length({EXT_SQL})) || '_' || (quality + 2) || {EXT_SQL} AS name
        FROM catalog JOIN labels USING (doc_id)),
    claims AS (
        SELECT path, {BASE_SQL} AS name, substr({BASE_SQL}, 1, length({BASE_SQL}) - length({EXT_SQL})) AS stem, {EXT_SQL} AS ext,
               row_number() OVER (PARTITION BY {BASE_SQL} ORDER BY path) AS place
        FROM catalog JOIN verdicts USING (doc_id) WHERE is_sensitive),
    owners AS (SELECT path, name, name AS dest_name FROM claims WHERE place = 1 AND name NOT IN (SELECT name FROM taken)),
    waiting AS (
        SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) AS slot FROM claims WHERE path NOT IN (SELECT path FROM owners)),
    candidates AS (
        SELECT name, stem, ext, unnest(range(1, max(slot) + (SELECT count(*) FROM taken) + (SELECT count(DISTINCT name) FROM claims) + 1)) AS n
        FROM waiting GROUP BY name, stem, ext),
    free AS (
        SELECT name, stem || '_' || n || ext AS dest_name, row_number() OVER (PARTITION BY name ORDER BY n) AS slot
        FROM candidates
        WHERE stem || '_' || n || ext NOT IN (SELECT name FROM taken) AND stem || '_' || n || ext NOT IN (SELECT name FROM claims)),
    named AS (
        SELECT path, name, dest_name FROM owners UNION ALL
        SELECT w.path, w.name, f.dest_name FROM waiting w JOIN free f ON f.name = w.name AND f.slot = w.slot)"""


@query("resolve_names", f"WITH {_NAMED_SQL} SELECT path, name, dest_name FROM named")
def resolve_names_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir)


_MANIFEST_SQL = f"""{_NAMED_SQL},
    manifest AS (
        SELECT row_number() OVER (ORDER BY path) AS seq, path AS src_path, '{TARGET}/' || dest_name AS dest_path,
               name AS original_name, dest_name AS backup_name, name <> dest_name AS renamed, 'move' AS mode,
               '{RUN_ID}' AS run_id, DATE '{SCAN_DATE}' AS scan_date
        FROM named)"""


@query("manifest", f"WITH {_MANIFEST_SQL} SELECT * FROM manifest")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_manifest(_named(spark, sf_dir), TARGET, "move", RUN_ID, SCAN_DATE)


@query(
    "restore",
    f"WITH {CATALOG_SQL} SELECT path, text FROM catalog JOIN documents USING (doc_id)",
)
def restore_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Move the flagged documents away and back again: the source as it was."""
    texts = derived_catalog(spark, sf_dir).join(_documents(spark, sf_dir), "doc_id")
    source = texts.select("doc_id", "path", "text")
    taken, remaining = quarantine(source, checkpointed(_verdicts(spark, sf_dir)), DOC, "move")
    moved = build_manifest(_named(spark, sf_dir), TARGET, "move", RUN_ID, SCAN_DATE)
    stored = taken.join(moved.select(F.col("src_path").alias("path"), "dest_path"), "path").select("dest_path", "text")
    return restore(moved, stored, remaining.select("path", "text"))


@query("encrypt_round_trip", "SELECT doc_id, text, strlen(text) + 28 AS closed_bytes, text IS NULL AS same FROM documents")
def encrypt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, the length of their ciphertexts, and whether a ciphertext is its text."""
    docs = _documents(spark, sf_dir).withColumn("closed", F.col("text"))
    closed = encrypt_payload(docs, "closed", "bundle key")
    opened = decrypt_payload(closed.withColumn("opened", F.col("closed")), "opened", "bundle key")
    same = F.col("closed").eqNullSafe(F.col("text").cast("binary"))
    return opened.select("doc_id", F.col("opened").alias("text"), F.octet_length("closed").cast("long").alias("closed_bytes"), same.alias("same"))


@query("stream_accumulate", f"WITH {_FOUND_SQL} SELECT doc_id, rule_idx, match_count FROM found")
def stream_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The early-stopped counts again, from a stream over the documents table."""
    schema = table(spark, sf_dir, "documents").schema
    # A glob, since a stream takes no single file by its name; it may match one file or a folder of them.
    source = f"{sf_dir.rstrip('/')}/documents.parque[t]"
    work = f"{shared_folder(spark).rstrip('/')}/accumulate-{spark.range(1).selectExpr('uuid() AS u').first().u}"
    stream = spark.readStream.schema(schema).parquet(source)
    pieces = stream.select("doc_id", F.lit(0).alias("chunk_no"), "text")
    updates = accumulate_stream(pieces, "doc_id", corpus_rules(), THRESHOLD)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(f"{work}/counts")

    started = (
        updates.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    # A later update of a document replaces an earlier one.
    rows = spark.read.schema(updates.schema.add("batch_id", T.IntegerType())).parquet(f"{work}/counts")
    latest = F.max_by("match_count", "batch_id").alias("match_count")
    return rows.groupBy("doc_id", "rule_idx").agg(latest)
