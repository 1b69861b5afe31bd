"""The scan of file contents: three formats, two of them by extractors, one of which fails on some files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.verdicts import details_text
from siftwell.plans.registry.base import LINES_SQL, THRESHOLD, corpus_rules, early_ctes, hits_ctes, query, table, verdict_select
from siftwell.plans.scan import scan_contents
from siftwell.sources.segments import Extractor


def _paragraphs(path: str, data: bytes) -> Iterator[tuple[int, str]]:
    for part in data.decode().split("\n"):
        yield 0, part


def _whole_or_broken(path: str, data: bytes) -> Iterator[tuple[int, str]]:
    if len(data) % 2:
        raise ValueError(f"odd length {len(data)}")
    yield 0, data.decode()


EXTRACTORS: dict[str, Extractor] = {"docx": _paragraphs, ".doc": _whole_or_broken}

# Plain text is cut every 500 lines, document parts every 200, and the last kind not at all.
_FILES_SQL = f"""
    files AS (
        SELECT '/in/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.docx' ELSE '.doc' END AS path, doc_id % 3 AS kind, coalesce(text, '') AS text,
               CASE WHEN doc_id % 3 = 2 AND strlen(coalesce(text, '')) % 2 = 1 THEN 'ValueError: odd length ' || strlen(text) END AS error
        FROM documents),
    part_lists AS (SELECT path, kind, CASE kind WHEN 0 THEN {LINES_SQL} WHEN 1 THEN string_split(text, chr(10)) ELSE [text] END AS parts FROM files WHERE error IS NULL),
    part_rows AS (SELECT path, kind, unnest(range(len(parts))) AS seg_no, unnest(parts) AS part FROM part_lists),
    chunks AS (
        SELECT path, seg_no // CASE kind WHEN 0 THEN 500 ELSE 200 END AS chunk_no,
               CASE kind WHEN 1 THEN string_agg(part, chr(10) ORDER BY seg_no) ELSE string_agg(part, '' ORDER BY seg_no) END AS text
        FROM part_rows GROUP BY path, kind, seg_no // CASE kind WHEN 0 THEN 500 ELSE 200 END),
    {hits_ctes('chunks', 'path, chunk_no')}"""


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 3
    ext = F.when(kind == 0, ".txt").when(kind == 1, ".docx").otherwise(".doc")
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), ext)
    return docs.select(path.alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def _shown(scanned: DataFrame) -> DataFrame:
    return scanned.select("path", "is_sensitive", details_text(F.col("details")).alias("details"), "error")


@query(
    "scan_contents",
    f"WITH {_FILES_SQL}, {early_ctes('path', 'chunk_no, pos')}, judged AS ({verdict_select('files', 'path')}) SELECT judged.*, error FROM judged JOIN files USING (path)",
)
def scan_file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(scan_contents(_contents(spark, sf_dir), corpus_rules(), THRESHOLD, EXTRACTORS))


@query(
    "scan_contents_full",
    f"""WITH {_FILES_SQL},
    numbered AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY chunk_no, pos) AS ord FROM hits),
    found AS (SELECT path, rule_idx, count(*) AS match_count, min(ord) AS first_ord FROM numbered GROUP BY path, rule_idx),
    judged AS ({verdict_select('files', 'path')}) SELECT judged.*, error FROM judged JOIN files USING (path)""",
)
def scan_file_contents_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the counts of all hits, not only those up to the first rule that is settled."""
    return _shown(scan_contents(_contents(spark, sf_dir), corpus_rules(), THRESHOLD, EXTRACTORS, early=False))
