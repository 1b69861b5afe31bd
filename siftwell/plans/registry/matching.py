"""Hits, counts, early stop and verdicts over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.rules import make_rules
from siftwell.operators import matching as ops
from siftwell.operators.chunking import chunk_lines
from siftwell.operators.verdicts import details_text, flag, verdicts
from siftwell.plans.registry.base import (
    CORPUS_PATTERNS,
    THRESHOLD,
    chunk_ctes,
    corpus_rules,
    early_ctes,
    hits_ctes,
    query,
    rule_name_sql,
    table,
    verdict_select,
)
from siftwell.plans.scan import chunk_findings, scan_chunked, scan_text, text_chunks
from siftwell.sources.segments import text_segments

DOC = ["doc_id"]
LINES_PER_CHUNK = 5

# The unanchored default rules with ASCII names, so that a plain SQL string can repeat them.
DEFAULT_ASCII = (
    ("id_number", r"[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]"),
    ("mobile", r"1[3-9]\d{9}"),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
)
SECRET_PATTERNS = (
    ("card", r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}"),
    ("phone", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
    ("secret", r"(token|password|secret|api_key) *[=:]"),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
)


def _shown(v: DataFrame, *keys: str) -> DataFrame:
    return v.select(*keys, "is_sensitive", details_text(F.col("details")).alias("details"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("fused_hits", f"WITH {hits_ctes('documents', 'doc_id')} SELECT doc_id, pos, rule_idx, matched FROM hits")
def fused_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.hits_fused(_documents(spark, sf_dir), DOC, corpus_rules())


@query(
    "independent_hits",
    " UNION ALL ".join(
        f"SELECT doc_id, CAST(unnest(range(len(regexp_extract_all(text, '{p}')))) AS INTEGER) AS pos, {i} AS rule_idx, "
        f"unnest(regexp_extract_all(text, '{p}')) AS matched FROM documents"
        for i, (_, p) in enumerate(CORPUS_PATTERNS)
    ),
)
def independent_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.hits_independent(_documents(spark, sf_dir), DOC, corpus_rules())


@query(
    "full_counts",
    f"WITH {hits_ctes('documents', 'doc_id')} "
    "SELECT doc_id, rule_idx, count(*) AS match_count FROM hits GROUP BY doc_id, rule_idx",
)
def full_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.counts(_documents(spark, sf_dir), DOC, corpus_rules())


@query(
    "independent_counts",
    " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rule_idx, len(regexp_extract_all(text, '{p}')) AS match_count FROM documents"
        for i, (_, p) in enumerate(CORPUS_PATTERNS)
    ),
)
def independent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.match_independent(_documents(spark, sf_dir), DOC, corpus_rules())


@query(
    "default_rule_counts",
    f"WITH {hits_ctes('documents', 'doc_id', DEFAULT_ASCII)} "
    f"SELECT doc_id, {rule_name_sql(patterns=DEFAULT_ASCII)} AS rule_name, count(*) AS match_count "
    "FROM hits GROUP BY doc_id, rule_idx",
)
def default_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = make_rules(DEFAULT_ASCII)
    counted = ops.counts(_documents(spark, sf_dir), DOC, rules)
    return ops.name_findings(counted, rules).select("doc_id", "rule_name", "match_count")


@query(
    "grouped_rule_counts",
    # The third rule has a group of its own, so the fourth is read from group 5.
    f"""WITH lists AS (SELECT doc_id, {", ".join(
        f"regexp_extract_all(text, '{'|'.join(f'({p})' for _, p in SECRET_PATTERNS)}', {g}) AS g{i}"
        for i, g in enumerate((1, 2, 3, 5)))} FROM documents),
    rows AS (SELECT doc_id, {", ".join(f"unnest(g{i}) AS m{i}" for i in range(4))} FROM lists)
    SELECT doc_id, rule_idx, count(*) AS match_count FROM (
        SELECT doc_id, CASE {" ".join(f"WHEN coalesce(m{i}, '') <> '' THEN {i}" for i in range(4))} END AS rule_idx FROM rows)
    GROUP BY doc_id, rule_idx""",
)
def grouped_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.counts(_documents(spark, sf_dir), DOC, make_rules(SECRET_PATTERNS))


@query(
    "verdict_whole_text",
    f"WITH {hits_ctes('documents', 'doc_id')}, {early_ctes('doc_id', 'pos')} {verdict_select('documents', 'doc_id')}",
)
def verdict_whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(scan_text(_documents(spark, sf_dir), DOC, corpus_rules(), THRESHOLD), "doc_id")


@query(
    "early_stop_fused",
    f"WITH {hits_ctes('documents', 'doc_id')}, {early_ctes('doc_id', 'pos')} "
    f"SELECT doc_id, rule_idx, {rule_name_sql()} AS rule_name, match_count, first_ord FROM found",
)
def early_stop_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = corpus_rules()
    found = ops.row_findings(_documents(spark, sf_dir), DOC, rules, THRESHOLD)
    return ops.explode_findings(found, DOC, rules).select("doc_id", "rule_idx", "rule_name", "match_count", "first_ord")


_SEQUENTIAL_HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {i} AS rule_idx, unnest(range(len(regexp_extract_all(text, '{p}')))) AS pos FROM documents"
    for i, (_, p) in enumerate(CORPUS_PATTERNS)
) + ")"


@query(
    "early_stop_sequential",
    f"WITH {_SEQUENTIAL_HITS}, {early_ctes('doc_id', 'rule_idx, pos')} SELECT doc_id, rule_idx, match_count FROM found",
)
def early_stop_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = corpus_rules()
    found = ops.row_findings(_documents(spark, sf_dir), DOC, rules, THRESHOLD, ops.INDEPENDENT)
    return ops.explode_findings(found, DOC, rules).select("doc_id", "rule_idx", "match_count")


_SEQUENTIAL_CHUNK_HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT doc_id, chunk_no, {i} AS rule_idx, unnest(range(len(regexp_extract_all(text, '{p}')))) AS pos FROM chunks"
    for i, (_, p) in enumerate(CORPUS_PATTERNS)
) + ")"
_SEQUENTIAL_CHUNKED_SQL = (
    f"WITH {chunk_ctes(LINES_PER_CHUNK)}, {_SEQUENTIAL_CHUNK_HITS}, {early_ctes('doc_id', 'chunk_no, rule_idx, pos')} "
    "SELECT doc_id, rule_idx, match_count FROM found"
)


@query("early_stop_sequential_chunked", _SEQUENTIAL_CHUNKED_SQL)
def early_stop_sequential_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = corpus_rules()
    chunks = text_chunks(_documents(spark, sf_dir), DOC, LINES_PER_CHUNK, None, "text")
    found = ops.row_findings(chunks, DOC, rules, THRESHOLD, ops.INDEPENDENT, chunks="chunks")
    return ops.explode_findings(found, DOC, rules).select("doc_id", "rule_idx", "match_count")


@query("early_stop_sequential_rows", _SEQUENTIAL_CHUNKED_SQL)
def early_stop_sequential_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result with the chunks of a document as rows of a table."""
    chunks = chunk_lines(text_segments(_documents(spark, sf_dir), DOC), DOC, LINES_PER_CHUNK, "")
    found = chunk_findings(chunks, DOC, corpus_rules(), THRESHOLD, ops.INDEPENDENT)
    return found.select("doc_id", "rule_idx", "match_count")


_CHUNKED_SQL = (
    f"WITH {chunk_ctes(LINES_PER_CHUNK)}, {hits_ctes('chunks', 'doc_id, chunk_no')}, "
    f"{early_ctes('doc_id', 'chunk_no, pos')} {verdict_select('documents', 'doc_id')}"
)


@query("scan_chunked", _CHUNKED_SQL)
def scan_chunked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_chunked(_documents(spark, sf_dir), DOC, corpus_rules(), THRESHOLD, LINES_PER_CHUNK)
    return _shown(scanned, "doc_id")


@query("scan_chunk_rows", _CHUNKED_SQL)
def scan_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same verdicts with the chunks of a document as rows of a table."""
    docs, rules = _documents(spark, sf_dir), corpus_rules()
    chunks = chunk_lines(text_segments(docs, DOC), DOC, LINES_PER_CHUNK, "")
    found = chunk_findings(chunks, DOC, rules, THRESHOLD)
    return _shown(verdicts(docs, found, DOC, rules, THRESHOLD), "doc_id")


@query(
    "flag_by_full_counts",
    f"WITH {hits_ctes('documents', 'doc_id')}, n AS (SELECT doc_id, rule_idx, count(*) AS c FROM hits GROUP BY ALL) "
    f"SELECT doc_id, max(c) >= {THRESHOLD} AS is_sensitive FROM n GROUP BY doc_id",
)
def flag_by_full_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag(ops.counts(_documents(spark, sf_dir), DOC, corpus_rules()), DOC, THRESHOLD)


@query(
    "conversation_findings",
    f"WITH {hits_ctes('conversations', 'conv_id, turn')}, {early_ctes('conv_id', 'turn, pos')} "
    "SELECT conv_id, rule_idx, match_count, first_ord FROM found",
)
def conversation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is one document and each turn one chunk."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("chunk_no"), "text")
    return chunk_findings(turns, ["conv_id"], corpus_rules(), THRESHOLD)


@query(
    "page_verdicts",
    f"WITH src AS (SELECT page_id, html AS text FROM pages), {hits_ctes('src', 'page_id')}, "
    f"{early_ctes('page_id', 'pos', 40)} {verdict_select('pages', 'page_id', 40)}",
)
def page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw html as plain text, with a threshold high enough to leave most pages unsettled."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return _shown(scan_text(pages, ["page_id"], corpus_rules(), 40, "html"), "page_id")
