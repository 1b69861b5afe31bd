"""Registration, the shared rule set and the SQL fragments the checks have in common."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from siftwell.functions.rules import RuleSet, make_rules
from siftwell.functions.text import UNICODE_SPACES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# ASCII, unanchored rules on which the JVM, RE2 and Python agree.
CORPUS_PATTERNS = (
    ("ipv4", r"\d{3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("digits2", r"\d{2}"),
    ("capital", r"[A-Z]"),
)
THRESHOLD = 5


def corpus_rules() -> RuleSet:
    return make_rules(CORPUS_PATTERNS)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL it is covered by tests against a plain loop."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPACES_SQL = "'" + UNICODE_SPACES + "'"
FUSED_SQL = "'" + "|".join(f"({p})" for _, p in CORPUS_PATTERNS) + "'"
LINES_SQL = r"regexp_extract_all(text, '[^\n]*\n|[^\n]+$', 0)"


def rule_name_sql(idx: str = "rule_idx", patterns: Sequence[tuple[str, str]] = CORPUS_PATTERNS) -> str:
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(patterns))
    return f"CASE {idx} {cases} END"


def hits_ctes(source: str, keys: str, patterns: Sequence[tuple[str, str]] = CORPUS_PATTERNS) -> str:
    """CTE ``hits(keys, pos, rule_idx, matched)`` of fused hits over ``source(keys, text)``."""
    fused = "'" + "|".join(f"({p})" for _, p in patterns) + "'"
    k = range(len(patterns))
    groups = ", ".join(f"regexp_extract_all(text, {fused}, {i + 1}) AS g{i}" for i in k)
    unnested = ", ".join(f"unnest(g{i}) AS m{i}" for i in k)
    cases = " ".join(f"WHEN coalesce(m{i}, '') <> '' THEN {i}" for i in k)
    texts = ", ".join(f"nullif(m{i}, '')" for i in k)
    return f"""
    hit_lists AS (SELECT {keys}, {groups} FROM {source}),
    hit_rows AS (SELECT {keys}, CAST(unnest(range(len(g0))) AS INTEGER) AS pos, {unnested} FROM hit_lists),
    hits AS (SELECT {keys}, pos, CASE {cases} END AS rule_idx, coalesce({texts}) AS matched FROM hit_rows)"""


def early_ctes(key: str, order: str, threshold: int = THRESHOLD) -> str:
    """CTE ``found(key, rule_idx, match_count, first_ord)`` from ``hits``, stopped early."""
    return f"""
    runs AS (
        SELECT *, row_number() OVER (PARTITION BY {key}, rule_idx ORDER BY {order}) AS run,
               row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS ord
        FROM hits),
    stops AS (SELECT *, min(CASE WHEN run = {threshold} THEN ord END) OVER (PARTITION BY {key}) AS stop FROM runs),
    found AS (
        SELECT {key}, rule_idx, count(*) AS match_count, min(ord) AS first_ord
        FROM stops WHERE stop IS NULL OR ord <= stop GROUP BY {key}, rule_idx)"""


def verdict_select(docs: str, key: str, threshold: int = THRESHOLD) -> str:
    """Final SELECT of a verdict check over ``found``."""
    return f"""
    SELECT d.{key}, coalesce(bool_or(f.match_count >= {threshold}), false) AS is_sensitive,
           coalesce(string_agg({rule_name_sql('f.rule_idx')} || ':' || f.match_count, '; ' ORDER BY f.first_ord, f.rule_idx), '') AS details
    FROM {docs} d LEFT JOIN found f ON f.{key} = d.{key} GROUP BY d.{key}"""


def chunk_ctes(size: int) -> str:
    """CTE ``chunks(doc_id, chunk_no, text)`` of ``documents`` cut every ``size`` lines."""
    return f"""
    line_lists AS (SELECT doc_id, {LINES_SQL} AS lines FROM documents),
    line_rows AS (SELECT doc_id, unnest(range(len(lines))) AS seg_no, unnest(lines) AS line FROM line_lists),
    chunks AS (
        SELECT doc_id, CAST(seg_no // {size} AS INTEGER) AS chunk_no, string_agg(line, '' ORDER BY seg_no) AS text
        FROM line_rows GROUP BY doc_id, seg_no // {size})"""
