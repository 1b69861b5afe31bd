"""From findings to verdicts, outcomes and details."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.rules import RuleSet
from siftwell.operators.matching import name_findings, rule_name

DETAILS = "array<struct<rule_name:string,match_count:bigint>>"

# Fixed value: a safe item that took no longer than this counts as a quick pass.
QUICK_PASS_MS = 200


def reaches(found: Column, threshold: int) -> Column:
    """Some single rule has enough hits; hits of different rules do not add up."""
    need = max(threshold, 1)
    return F.coalesce(F.exists(found, lambda f: f["match_count"] >= need), F.lit(False))


def details_of(found: Column, rules: RuleSet) -> Column:
    rows = F.transform(
        found,
        lambda f: F.struct(rule_name(f["rule_idx"], rules).alias("rule_name"), f["match_count"].alias("match_count")),
    )
    return F.coalesce(rows.cast(DETAILS), F.array().cast(DETAILS))


def row_verdicts(found: DataFrame, keys: Sequence[str], rules: RuleSet, threshold: int) -> DataFrame:
    """``(keys..., is_sensitive, details)`` from ``(keys..., found)``; no shuffle."""
    return found.select(
        *keys,
        reaches(F.col("found"), threshold).alias("is_sensitive"),
        details_of(F.col("found"), rules).alias("details"),
    )


def flag(findings: DataFrame, keys: Sequence[str], threshold: int) -> DataFrame:
    """``(keys..., is_sensitive)`` for the documents that have findings."""
    return findings.groupBy(*keys).agg(F.bool_or(F.col("match_count") >= max(threshold, 1)).alias("is_sensitive"))


def verdicts(
    documents: DataFrame, findings: DataFrame, keys: Sequence[str], rules: RuleSet, threshold: int
) -> DataFrame:
    """One row per document, also for those without a hit.

    A document has at most one finding per rule, so the collected list is as short as the
    rule set.
    """
    named = name_findings(findings, rules)
    row = F.struct("first_ord", "rule_idx", "rule_name", "match_count")
    per_doc = named.groupBy(*keys).agg(
        F.bool_or(F.col("match_count") >= max(threshold, 1)).alias("is_sensitive"),
        F.array_sort(F.collect_list(row)).alias("_rows"),
    )
    details = F.transform(
        "_rows", lambda r: F.struct(r["rule_name"].alias("rule_name"), r["match_count"].alias("match_count"))
    ).cast(DETAILS)
    joined = documents.select(*keys).join(per_doc.withColumn("details", details).drop("_rows"), list(keys), "left")
    return joined.select(
        *keys,
        F.coalesce("is_sensitive", F.lit(False)).alias("is_sensitive"),
        F.coalesce("details", F.array().cast(DETAILS)).alias("details"),
    )


def classify(
    size_bytes: Column,
    is_sensitive: Column,
    max_bytes: int,
    elapsed_ms: Column | None = None,
    error: Column | None = None,
    size_prefiltered: bool = False,
) -> Column:
    """Outcome of one item, in this order: sensitive, error, unreadable, oversize, quick, safe."""
    status = F.when(F.coalesce(is_sensitive, F.lit(False)), F.lit("sensitive"))
    if error is not None:
        status = status.when(error.isNotNull(), F.lit("error"))
    status = status.when(size_bytes.isNull(), F.lit("unreadable"))
    if not size_prefiltered:
        status = status.when(size_bytes > max_bytes, F.lit("oversize"))
    if elapsed_ms is not None:
        status = status.when(elapsed_ms <= QUICK_PASS_MS, F.lit("quick"))
    return status.otherwise(F.lit("safe"))


def discard_stale(results: DataFrame, written_off: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop results of items that were already written off."""
    gone = written_off.select(*keys).dropDuplicates(list(keys))
    return results.join(gone, list(keys), "left_anti")


def details_text(details: Column) -> Column:
    """``name:count`` pairs in order, joined by ``; `` for reports."""
    pairs = F.transform(details, lambda d: F.concat(d["rule_name"], F.lit(":"), d["match_count"].cast("string")))
    return F.array_join(pairs, "; ")
