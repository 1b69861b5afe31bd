"""Run report and per-rule summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("sensitive", "error", "unreadable", "oversize", "quick", "safe")


def run_report(outcomes: DataFrame, status: str = "status") -> DataFrame:
    """``(metric, value)``: items in total and by outcome, zero counts included."""
    counted = outcomes.agg(
        F.count("*").alias("scanned"), *[F.count_if(F.col(status) == s).alias(s) for s in STATUSES]
    )
    names = ("scanned", *STATUSES)
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    return counted.select(F.inline(pairs))


def rule_summary(findings: DataFrame) -> DataFrame:
    """Hits and documents per rule. A document has one finding per rule, so rows are documents."""
    return findings.groupBy("rule_idx", "rule_name").agg(
        F.sum("match_count").alias("hits"), F.count("*").alias("documents")
    )
