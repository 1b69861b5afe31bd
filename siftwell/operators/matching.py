"""Hits, counts and early-stopped findings as DataFrames.

Two layouts are served. A table with one row per document keeps all work inside the row
(``functions.matching``): one narrow stage, no shuffle. A ``chunks`` table with several
rows per document needs one shuffle, and only for the few hits that can matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions import matching as m
from siftwell.functions.rules import RuleSet
from siftwell.operators.ordinals import first_few
from siftwell.session import spread

FUSED, INDEPENDENT = "fused", "independent"


def pick_mode(rules: RuleSet, mode: str = FUSED) -> str:
    """Fused unless asked otherwise or a rule can match nothing at all."""
    if mode not in (FUSED, INDEPENDENT):
        raise ValueError(f"mode must be '{FUSED}' or '{INDEPENDENT}', not {mode!r}")
    return mode if rules.fusable else INDEPENDENT


def rule_name(rule_idx: Column, rules: RuleSet) -> Column:
    """Index to name by a literal array: the equi-join with a driver-sized rules table."""
    if not len(rules):
        return F.lit(None).cast("string")
    return F.get(F.array(*[F.lit(n) for n in rules.names]), rule_idx)


def name_findings(findings: DataFrame, rules: RuleSet) -> DataFrame:
    return findings.withColumn("rule_name", rule_name(F.col("rule_idx"), rules))


def hits_fused(texts: DataFrame, keys: Sequence[str], rules: RuleSet, text: str = "text") -> DataFrame:
    """``(keys..., pos, rule_idx, matched)``: one row per hit, ``pos`` from 0 within the text."""
    hit = F.posexplode_outer(m.fused_hits(F.col(text), rules)).alias("pos", "hit")
    found = spread(texts.select(*keys, text)).select(*keys, hit).where("pos IS NOT NULL")
    return found.select(*keys, "pos", "hit.rule_idx", "hit.matched")


def hits_independent(texts: DataFrame, keys: Sequence[str], rules: RuleSet, text: str = "text") -> DataFrame:
    """As :func:`hits_fused`, each rule on its own; ``pos`` counts within the rule."""
    matches = m.independent_matches(F.col(text), rules)
    per_rule = spread(texts.select(*keys, text)).select(*keys, F.posexplode(matches).alias("rule_idx", "found"))
    return per_rule.select(*keys, "rule_idx", F.posexplode("found").alias("pos", "matched")).select(
        *keys, "pos", "rule_idx", "matched"
    )


def match_independent(texts: DataFrame, keys: Sequence[str], rules: RuleSet, text: str = "text") -> DataFrame:
    """``(keys..., rule_idx, match_count)`` for every document and rule, zero counts included.

    Documents meet rules through a literal array of per-rule counts, so nothing is joined.
    """
    counts = m.independent_counts(F.col(text), rules)
    return spread(texts.select(*keys, text)).select(*keys, F.posexplode(counts).alias("rule_idx", "match_count"))


def fused_counts(texts: DataFrame, keys: Sequence[str], rules: RuleSet, text: str = "text") -> DataFrame:
    """As :func:`match_independent` with one fused pass over each text."""
    counted = m.bind(m.fused_codes(F.col(text), rules), lambda c: m.code_counts(c, len(rules)))
    # The outer form, since the inner one would compute the array once more to test its size.
    return spread(texts.select(*keys, text)).select(*keys, F.posexplode_outer(counted).alias("rule_idx", "match_count"))


def counts(
    texts: DataFrame, keys: Sequence[str], rules: RuleSet, mode: str = FUSED, text: str = "text"
) -> DataFrame:
    """Full counts per document and rule, hits only.

    ``keys`` may repeat over rows (chunks of one document): each row is reduced to one
    count per rule before the shuffle, and the sum combines on the map side.
    """
    per_row = (fused_counts if pick_mode(rules, mode) == FUSED else match_independent)(texts, keys, rules, text)
    return per_row.where("match_count > 0").groupBy(*keys, "rule_idx").agg(F.sum("match_count").alias("match_count"))


def findings(
    hits: DataFrame, keys: Sequence[str], rules: RuleSet, threshold: int, order: Sequence[str] = ("chunk_no", "pos")
) -> DataFrame:
    """Early-stopped counts from hits spread over rows: ``(keys..., rule_idx, match_count, first_ord)``.

    Counting ends at the hit with which some rule reaches the threshold. A rule's hits
    after its own threshold-th come after that point, so the first ``threshold`` hits per
    document and rule decide everything. That many are kept by :func:`first_few`, mostly
    before the shuffle, and the windows per document then see at most
    ``rules * threshold`` rows however many hits the document has.
    """
    need = max(threshold, 1)
    kept = first_few(hits.select(*keys, "rule_idx", *[c for c in order if c != "rule_idx"]), [*keys, "rule_idx"], order, need, "run")
    per_doc = W.partitionBy(*keys)
    ordered = kept.withColumn("ord", (F.row_number().over(per_doc.orderBy(*order, "rule_idx")) - 1).cast("bigint"))
    stop = F.min(F.when(F.col("run") == need - 1, F.col("ord"))).over(per_doc)
    return (
        ordered.withColumn("stop", stop)
        .where(F.col("stop").isNull() | (F.col("ord") <= F.col("stop")))
        .groupBy(*keys, "rule_idx")
        .agg(F.count("*").alias("match_count"), F.min("ord").alias("first_ord"))
    )


def row_findings(
    texts: DataFrame,
    keys: Sequence[str],
    rules: RuleSet,
    threshold: int,
    mode: str = FUSED,
    text: str | None = "text",
    chunks: str | None = None,
    early: bool = True,
) -> DataFrame:
    """``(keys..., found)`` for one-row documents, ``found`` in first-hit order.

    ``chunks`` names an ``array<string>`` column and takes the place of ``text``.
    """
    k, limit = len(rules), threshold if early else 2**31 - 1
    fused = pick_mode(rules, mode) == FUSED
    if not fused and chunks is not None:
        found = m.sequential_chunked(F.col(chunks), rules, limit)
    elif not fused:
        found = m.sequential_whole(F.col(text), rules, limit)
    else:
        if chunks is None:
            codes = m.fused_codes(F.col(text), rules)
        elif early:
            codes = m.early_codes(F.col(chunks), rules, threshold)
        else:
            codes = m.chunk_codes(F.col(chunks), rules)
        found = m.bind(codes, lambda c: m.early_stop(c, k, threshold) if early else m.full_findings(c, k))
    source = spread(texts.select(*dict.fromkeys([*keys, text]))) if chunks is None else texts
    return source.select(*keys, found.alias("found"))


def explode_findings(found: DataFrame, keys: Sequence[str], rules: RuleSet) -> DataFrame:
    """Long form ``(keys..., rule_idx, rule_name, match_count, first_ord)``."""
    # An inner explode would make the optimizer test the array's size before the explode,
    # and so compute the whole array twice; the outer one leaves the test to the rows.
    rows = found.select(*keys, F.explode_outer("found").alias("f")).where("f IS NOT NULL")
    return name_findings(rows.select(*keys, "f.rule_idx", "f.match_count", "f.first_ord"), rules)
