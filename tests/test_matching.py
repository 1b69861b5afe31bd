from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import model
from siftwell.functions.matching import fused_codes
from siftwell.functions.rules import make_rules
from siftwell.operators import matching as ops
from siftwell.operators.chunking import chunk_lines
from siftwell.operators.verdicts import flag, verdicts
from siftwell.plans.scan import chunk_findings, scan_chunked, scan_text
from siftwell.sources.segments import text_segments

PATTERNS = [r"ab", r"\d+", r"[A-Z]b?", r"a\s*b"]
RULES = make_rules([(f"r{i}", p) for i, p in enumerate(PATTERNS)])
KEY = ["d"]


def _texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("aabbAB12 \n\n") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def _table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "d int, text string")


def _rows(df):
    return {r.d: (r.is_sensitive, [(int(x.rule_name[1:]), x.match_count) for x in r.details]) for r in df.collect()}


@pytest.mark.parametrize("mode", [ops.FUSED, ops.INDEPENDENT])
@pytest.mark.parametrize("threshold", [0, 1, 2, 4, 50])
def test_whole_texts_equal_the_loop(spark, mode, threshold):
    texts = _texts(150, threshold)
    got = _rows(scan_text(_table(spark, texts), KEY, RULES, threshold, mode=mode))
    assert got == {i: model.scan([t], PATTERNS, threshold, mode == ops.FUSED) for i, t in enumerate(texts)}


@pytest.mark.parametrize("mode", [ops.FUSED, ops.INDEPENDENT])
@pytest.mark.parametrize("threshold", [1, 3, 5])
def test_chunked_texts_equal_the_loop_in_both_layouts(spark, mode, threshold):
    texts = _texts(150, 10 + threshold)
    df = _table(spark, texts)
    expected = {
        i: model.scan(model.cut(model.lines_of(t), 2), PATTERNS, threshold, mode == ops.FUSED) for i, t in enumerate(texts)
    }
    assert _rows(scan_chunked(df, KEY, RULES, threshold, lines_per_chunk=2, mode=mode)) == expected
    chunks = chunk_lines(text_segments(df, KEY), KEY, 2, "")
    found = chunk_findings(chunks, KEY, RULES, threshold, mode)
    assert _rows(verdicts(df, found, KEY, RULES, threshold)) == expected


def test_early_and_full_counts_give_the_same_verdict(spark):
    df = _table(spark, _texts(200, 7))
    early = {r.d: r.is_sensitive for r in scan_text(df, KEY, RULES, 3).collect()}
    full = {r.d: r.is_sensitive for r in flag(ops.counts(df, KEY, RULES), KEY, 3).collect()}
    assert {d: full.get(d, False) for d in early} == early
    found = ops.row_findings(df, KEY, RULES, 3)
    assert ops.explode_findings(found, KEY, RULES).agg(F.max("match_count")).first()[0] <= 3


def test_full_findings_count_everything(spark):
    texts = _texts(60, 3)
    found = ops.row_findings(_table(spark, texts), KEY, RULES, 1, early=False)
    got = {(r.d, r.rule_idx): r.match_count for r in ops.explode_findings(found, KEY, RULES).collect()}
    expected = {}
    for d, t in enumerate(texts):
        for rule in model.hits_in(t, PATTERNS, True):
            expected[d, rule] = expected.get((d, rule), 0) + 1
    assert got == expected


def test_the_order_of_hits_decides_what_is_reported(spark):
    a_then_b = make_rules([("A", "A"), ("B", "B")])
    b_first = make_rules([("B", "B"), ("A", "A")])
    df = _table(spark, ["AABAA"])
    row = scan_text(df, KEY, a_then_b, 3).first()
    assert row.is_sensitive and [tuple(x) for x in row.details] == [("A", 3), ("B", 1)]
    row = scan_text(df, KEY, b_first, 3, mode=ops.INDEPENDENT).first()
    assert row.is_sensitive and [tuple(x) for x in row.details] == [("B", 1), ("A", 3)]


def test_hits_of_different_rules_do_not_add_up(spark):
    rules = make_rules([("A", "A"), ("B", "B")])
    row = scan_text(_table(spark, ["AABB"]), KEY, rules, 3).first()
    assert not row.is_sensitive and [tuple(x) for x in row.details] == [("A", 2), ("B", 2)]


def test_nothing_to_search_is_not_sensitive(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "12")], "d int, text string")
    for mode in (ops.FUSED, ops.INDEPENDENT):
        for rules in (make_rules([]), make_rules([("x", "x")])):
            for scanned in (scan_text(df, KEY, rules, 1, mode=mode), scan_chunked(df, KEY, rules, 1, mode=mode)):
                assert all(not r.is_sensitive and r.details == [] for r in scanned.collect())


def test_chunk_borders_cut_matches(spark):
    rules = make_rules([("ab", r"a\s+b")])
    df = _table(spark, ["a\nb"])
    assert not scan_chunked(df, KEY, rules, 1, lines_per_chunk=1).first().is_sensitive
    assert scan_chunked(df, KEY, rules, 1).first().is_sensitive


def test_lines_beyond_a_cap_are_not_read_and_all_are_without(spark):
    rules = make_rules([("hit", "HIT")])
    df = _table(spark, ["x\n" * 10_000 + "HIT", "x\n" * 9_999 + "HIT"])
    assert [r.is_sensitive for r in scan_chunked(df, KEY, rules, 1, cap=10_000).orderBy("d").collect()] == [False, True]
    assert [r.is_sensitive for r in scan_chunked(df, KEY, rules, 1).orderBy("d").collect()] == [True, True]


def test_one_document_with_most_chunks(spark):
    """A hot document in the many-rows layout, with hits in every chunk."""
    rng = random.Random(5)
    pieces = [(0 if i % 3 else i, i, "".join(rng.choice("aAbB1 ") for _ in range(8))) for i in range(900)]
    df = spark.createDataFrame(pieces, "d int, chunk_no int, text string")
    found = chunk_findings(df, KEY, RULES, 20)
    got = _rows(verdicts(df.select("d").distinct(), found, KEY, RULES, 20))
    by_doc = {}
    for d, _, text in sorted(pieces, key=lambda p: p[1]):
        by_doc.setdefault(d, []).append(text)
    assert got == {d: model.scan(chunks, PATTERNS, 20) for d, chunks in by_doc.items()}


def test_no_shuffle_for_one_row_documents(spark, sf_dir):
    """Beyond dealing a small file out to the cores, a scan of whole documents stays narrow."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = scan_chunked(docs, ["doc_id"], RULES, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("RoundRobinPartitioning") <= 1
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_the_pattern_is_applied_once_per_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = make_rules([("d", r"\d\d"), ("u", "[A-Z]")])
    found = ops.row_findings(docs, ["doc_id"], rules, 3)
    plan = ops.explode_findings(found, ["doc_id"], rules)._jdf.queryExecution().optimizedPlan().toString()
    # The fused pass and the marking of single rules, in branches of their own.
    assert plan.count("regexp_replace(") == 3


DEEP = [r"(?:ab|c)+", r"\d", r"(?:[A-Z]b?){2,}"]


@pytest.mark.parametrize("mode", [ops.FUSED, ops.INDEPENDENT])
def test_deeply_repeating_rules_equal_the_loop(spark, mode):
    rules = make_rules([(f"r{i}", p) for i, p in enumerate(DEEP)])
    assert [r.deep for r in rules] == [True, False, True] and not RULES.deep
    fused = mode == ops.FUSED
    texts = _texts(120, 21)
    df = _table(spark, texts)
    assert _rows(scan_text(df, KEY, rules, 3, mode=mode)) == {i: model.scan([t], DEEP, 3, fused) for i, t in enumerate(texts)}
    expected = {i: model.scan(model.cut(model.lines_of(t), 2), DEEP, 3, fused) for i, t in enumerate(texts)}
    assert _rows(scan_chunked(df, KEY, rules, 3, lines_per_chunk=2, mode=mode)) == expected
    found = chunk_findings(chunk_lines(text_segments(df, KEY), KEY, 2, ""), KEY, rules, 3, mode)
    assert _rows(verdicts(df, found, KEY, rules, 3)) == expected
    full = {(r.d, r.rule_idx): r.match_count for r in ops.counts(df, KEY, rules, mode).collect()}
    hits = ops.hits_fused(df, KEY, rules) if fused else ops.hits_independent(df, KEY, rules)
    assert {(r.d, r.rule_idx): r["count"] for r in hits.groupBy("d", "rule_idx").count().collect()} == full
    counted = {}
    for d, t in enumerate(texts):
        for rule in model.hits_in(t, DEEP, fused):
            counted[d, rule] = counted.get((d, rule), 0) + 1
    assert full == counted


def test_long_repetitions_do_not_exhaust_the_stack(spark):
    df = _table(spark, ["ab" * 200_000, "x"])
    rows = _rows(scan_chunked(df, KEY, make_rules([("r0", r"(?:ab|c)+d?")]), 1))
    assert rows == {0: (True, [(0, 1)]), 1: (False, [])}


OVERLAPS = [r"a+b", r"b\w", r"[0-9]{2}", r"1[a-z]", r"(x)(?:y|z)*"]


def test_hits_that_overlap_are_settled_by_the_fused_pattern(spark):
    """Texts without hits, of one rule, of several side by side, of several that overlap, with very many, and with marks."""
    rng = random.Random(12)
    texts = ["", "none", "aab aab", "12 xy", "ab12xyzab", "aabc1d2", "12a", "b" * 300 + "12" * 100, "ab\ufdd0bc", "xyzz" * 40]
    texts += ["".join(rng.choices("ab12xyz c", k=rng.randrange(1, 40))) for _ in range(400)]
    rules = make_rules([(f"r{i}", p) for i, p in enumerate(OVERLAPS)])
    df = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    got = {r.d: r.codes for r in df.select("d", fused_codes(F.col("text"), rules).alias("codes")).collect()}
    fused = re.compile("|".join(f"(?P<r{i}>{p})" for i, p in enumerate(OVERLAPS)))
    want = {i: [next(k for k in range(len(OVERLAPS)) if m[f"r{k}"] is not None) for m in fused.finditer(t)] for i, t in enumerate(texts)}
    assert got == want
    alone = {i: sorted(k for k, p in enumerate(OVERLAPS) for _ in re.finditer(p, t)) for i, t in enumerate(texts)}
    assert any(sorted(want[i]) != alone[i] for i in want) and any(len(set(want[i])) > 1 and sorted(want[i]) == alone[i] for i in want)
