"""Matching in Arrow batches for rules that are unsafe on the JVM.

The JVM matcher calls itself once per repetition of a group, so a rule such as
``(?:ab|c)+`` over a long run overflows the stack and takes the executor with it. Rule sets
with such a rule are matched by Python's ``re``, which keeps its state on the heap. Results
are the same; only the place differs. The nested functions travel to the workers by value.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.rules import RuleSet

_HITS = T.ArrayType(
    T.StructType([T.StructField("rule_idx", T.IntegerType()), T.StructField("matched", T.StringType())])
)


def _fused_search(patterns: list[str]) -> Callable:
    """A generator of ``(rule_idx, matched)``: leftmost match first, earlier rules on a tie."""

    def search(text: str):
        compiled = [re.compile(p) for p in patterns]
        ahead = [c.search(text) for c in compiled]
        while True:
            found = [(m.start(), i) for i, m in enumerate(ahead) if m is not None]
            if not found:
                return
            _, rule = min(found)
            end = ahead[rule].end()
            yield rule, ahead[rule].group()
            for i, m in enumerate(ahead):
                if m is not None and m.start() < end:
                    ahead[i] = compiled[i].search(text, end)

    return search


def hits(text: Column, rules: RuleSet) -> Column:
    """``array<struct<rule_idx, matched>>`` of the fused scan."""
    search = _fused_search([r.pattern for r in rules])

    @F.pandas_udf(_HITS)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: [] if t is None else [{"rule_idx": i, "matched": found} for i, found in search(t)]
        )

    return find(text)


def codes(chunks: Column, rules: RuleSet, need: int | None) -> Column:
    """``array<int>`` of the fused scan over an array of chunks, up to the settling hit."""
    search = _fused_search([r.pattern for r in rules])
    n_rules = len(rules)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def find(documents: pd.Series) -> pd.Series:
        def scan(chunks) -> list[int]:
            found, counts = [], [0] * n_rules
            for chunk in () if chunks is None else chunks:
                for rule, _ in () if chunk is None else search(chunk):
                    found.append(rule)
                    counts[rule] += 1
                    if counts[rule] == need:
                        return found
            return found

        return documents.map(scan)

    return find(chunks)


def matches(chunks: Column, rules: RuleSet) -> Column:
    """``array<array<array<string>>>``: per chunk and rule, the matches of each rule alone."""
    patterns = [r.pattern for r in rules]

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))
    def find(documents: pd.Series) -> pd.Series:
        def scan(chunks) -> list[list[list[str]]]:
            return [
                [[] if chunk is None else [m.group() for m in re.finditer(p, chunk)] for p in patterns]
                for chunk in (() if chunks is None else chunks)
            ]

        return documents.map(scan)

    return find(chunks)
