"""Quality rules: a threshold table compiled into one projection (no shuffle, no user function).

Null text counts as empty: zero words, ``base_failed``. Empty tables give empty results; a repeated row gives its
result again; other columns of the input are ignored, so their names cannot clash. Long texts stay inside their row.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import WORD, let

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "for",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "im",
    "de", "la", "le", "les", "et", "des", "que", "est", "un", "une", "pour",
    "el", "los", "las", "y", "en", "una", "por", "con", "del", "se",
)


class Rule(NamedTuple):
    """A text passes where ``low <= numerator / denominator <= high``; a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float


THRESHOLDS = (
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("word_count", "n_words", "one", 50.0, 1_000_000.0),
    Rule("symbol_ratio", "n_symbols", "n_words", 0.0, 0.1),
    Rule("stop_words", "n_stop_words", "one", 2.0, float("inf")),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
    Rule("repeated_words", "n_repeat_words", "n_words", 0.0, 0.5),
)

# Base conditions of the query's contract.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Window hashes are sorted with their places, so equal windows are neighbours; the places found are then walked in
    order, and each adds the words that the one before did not cover.
    """

    def windows(h: Column) -> Column:
        inner = F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0)))
        return F.transform(inner, lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("t"), i.alias("i")))

    def places(s: Column) -> Column:
        same = lambda x, i: (F.get(s, i - 1)["t"] == x["t"]) | (F.get(s, i + 1)["t"] == x["t"])
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    found = let(F.sort_array(let(hashes, windows)), places)
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
    return F.aggregate(found, start, step, lambda acc: acc["n"])


def measures(text: Column) -> Column:
    """All counts of a text, as one struct of longs."""
    text = F.coalesce(text, F.lit(""))
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    has_word = lambda line: line.rlike(WORD)

    def of(words: Column, lines: Column) -> Column:
        n = {
            "n_words": F.size(words),
            "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeat_words(words),
            "n_stop_words": F.size(F.array_intersect(words, stops)),
            "one": F.lit(1),
        }
        return F.struct(*[c.cast("long").alias(k) for k, c in n.items()])

    lines = F.filter(F.split(text, "\n"), has_word)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return let(words, lambda w: let(lines, lambda ls: of(w, ls)))


def compiled(counts: Column, rules: Sequence[Rule] = THRESHOLDS) -> Column:
    """The threshold table as one boolean column over a struct of counts."""
    verdict = F.lit(True)
    for rule in rules:
        ratio = counts[rule.numerator] / F.nullif(counts[rule.denominator], F.lit(0))
        verdict = verdict & F.coalesce((ratio >= rule.low) & (ratio <= rule.high), F.lit(True))
    return verdict


def quality(docs: DataFrame, rules: Sequence[Rule] = THRESHOLDS) -> DataFrame:
    """Counts and verdict of each document. Needs ``doc_id`` and ``text``; one row per input row."""
    counted = docs.select("doc_id", measures(F.col("text")).alias("m"))
    failed = (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("m.n_words"))
    return counted.select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "m.n_lines",
        "m.n_stop_words", failed.alias("base_failed"), (~failed & compiled(F.col("m"), rules)).alias("kept"),
    )
