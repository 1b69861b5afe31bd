from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from siftwell.functions.matching import independent_count
from siftwell.functions.rules import (
    RuleError,
    check_on_spark,
    default_rules,
    first_characters,
    fuse,
    make_rules,
    required_text,
    to_java,
)
from siftwell.operators.matching import INDEPENDENT, counts, hits_fused, hits_independent, pick_mode
from siftwell.sources.settings import Settings, load_config, parse_config

# The default mobile rule tied to the whole text.
ANCHORED_MOBILE = r"^1(3[0-9]|4[01456789]|5[012356789]|6[2567]|7[0-8]|8[0-9]|9[0-9])\d{8}$"


def _count(spark, pattern, texts):
    rule = next(iter(make_rules([("r", pattern)])))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.n for r in df.select("i", independent_count(F.col("t"), rule).alias("n")).orderBy("i").collect()]


def _total(spark, text, mode="fused", rules=None):
    rules = rules or default_rules()
    df = spark.createDataFrame([(1, text)], "d int, text string")
    return {r.rule_idx: r.match_count for r in counts(df, ["d"], rules, mode).collect()}


def test_fused_takes_the_earlier_rule_and_does_not_reuse_text(spark):
    assert _total(spark, "13912345678@qq.com") == {1: 1}
    assert _total(spark, "13912345678@qq.com", INDEPENDENT) == {1: 1, 2: 1}


def test_id_number_wins_over_the_phone_inside_it(spark):
    assert _total(spark, "110101199003078315") == {0: 1}


def test_digits_are_unicode_and_ranges_are_not(spark):
    text = "１３８１２３４５６７８"
    assert _count(spark, r"\d{11}", [text]) == [1]
    assert _count(spark, r"[0-9]{11}", [text]) == [0]


def test_anchors_follow_the_newline_rule(spark):
    number = "13812345678"
    texts = [number, number + "\n", number + "\r\n", number + "\u2028", "x\n" + number]
    assert _count(spark, ANCHORED_MOBILE, texts) == [1, 1, 0, 0, 0]


def test_empty_matches_count_alone_and_cannot_be_fused(spark):
    assert _count(spark, "a*", ["baac"]) == [len(re.findall("a*", "baac"))] == [4]
    rules = make_rules([("stars", "a*"), ("b", "b")])
    assert pick_mode(rules) == INDEPENDENT
    with pytest.raises(RuleError):
        fuse(rules)
    for pattern in (r"\b", "(?=x)", "x?", "(a|)"):
        assert not make_rules([("e", pattern)]).fusable


@pytest.mark.parametrize(
    "pattern, texts",
    [
        (r"(?P<a_b>\d)(?P=a_b)", ["11 22 12", "1"]),
        (r"(\w)\1", ["aa bb ab", "ab"]),
        (r"(?i)ABC", ["abc aBc", "xyz"]),
        (r"(?i:straße)", ["STRASSE straße Straße", "x"]),
        (r"[[a]", ["[a", "b"]),
        (r"[]x]", ["]x]", "b"]),
        (r"[^]x]", ["]xa", "b"]),
        (r"[a&&b]", ["a&b", "c"]),
        (r"x{,2}y", ["xxxy", "y"]),
        (r"a{b}", ["a{b}", "ab"]),
        (r"foo\Z", ["foo", "foo\n"]),
        (r"foo$", ["foo", "foo\n", "foo\nx"]),
        (r"(?m)^a$", ["a\na\nb", "ba"]),
        (r"\u4e2d+", ["中中 中", "x"]),
        (r"\U0001F600", ["😀 😀", "x"]),
        (r"a(?#note)b", ["ab", "a"]),
        (r"(?<=a)b(?!c)", ["ab abc", "b"]),
        (r"\bword\b", ["word wordy", "éword"]),
        (r"(?a:\d)", ["1１", "１"]),
        (r"(?s)a.b", ["a\nb", "ab"]),
        (r"a.b", ["a\nb", "a\rb", "a\u2028b"]),
        (r"\101\x42", ["AB", "x"]),
    ],
)
def test_dialect_counts_like_python(spark, pattern, texts):
    assert _count(spark, pattern, texts) == [len([*re.finditer(pattern, t)]) for t in texts]


_ESCAPES = (r"\d", r"\D", r"\s", r"\S", r"\w", r"\W", r"\a", r"\f", r"\n", r"\r", r"\t", r"\v", r"\x41", r"\\", r"\.", r"\-")
_EDGES = (r"\b.", r"\B.", r"\Aa", r".\Z", r"\w+", r"\b\w+\b", r"[^\W\d]+", r"[^\s\w]", r"(?a:\w+)\w", r"(?a)\b\w", r"(?a)\s")
_ODD = (r"a\vb", r"[\v]", r"[\b]", r"xy{,}z", r"(?x)a[ ]b", r"(?x)a[#]b # [(", r"(?x: a b )c d", r"[\x1c-\x1f]")
_SAMPLES = (
    "a\x1cb\x1fc d", "e\u0301x m\u0301", "x\u00b2 1\uff11 \u0661", "a\nb a\x0bb\x0c\r\t\x07\x08", "xz xyyz", "a b a#b abc d",
    "_A-B.\\", "\u4e2d\u6587 \u2160\u00bd", "\u00a0\u2003\x85\u200b", "", "...", "\u0903a\u203fb",
)


def test_every_escape_counts_like_python(spark):
    singles = [*_ESCAPES, *_EDGES, *_ODD]
    patterns = [*singles, *(f"[{e}]" for e in _ESCAPES), *(f"[^{e}q]" for e in _ESCAPES), *(f"[q{e}]+" for e in _ESCAPES)]
    rules = make_rules([(str(i), p) for i, p in enumerate(patterns)])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(_SAMPLES)], "d int, text string")
    columns = [F.regexp_count("text", F.lit(r.java)).alias(f"c{r.idx}") for r in rules]
    counted = {row.d: row for row in df.select("d", *columns).collect()}
    wrong = [
        (r.pattern, t) for r in rules for d, t in enumerate(_SAMPLES)
        if counted[d][f"c{r.idx}"] != len([*re.finditer(r.pattern, t)])
    ]
    assert not wrong


def test_escapes_count_like_python_when_fused(spark):
    patterns = [r"a\vb", r"(\w)\1", r"[^\W\d]+", r"\s", r"\d+"]
    rules = make_rules([(str(i), p) for i, p in enumerate(patterns)])
    joined = re.compile("|".join(f"(?P<g{i}>{p})".replace(r"\1", r"(?P=one)").replace(r"(\w)", r"(?P<one>\w)") for i, p in enumerate(patterns)))
    for text in _SAMPLES:
        expected = {i: 0 for i in range(len(patterns))}
        for m in joined.finditer(text):
            expected[next(i for i in expected if m.group(f"g{i}") is not None)] += 1
        assert {k: v for k, v in _total(spark, text, rules=rules).items() if v} == {k: v for k, v in expected.items() if v}


def test_back_references_and_names_survive_fusion(spark):
    patterns = [("pair", r"(\d)\1"), ("twice", r"([a-z])\1"), ("named", r"(?P<q>[A-Z])(?P=q)"), ("again", r"(?P<q>[!?])(?P=q)")]
    rules = make_rules(patterns)
    text = "11 aa BB ?? 12 ab BC ?!"
    assert _total(spark, text, rules=rules) == {0: 1, 1: 1, 2: 1, 3: 1}
    check_on_spark(spark, rules)


def test_inline_flags_stay_inside_their_rule(spark):
    rules = make_rules([("loose", "(?i)abc"), ("strict", "xyz")])
    assert _total(spark, "ABC XYZ xyz", rules=rules) == {0: 1, 1: 1}


def test_marks_inside_a_text_do_not_change_the_result(spark):
    rules = make_rules([("d", r"\d"), ("u", "[A-Z]")])
    texts = ["1A2", "\ufdd01A\ufdd12", "\ufdd0\ufdd1", "A\ufdd1\ufdd0\ufdd01"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "d int, text string")
    rows = {(r.d, r.pos): (r.rule_idx, r.matched) for r in hits_fused(df, ["d"], rules).collect()}
    expected = {}
    for d, t in enumerate(texts):
        for pos, m in enumerate(re.finditer(r"(\d)|([A-Z])", t)):
            expected[d, pos] = (m.lastindex - 1, m.group())
    assert rows == expected


def test_independent_hits_number_each_rule_on_its_own(spark):
    rules = make_rules([("d", r"\d"), ("u", "[A-Z1]")])
    df = spark.createDataFrame([(1, "1A2")], "d int, text string")
    rows = sorted((r.rule_idx, r.pos, r.matched) for r in hits_independent(df, ["d"], rules).collect())
    assert rows == [(0, 0, "1"), (0, 1, "2"), (1, 0, "1"), (1, 1, "A")]


def test_required_text_is_on_every_path():
    assert required_text(r"token *=") == "token"
    assert required_text("a|b") is None
    assert required_text("(?i)token") is None
    assert required_text(r"(abc)?x+yz") == "yz"


def test_first_characters_cover_every_match():
    rng = random.Random(1)
    patterns = [r"\d{3}", "[A-Z]b?", "(?:ab|c)+d", r"\bfoo", "(a|b)c", "x*y", "[^a]b", r"(?:[0-9]|[x-z])+?q", "(?i)k", r"\s+a", "😀"]
    for pattern in patterns:
        starts = first_characters(pattern)
        text = "".join(rng.choice("abcdfoxyzqAK09 \n😀") for _ in range(5000))
        if starts is not None:
            assert all(re.match(f"[{starts}]", m.group()) or ord(m.group()[0]) > 0xFFFF for m in re.finditer(pattern, text))
    assert [first_characters(p) for p in ("x*y", "[^a]b", "(?i)k")] == [None, None, None]


def test_the_guard_skips_only_where_nothing_can_start(spark):
    rules = make_rules([("number", r"\d{2}"), ("capital", "[A-Z]b?"), ("mark", "[!?]+")])
    assert "(?=[" in fuse(rules).java
    assert "(?=[" not in fuse(make_rules([("word", "[a-z]+"), ("number", r"\d")])).java
    text = "ab 12 Ab １２ !? 3 B"
    whole = re.compile(r"(\d{2})|([A-Z]b?)|([!?]+)")
    expected = {}
    for m in whole.finditer(text):
        expected[m.lastindex - 1] = expected.get(m.lastindex - 1, 0) + 1
    assert _total(spark, text, rules=rules) == expected


def test_rules_are_refused_before_any_job():
    for bad in ("text", {"pattern": "a"}, [1], [{"name": "n"}], [{"name": "n", "pattern": "("}], [{"pattern": 3}]):
        with pytest.raises(RuleError):
            make_rules(bad)
    with pytest.raises(RuleError):
        to_java(r"(a)?(?(1)b|c)")


def test_unnamed_rules_are_named_by_position():
    rules = make_rules([{"name": "a", "pattern": "a"}, {"pattern": "b"}])
    assert rules.names == ["a", "规则2"]


def test_settings_are_filled_and_missing_keys_reported(spark, tmp_path):
    file = tmp_path / "settings.json"
    file.write_text(json.dumps({"rules": [{"pattern": "x"}], "match_threshold": 7}), encoding="utf-8")
    rules, settings, missing = load_config(spark, str(file))
    assert rules.names == ["规则1"] and settings.match_threshold == 7 and settings.max_file_size_mb == 100
    assert missing == ["backup_base_path", "dev", "file_timeout_sec", "max_file_size_mb", "thread_idle_timeout_sec"]
    assert settings.mode == "move" and file.exists()


def test_settings_are_checked_strictly():
    assert parse_config("{}")[1] == Settings()
    for bad in ("[]", "{", '{"rules": 1}', '{"dev": "false"}', '{"match_threshold": "3"}', '{"match_threshold": true}'):
        with pytest.raises(RuleError):
            parse_config(bad)
