"""Rules as data: validation, dialect, and fusion into one alternation.

Rules are written in Python's regular-expression dialect and run on the JVM. Every
pattern gets the prefix ``(?U)(?d)`` so that ``\\d`` and case are Unicode-aware and ``$`` only looks
past a final ``\\n``; ``\\w``, ``\\s`` and ``\\b`` are written out as classes; the few constructs that are spelled differently are
rewritten one token at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from re import _parser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIALECT = "(?U)(?d)"

# The rule set used when the user supplies none.
DEFAULT_RULES = (
    ("身份证号码", r"[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]"),
    ("手机号码", r"1[3-9]\d{9}"),
    ("电子邮箱", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
)
UNNAMED_RULE = "规则"

RULES_SCHEMA = "rule_idx int, rule_name string, pattern string"


class RuleError(ValueError):
    """A rule the engine refuses before any job starts."""


@dataclass(frozen=True)
class Rule:
    idx: int
    name: str
    pattern: str
    body: str
    groups: int
    matches_empty: bool
    # A string every match contains, or None. A text without it cannot match the rule.
    needs: str | None
    # What a match can start with, as the body of a character class, or None if unknown.
    starts: str | None
    # Repeats a group so often that the JVM matcher, which recurses, could exhaust its stack.
    deep: bool

    @property
    def java(self) -> str:
        return DIALECT + self.body


@dataclass(frozen=True)
class RuleSet:
    """An ordered, validated set of rules; small by construction, it comes from the driver."""

    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def __len__(self) -> int:
        return len(self.rules)

    def __iter__(self):
        return iter(self.rules)

    @property
    def names(self) -> list[str]:
        return [r.name for r in self.rules]

    @property
    def fusable(self) -> bool:
        """Zero-length matches cannot say which alternative they came from."""
        return not any(r.matches_empty for r in self.rules)

    @property
    def deep(self) -> bool:
        return any(r.deep for r in self.rules)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r.idx, r.name, r.pattern) for r in self.rules], RULES_SCHEMA)


@dataclass(frozen=True)
class Fused:
    """One alternation for a whole rule set; ``offsets[i]`` is the group of rule ``i``."""

    java: str
    offsets: tuple[int, ...]


def make_rules(raw: Iterable[Mapping[str, str] | tuple[str | None, str]]) -> RuleSet:
    """Validate user rules: each needs a pattern, and each pattern must compile."""
    if isinstance(raw, (str, bytes, Mapping)) or not isinstance(raw, Iterable):
        raise RuleError("rules must be a list")
    rules = []
    for idx, item in enumerate(raw):
        if isinstance(item, Mapping):
            if item.get("pattern") is None:
                raise RuleError(f"rules[{idx}] has no pattern")
            name, pattern = item.get("name"), item["pattern"]
        elif isinstance(item, tuple) and len(item) == 2:
            name, pattern = item
        else:
            raise RuleError(f"rules[{idx}] is not an object with a pattern")
        name = f"{UNNAMED_RULE}{idx + 1}" if name is None else name
        try:
            compiled = re.compile(pattern)
        except (re.error, TypeError) as problem:
            raise RuleError(f"rule '{name}' does not compile: {problem}") from problem
        rules.append(
            Rule(
                idx=idx,
                name=name,
                pattern=pattern,
                body=to_java(pattern),
                groups=compiled.groups,
                matches_empty=compiled.match("") is not None or _min_width(pattern) == 0,
                needs=required_text(pattern),
                starts=first_characters(pattern),
                deep=_repeats_deeply(_parser.parse(pattern)),
            )
        )
    return RuleSet(tuple(rules))


def default_rules() -> RuleSet:
    return make_rules(DEFAULT_RULES)


def _min_width(pattern: str) -> int:
    """Shortest possible match, lookarounds included: ``\\b`` and ``(?=x)`` have width zero."""
    return _parser.parse(pattern).getwidth()[0]


# Group repetitions the JVM's default stack holds with a wide margin.
_SAFE_REPEATS = 500
_ONE_CHARACTER = ("LITERAL", "NOT_LITERAL", "IN", "ANY", "CATEGORY")


def _repeats_deeply(items, times: int = 1) -> bool:
    for kind, value in items:
        name = str(kind)
        if name.endswith("REPEAT"):
            body, often = value[2], times * int(value[1])
            if len(body) == 1 and str(body[0][0]) in _ONE_CHARACTER:
                continue
            if often > _SAFE_REPEATS or _repeats_deeply(body, often):
                return True
        elif name == "SUBPATTERN" and _repeats_deeply(value[3], times):
            return True
        elif name == "BRANCH" and any(_repeats_deeply(branch, times) for branch in value[1]):
            return True
        elif name in ("ASSERT", "ASSERT_NOT") and _repeats_deeply(value[1], times):
            return True
        elif name == "ATOMIC_GROUP" and _repeats_deeply(value, times):
            return True
    return False


def required_text(pattern: str) -> str | None:
    """The longest run of plain characters on the one path every match takes."""
    parsed = _parser.parse(pattern)
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return None
    runs, run = [], ""
    for kind, value in parsed:
        if str(kind) == "LITERAL":
            run += chr(value)
        else:
            runs.append(run)
            run = ""
    return max([*runs, run], key=len) or None


_ANY = r"\u0000-\uffff"
_COMMON = "aeinst "
_CATEGORIES = {"CATEGORY_DIGIT": r"\d", "CATEGORY_SPACE": r"\s", "CATEGORY_WORD": r"\w"}


def first_characters(pattern: str) -> str | None:
    """A character class body, in Python's dialect, that holds the first character of every match."""
    parsed = _parser.parse(pattern)
    if parsed.state.flags & (re.IGNORECASE | re.ASCII):
        return None
    return _first_of(parsed)


def _first_of(items) -> str | None:
    for kind, value in items:
        name = str(kind)
        if name == "AT":
            continue
        if name == "LITERAL":
            return _class_char(value)
        if name == "IN":
            return _class_body(value)
        if name == "SUBPATTERN" and not value[1] and not value[2]:
            return _first_of(value[3])
        if name == "BRANCH":
            parts = [_first_of(branch) for branch in value[1]]
            return None if None in parts else "".join(parts)
        if name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            return _first_of(value[2])
        return None
    return None


def _class_char(code: int) -> str:
    # This escape means the same in both dialects; beyond it the guard does without.
    return "\\u%04x" % code if code <= 0xFFFF else _ANY


def _class_body(items) -> str | None:
    body = ""
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            body += _class_char(value)
        elif name == "RANGE":
            body += _class_char(value[0]) + "-" + _class_char(value[1])
        elif name == "CATEGORY" and str(value) in _CATEGORIES:
            body += _CATEGORIES[str(value)]
        else:
            return None
    return body


def _start_guard(rules: list[Rule]) -> str:
    """A lookahead that passes over positions where no rule can start.

    One class test replaces an attempt at every alternative. It is left out where it would
    let most of ordinary text pass.
    """
    starts = [r.starts for r in rules]
    if len(rules) < 2 or None in starts:
        return ""
    allowed = f"[{''.join(starts)}]"
    return "" if any(re.match(allowed, c) for c in _COMMON) else f"(?={to_java(allowed)})"


def fuse(rules: Iterable[Rule]) -> Fused:
    """``(p0)|(p1)|...``: one left-to-right scan where earlier rules win at the same start."""
    rules = list(rules)
    bad = [r.name for r in rules if r.matches_empty]
    if bad:
        raise RuleError(f"rules that match the empty string cannot be fused: {bad}")
    offsets, parts, next_group = [], [], 1
    for rule in rules:
        offsets.append(next_group)
        parts.append("(" + to_java(rule.pattern, group_shift=next_group, name_tag=f"r{rule.idx}x") + ")")
        next_group += 1 + rule.groups
    guard = _start_guard(rules)
    body = "|".join(parts)
    return Fused(DIALECT + (f"{guard}(?:{body})" if guard else body), tuple(offsets))


def check_on_spark(spark: SparkSession, rules: RuleSet) -> None:
    """Compile every rule on the JVM, alone and fused, over one literal row."""
    patterns = [(r.name, r.java) for r in rules]
    if rules.fusable and len(rules):
        patterns.append(("all rules fused", fuse(rules).java))
    if not patterns:
        return
    try:
        spark.range(1).select(*[F.regexp_count(F.lit(""), F.lit(pattern)) for _, pattern in patterns]).collect()
        return
    except Exception:  # noqa: BLE001 - which rule it was is found out below
        pass
    for name, pattern in patterns:
        try:
            spark.range(1).select(F.regexp_count(F.lit(""), F.lit(pattern))).collect()
        except Exception as problem:
            raise RuleError(f"rule '{name}' does not compile on the JVM: {problem}") from problem


_FLAGS = {"i": "iu", "m": "m", "s": "s", "x": "x", "u": "", "a": ""}
_QUANTIFIER = re.compile(r"\{(\d+(,\d*)?|,\d*)\}")
_LEADING_FLAGS = re.compile(r"\(\?([aiLmsux]+)\)")
# What a word character is in Python: letters and numbers, no marks. Java's own class takes marks.
_WORD = r"\p{L}\p{N}_"
_ASCII_WORD = "a-zA-Z0-9_"
# Python's white space holds four separators that Unicode's property leaves out.
_SPACE = r"\s\x1c-\x1f"


def _java_flags(flags: str) -> str:
    return "".join(_FLAGS[f] for f in flags if f in _FLAGS)


def to_java(pattern: str, group_shift: int = 0, name_tag: str = "") -> str:
    """Rewrite one Python pattern for ``java.util.regex``, moving back-references by ``group_shift``."""
    scoped = ""
    leading = _LEADING_FLAGS.match(pattern)
    if leading:
        scoped, pattern = leading.group(1), pattern[leading.end() :]
    out, i, in_class = [], 0, False
    # (ASCII classes, verbose) of the groups around the current position.
    modes = [("a" in scoped, "x" in scoped)]
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            text, i = _escape(pattern, i, in_class, group_shift, modes[-1][0])
            out.append(text)
        elif in_class:
            if ch == "]":
                in_class = False
                out.append(ch)
            else:
                # White space and # in a class count, in verbose patterns too.
                out.append("\\" + ch if ch in "[&#" else "\\x%02x" % ord(ch) if ch in " \t\n\r\v\f" else ch)
            i += 1
        elif ch == "#" and modes[-1][1]:
            end = pattern.find("\n", i)
            i = len(pattern) if end < 0 else end
        elif ch == "[":
            in_class = True
            opening = "[^" if pattern.startswith("[^", i) else "["
            out.append(opening)
            i += len(opening)
            if pattern.startswith("]", i):
                out.append("\\]")
                i += 1
        elif pattern.startswith("(?", i):
            start = i
            text, i = _group(pattern, i, name_tag)
            out.append(text)
            if pattern[i - 1] != ")":
                modes.append(_modes_inside(pattern[start:i], modes[-1]))
        elif ch == "{":
            quantifier = _QUANTIFIER.match(pattern, i)
            if quantifier:
                out.append(quantifier.group().replace("{,", "{0,"))
                i = quantifier.end()
            else:
                out.append("\\{")
                i += 1
        else:
            if ch == "(":
                modes.append(modes[-1])
            elif ch == ")":
                modes.pop()
            out.append("\\}" if ch == "}" else ch)
            i += 1
    body = "".join(out)
    ascii_only = "a" in scoped
    flags = _java_flags(scoped) + ("-U" if ascii_only else "")
    return f"(?{flags}:{body})" if flags else body


def _modes_inside(opening: str, outside: tuple[bool, bool]) -> tuple[bool, bool]:
    """(ASCII classes, verbose) behind the opening of a group, such as ``(?a-x:``."""
    flags = re.compile(r"\(\?([aiLmsux]*)(?:-([imsx]+))?:").fullmatch(opening)
    if not flags:
        return outside
    on, off = flags.group(1), flags.group(2) or ""
    return ("a" in on or (outside[0] and "u" not in on), "x" in on or (outside[1] and "x" not in off))


def _escape(pattern: str, i: int, in_class: bool, group_shift: int, ascii_only: bool) -> tuple[str, int]:
    code = pattern[i + 1]
    word = _ASCII_WORD if ascii_only else _WORD
    if code == "v":
        return "\\x0b", i + 2
    if code in "wW":
        return (word if in_class and code == "w" else f"[{'^' if code == 'W' else ''}{word}]"), i + 2
    if code in "sS" and not ascii_only:
        return (_SPACE if in_class and code == "s" else f"[{'^' if code == 'S' else ''}{_SPACE}]"), i + 2
    if code == "b" and in_class:
        return "\\x08", i + 2
    if code == "b":
        return f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))", i + 2
    if code == "B":
        return f"(?:(?<=[{word}])(?=[{word}])|(?!\\A\\z)(?<![{word}])(?![{word}]))", i + 2
    if code == "Z" and not in_class:
        return "\\z", i + 2
    if code == "U":
        return "\\x{" + pattern[i + 2 : i + 10] + "}", i + 10
    if code == "N":
        raise RuleError("named characters are not supported, write the character itself")
    octal = re.compile(r"0[0-7]{0,2}|[0-3][0-7]{2}").match(pattern, i + 1)
    if octal:
        return "\\x{%x}" % int(octal.group(), 8), octal.end()
    number = re.compile(r"[1-9][0-9]?").match(pattern, i + 1)
    if number and not in_class:
        # The group around it keeps a following digit out of the reference.
        return f"(?:\\{int(number.group()) + group_shift})", number.end()
    return pattern[i : i + 2], i + 2


def _group(pattern: str, i: int, name_tag: str) -> tuple[str, int]:
    def java_name(name: str) -> str:
        # Java names have no underscores; the length keeps a_b and ab apart.
        return f"n{name_tag}{len(name)}{re.sub('[^A-Za-z0-9]', '', name)}"

    named = re.compile(r"\(\?P<(\w+)>").match(pattern, i)
    if named:
        return f"(?<{java_name(named.group(1))}>", named.end()
    reference = re.compile(r"\(\?P=(\w+)\)").match(pattern, i)
    if reference:
        return f"\\k<{java_name(reference.group(1))}>", reference.end()
    if pattern.startswith("(?#", i):
        return "", pattern.index(")", i) + 1
    if pattern.startswith("(?(", i):
        raise RuleError("conditional groups are not supported")
    flags = re.compile(r"\(\?([aiLmsux]*)(?:-([imsx]+))?:").match(pattern, i)
    if flags:
        on, off = _java_flags(flags.group(1)), _java_flags(flags.group(2) or "")
        off += "U" if "a" in flags.group(1) else ""
        return f"(?{on}{'-' + off if off else ''}:", flags.end()
    return "(?", i + 2
