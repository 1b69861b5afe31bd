"""Row-local matching: everything here is one expression over one text column.

No explode and no shuffle: the hits of a text live in an array beside the text. The
DataFrame operators in ``siftwell.operators.matching`` use these when a document is one
row, which is how files and document tables arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions import deep
from siftwell.functions.rules import Fused, Rule, RuleSet, fuse
from siftwell.functions.text import REST

# Noncharacters that mark a hit and its groups inside the rewritten text.
_HIT, _END = "\ufdd0", "\ufdd1"

HIT_TYPE = "struct<rule_idx:int,matched:string>"
NO_HITS = f"array<{HIT_TYPE}>"
FINDING_TYPE = "struct<rule_idx:int,match_count:bigint,first_ord:bigint>"


# Up to this many different required strings are tested one by one per text.
_MAX_NEEDS = 3


def _marked_pieces(text: Column, rules: RuleSet, present: Sequence[Rule]) -> Column:
    """One regex pass: each hit becomes ``_HIT $g0 _END $g1 _END ...``; one piece per hit.

    Only the group of the rule that matched is non-empty, so the number of leading
    ``_END`` characters of a piece is the rule index. Rules that are not ``present`` are left
    out of the pattern and keep their ``_END``.
    """
    fused = fuse(present)
    group = {r.idx: g for r, g in zip(present, fused.offsets)}
    template = _HIT + "".join((f"${group[r.idx]}" if r.idx in group else "") + _END for r in rules)
    marked = F.regexp_replace(text, F.lit(fused.java), F.lit(template))
    return F.slice(F.split(marked, _HIT), 2, REST)


def _has_marks(text: Column) -> Column:
    return F.contains(text, F.lit(_HIT)) | F.contains(text, F.lit(_END))


def _group_arrays(text: Column, fused: Fused) -> Column:
    """The slower exact form, one pass per rule, for texts that hold the marks themselves."""
    groups = [F.regexp_extract_all(text, F.lit(fused.java), F.lit(g)) for g in fused.offsets]
    return F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)])


def _winner(row: Column, n_rules: int, value: Callable[[int, Column], Column]) -> Column:
    picked = F.when(row["g0"] != "", value(0, row["g0"]))
    for i in range(1, n_rules):
        picked = picked.when(row[f"g{i}"] != "", value(i, row[f"g{i}"]))
    return picked


def _by_content(text: Column, rules: RuleSet, search: Callable[[Sequence[Rule]], Column], nothing: Column) -> Column:
    """``search`` with only the rules whose required string occurs in the text.

    A rule that cannot match anywhere in a text does not change what the others match, and
    a plain substring test costs far less than trying its pattern at every position.
    """
    needs = list(dict.fromkeys(r.needs for r in rules if r.needs))[:_MAX_NEEDS]

    def branch(open_needs: list[str], absent: frozenset[str]) -> Column:
        if open_needs:
            need, rest = open_needs[0], open_needs[1:]
            return F.when(F.contains(text, F.lit(need)), branch(rest, absent)).otherwise(branch(rest, absent | {need}))
        present = [r for r in rules if r.needs not in absent]
        return search(present) if present else nothing

    return branch(needs, frozenset())


SPANS = "array<struct<start:int,end:int,rule_idx:int>>"


def _spans(text: Column, java: Column, rule_idx: Column) -> Column:
    """Where a rule's own hits lie, from one marking pass."""
    marked = F.call_function("regexp_replace", text, java, F.lit(f"{_HIT}$0{_HIT}"))
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("at"))

    def step(a: Column, piece: Column) -> Column:
        end = a["at"] + F.length(piece)
        return F.struct(F.concat(a["ends"], F.array(end)).alias("ends"), end.alias("at"))

    def spans(e: Column) -> Column:
        # Pieces alternate: text, hit, text, hit, ..., text.
        hits = F.sequence(F.lit(0), F.floor(F.size(e) / 2).cast("int") - 1)
        return F.transform(hits, lambda i: F.struct(F.get(e, i * 2).alias("start"), F.get(e, i * 2 + 1).alias("end"), rule_idx.alias("rule_idx")))

    return bind(F.aggregate(F.split(marked, _HIT), start, step)["ends"], spans)


def _lone_codes(text: Column, rules: RuleSet, counts: Column, fused: Column) -> Column:
    """The fused codes from the rules' own hits, wherever no two hits of different rules overlap.

    If none overlap, a search with all rules at once finds just these hits: where it stands, the
    next place at which any rule matches is the next of them, and no other rule matches there. So
    texts that one rule hits need only its count, and texts hit by more have the hits put in
    order; only where two overlap does the fused pattern have to decide.
    """
    def ordered(s: Column) -> Column:
        clash = F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i)["start"] < F.get(s, i - 1)["end"])
        return F.when(clash, fused).otherwise(F.transform(s, lambda x: x["rule_idx"]))

    hit = F.filter(F.transform(counts, lambda n, i: F.when(n > 0, i)), lambda i: i.isNotNull())
    patterns = F.array(*[F.lit(r.java) for r in rules])

    def by_rules(h: Column) -> Column:
        spans = F.flatten(F.transform(h, lambda i: _spans(text, F.get(patterns, i), i.cast("int")))).cast(SPANS)
        alone = F.array_repeat(F.get(h, F.lit(0)).cast("int"), F.get(counts, F.get(h, F.lit(0))).cast("int"))
        few = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, n: a + n) <= _MOST_SPANS
        return (
            F.when(F.size(h) == 0, F.array().cast("array<int>"))
            .when(F.size(h) == 1, alone)
            .when(few, bind(F.array_sort(spans), ordered))
            .otherwise(fused)
        )

    return bind(hit, by_rules)


# Hits of a text that are put in order one by one; with more, one fused pass is cheaper.
_MOST_SPANS = 64


def fused_codes(text: Column, rules: RuleSet) -> Column:
    """``array<int>``: the rule index of every hit, left to right."""
    nothing = F.array().cast("array<int>")
    if not len(rules):
        return nothing
    if rules.deep:
        return deep.codes(F.array(text), rules, None)

    def search(present: Sequence[Rule]) -> Column:
        return F.transform(
            _marked_pieces(text, rules, present), lambda p: F.length(p) - F.length(F.ltrim(p, F.lit(_END)))
        )

    exact = F.transform(_group_arrays(text, fuse(rules)), lambda row: _winner(row, len(rules), lambda i, _: F.lit(i)))
    fused = _by_content(text, rules, search, nothing)
    lone = bind(F.array(*[independent_count(text, r) for r in rules]), lambda counts: _lone_codes(text, rules, counts, fused))
    return F.when(_has_marks(text), exact).otherwise(lone)


def fused_hits(text: Column, rules: RuleSet) -> Column:
    """``array<struct<rule_idx, matched>>``: every hit with its text, left to right."""
    nothing = F.array().cast(NO_HITS)
    if not len(rules):
        return nothing
    if rules.deep:
        return deep.hits(text, rules).cast(NO_HITS)

    def named(i: Column | int, matched: Column) -> Column:
        index = F.lit(i) if isinstance(i, int) else i
        return F.struct(index.alias("rule_idx"), matched.alias("matched"))

    def search(present: Sequence[Rule]) -> Column:
        return F.transform(
            _marked_pieces(text, rules, present),
            lambda p: named(
                F.length(p) - F.length(F.ltrim(p, F.lit(_END))),
                F.substring_index(F.ltrim(p, F.lit(_END)), _END, 1),
            ),
        ).cast(NO_HITS)

    exact = F.transform(_group_arrays(text, fuse(rules)), lambda row: _winner(row, len(rules), named))
    return F.when(_has_marks(text), exact.cast(NO_HITS)).otherwise(_by_content(text, rules, search, nothing))


def count_code(codes: Column, rule_idx: int) -> Column:
    return F.size(F.filter(codes, lambda c: c == rule_idx)).cast("bigint")


def code_counts(codes: Column, n_rules: int) -> Column:
    """``array<bigint>``: one count per rule, of the hits in ``codes``."""
    if not n_rules:
        return F.array().cast("array<bigint>")
    return F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), lambda i: F.size(F.filter(codes, lambda c: c == i)).cast("bigint"))


def independent_count(text: Column, rule: Rule) -> Column:
    """Non-overlapping matches of one rule, zero-length ones included."""
    nothing = F.lit(0).cast("bigint")
    found = F.coalesce(F.regexp_count(text, F.lit(rule.java)).cast("bigint"), nothing)
    return found if rule.needs is None else F.when(F.contains(text, F.lit(rule.needs)), found).otherwise(nothing)


def independent_counts(text: Column, rules: RuleSet) -> Column:
    """``array<bigint>``: one count per rule."""
    if rules.deep:
        return _sizes(deep.matches(F.array(text), rules)[0])
    return F.array(*[independent_count(text, r) for r in rules])


def independent_matches(text: Column, rules: RuleSet) -> Column:
    """``array<array<string>>``: the matches of each rule."""
    if rules.deep:
        return deep.matches(F.array(text), rules)[0]
    return F.array(*[F.regexp_extract_all(text, F.lit(r.java), F.lit(0)) for r in rules])


def _sizes(matches: Column) -> Column:
    return F.transform(matches, lambda found: F.size(found).cast("bigint"))


def chunk_codes(chunks: Column, rules: RuleSet) -> Column:
    """``array<int>`` of all hits over an array of chunks."""
    if rules.deep:
        return deep.codes(chunks, rules, None)
    return F.flatten(F.transform(chunks, lambda c: fused_codes(c, rules)))


def early_codes(chunks: Column, rules: RuleSet, threshold: int) -> Column:
    """Rule indexes over an array of chunks, leaving later chunks unscanned once settled.

    The fold carries the codes so far. A chunk is only searched while no rule has reached
    the threshold, which is where a sequential scanner would stop reading.
    """
    need = max(threshold, 1)
    if rules.deep:
        return deep.codes(chunks, rules, need)
    start = F.struct(F.array().cast("array<int>").alias("codes"), F.lit(False).alias("settled"))

    def settled(codes: Column) -> Column:
        reached = F.lit(False)
        for rule in rules:
            reached = reached | (count_code(codes, rule.idx) >= need)
        return reached

    def step(acc: Column, chunk: Column) -> Column:
        codes = F.concat(acc["codes"], fused_codes(chunk, rules))
        return F.when(acc["settled"], acc).otherwise(
            bind(codes, lambda c: F.struct(c.alias("codes"), settled(c).alias("settled")))
        )

    return F.aggregate(chunks, start, step)["codes"]


def _ordinals_of(codes: Column, rule_idx: int) -> Column:
    """Where in the hit sequence a rule occurs."""
    return F.filter(F.transform(codes, lambda c, j: F.when(c == rule_idx, j)), lambda j: j.isNotNull())


def early_stop(codes: Column, n_rules: int, threshold: int) -> Column:
    """Prefix counts per rule up to the hit at which some rule first reaches the threshold.

    ``array<struct<rule_idx, match_count, first_ord>>`` in first-hit order.
    """
    need = max(threshold, 1)
    found = F.array().cast(f"array<{FINDING_TYPE}>")
    if not n_rules:
        return found
    # The ordinals of each rule are computed once and bound through a one-element transform.
    ordinals = F.struct(*[_ordinals_of(codes, i).alias(f"r{i}") for i in range(n_rules)])

    def settle(o: Column) -> Column:
        marks = [F.get(o[f"r{i}"], F.lit(need - 1)) for i in range(n_rules)]
        stop = F.least(*marks) if n_rules > 1 else marks[0]
        return F.struct(
            *[o[f"r{i}"].alias(f"r{i}") for i in range(n_rules)],
            F.coalesce(stop, F.lit(2**31 - 1)).alias("stop"),
        )

    def findings(o: Column) -> Column:
        per_rule = [
            F.struct(
                F.lit(i).alias("rule_idx"),
                F.size(F.filter(o[f"r{i}"], lambda j: j <= o["stop"])).cast("bigint").alias("match_count"),
                F.get(o[f"r{i}"], F.lit(0)).cast("bigint").alias("first_ord"),
            )
            for i in range(n_rules)
        ]
        hit = F.filter(F.array(*per_rule), lambda f: f["match_count"] > 0)
        return _by_first(hit)

    return bind(bind(ordinals, settle), findings)


def full_findings(codes: Column, n_rules: int) -> Column:
    """Counts over the whole text, no early stop; same element type as :func:`early_stop`."""
    if not n_rules:
        return F.array().cast(f"array<{FINDING_TYPE}>")
    per_rule = [
        F.struct(
            F.lit(i).alias("rule_idx"),
            count_code(codes, i).alias("match_count"),
            (F.array_position(codes, F.lit(i)) - 1).cast("bigint").alias("first_ord"),
        )
        for i in range(n_rules)
    ]
    return _by_first(F.filter(F.array(*per_rule), lambda f: f["match_count"] > 0))


def sequential_whole(text: Column, rules: RuleSet, threshold: int) -> Column:
    """Rule after rule over one text, ending with the rule that reaches the threshold."""
    need = max(threshold, 1)
    counts = independent_counts(text, rules)
    if not len(rules):
        return F.array().cast(f"array<{FINDING_TYPE}>")

    def findings(c: Column) -> Column:
        reached = F.filter(F.transform(c, lambda n, i: F.when(n >= need, i)), lambda i: i.isNotNull())
        stop = F.coalesce(F.get(reached, F.lit(0)), F.lit(2**31 - 1))
        rows = F.transform(
            c,
            lambda n, i: F.struct(
                i.cast("int").alias("rule_idx"),
                F.least(n, F.lit(need)).cast("bigint").alias("match_count"),
                i.cast("bigint").alias("first_ord"),
            ),
        )
        return F.filter(rows, lambda f: (f["match_count"] > 0) & (f["rule_idx"] <= stop))

    return bind(counts, findings)


def sequential_chunked(chunks: Column, rules: RuleSet, threshold: int) -> Column:
    """Chunk after chunk, rule after rule inside a chunk, counts carried between chunks."""
    need = max(threshold, 1)
    k = len(rules)
    if not k:
        return F.array().cast(f"array<{FINDING_TYPE}>")
    start = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), k).alias("counts"),
        F.array_repeat(F.lit(None).cast("bigint"), k).alias("firsts"),
        F.lit(0).cast("bigint").alias("chunk"),
        F.lit(False).alias("settled"),
    )

    def step(acc: Column, chunk: Column) -> Column:
        found = _sizes(chunk) if rules.deep else independent_counts(chunk, rules)
        return F.when(acc["settled"], acc).otherwise(bind(found, lambda n: absorb(acc, n)))

    def absorb(acc: Column, found: Column) -> Column:
        total = F.zip_with(acc["counts"], found, lambda a, b: a + b)
        reached = F.filter(F.transform(total, lambda n, i: F.when(n >= need, i)), lambda i: i.isNotNull())
        stop = F.coalesce(F.get(reached, F.lit(0)), F.lit(2**31 - 1))
        counts = F.transform(
            total, lambda n, i: F.when(i <= stop, F.least(n, F.lit(need).cast("bigint"))).otherwise(acc["counts"][i])
        )
        firsts = F.transform(
            acc["firsts"],
            lambda f, i: F.when(f.isNull() & (found[i] > 0) & (i <= stop), acc["chunk"] * k + i).otherwise(f),
        )
        return F.struct(
            counts.alias("counts"),
            firsts.alias("firsts"),
            (acc["chunk"] + 1).alias("chunk"),
            (F.size(reached) > 0).alias("settled"),
        )

    done = F.aggregate(deep.matches(chunks, rules) if rules.deep else chunks, start, step)

    def findings(d: Column) -> Column:
        rows = F.transform(
            d["counts"],
            lambda n, i: F.struct(
                i.cast("int").alias("rule_idx"), n.alias("match_count"), d["firsts"][i].alias("first_ord")
            ),
        )
        return _by_first(F.filter(rows, lambda f: f["match_count"] > 0))

    return bind(done, findings)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it by name inside ``body``.

    Unlike an alias in an earlier projection, this survives a filter that the optimizer
    pushes down by substituting the alias: an expensive value stays a single occurrence.
    """
    return F.transform(F.array(value), body)[0]


def _by_first(findings: Column) -> Column:
    """First-hit order; the key goes first because structs sort field by field."""
    keyed = F.transform(
        findings,
        lambda f: F.struct(f["first_ord"].alias("first_ord"), f["rule_idx"].alias("rule_idx"), f["match_count"].alias("n")),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda f: F.struct(f["rule_idx"].alias("rule_idx"), f["n"].alias("match_count"), f["first_ord"].alias("first_ord")),
    )
