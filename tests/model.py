"""A plain loop over plain strings, written from the semantics, to compare the engine with."""

from __future__ import annotations

import re


def hits_in(text, patterns, fused):
    """Rule indexes of the hits in scanning order."""
    if not fused:
        return [i for i, p in enumerate(patterns) for _ in re.finditer(p, text)]
    groups, first = [], 1
    for p in patterns:
        groups.append(first)
        first += 1 + re.compile(p).groups
    whole = re.compile("|".join(f"({p})" for p in patterns))
    return [next(i for i, g in enumerate(groups) if m.group(g) is not None) for m in whole.finditer(text)]


def scan(chunks, patterns, threshold, fused=True):
    """``(is_sensitive, [(rule, count), ...])`` with counting stopped at the threshold."""
    need = max(threshold, 1)
    seen = {}
    for chunk in chunks:
        for rule in hits_in(chunk, patterns, fused):
            seen[rule] = seen.get(rule, 0) + 1
            if seen[rule] == need:
                return True, list(seen.items())
    return False, list(seen.items())


def lines_of(text):
    return re.findall(r"[^\n]*\n|[^\n]+\Z", text)


def cut(lines, size, joiner=""):
    return [joiner.join(lines[i : i + size]) for i in range(0, len(lines), size)]


def cut_units(units, size, cap=10_000):
    """Chunks of a list of units, closed at the end of the unit that fills them."""
    chunks, held, read = [], [], 0
    for unit in units:
        take = unit[: cap - read]
        read += len(take)
        held += take
        if len(held) >= size:
            chunks.append(held)
            held = []
    return chunks + ([held] if held else [])


def name_claims(paths, existing):
    """Destination names when first claimants go first and everyone takes the first free name."""

    def split(name):
        body = name.lstrip(".")
        dot = body.rfind(".")
        return (name, "") if dot <= 0 else (name[: len(name) - len(body) + dot], body[dot:])

    taken, given = set(existing), {}
    ordered = sorted(paths)
    firsts = list({p.rsplit("/", 1)[-1]: p for p in reversed(ordered)}.values())
    for path in sorted(firsts) + [p for p in ordered if p not in set(firsts)]:
        name = path.rsplit("/", 1)[-1]
        if name in taken:
            head, ext = split(name)
            number = 1
            while f"{head}_{number}{ext}" in taken or f"{head}_{number}{ext}" in _names(ordered):
                number += 1
            name = f"{head}_{number}{ext}"
        taken.add(name)
        given[path] = name
    return given


def _names(paths):
    return {p.rsplit("/", 1)[-1] for p in paths}
