"""Blocks of a web page: the leaf texts between block borders, each with the path of elements around it.

Tags are read as browsers do where it matters for text: comments, declarations and raw elements (scripts, styles, titles) hold
no text, end tags that match nothing are ignored, a block ends an open paragraph, an item ends the one before it. What is not
closed ends with the page. Inline elements don't end a block, line breaks do.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/>]|$)", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Elements by how the HTML standard treats their content.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
UNSEEN = frozenset("head noscript template svg math object select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# An element of the key ends an open one of the value, up to the nearest element of SCOPES.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPES = frozenset("ul ol menu dl table tbody thead tfoot html".split())


class Element(NamedTuple):
    """An open element: its name, and the names of it and all around it, outermost first."""

    tag: str
    path: tuple[tuple[str, ...], ...]
    seen: bool


class Block(NamedTuple):
    """A leaf text, white space made one space; the letters of it that are links; the names of each element around it."""

    text: str
    linked: int
    path: tuple[tuple[str, ...], ...]


_known: dict[tuple[str, str], tuple[str, ...]] = {}


def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element is called: its tag, and the parts of its class, id, role and the like."""
    known = _known.get((tag, attributes))
    if known is None:
        found = [f"<{tag}"]
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                found.append("hidden")
            elif key != "style":
                found.extend(part.lower() for part in _NAME.findall(html.unescape(value)))
        known = tuple(dict.fromkeys(found))
        if len(_known) > 10_000:
            _known.clear()
        _known[tag, attributes] = known
    return known


def _ended(stack: list[Element], tags: tuple[str, ...]) -> None:
    """Close the innermost element of ``tags`` and what it holds, unless a scope lies between."""
    for at in range(len(stack) - 1, 0, -1):
        if stack[at].tag in tags:
            del stack[at:]
            return
        if stack[at].tag in SCOPES:
            return


def _paragraph_ended(stack: list[Element]) -> None:
    at = len(stack) - 1
    while stack[at].tag in INLINE:
        at -= 1
    if stack[at].tag == "p":
        del stack[at:]


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; those without text are left out."""
    found: list[Block] = []
    stack = [Element("", (), True)]
    pieces: list[str] = []
    linked = at = links = 0
    path = stack[0].path

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append(Block(text, min(linked, len(text)), path))
            pieces.clear()
        linked = 0

    def take(raw: str) -> None:
        nonlocal path, linked
        if raw and stack[-1].seen:
            text = html.unescape(raw) if "&" in raw else raw
            if not pieces:
                path = stack[-1].path
            pieces.append(text)
            if links:
                linked += len(text)

    while at < len(page):
        mark = _TAG.search(page, at)
        if mark is None:
            take(page[at:])
            break
        take(page[at : mark.start()])
        at = mark.end()
        tag = mark[2]
        if tag is None:
            continue
        tag = tag.lower()
        if mark[1]:
            if tag not in INLINE:
                close()
            if any(e.tag == tag for e in stack):
                while stack.pop().tag != tag:
                    pass
            links = sum(e.tag == "a" for e in stack) if tag == "a" or links else 0
            continue
        if tag not in INLINE:
            close()
            _paragraph_ended(stack)
            if tag in ENDS:
                _ended(stack, ENDS[tag])
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>|\\Z", re.I).search(page, at)
            at = end.end()
        elif tag not in VOID:
            around = stack[-1]
            own = () if tag in INLINE else (names_of(tag, mark[3]),)
            stack.append(Element(tag, around.path + own, around.seen and tag not in UNSEEN))
            links += tag == "a"
    close()
    return found
