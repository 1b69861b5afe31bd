"""Text decoding, line splitting and stripping as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
UNICODE_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Longer than any array Spark can hold, yet safe to add to a start index.
REST = 1_000_000_000


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode white space, not only U+0020."""
    return F.btrim(c, F.lit(UNICODE_SPACES))


def non_blank(c: Column) -> Column:
    return strip(c) != ""


def lossy_utf8(content: Column) -> Column:
    """Bytes to text; every malformed sequence becomes U+FFFD instead of an error."""
    return F.make_valid_utf8(content.cast("string"))


def universal_newlines(c: Column) -> Column:
    """CRLF and lone CR become LF. Literal replaces, so no regex engine is involved."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def split_lines(c: Column) -> Column:
    """Lines without their newline; a final newline does not open another line."""
    pieces = F.split(c, "\n")
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


def physical_lines(c: Column) -> Column:
    """Lines that keep their newline, as iterating over a text file yields them."""
    pieces = F.split(c, "\n")
    closed = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda line: F.concat(line, F.lit("\n")))
    last = F.element_at(pieces, -1)
    return F.when(last == "", closed).otherwise(F.concat(closed, F.array(last)))


def stripped_lines(c: Column) -> Column:
    """Stripped, non-blank lines: the segments of a page or slide."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda line: line != "")


def head_lines(lines: Column, cap: int | None) -> Column:
    return lines if cap is None else F.slice(lines, 1, cap)


def cap_chars_array(lines: Column, max_chars: int) -> Column:
    """Keep a line iff the lines before it hold fewer than ``max_chars`` characters."""
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("kept"))
    folded = F.aggregate(
        lines,
        start,
        lambda acc, line: F.when(
            acc["total"] < max_chars,
            F.struct(
                (acc["total"] + F.length(line)).alias("total"),
                (acc["kept"] + 1).alias("kept"),
            ),
        ).otherwise(acc),
    )
    return F.slice(lines, F.lit(1), folded["kept"])


def binary_prefix_text(content: Column, n_bytes: int) -> Column:
    """The first ``n_bytes`` of a binary value as lossy UTF-8 text."""
    return lossy_utf8(F.substring(content, 1, n_bytes))
