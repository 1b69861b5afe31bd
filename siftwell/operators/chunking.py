"""Caps and chunks over segment tables, where a document is many rows.

``segments`` is ``(doc keys..., unit_no, seg_no, text)``; ``seg_no`` numbers a document's
segments from 0. A document that is one row should use ``siftwell.functions.chunks``, which
needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.chunks import FILL, fill_of, filled, running
from siftwell.functions.text import non_blank
from siftwell.operators.ordinals import first_n, positions, running_total

# Units that are cut by one row.
BLOCK_UNITS = 4096


def drop_blank(segments: DataFrame, text: str = "text") -> DataFrame:
    return segments.where(non_blank(F.col(text)))


def cap_segments(
    segments: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, count_blank: bool = True
) -> DataFrame:
    """The first ``n`` segments of each document.

    ``count_blank`` says whether blank segments use up the cap. Adds ``position``, counted
    from 0 among the segments that count.
    """
    counted = segments if count_blank else drop_blank(segments)
    return first_n(counted, keys, order, n)


def cap_chars(
    segments: DataFrame, keys: Sequence[str], order: Sequence[str], max_chars: int, text: str = "text"
) -> DataFrame:
    """Keep a segment iff the segments before it hold fewer than ``max_chars`` characters."""
    return running_total(
        segments, keys, order, weight=F.length(F.col(text)), out="chars_before", below=max_chars
    )


def chunk_lines(
    segments: DataFrame, keys: Sequence[str], n: int, joiner: str, position: str = "seg_no", text: str = "text"
) -> DataFrame:
    """``(keys..., chunk_no, text)``; chunk = floor(position / n).

    The group is ``(document, chunk)`` and holds at most ``n`` segments, so one document
    that owns most of the table is still spread over the cluster.
    """
    chunk_no = F.floor(F.col(position) / F.lit(float(n))).cast("int")
    return _assemble(segments.withColumn("chunk_no", chunk_no), keys, position, joiner, text)


def _assemble(segments: DataFrame, keys: Sequence[str], position: str, joiner: str, text: str) -> DataFrame:
    members = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t"))))
    grouped = segments.groupBy(*keys, "chunk_no").agg(members.alias("_members"))
    return grouped.select(
        *keys, "chunk_no", F.array_join(F.transform("_members", lambda m: m["t"]), joiner).alias("text")
    )


def capped_units(
    units: DataFrame, keys: Sequence[str], unit: str, lines: str = "lines", cap: int | None = None
) -> DataFrame:
    """The units that hold a document's first ``cap`` segments, the last one cut to fit.

    Every unit that counts has at least one segment, so the first ``cap`` non-empty units
    are enough, and only those are ordered. Adds ``before``, the segments ahead of the unit.
    Without a cap all units that count are returned as they are, and ``before`` is not needed.
    """
    filled = units.where(F.size(lines) > 0)
    if cap is None:
        return filled
    head = first_n(filled, keys, [unit], cap, out="_unit_pos").drop("_unit_pos")
    placed = running_total(head, keys, [unit], weight=F.size(lines), out="before", below=cap)
    room = F.lit(cap) - F.col("before")
    return placed.withColumn(
        lines, F.slice(F.col(lines), F.lit(1), F.least(F.size(lines), room.cast("int")))
    )


def unit_chunks(sizes: DataFrame, keys: Sequence[str], unit: str, n: int) -> DataFrame:
    """``(keys..., unit, chunk_no)`` for units of ``sizes (keys..., unit, size)``, however many a document has.

    What a chunk holds when a block of units begins decides all that follows in the block, and
    that is a number below ``n``. So each block of ``BLOCK_UNITS`` units is reduced to a map: for
    every fill it may begin with, the fill it ends with and the chunks it closes. A document's
    maps, one per block, are walked in order, which tells each block its true beginning; the
    blocks are then cut side by side. No row holds more than a block's units, or one map per
    block of its document.

    Whole numbers are cut into blocks as they are, other units by their position.
    """
    whole = isinstance(sizes.schema[unit].dataType, T.IntegralType)
    placed = sizes.withColumn("_at", F.col(unit).cast("bigint")) if whole else positions(sizes, keys, [unit], out="_at")
    size = F.lit(n).cast("bigint")
    # Keys stay inside a struct, where nulls are equal.
    document = F.struct(*[F.col(k) for k in keys]).alias("_doc")
    rows = placed.select(document, F.floor(F.col("_at") / BLOCK_UNITS).alias("_block"), F.col("_at"), F.col(unit).alias("_unit"), "size")
    members = F.array_sort(F.collect_list(F.struct("_at", "_unit", "size"))).alias("_units")
    blocks = rows.groupBy("_doc", "_block").agg(members)

    fills = F.transform(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)), lambda held: fill_of(held.cast("bigint")))
    ends = F.aggregate("_units", fills, lambda acc, u: F.transform(acc, lambda at: filled(at, u["size"], size)))
    maps = blocks.select("_doc", "_block", ends.alias("_ends"))

    def through(at: Column, block: Column) -> Column:
        end = F.get(block["_ends"], at["held"].cast("int"))
        return F.struct(end["held"].alias("held"), (at["chunk"] + end["chunk"]).alias("chunk"), at["chunk"].alias("id"))

    walked = maps.groupBy("_doc").agg(F.array_sort(F.collect_list(F.struct("_block", "_ends"))).alias("_maps"))
    after = running(F.col("_maps"), fill_of(), through, FILL)
    begins = F.concat(F.array(fill_of()), F.slice(after, F.lit(1), F.size("_maps") - 1))
    entries = walked.select("_doc", F.explode(F.arrays_zip(F.transform("_maps", lambda m: m["_block"]).alias("b"), begins.alias("f"))).alias("_e"))
    entries = entries.select("_doc", F.col("_e.b").alias("_block"), F.col("_e.f").alias("_fill"))

    cut = blocks.join(entries, ["_doc", "_block"])
    ids = running(F.col("_units"), F.col("_fill"), lambda at, u: filled(at, u["size"], size), FILL)
    pairs = F.arrays_zip(F.transform("_units", lambda u: u["_unit"]).alias("u"), ids.alias("f"))
    return cut.select("_doc", F.explode(pairs).alias("_p")).select(
        *[F.col(f"_doc.{k}").alias(k) for k in keys], F.col("_p.u").alias(unit), F.col("_p.f.id").cast("int").alias("chunk_no")
    )


def chunk_units(
    units: DataFrame,
    keys: Sequence[str],
    unit: str,
    n: int,
    joiner: str = "\n",
    lines: str = "lines",
    cap: int | None = None,
) -> DataFrame:
    """``(keys..., chunk_no, text)`` where a chunk closes at the end of the unit that fills it.

    Chunk numbers come from the (unit, size) pairs, see :func:`unit_chunks`; the texts
    themselves are joined per chunk. A ``cap`` reads a document's first segments only.
    """
    capped = capped_units(units, keys, unit, lines, cap)
    sizes = capped.select(*keys, unit, F.size(lines).cast("bigint").alias("size"))
    placed = unit_chunks(sizes, keys, unit, n)
    with_chunk = capped.join(placed, [*keys, unit])
    body = with_chunk.withColumn("_body", F.array_join(F.col(lines), joiner))
    return _assemble(body, keys, unit, joiner, "_body")
