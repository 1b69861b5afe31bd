"""Cutting an array of segments into chunk texts, inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.matching import bind


def _glue(segments: Column, joiner: Column) -> Column:
    # By name, because the joiner is a column and may differ per row.
    return F.call_function("array_join", segments, joiner)


def chunk_array(segments: Column, size: Column | int, joiner: Column | str) -> Column:
    """``array<string>`` of chunk texts: segment ``i`` goes to chunk ``floor(i / size)``."""
    n = F.lit(size) if isinstance(size, int) else size
    sep = F.lit(joiner) if isinstance(joiner, str) else joiner
    last = F.ceil(F.size(segments) / n.cast("double")).cast("int") - 1
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: _glue(F.slice(segments, k * n + 1, n), sep))
    return (
        F.when(F.size(segments) == 0, F.array().cast("array<string>"))
        .when(last == 0, F.array(_glue(segments, sep)))
        .otherwise(cut)
    )


# Elements that a running fold collects before it starts a new piece of its result.
_SLICE = 64


def running(values: Column, start: Column, step: Callable[[Column, Column], Column], state: str) -> Column:
    """The states of a fold after each element, as an array of type ``state``.

    Appending to one array would copy it at every element. The states of a slice are collected
    by themselves and the slices joined at the end, so the copies grow with the square root only.
    """
    states = f"array<{state}>"
    start = start.cast(state)

    def inside(acc: Column, value: Column) -> Column:
        return bind(step(acc["at"], value).cast(state), lambda at: F.struct(F.concat(acc["out"], F.array(at)).alias("out"), at.alias("at")))

    def of_slice(acc: Column, piece: Column) -> Column:
        first = F.struct(F.array().cast(states).alias("out"), acc["at"].alias("at"))
        done = F.aggregate(piece, first, inside)
        return bind(done, lambda d: F.struct(F.concat(acc["outs"], F.array(d["out"])).alias("outs"), d["at"].alias("at")))

    count = F.ceil(F.size(values) / F.lit(float(_SLICE))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(values, k * _SLICE + 1, _SLICE))
    none = F.struct(F.array().cast(f"array<{states}>").alias("outs"), start.alias("at"))
    return F.when(count <= 0, F.array().cast(states)).otherwise(F.flatten(F.aggregate(pieces, none, of_slice)["outs"]))


# Segments the open chunk holds, the chunk that is open, and the chunk the last unit went to.
FILL = "struct<held:bigint,chunk:bigint,id:bigint>"


def filled(at: Column, size: Column, n: Column) -> Column:
    """The fill after a unit of ``size`` segments: a chunk closes with the unit that fills it."""
    full = at["held"] + size >= n
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.when(full, zero).otherwise(at["held"] + size).alias("held"),
        F.when(full, at["chunk"] + 1).otherwise(at["chunk"]).alias("chunk"),
        at["chunk"].alias("id"),
    )


def fill_of(held: Column | int = 0, chunk: Column | int = 0) -> Column:
    value = lambda v: F.lit(v) if isinstance(v, int) else v
    return F.struct(value(held).alias("held"), value(chunk).alias("chunk"), value(chunk).alias("id")).cast(FILL)


def unit_chunk_ids(sizes: Column, size: Column | int) -> Column:
    """Chunk id per unit: a chunk closes at the end of the unit that fills it.

    ``sizes`` holds the segments per unit, in order. The running total restarts at every
    close, which no window frame can express, so it is a fold over the array.
    """
    n = F.lit(size) if isinstance(size, int) else size
    fills = running(sizes, fill_of(), lambda at, s: filled(at, s, n), FILL)
    return F.transform(fills, lambda at: at["id"].cast("int"))


def unit_chunk_array(segments: Column, size: Column | int, joiner: Column | str = "\n") -> Column:
    """Chunk texts of an ordered ``array<struct<unit_no, text>>``.

    A chunk is closed when a new unit starts and it holds at least ``size`` segments. One
    walk over the segments finds where chunks start; their texts are then cut out.
    """
    n = F.lit(size) if isinstance(size, int) else size
    sep = F.lit(joiner) if isinstance(joiner, str) else joiner
    state = "struct<unit:int,held:bigint,fresh:boolean>"

    def step(at: Column, segment: Column) -> Column:
        close = F.coalesce((segment["unit_no"] != at["unit"]) & (at["held"] >= n), F.lit(False))
        held = F.when(close, F.lit(1).cast("bigint")).otherwise(at["held"] + 1)
        return F.struct(segment["unit_no"].alias("unit"), held.alias("held"), close.alias("fresh"))

    first = F.struct(F.lit(None).cast("int").alias("unit"), F.lit(0).alias("held"), F.lit(False).alias("fresh"))
    walked = running(segments, first, step, state)
    closes = F.filter(F.transform(walked, lambda at, i: F.when(at["fresh"], i)), lambda i: i.isNotNull())
    edges = F.concat(F.array(F.lit(0)), closes, F.array(F.size(segments)))
    texts = F.transform(segments, lambda s: s["text"])

    def cut(e: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(e) - 2),
            lambda k: _glue(F.slice(texts, F.get(e, k) + 1, F.get(e, k + 1) - F.get(e, k)), sep),
        )

    return F.when(F.size(segments) == 0, F.array().cast("array<string>")).otherwise(bind(edges, cut))
