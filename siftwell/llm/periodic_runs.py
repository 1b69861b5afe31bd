"""Periodic runs of words: stretches that repeat themselves at least three times.

A run is a maximal stretch of words with smallest period ``q`` and at least ``max(24, 3 * q)`` words. All of them are found,
scale by scale:

* Periods up to 24 by direct lag scans: the text is compared with itself shifted by each of them.
* Periods in ``(Q, 2 Q]`` by minimisers, for ``Q`` = 24, 48, 96, ...: of each ``Q`` consecutive ``Q``-word hashes the least
  (leftmost among equals) is selected. Inside a run two windows that lie one period apart are equal, hence select
  places one period apart with equal hashes; pairs of equal minimisers at such a distance seed an extension to both sides.

Hashes whose words lie in a run already found with a period of at most ``Q / 3`` are never selected, so equal ones lie
more than ``Q / 3`` apart and each has at most five partners within ``2 Q``. That loses nothing: windows that are one
period from a partner cover over two periods of a run, and if all hashes there were of that kind, the run would have
that shorter period throughout. A run of a multiple of its smallest period has the ends of the run of the smallest.

Words are told apart by 64-bit hashes; a run found by hashes of spans is compared word by word before it counts. Work
is one narrow stage over the texts, in slices of about 2 MB; a longer text is one slice and takes some thirty times its
size in its task. Rows never meet: a border that equals nothing else stands between them.

Null, empty and blank texts have no words, hence no runs and an empty collapsed text. Null ids stay null. Repeated rows
give a result each. Empty tables give empty results; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Spans, Words, mix, text_slices

MIN_WORDS = 24
EXPONENT = 3
# Periods up to this are scanned for directly; it is the first scale, too, so it may not be below MIN_WORDS.
SHORT = 24
_ALL = np.uint64(0x0101010101010101)

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_FOUND_DDL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _stretches(x: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ``x[i] == x[i + lag]`` holds for at least ``least`` (16 or more) places on end: starts and ends."""
    n = len(x) - lag
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros((n + 7) // 8 * 8, dtype=bool)
    np.equal(x[:n], x[lag:], out=same[:n])
    # So many equal places fill a block of eight.
    full = np.flatnonzero(same.view(np.uint64) == _ALL)
    fresh = np.flatnonzero(np.diff(full, prepend=-2) > 1)
    starts, ends = full[fresh] * 8, (full[np.append(fresh[1:], len(full)) - 1] + 1) * 8 if len(full) else full
    for _ in range(7):
        starts = starts - ((starts > 0) & same[np.maximum(starts - 1, 0)])
        ends = ends + ((ends < n) & same[np.minimum(ends, n - 1)])
    long = ends - starts >= least
    return starts[long], ends[long]


def _common(n: int, spans: Spans, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many of ``n`` words behind (``back``: before) the places ``a < b`` are equal, by bisection over hashes of spans."""
    low, high = np.zeros(len(a), np.int64), a.copy() if back else n - b
    while (low < high).any():
        middle = (low + high + 1) // 2
        if back:
            equal = spans(a - middle, a) == spans(b - middle, b)
        else:
            equal = spans(a, a + middle) == spans(b, b + middle)
        low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
    return low


def _pairs(words: int, spans: Spans, scale: int, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Equal minimisers of ``scale`` at distances in ``(scale, 2 * scale]``: the first place and the distance."""
    n = words - scale + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < scale:
        return none
    places = np.arange(n)
    hashes = spans(places, places + scale)
    bits = np.uint64((1 << n.bit_length()) - 1)
    keys = (hashes & ~bits) | places.astype(np.uint64)
    inside = (runs[2] <= scale // EXPONENT) & (runs[1] >= scale)
    if inside.any():
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, runs[0][inside], 1)
        np.add.at(edges, (runs[0] + runs[1])[inside] - scale + 1, -1)
        keys[np.cumsum(edges[:-1]) > 0] = ~np.uint64(0)
    blocks = np.full((n + scale - 1) // scale * scale, ~np.uint64(0))
    blocks[:n] = keys
    blocks = blocks.reshape(-1, scale)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - scale + 1], ahead[scale - 1 : n])
    least = least[least != ~np.uint64(0)]
    if not len(least):
        return none
    chosen = (least[np.append(True, least[1:] != least[:-1])] & bits).astype(np.int64)
    chosen = chosen[np.lexsort((chosen, hashes[chosen]))]
    first, distance = [], []
    for step in range(1, 2 * EXPONENT):
        a, b = chosen[:-step], chosen[step:]
        near = (hashes[a] == hashes[b]) & (b - a > scale) & (b - a <= 2 * scale)
        first.append(a[near])
        distance.append((b - a)[near])
    return np.concatenate(first), np.concatenate(distance)


def _holds(x: np.ndarray, start: int, length: int, period: int) -> bool:
    return np.array_equal(x[start : start + length - period], x[start + period : start + length])


def _distinct(starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> Runs:
    """One row per stretch, with its smallest period, by start, then length."""
    order = np.lexsort((periods, lengths, starts))
    starts, lengths, periods = starts[order], lengths[order], periods[order]
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (starts[1:] != starts[:-1]) | (lengths[1:] != lengths[:-1])
    return starts[fresh], lengths[fresh], periods[fresh]


def _seeded(x: np.ndarray, scale: int, runs: Runs) -> Runs:
    """Runs with periods in ``(scale, 2 * scale]``, and others that a pair at such a distance leads to."""
    spans = Spans(x)
    at, lag = _pairs(len(x), spans, scale, runs)
    before = _common(len(x), spans, at, at + lag, back=True)
    starts, lengths = at - before, before + lag + _common(len(x), spans, at, at + lag, back=False)
    long = lengths >= np.maximum(MIN_WORDS, EXPONENT * lag)
    starts, lengths, lag = _distinct(starts[long], lengths[long], lag[long])
    true = np.array([_holds(x, *run) for run in zip(starts.tolist(), lengths.tolist(), lag.tolist(), strict=True)], dtype=bool)
    parts = [(starts[true], lengths[true], lag[true])]
    for period in np.unique(lag[~true]).tolist():
        # Spans with equal hashes that differ: this distance is scanned word by word.
        parts.append(_scanned(x, period))
    return _together(parts)


def _scanned(x: np.ndarray, period: int) -> Runs:
    starts, ends = _stretches(x, period, max(MIN_WORDS, EXPONENT * period) - period)
    return starts, ends - starts + period, np.full(len(starts), period)


def _together(parts: list[Runs]) -> Runs:
    return _distinct(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def find_runs(hashes: np.ndarray, first: np.ndarray) -> Runs:
    """Runs in rows of word hashes; row ``r`` is ``hashes[first[r]:first[r + 1]]``.

    Starts count from the first word of all rows.
    """
    rows = len(first) - 1
    sizes = np.diff(first)
    borders = mix(np.arange(rows, dtype=np.uint64) ^ np.uint64(0xB0D3 << 48))

    def joined(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen rows, each with a border behind it, and how far each row has moved."""
        at = np.zeros(len(chosen), np.int64)
        np.cumsum(sizes[chosen[:-1]] + 1, out=at[1:])
        shift = at - first[chosen]
        x = np.empty(int(sizes[chosen].sum()) + len(chosen), np.uint64)
        source = np.arange(len(x)) - np.repeat(shift, sizes[chosen] + 1)
        ends = at + sizes[chosen]
        source[ends] = 0
        x[:] = hashes[source]
        x[ends] = borders[chosen]
        return x, shift

    none = np.zeros(0, np.int64)
    found: Runs = (none, none, none)
    scale = 0
    while True:
        chosen = np.flatnonzero(sizes >= max(MIN_WORDS, EXPONENT * (scale + 1)))
        if not len(chosen):
            return found
        x, shift = joined(chosen)
        at = first[chosen] + shift
        if not scale:
            got = _together([_scanned(x, lag) for lag in range(1, SHORT + 1)])
        else:
            # What is known already, in the places of these rows.
            here = sizes[np.searchsorted(first, found[0], side="right") - 1] >= EXPONENT * (scale + 1)
            row = np.searchsorted(first[chosen], found[0][here], side="right") - 1
            got = _seeded(x, scale, (found[0][here] + shift[row], found[1][here], found[2][here]))
        moved = got[0] - shift[np.searchsorted(at, got[0], side="right") - 1]
        found = _together([found, (moved, got[1], got[2])])
        scale = scale * 2 or SHORT


def _dropped(n: int, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a run behind its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts + periods, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_slices(batch):
            words = Words(data, offsets)
            first = words.first
            starts, lengths, periods = find_runs(words.hashes, first)
            row = np.searchsorted(first, starts, side="right") - 1
            begins = starts - first[row]
            borders = np.searchsorted(row, np.arange(len(first)))
            texts = []
            for r in range(len(first) - 1):
                kept = data[offsets[r] : offsets[r + 1]].tobytes().split()
                of = slice(borders[r], borders[r + 1])
                if of.start < of.stop:
                    gone = _dropped(len(kept), begins[of], lengths[of], periods[of]).tolist()
                    kept = [word for word, drop in zip(kept, gone, strict=True) if not drop]
                texts.append(b" ".join(kept))
            order = np.lexsort((periods, begins, row))
            run = pa.StructArray.from_arrays([pa.array(c[order], type=pa.int64()) for c in (begins, lengths, periods)], fields=list(_RUN))
            columns = [
                rows.column(0).cast(pa.int64()),
                pa.array(np.diff(first), type=pa.int64()),
                pa.ListArray.from_arrays(pa.array(borders, type=pa.int32()), run),
                pa.array(texts, type=pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_FOUND)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each row of ``docs (doc_id, text)``.

    ``runs`` are structs ``start, length, period`` in words, by start, then period. ``collapsed`` is the text with one
    period left of each run: its words joined by one space, without those in a run behind its first period.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, _FOUND_DDL)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period (ties: smallest start, then period); null without runs.

    The quotient of two numbers below 2^26 is told apart from any other by a double.
    """
    return F.aggregate(
        runs,
        F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda best, run: F.when(best.isNull() | (run["length"] / run["period"] > best["length"] / best["period"]), run).otherwise(best),
    )
