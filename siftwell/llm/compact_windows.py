"""Near-duplicate passages by compact windows.

The tokens of a text are its five-word shingles. For each of ``hashes`` functions, the Cartesian tree over the token
hashes says for every token ``c`` the widest stretch ``[l, r]`` in which it is the minimum; all sub-sequences inside
that hold ``c`` share that min-hash. Only stretches wide enough for a passage count. Stretches of different texts
with the same min-hash are joined, overlapping ones of a pair of texts grow into one region of either, and the regions
are verified: the passages reported have ``passage`` words or more, and an aligned shingle similarity of
``similarity`` or more.

A near passage holds a run of shared tokens without a gap (``shared_run``; repeats of a few words in a row excepted).
The least token of such a run is the same in both texts, so the first function takes every stretch of that width, and
misses no pair by chance. The others take stretches as wide as a passage.

Before anything is compared, places that no near passage can hold are left out. Of a passage's tokens ``similarity`` or more
stand in its partner too, so it lies within stretches of its width or more of which that share of tokens is found in another text. Around the
agreeing windows, tokens are counted over all texts, and windows outside such stretches go. A line that many texts
hold among words of their own proposes nothing, however many hold it.

What is left of a group of texts with the same min-hash is compared with its least and its greatest member first, at all their places.
Places of a group that passages link, one by one, are a class. Where a group is of several classes, a task takes all its places (of a
large group, those of two blocks) with the tokens near each, and looks for passages around places of different classes: those with the
most shared tokens nearby are compared with all others, then as many again, and so on. What a passage links is one class from then on, so
a group is reported with few more pairs than it has texts. No two places of different classes are left uncompared.

Equal texts are compared once; each copy is reported with the first one, over its whole length. Null ids are ids like
others; rows that repeat id and text are one document. Null, empty and short texts have no passage. Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import WORD, Words, checkpointed, document_key, mix, numbers, outer_id, record_batches, signed, small, text_slices, written
from siftwell.llm.order_minhash import aligned
from siftwell.llm.pairs import GROUP, blocked, whole_groups

PASSAGE = 50
SHINGLE = 5
SIMILARITY = 0.8
HASHES = 3
ROWS = 1 << 15
# Places of one frame, of one block of a group, and pairs of them that are listed at once.
PLACES = 4096
BLOCK = 1024
LISTED = 1 << 14
# Pairs that are verified at once.
PAIRS = 128
# Rows that are gone over at once, place by place.
COLUMNS = 1 << 10
# Numbers that the tokens which places of a group share are told apart by.
BITS = 4096


def shared_run(width: int, similarity: float, gap: int = SHINGLE - 1) -> int:
    """Length of the longest run of aligned tokens that near passages of ``width`` tokens or more have at least.

    With ``m`` aligned, at most ``m / similarity - m`` are not; a gap between runs leaves ``gap`` of them or more.
    """
    least = int(np.ceil(2 * width * similarity / (1 + similarity) - 1e-9))
    m = np.arange(least, 16 * least)
    runs = np.floor(m * (1 / similarity - 1) / gap + 1e-9) + 1
    return max(1, int(np.ceil(m / runs - 1e-9).min()))


def smaller_neighbours(values: np.ndarray, strict: bool) -> np.ndarray:
    """For each place the nearest one before it with a value not above its own (``strict``: below it).

    ``values`` must begin with a value below all others. Places jump over their neighbours' results, all at once.
    """
    before = np.arange(len(values)) - 1
    before[0] = 0
    left = np.arange(1, len(values))
    above = np.greater_equal if strict else np.greater
    while len(left):
        left = left[above(values[before[left]], values[left]) & (before[left] > 0)]
        before[left] = before[before[left]]
    return before


def compact_windows(values: np.ndarray, borders: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``row, l, c, r`` (places within the row, ``r`` included) of all compact windows of ``width`` tokens or more.

    Of equal minima the leftmost stands for the window.
    """
    counts = np.diff(borders)
    rows = np.repeat(np.arange(len(counts)), counts)
    # A barrier below all values before each row and after the last.
    at = np.arange(len(values)) + rows + 1
    fenced = np.zeros(len(values) + len(counts) + 1, dtype=np.uint64)
    fenced[at] = np.maximum(values, np.uint64(1))
    low = smaller_neighbours(fenced, strict=False)[at] + 1
    high = len(fenced) - 1 - smaller_neighbours(fenced[::-1].copy(), strict=True)[::-1][at] - 1
    wide = np.flatnonzero(high - low + 1 >= width)
    shift = (borders[:-1] + np.arange(len(counts)) + 1)[rows[wide]]
    return rows[wide], low[wide] - shift, at[wide] - shift, high[wide] - shift


_WINDOWS = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("l", pa.int32()), ("c", pa.int32()), ("r", pa.int32())])


def _apart(docs: np.ndarray, keys: np.ndarray, at: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """Which windows to keep where a token repeats inside its stretch: one for every ``width`` places."""
    order = np.lexsort((at, high, keys, docs))
    same = np.ones(len(order), dtype=bool)
    for column in (docs, keys, high):
        same[1:] &= column[order][1:] == column[order][:-1]
    same[:1] = False
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    step = (at[order] - at[order][head]) // width
    keep = ~same
    keep[1:] |= step[1:] != step[:-1]
    return np.sort(order[keep])


def _factors(hashes: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sliding(values: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` (minimum or maximum) over every ``width`` values in a row."""
    k = 1
    while 2 * k <= width:
        values = of(values[:-k], values[k:])
        k *= 2
    return of(values[: k - width], values[width - k :]) if width > k else values


def least_places(values: np.ndarray, borders: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``row, c`` of the compact windows of ``width`` tokens or more, kept ``_apart``.

    A token is the least of some ``width`` in a row where the greatest of the minima around it is its own value. Only rows where
    such a value repeats take the Cartesian tree, which tells equal ones apart.
    """
    counts = np.diff(borders)
    values = np.maximum(values, np.uint64(1))
    if len(values) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _sliding(values, width, np.minimum)
    rows = np.repeat(np.arange(len(counts)), counts)
    least[rows[: len(least)] != rows[width - 1 :]] = 0
    fence = np.zeros(width - 1, dtype=np.uint64)
    place = np.flatnonzero(_sliding(np.concatenate([fence, least, fence]), width, np.maximum) == values)
    row = rows[place]
    marks = values[place] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(marks)
    same = np.flatnonzero(marks[order][1:] == marks[order][:-1])
    if not len(same):
        return row, place - borders[row]
    twice = np.zeros(len(counts), dtype=bool)
    twice[row[order[same]]] = twice[row[order[same + 1]]] = True
    place, row = place[~twice[row]], row[~twice[row]]
    of = np.flatnonzero(twice)
    own = values[twice[rows]]
    again, _, at, high = compact_windows(own, np.append(0, np.cumsum(counts[of])), width)
    keep = _apart(again, own[np.append(0, np.cumsum(counts[of]))[again] + at], at, high, width)
    return np.append(row, of[again[keep]]), np.append(place - borders[row], at[keep])


_DEALT = pa.schema([("bucket", pa.int32()), ("key", pa.list_(pa.int64())), ("doc", pa.list_(pa.int64())), ("c", pa.list_(pa.int32()))])
_DEALT_DDL = "bucket int, key array<long>, doc array<long>, c array<int>"
_PLACES = pa.schema([("doc", pa.int64()), ("c", pa.list_(pa.int32()))])
# Tokens of one bucket, about.
BUCKET = 1 << 18


def _dealt(keys: np.ndarray, rows: np.ndarray, docs: np.ndarray, places: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Tokens of a slice of texts as one row a bucket of keys.

    A token that several texts of the slice hold is found in two texts already: of it, only those of two texts go to its bucket, to
    tell the other slices. The rest go past, in the buckets behind, without keys; so no bucket fills with a very frequent token.
    """
    order = np.argsort(keys)
    keys, rows, places = keys[order], rows[order], places[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(heads, len(keys)))
    lowest, highest = np.repeat(np.minimum.reduceat(rows, heads), sizes), np.repeat(np.maximum.reduceat(rows, heads), sizes)
    past = (rows != lowest) & (rows != highest)
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    out = []
    for kind, base in ((~past, 0), (past, buckets)):
        at = np.flatnonzero(kind)
        cuts = np.flatnonzero(np.append(True, np.diff(bucket[at]) != 0)) if len(at) else at
        offsets = pa.array(np.append(cuts, len(at)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (signed(keys)[at], docs[rows[at]], places[at].astype(np.int32))]
        if base:
            lists[0] = pa.ListArray.from_arrays(pa.array(np.zeros(len(cuts) + 1), pa.int32()), pa.array([], pa.int64()))
        out.append(pa.RecordBatch.from_arrays([pa.array(bucket[at][cuts] + np.int32(base)), *lists], schema=_DEALT))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0]


def _repeated(group: pa.Table) -> pa.Table:
    """The places, text by text, of a bucket's tokens that are found in two texts or more; those without keys are known to be."""
    keys, docs, places = (group[n].combine_chunks().flatten().to_numpy(zero_copy_only=False) for n in ("key", "doc", "c"))
    if len(keys):
        order = np.argsort(keys)
        keys, docs, places = keys[order], docs[order], places[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        shared = np.minimum.reduceat(docs, heads) != np.maximum.reduceat(docs, heads)
        shared = np.repeat(shared, np.diff(np.append(heads, len(keys))))
        docs, places = docs[shared], places[shared]
    order = np.argsort(docs)
    docs, places = docs[order], places[order]
    heads = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else order
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(docs)), pa.int32()), pa.array(places, pa.int32()))
    return pa.Table.from_arrays([pa.array(docs[heads]), lists], schema=_PLACES)


def _centres(run_width: int, shingle: int, seed: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Least tokens of all stretches of ``run_width`` tokens, by the first function."""
    factor = _factors(1, seed)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                shingles, borders = Words(data, offsets).shingles(shingle)
                row, at = least_places(shingles * factor, borders, run_width)
                if len(row):
                    yield _dealt(shingles[borders[row] + at], row, numbers(rows, "th"), at, buckets)

    return run


def _windows(hashes: int, run_width: int, width: int, shingle: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compact windows of all functions whose least token lies in one of the text's stretches, cut to that stretch."""
    factors = _factors(hashes, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                shingles, borders = Words(data, offsets).shingles(shingle)
                docs = numbers(rows, "th")
                starts, ends = (rows.column(rows.schema.get_field_index(n)) for n in ("starts", "ends"))
                shift = np.repeat(borders[:-1], starts.value_lengths().to_numpy(zero_copy_only=False))
                starts, ends = (x.flatten().to_numpy(zero_copy_only=False) + shift for x in (starts, ends))
                for j, factor in enumerate(factors):
                    values = shingles * factor
                    row, low, at, high = compact_windows(values, borders, width if j else run_width)
                    place = borders[row] + at
                    of = np.searchsorted(starts, place, side="right") - 1
                    keep = np.flatnonzero((of >= 0) & (place < ends[of]))
                    row, at, of, place = row[keep], at[keep], of[keep], place[keep]
                    low, high = np.maximum(low[keep], starts[of] - borders[row]), np.minimum(high[keep], ends[of] - 1 - borders[row])
                    keys = mix(values[place] + np.uint64(j))
                    keep = _apart(row, keys, at, high, width)
                    row, low, at, high, keys = row[keep], low[keep], at[keep], high[keep], keys[keep]
                    yield from record_batches({"key": signed(keys), "doc": docs[row], "l": low, "c": at, "r": high}, _WINDOWS)

    return run


def _regions(drift: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Grow the agreeing windows of each pair of texts into regions of both.

    Windows of a pair whose texts lie shifted alike, ``drift`` places more or less from one to the next, are a band; those of
    a band that overlap in the first text are a region, with the ``shift`` of its first window.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["a", "b"], ROWS):
            pair, shift = frame["group"].to_numpy(), (frame["ac"] - frame["bc"]).to_numpy()
            order = np.lexsort((shift, pair))
            step = np.append(True, (np.diff(pair[order]) != 0) | (np.diff(shift[order]) > drift))
            band = np.empty(len(order), dtype=np.int64)
            band[order] = np.cumsum(step)
            al, ar = frame["al"].to_numpy().astype(np.int64), frame["ar"].to_numpy().astype(np.int64)
            order = np.lexsort((frame["bl"].to_numpy(), al, band))
            # Bands lie apart on one line, so that the farthest end so far never reaches into the next.
            line = band[order] << 32
            reached = np.maximum.accumulate(line + ar[order])
            heads = np.flatnonzero(np.append(True, line[1:] + al[order][1:] > reached[:-1]))
            column = lambda name: frame[name].to_numpy()[order]
            out = {"a": column("a")[heads], "al": column("al")[heads], "ar": np.maximum.reduceat(column("ar"), heads), "b": column("b")[heads]}
            out |= {"bl": np.minimum.reduceat(column("bl"), heads), "br": np.maximum.reduceat(column("br"), heads), "shift": shift[order][heads]}
            yield pd.DataFrame(out)

    return run


def _tokens(reach: int, shingle: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The tokens of each text that stand at most ``reach`` places from one of its ``centres``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                shingles, borders = Words(data, offsets).shingles(shingle)
                docs = numbers(rows, "th")
                centres = rows.column(rows.schema.get_field_index("centres"))
                row = np.repeat(np.arange(len(rows)), centres.value_lengths().to_numpy(zero_copy_only=False))
                at = centres.flatten().to_numpy(zero_copy_only=False) + borders[row]
                edges = np.zeros(len(shingles) + 1, dtype=np.int64)
                np.add.at(edges, np.maximum(at - reach, borders[row]), 1)
                np.add.at(edges, np.minimum(at + reach + 1, borders[row + 1]), -1)
                near = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
                of = np.searchsorted(borders, near, side="right") - 1
                if len(near):
                    yield _dealt(shingles[near], of, docs, near - borders[of], buckets)

    return run


def dense_stretches(places: np.ndarray, width: int, density: float) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the union of all stretches that begin and end with one of ``places`` (sorted, distinct), are ``width`` wide or
    more, and hold that share of ``places``.

    From place ``i`` to ``j`` that share is reached if ``j - density * places[j]`` is no lower than the same at ``i``, less
    ``1 - density``; of all such ``j`` the last is taken.
    """
    u = np.arange(len(places)) - density * places
    highest = np.maximum.accumulate(u[::-1])
    last = len(places) - 1 - np.searchsorted(highest, u - (1 - density) - 1e-9)
    starts = np.flatnonzero(places[last] - places >= width - 1)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.maximum.accumulate(places[last[starts]]) + 1
    starts = places[starts]
    fresh = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    return starts[fresh], ends[np.append(fresh[1:], len(starts)) - 1]


_STRETCHES = pa.schema([("th", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _stretches(width: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The dense stretches of each text, where it has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(len(batch)):
                places = np.unique(batch.column(1)[row].values.to_numpy(zero_copy_only=False)).astype(np.int64)
                starts, ends = dense_stretches(places, width, similarity)
                if len(starts):
                    out.append((batch.column(0)[row].as_py(), starts.tolist(), ends.tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _STRETCHES, strict=True)], schema=_STRETCHES)

    return run


def _ranks(groups: np.ndarray) -> np.ndarray:
    """The place of each row in its group; those of a group stand together."""
    at = np.arange(len(groups))
    heads = np.append(True, groups[1:] != groups[:-1])[: len(groups)]
    return at - np.maximum.accumulate(np.where(heads, at, 0))


def _dense(pair: np.ndarray, places: np.ndarray, width: int, density: float) -> tuple[np.ndarray, np.ndarray]:
    """``dense_stretches`` of many pairs at once, by borders of the form ``pair << 32 | place``."""
    line = pair << 32 | places
    if not len(line):
        return line, line
    # In fixed point, every pair lower than the one before it, so that no later one is taken for a place of an earlier one.
    u = np.rint((_ranks(pair) - density * places) * (1 << 18)).astype(np.int64) - (pair << 42)
    highest = np.maximum.accumulate(u[::-1])
    last = len(line) - 1 - np.searchsorted(highest, u - int((1 - density) * (1 << 18)) - 2)
    starts = np.flatnonzero(places[last] - places >= width - 1)
    if not len(starts):
        return line[:0], line[:0]
    ends = np.maximum.accumulate(line[last[starts]]) + 1
    starts = line[starts]
    fresh = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    return starts[fresh], ends[np.append(fresh[1:], len(starts)) - 1]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row of each."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), lengths)


def shared_runs(x: np.ndarray, xp: np.ndarray, y: np.ndarray, yp: np.ndarray, drift: np.ndarray, width: int, similarity: float) -> tuple[np.ndarray, ...]:
    """``pair, x0, x1, y0, y1`` of the runs of shared shingles of many pairs, where near passages may lie. ``xp`` and ``yp`` number the
    pair of each shingle. Where a shingle stands at several places, the one nearest to ``drift`` places on is its partner.
    """
    none = (np.zeros(0, np.int64),) * 5
    xat, yat = _ranks(xp), _ranks(yp)
    if not len(x) or not len(y):
        return none
    # Shingles in order, each with its place behind it.
    bits = int(max(xat.max(), yat.max())).bit_length()
    wanted, packed = ((p << 32 | v.view(np.uint32)) << bits | at for v, p, at in ((x, xp, xat), (y, yp, yat)))
    wanted.sort()
    packed.sort()
    order, ranked = packed & ((1 << bits) - 1), packed >> bits
    heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    distinct = ranked[heads]
    group = np.searchsorted(distinct, wanted >> bits)
    group[group == len(distinct)] = 0
    hits = np.flatnonzero(distinct[group] == wanted >> bits)
    of = np.full(len(x), -1)
    of[np.searchsorted(xp, wanted[hits] >> (32 + bits)) + (wanted[hits] & ((1 << bits) - 1))] = group[hits]
    shared = np.flatnonzero(of >= 0)
    group = of[shared]
    # Passages lie within stretches dense in shared shingles, of either sequence.
    starts, ends = _dense(xp[shared], xat[shared], width, similarity)
    if not len(starts):
        return none
    tails = np.append(heads[1:], len(ranked))
    met = np.zeros(len(heads), dtype=bool)
    met[group] = True
    met = np.repeat(met, tails - heads)
    yline = (ranked >> 32)[met] << 32 | order[met]
    yline.sort()
    either = np.zeros(int(max(xp[-1], yp[-1])) + 1, dtype=bool)
    either[_dense(yline >> 32, yline & 0xFFFFFFFF, width, similarity)[0] >> 32] = True
    line = xp[shared] << 32 | xat[shared]
    of = np.searchsorted(starts, line, side="right") - 1
    keep = np.flatnonzero((of >= 0) & (line < ends[of]) & either[xp[shared]])
    if not len(keep):
        return none
    shared, group = shared[keep], group[keep]
    # The partner of a shared shingle: the place in y nearest to where its neighbours point; of two as near, the first.
    pair, place, low, high = xp[shared], xat[shared], heads[group], tails[group]
    partner = order[low]
    many = np.flatnonzero(high - low > 1)
    to, low, high = place[many] + drift[pair[many]], low[many], high[many]
    after = np.searchsorted(packed, ranked[low] << bits | np.clip(to, 0, (1 << bits) - 1))
    before, after = order[np.maximum(after - 1, low)], order[np.minimum(after, high - 1)]
    partner[many] = np.where(np.abs(before - to) <= np.abs(after - to), before, after)
    cuts = np.flatnonzero((np.diff(place) != 1) | (np.diff(partner) != 1) | (np.diff(pair) != 0)) + 1
    heads, tails = np.append(0, cuts), np.append(cuts, len(pair)) - 1
    return pair[heads], place[heads], place[tails] + 1, partner[heads], partner[tails] + 1


def joined_runs(runs: list[tuple[int, int, int, int]], x: np.ndarray, y: np.ndarray, width: int, similarity: float, shortest: int = SHINGLE) -> list[tuple[int, int, int, int]]:
    """``x0, x1, y0, y1`` of near-duplicate passages of two shingle sequences, ``width`` shingles or more.

    Runs of shared shingles are joined from left to right as long as their similarity stays; a run of fewer than
    ``shortest`` that does not fit is passed over. The stretch of ``y`` is where the partners lie; the pair is then aligned.
    """
    found: list[tuple[int, int, int, int]] = []

    def close(x0: int, x1: int, y0: int, y1: int) -> None:
        if min(x1 - x0, y1 - y0) < width:
            return
        # The joined runs are an alignment themselves; only where it falls short is the best one looked for.
        if sure * (1 + similarity) >= similarity * (x1 - x0 + y1 - y0) or aligned(x[x0:x1], y[y0:y1], similarity):
            found.append((x0, x1, y0, y1))

    current, good = runs[0], runs[0][1] - runs[0][0]
    sure = good
    for run in runs[1:]:
        n = good + run[1] - run[0]
        if run[2] >= current[3] - 1 and n * (1 + similarity) >= similarity * (run[1] - current[0] + run[3] - current[2]):
            sure += run[1] - run[0] - max(current[3] - run[2], 0)
            current, good = (current[0], run[1], current[2], run[3]), n
        elif run[1] - run[0] >= min(good, shortest):
            close(*current)
            current, good = run, run[1] - run[0]
            sure = good
    close(*current)
    return found


def runs_around(runs: list[tuple[int, int, int, int]], x: int, y: int, width: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """The near-duplicate passage of most shared shingles that begins and ends with a run and in which ``x`` stands for ``y``, if any.

    Runs that cross those nearer to ``x`` are passed over.
    """
    middle = [k for k, run in enumerate(runs) if run[0] <= x < run[1] and run[2] + x - run[0] == y]
    if not middle:
        return []
    before, after = [runs[middle[0]]], [runs[middle[0]]]
    for run in runs[: middle[0]][::-1]:
        if run[3] <= before[-1][2]:
            before.append(run)
    for run in runs[middle[0] + 1 :]:
        if run[2] >= after[-1][3]:
            after.append(run)
    early, late = np.array(before), np.array(after)
    good = np.cumsum(early[:, 1] - early[:, 0])[:, None] + np.cumsum(late[:, 1] - late[:, 0]) - (late[0, 1] - late[0, 0])
    wide, other = late[:, 1] - early[:, :1], late[:, 3] - early[:, 2:3]
    fit = (np.minimum(wide, other) >= width) & (good * (1 + similarity) >= similarity * (wide + other) - 1e-9)
    i, j = np.unravel_index(np.argmax(np.where(fit, good, 0)), good.shape)
    return [(int(early[i, 0]), int(late[j, 1]), int(early[i, 2]), int(late[j, 3]))] if fit[i, j] else []


def dense_around(shared: np.ndarray, width: int, density: float) -> np.ndarray:
    """Which rows of ``shared`` hold a stretch around their middle of ``width`` places or more that begins and ends with a place
    set, with that share of places set."""
    found = [_dense_around(np.ascontiguousarray(shared[at : at + COLUMNS].T), width, density) for at in range(0, len(shared), COLUMNS)]
    return np.concatenate([np.zeros(0, dtype=bool), *found])


def _dense_around(shared: np.ndarray, width: int, density: float) -> np.ndarray:
    """The same for rows that stand as columns, place by place for all of them."""
    size, count = shared.shape
    middle = size // 2
    g = np.zeros((size + 1, count), dtype=np.float32)
    steps = shared - np.float32(density)
    for k in range(size):
        np.add(g[k], steps[k], out=g[k + 1])
    last = max(0, min(middle, size - width))
    below = np.where(shared[: last + 1], g[: last + 1], np.inf) - 1e-3
    ends = np.where(shared[middle:], g[middle + 1 :], -np.inf)
    # Stretches that begin so early that they are wide enough wherever they end behind the middle.
    early = max(0, min(last, middle + 1 - width) + 1)
    highest = np.full(count, -np.inf, dtype=np.float32)
    found = np.zeros(count, dtype=bool)
    for k in range(size, middle, -1):
        np.maximum(highest, ends[k - middle - 1], out=highest)
        if early <= k - width <= last:
            found |= highest >= below[k - width]
    return found | (highest >= below[:early].min(axis=0)) if early else found


class _Classes:
    """Classes of rows that grow together; each row begins in that of its ``labels``."""

    def __init__(self, labels: np.ndarray) -> None:
        _, self._label = np.unique(labels, axis=1, return_inverse=True)
        self._label = self._label.reshape(-1)
        self._parent = np.arange(int(self._label.max(initial=-1)) + 1)

    def of(self, rows: np.ndarray) -> np.ndarray:
        while len(far := np.flatnonzero(self._parent[self._parent] != self._parent)):
            self._parent[far] = self._parent[self._parent[far]]
        return self._parent[self._label[rows]]

    def _root(self, at: int) -> int:
        while self._parent[at] != at:
            at = int(self._parent[at])
        return at

    def join(self, a: int, b: int) -> bool:
        """Whether the rows ``a`` and ``b`` were of two classes, which are one now."""
        a, b = sorted((self._root(int(self._label[a])), self._root(int(self._label[b]))))
        self._parent[b] = a
        return a != b


class _Places:
    """Places of some groups, those with the most shared tokens around them first, with the tokens near each; its own is in the middle."""

    def __init__(self, frame: pd.DataFrame, width: int, similarity: float, shingle: int, across: bool) -> None:
        self._width, self._similarity, self._shingle = width, similarity, shingle
        # Of two passages of that similarity one has this share of its tokens in the other, or more.
        self._best = 2 * similarity / (1 + similarity)
        lengths, middle = frame["near"].map(len).to_numpy(), 2 * width
        before = np.minimum(frame["c"].to_numpy(), middle).astype(np.int64)
        at = np.arange(2 * middle + 1) - (middle - before)[:, None]
        inside = (at >= 0) & (at < lengths[:, None])
        tokens = np.zeros(inside.shape, dtype=np.int32)
        tokens[inside] = np.concatenate(frame["near"].to_list())
        group, label = frame["group"].to_numpy(), frame["class"].to_numpy()
        # Tokens that places of other classes (and of the other block) hold too; only where they are dense has a place a partner.
        row = np.nonzero(inside)[0]
        marks = group[row] << 32 | tokens[inside].view(np.uint32)
        order = np.argsort(marks)
        marks = marks[order]
        heads = np.flatnonzero(np.append(True, marks[1:] != marks[:-1])[: len(marks)])
        sizes = np.diff(np.append(heads, len(marks)))
        parted = np.ones(len(heads), dtype=bool)
        for side in (label, frame["block"].to_numpy())[: 1 + across]:
            of = side[row[order]]
            parted &= np.minimum.reduceat(of, heads) != np.maximum.reduceat(of, heads)
        # The tokens that places of a group share, numbered; each has a bit of its own unless they are very many.
        several = sizes > 1
        number = np.cumsum(several) - several
        of = marks[heads] >> 32
        number = np.where(several, (number - number[np.searchsorted(of, of)]) % BITS, BITS).astype(np.int16)
        both, often, bit = np.empty(len(row), dtype=bool), np.empty(len(row), dtype=np.int64), np.empty(len(row), dtype=np.int16)
        both[order], often[order], bit[order] = np.repeat(parted, sizes), np.repeat(sizes, sizes), np.repeat(number, sizes)
        shared = np.zeros(inside.shape, dtype=bool)
        bits = np.full(inside.shape, BITS, dtype=np.int16)
        shared[inside], bits[inside] = both, bit
        fit = np.flatnonzero(dense_around(shared, width, similarity))
        doc = frame["doc"].to_numpy()
        self.rows = fit = fit[np.lexsort((doc[fit], -np.bincount(row, often, len(frame))[fit], group[fit]))]
        self.group, self.doc, self.block = group[fit], doc[fit], frame["block"].to_numpy()[fit]
        self.tokens, self.inside, self.before = tokens[fit], inside[fit], before[fit]
        self.strong = dense_around(shared[fit], width, self._best)
        self._bits = bits[fit]
        holds = np.zeros((len(fit), BITS + 1), dtype=bool)
        holds[np.arange(len(fit))[:, None], self._bits] = True
        holds[:, BITS] = False
        self._holds = holds.ravel()
        self._rank = _ranks(self.group)
        heads = np.flatnonzero(self._rank == 0)
        self._ends = np.repeat(np.append(heads[1:], len(fit)), np.diff(np.append(heads, len(fit)))) if len(fit) else heads

    def pairs(self, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The places ``low`` to ``high`` of each group, each with all that stand behind it there."""
        lead = np.flatnonzero((self._rank >= low) & (self._rank < high))
        behind = self._ends[lead] - lead - 1
        total = np.cumsum(behind)
        at = 0
        while at < len(lead):
            to = max(at + 1, int(np.searchsorted(total, total[at] - behind[at] + LISTED, side="right")))
            a, many = np.repeat(lead[at:to], behind[at:to]), behind[at:to]
            yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
            at = to

    def alike(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of each pair stand alike, counted from its places, and whether that makes a passage around them."""
        counts, found = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=bool)
        for at in range(0, len(a), COLUMNS):
            same = self.tokens[a[at : at + COLUMNS]] == self.tokens[b[at : at + COLUMNS]]
            same &= self.inside[a[at : at + COLUMNS]] & self.inside[b[at : at + COLUMNS]]
            counts[at : at + COLUMNS] = count = np.count_nonzero(same, axis=1)
            fit = np.flatnonzero(count >= self._best * self._width - 1e-6)
            found[at + fit] = dense_around(same[fit], self._width, self._best)
        return counts, found

    def likely(self, a: np.ndarray, b: np.ndarray, alike: np.ndarray) -> np.ndarray:
        """How many tokens each pair shares, of which ``alike`` make no passage; 0 where all of them are not dense enough for one either."""
        found = np.zeros(len(a), dtype=np.int64)
        for at in range(0, len(a), COLUMNS):
            x, y = a[at : at + COLUMNS], b[at : at + COLUMNS]
            one = self._holds.take(np.add(self._bits[x], (y * (BITS + 1))[:, None], dtype=np.intp))
            other = self._holds.take(np.add(self._bits[y], (x * (BITS + 1))[:, None], dtype=np.intp))
            least, count = self._width * self._similarity, np.count_nonzero(one, axis=1)
            more = np.maximum(count, np.count_nonzero(other, axis=1)) > alike[at : at + COLUMNS]
            fit = np.flatnonzero(more & (count >= least))
            near = fit[self._dense(one[fit], other[fit])]
            # Without the tokens that only seem to be equal.
            one, other = self._equal(x[near], y[near])
            held = self._dense(one, other)
            found[at + near[held]] = np.count_nonzero(one[held], axis=1)
        return found

    def _dense(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether the shared tokens of either side are dense around the middle, and those of one side as dense as one must be."""
        found = dense_around(one, self._width, self._best)
        left = np.flatnonzero(~found)
        found[left] = dense_around(other[left], self._width, self._best)
        for side in (one, other):
            left = np.flatnonzero(found)
            found[left] = dense_around(side[left], self._width, self._similarity)
        return found

    def _equal(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens of either place of each pair the other has near it."""
        pair = np.arange(len(a))[:, None] << 33
        # Outside of the texts no two are equal.
        x, y = (np.where(self.inside[n], self.tokens[n].view(np.uint32).astype(np.int64), (1 << 32) + k) | pair for k, n in enumerate((a, b)))

        def among(these: np.ndarray, those: np.ndarray) -> np.ndarray:
            those = np.sort(those, axis=1).ravel()
            return those[np.minimum(np.searchsorted(those, these.ravel()), len(those) - 1)].reshape(these.shape) == these if len(those) else these == 0

        return among(x, y), among(y, x)

    def straight(self, a: int, b: int) -> tuple[int, int, int, int]:
        """``x0, x1, y0, y1`` of a passage of a pair that is ``alike``, counted from its places."""
        same = (self.tokens[a] == self.tokens[b]) & self.inside[a] & self.inside[b]
        places, middle = np.flatnonzero(same), len(same) // 2
        early, late = places[places <= middle], places[places >= middle]
        held = np.concatenate([[0], np.cumsum(same)])
        wide = late[None, :] + 1 - early[:, None]
        fit = (wide >= self._width) & (held[late + 1][None, :] - held[early][:, None] >= self._best * wide - 1e-3)
        i, j = np.unravel_index(np.argmax(np.where(fit, wide, 0)), wide.shape)
        x0, x1 = int(early[i]) - middle, int(late[j]) + 1 - middle
        return x0, x1, x0, x1

    def verified(self, a: np.ndarray, b: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
        """The same of those of the pairs that have a passage around their places, by their numbers."""
        found = {}
        for at in range(0, len(a), PAIRS):
            x, y = a[at : at + PAIRS], b[at : at + PAIRS]
            xs, ys = self.tokens[x][self.inside[x]], self.tokens[y][self.inside[y]]
            xn, yn = self.inside[x].sum(axis=1), self.inside[y].sum(axis=1)
            pairs = np.arange(len(x))
            xm, ym = self.before[x], self.before[y]
            pair, *sides = shared_runs(xs, np.repeat(pairs, xn), ys, np.repeat(pairs, yn), ym - xm, self._width, self._similarity)
            if not len(pair):
                continue
            xb, yb = np.append(0, np.cumsum(xn)), np.append(0, np.cumsum(yn))
            heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            runs = list(zip(*(side.tolist() for side in sides), strict=True))
            for k, lo, hi in zip(pair[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(pair)], strict=True):
                u, v = int(xm[k]), int(ym[k])
                joined = joined_runs(runs[lo:hi], xs[xb[k] : xb[k + 1]], ys[yb[k] : yb[k + 1]], self._width, self._similarity, self._shingle)
                joined = [j for j in joined if j[0] <= u < j[1] and j[2] <= v < j[3]] or runs_around(runs[lo:hi], u, v, self._width, self._similarity)
                for x0, x1, y0, y1 in joined[:1]:
                    found[at + k] = (x0 - u, x1 - u, y0 - v, y1 - v)
        return found


def _joined(places: _Places, classes: _Classes, across: bool) -> list[tuple[int, int, tuple[int, int, int, int]]]:
    """Pairs of places that a passage covers, as few as make one class of all that such passages link, one by one.

    The first places of each group are compared with all behind them, then as many again, and so on; only those of two classes.
    Nothing depends on which groups stand in a frame together.
    """
    links: list[tuple[int, int, tuple[int, int, int, int]]] = []

    def link(a: np.ndarray, b: np.ndarray, shared: np.ndarray, certain: bool) -> None:
        order = np.lexsort((b, a, -shared))
        a, b = a[order], b[order]
        while True:
            one, other = classes.of(a), classes.of(b)
            left = np.flatnonzero(one != other)
            if not len(left):
                return
            # The best pair of each class that is left.
            a, b, one, other = a[left], b[left], one[left], other[left]
            at = np.arange(len(a))
            first = np.full(int(max(one.max(), other.max())) + 1, len(a))
            np.minimum.at(first, one, at)
            np.minimum.at(first, other, at)
            best = np.unique(first[first < len(a)])
            passages = {} if certain else places.verified(a[best], b[best])
            for k, i in enumerate(best.tolist()):
                if (certain or k in passages) and classes.join(a[i], b[i]):
                    links.append((int(a[i]), int(b[i]), places.straight(int(a[i]), int(b[i])) if certain else passages[k]))
            a, b = np.delete(a, best), np.delete(b, best)

    low, high, most = 0, 1, int(np.bincount(places.group).max(initial=0))
    while low < most:
        kept = []
        for a, b in places.pairs(low, high):
            fit = (classes.of(a) != classes.of(b)) & (places.strong[a] | places.strong[b]) & (places.doc[a] != places.doc[b])
            if across:
                fit &= places.block[a] != places.block[b]
            a, b = a[fit], b[fit]
            kept.append((a, b, *places.alike(a, b)))
        low, high = high, 2 * high
        if not kept:
            continue
        a, b, alike, certain = (np.concatenate(x) for x in zip(*kept, strict=True))
        link(a[certain], b[certain], alike[certain], certain=True)
        left = np.flatnonzero(~certain & (classes.of(a) != classes.of(b)))
        shared = places.likely(a[left], b[left], alike[left])
        left, shared = left[shared > 0], shared[shared > 0]
        link(a[left], b[left], shared, certain=False)
    return links


_FOUND, _AB, _BA = ("from", "to", "other_from", "other_to"), ("a0", "a1", "b0", "b1"), ("b0", "b1", "a0", "a1")
_SIDES = ["a", "al", "ac", "ar", "a0", "a1", "b", "bl", "bc", "br", "b0", "b1"]
_LINKS_DDL = ", ".join(f"{n} {'int' if n in ('al', 'ac', 'ar', 'bl', 'bc', 'br') else 'long'}" for n in _SIDES) + ", node long, class long"


def _links(width: int, similarity: float, shingle: int, across: bool, block: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The pairs that link the classes of each group, with a passage of either; of groups of several blocks also the class of each place."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, GROUP, PLACES):
            places = _Places(frame, width, similarity, shingle, across)
            classes = _Classes(np.stack([frame["group"].to_numpy(), frame["class"].to_numpy()])[:, places.rows])
            doc, l, c, r = (frame[n].to_numpy()[places.rows] for n in ("doc", "l", "c", "r"))
            out: list[tuple] = []
            for a, b, (x0, x1, y0, y1) in _joined(places, classes, across):
                sides = ((i, (doc[i], l[i], c[i], r[i], c[i] + first, c[i] + last + shingle - 1)) for i, first, last in ((a, x0, x1), (b, y0, y1)))
                one, other = sorted((s for _, s in sides), key=lambda s: s[0])
                out.append((*one, *other))
            links = pd.DataFrame(out, columns=_SIDES)
            links["node"] = links["class"] = pd.Series(dtype="Int64")
            yield links
            several = np.flatnonzero(frame["size"].to_numpy() > block) if not across else []
            if len(several):
                # A class is called by the least of its own.
                label = frame["class"].to_numpy().copy()
                of = classes.of(np.arange(len(places.rows)))
                least = np.full(int(of.max(initial=-1)) + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, of, label[places.rows])
                label[places.rows] = least[of]
                named = pd.DataFrame({n: pd.Series(np.full(len(several), None), dtype="Int64") for n in _SIDES})
                named["node"], named["class"] = frame["node"].to_numpy()[several], label[several]
                yield named

    return run


_PASSAGES = pa.schema([(n, pa.int64()) for n in ("a", "a0", "a1", "b", "b0", "b1")])
_PASSAGES_DDL = "a long, a0 long, a1 long, b long, b0 long, b1 long"


def _verify(width: int, shingle: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), PAIRS):
                batch, out = whole.slice(at, PAIRS), []
                (x, xp), (y, yp) = _lists(batch.column(4)), _lists(batch.column(5))
                pair, *sides = shared_runs(x, xp, y, yp, numbers(batch, "drift"), width, similarity)
                xb, yb = (np.searchsorted(p, np.arange(len(batch) + 1)) for p in (xp, yp))
                if not len(pair):
                    continue
                heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                names = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
                runs = list(zip(*(side.tolist() for side in sides), strict=True))
                for k, lo, hi in zip(pair[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(pair)], strict=True):
                    a, al, b, bl = names[k]
                    for x0, x1, y0, y1 in joined_runs(runs[lo:hi], x[xb[k] : xb[k + 1]], y[yb[k] : yb[k + 1]], width, similarity, shingle):
                        out.append((a, al + x0, al + x1 + shingle - 1, b, bl + y0, bl + y1 + shingle - 1))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_PASSAGES)

    return run


def _sequences(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("doc", pa.int64()), ("x", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                shingles, borders = Words(data, offsets).shingles(shingle)
                short = (shingles >> np.uint64(32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(short))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists], schema=schema)

    return run


def near_passages(
    docs: DataFrame, passage: int = PASSAGE, similarity: float = SIMILARITY, hashes: int = HASHES, shingle: int = SHINGLE, seed: int = 5
) -> DataFrame:
    """``doc_id, start_word, end_word, other_id, other_start, other_end``: passages near to one of another document.

    Needs ``doc_id`` and ``text``. ``other_id`` is a representative of those that share the passage.
    """
    keyed = docs.select(*document_key(), "text")
    texts = written(keyed.groupBy("th").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.max(F.octet_length("text")).alias("bytes")), "texts")
    copies = small(checkpointed(texts.where("n > 1").select("th", "id")))
    # The first row of each text stands for its copies; only rows of copies are dealt out for that.
    others = copies.select("th", F.col("id").alias("least"))
    alike = keyed.join(others, "th", "left")
    first = alike.where("least is null").select("th", "text").unionByName(alike.where("id = least").select("th", "text").dropDuplicates(["th"]))
    width = passage - shingle + 1
    run_width = shared_run(width, similarity, shingle - 1)

    def repeated(dealt: DataFrame, name: str) -> DataFrame:
        found = dealt.groupBy("bucket").applyInArrow(_repeated, "doc long, c array<int>")
        return written(found.groupBy(F.col("doc").alias("th")).agg(F.flatten(F.collect_list("c")).alias(name)), name)

    # Some forty bytes of text have one centre, and every centre so many tokens around it at most.
    buckets = 1 + (texts.agg(F.sum("bytes")).first()[0] or 0) // 40 // BUCKET
    centres = repeated(first.mapInArrow(_centres(run_width, shingle, seed, buckets), _DEALT_DDL), "centres")
    buckets = 1 + (centres.agg(F.sum(F.size("centres"))).first()[0] or 0) * (4 * width + 1) // 2 // BUCKET
    places = repeated(first.join(centres, "th").mapInArrow(_tokens(2 * width, shingle, buckets), _DEALT_DDL), "places")
    stretches = written(places.mapInArrow(_stretches(width, similarity), "th long, starts array<int>, ends array<int>"), "stretches")
    dense = first.join(small(stretches.select("th")), "th", "left_semi").join(stretches, "th")
    windows = dense.mapInArrow(_windows(hashes, run_width, width, shingle, seed), "key long, doc long, l int, c int, r int")
    windows = written(windows, "windows")
    seen = windows.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("size")).where("least <> most")
    agreeing = written(windows.join(seen, "key"), "agreeing")
    held = first.join(small(checkpointed(agreeing.select(F.col("doc").alias("th")).distinct())), "th", "left_semi")
    sequences = written(held.mapInArrow(_sequences(shingle), "doc long, x array<int>"), "sequences")

    def verified(pairs: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The passages of ``pairs`` in regions not verified ``before``, and these regions."""
        # A passage may reach beyond the stretch of its longest run.
        wide = pairs.select(
            "a", F.greatest(F.col("al") - width, F.lit(0)).alias("al"), "ac", (F.col("ar") + width).alias("ar"),
            "b", F.greatest(F.col("bl") - width, F.lit(0)).alias("bl"), "bc", (F.col("br") + width).alias("br"),
        )
        ordered = wide.repartition("a", "b").sortWithinPartitions("a", "b")
        regions = ordered.mapInPandas(_regions(width // 3), "a long, al int, ar int, b long, bl int, br int, shift int")
        regions = written(regions if before is None else regions.join(before, regions.columns, "left_anti"), "regions")
        left = small(regions).join(sequences.withColumnRenamed("doc", "a"), "a").withColumn("x", F.expr("slice(x, al + 1, ar - al + 1)"))
        both = left.join(sequences.select(F.col("doc").alias("b"), F.col("x").alias("y")), "b").withColumn("y", F.expr("slice(y, bl + 1, br - bl + 1)"))
        asked = both.select("a", F.col("al").cast("long").alias("al"), "b", F.col("bl").cast("long").alias("bl"), "x", "y", F.expr("al - shift - bl").alias("drift"))
        return written(asked.mapInArrow(_verify(width, shingle, similarity), _PASSAGES_DDL).distinct(), "passages"), regions

    ends = agreeing.where("doc = least or doc = most")
    ends = ends.select("key", F.col("doc").alias("a"), F.col("l").alias("al"), F.col("c").alias("ac"), F.col("r").alias("ar"))
    pairs = agreeing.select("key", F.col("doc").alias("b"), F.col("l").alias("bl"), F.col("c").alias("bc"), F.col("r").alias("br")).join(ends, "key")
    found, regions = verified(pairs.where("a <> b"))
    def within(place: str, start: str, end: str) -> Column:
        return (F.col(start) <= F.col(place)) & (F.col(place) + shingle <= F.col(end))

    # Without its ends a group needs two texts more. Places that passages tie to the first place of an end are of one class with it;
    # where one is tied to both ends, all of these are.
    inner = agreeing.where("size > 3 and doc <> most and doc <> least")
    firsts = agreeing.where("size > 3 and (doc = least or doc = most)").groupBy("key", F.col("doc").alias("other")).agg(F.min("c").alias("end"))
    sides = found.selectExpr("a AS doc", "a0 AS from", "a1 AS to", "b AS other", "b0 AS other_from", "b1 AS other_to")
    sides = sides.unionAll(found.selectExpr("b", "b0", "b1", "a", "a0", "a1"))
    tied = inner.select("key", "doc", "c", "least").join(firsts, "key").join(sides, ["doc", "other"])
    tied = tied.where(within("c", "from", "to") & within("end", "other_from", "other_to"))
    tied = tied.groupBy("key", "doc", "c").agg(F.max(F.expr("other = least")).alias("low"), F.max(F.expr("other <> least")).alias("high"))
    places = inner.join(tied, ["key", "doc", "c"], "left").withColumn("node", F.xxhash64("key", "doc", "c"))
    places = written(places.select("key", "doc", "l", "c", "r", "size", "node", "low", "high"), "tied")
    both = places.where("low and high").select("key", F.lit(True).alias("both")).distinct()
    places = places.join(both, "key", "left").withColumn("class", F.expr("CASE WHEN low OR (high AND both) THEN 0 WHEN high THEN 1 ELSE node END"))
    parted = places.groupBy("key").agg(F.min("class").alias("first"), F.max("class").alias("last")).where("first <> last").select("key")
    places = written(places.join(parted, "key", "left_semi").drop("low", "high", "both"), "open")

    def linked(places: DataFrame, across: bool) -> DataFrame:
        """The links of the groups of ``places``: of those in the same block, or of those in two blocks."""
        reach = 2 * width
        rows = blocked(places, F.col("size"), across, BLOCK)
        rows = (rows.where("low < high") if across else rows).join(sequences, "doc")
        near = F.expr(f"slice(x, greatest(c - {reach}, 0) + 1, c + {reach} + 1 - greatest(c - {reach}, 0))")
        rows = rows.select("key", "low", "high", "block", "node", "doc", "l", "c", "r", "size", "class", near.alias("near"))
        ordered = rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "node")
        return written(ordered.mapInPandas(_links(width, similarity, shingle, across, BLOCK), _LINKS_DDL), "links")

    # Groups of several blocks are linked block by block first; the classes of their blocks meet then.
    every = links = linked(places, across=False)
    more, fresh = verified(links.where("node is null").drop("a0", "a1", "b0", "b1", "node", "class"), regions)
    found, regions = found.unionByName(more), regions.unionByName(fresh)
    links = linked(places.drop("class").join(links.where("node is not null").select("node", "class"), "node"), across=True)
    more, _ = verified(links.drop("a0", "a1", "b0", "b1", "node", "class"), regions)
    found, links = found.unionByName(more), every.unionByName(links).where("node is null")
    # A region may be cut into passages in another way than the tokens near a place; then the passage around the place is one too.
    ordered = found.selectExpr("least(a, b) AS a", "greatest(a, b) AS b", *(f"IF(a < b, {x}, {y}) AS {n}" for x, y, n in zip(_AB, _BA, _FOUND, strict=True)))
    covered = within("ac", "from", "to") & within("bc", "other_from", "other_to")
    alone = links.join(ordered.withColumnsRenamed({"a": "a_", "b": "b_"}), (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")) & covered, "left_anti")
    found = found.unionByName(alone.select("a", "a0", "a1", "b", "b0", "b1"))
    found = found.distinct()
    ids = texts.select("th", "id")
    named = found.join(ids.select(F.col("th").alias("a"), F.col("id").alias("other")), "a").join(ids.select(F.col("th").alias("b"), "id"), "b")
    near = named.select(
        outer_id().alias("doc_id"), F.col("b0").alias("start_word"), F.col("b1").alias("end_word"),
        outer_id("other").alias("other_id"), F.col("a0").alias("other_start"), F.col("a1").alias("other_end"),
    )
    # Words are counted once for each text that has copies.
    counted = alike.where("id = least").dropDuplicates(["th"]).select("th", F.col("id").alias("other"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).alias("words"))
    counted = small(checkpointed(counted.where(F.col("words") >= passage)))
    again = keyed.select("id", "th").join(counted, "th")
    again = again.where("id <> other").distinct()
    return near.unionByName(
        again.select(
            outer_id().alias("doc_id"), F.lit(0).cast("long").alias("start_word"), F.col("words").cast("long").alias("end_word"),
            outer_id("other").alias("other_id"), F.lit(0).cast("long").alias("other_start"), F.col("words").cast("long").alias("other_end"),
        )
    )
