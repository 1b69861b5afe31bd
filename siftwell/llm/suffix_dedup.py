"""Repeated passages by sparse suffix arrays.

Of all suffixes of a text only those are kept that begin at a minimiser: the ``ANCHOR``-word run with the lowest hash
among the runs inside some window of ``passage`` words. Equal windows choose equal places, so wherever
a passage of that length repeats, a kept suffix lies at the same place of each copy. Suffixes are sorted by
the hash of their first words; where neighbours of different documents agree, each is extended to the left and right
over all windows that chose it, and windows that agree again are repeats. The spans found are exactly the union of
all ``passage``-word windows that occur in two documents or more, up to collisions of 96 bits of hash.

Words are runs of anything but ASCII white space; how they are spaced does not matter. Null ids are one document with
the id null; rows that repeat id and text are one document, and rows that repeat an id alone are texts of one document.
Null, empty and shorter texts have no passage. Empty tables give empty results; other columns are ignored, and kept by
``without_repeats``. A long text is read in one piece, in memory of some forty times its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.window import Window

from siftwell.llm.common import NARROW_BYTES, Words, checkpointed, document_key, numbers, outer_id, record_batches, signed, small, text_slices, whole_row, written

PASSAGE = 50
ANCHOR = 25
# Suffixes of one anchor that are compared at once. More are dealt out; what their tasks leave open is compared after.
HOT = 2000
# Rows that a task sorts at a time; the suffixes of an anchor stay together.
ROWS = 1 << 16


def _chosen(words: Words, passage: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the anchor that each window chose (the leftmost of the lowest), and hashes of all runs."""
    n = len(words) - anchor + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    runs = words.spans(at, at + anchor)
    counts = np.diff(words.first)
    starts = np.concatenate([np.zeros(0, np.int64), np.flatnonzero(np.repeat(words.first[1:], counts) - np.arange(len(words)) >= passage)])
    width = passage - anchor + 1
    low, where, span = runs, at, 1
    while span < width:
        step = min(span, width - span)
        if len(low) <= step:
            break
        better = low[step:] < low[:-step]
        where = np.where(better, where[step:], where[:-step])
        low = np.where(better, low[step:], low[:-step])
        span += step
    return starts, where[starts], runs


_ANCHORS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("g", pa.int64())])


def _anchors(passage: int, anchor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, size=NARROW_BYTES):
                words = Words(data, offsets)
                _, where, runs = _chosen(words, passage, anchor)
                where = np.unique(where)
                row = np.searchsorted(words.first, where, side="right") - 1
                ids, ths = numbers(rows, "id"), numbers(rows, "th")
                yield from record_batches({"id": ids[row], "th": ths[row], "g": signed(runs[where])}, _ANCHORS)

    return run


_SUFFIXES = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("g", pa.int64()), ("start", pa.int32()), ("windows", pa.list_(pa.int32()))])


def _suffixes(passage: int, anchor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per repeated anchor of a document the windows that chose it: the first's start, and the hashes of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, size=NARROW_BYTES):
                words = Words(data, offsets)
                starts, where, runs = _chosen(words, passage, anchor)
                if not len(starts):
                    continue
                row = np.searchsorted(words.first, starts, side="right") - 1
                asked = rows.column(rows.schema.get_field_index("gs"))
                flat = asked.flatten().to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(len(rows)), asked.value_lengths().to_numpy(zero_copy_only=False))
                # A run counts only where its own document asked for it.
                mark = lambda g, r: g ^ (r.astype(np.int64) * np.int64(0x9E3779B97F4A7C1))
                keep = np.isin(mark(signed(runs)[where], row), mark(flat, of))
                starts, where, row = starts[keep], where[keep], row[keep]
                if not len(starts):
                    continue
                hashes = (words.spans(starts, starts + passage) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                begins = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)]))
                windows = pa.ListArray.from_arrays(pa.array(np.append(begins, len(starts)), pa.int32()), pa.array(hashes))
                first = starts[begins] - words.first[row[begins]]
                ids, ths = numbers(rows, "id")[row[begins]], numbers(rows, "th")[row[begins]]
                yield from record_batches(
                    {"id": ids, "th": ths, "g": signed(runs[where[begins]]), "start": first.astype(np.int32), "windows": windows}, _SUFFIXES
                )

    return run


_SPANS = pa.schema([
    ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("redundant", pa.bool_()),
    ("g", pa.int64()), ("h", pa.int32()), ("repeated", pa.bool_()),
])
_SPANS_DDL = "id long, th long, start int, stop int, redundant boolean, g long, h int, repeated boolean"


def _compare(table: pa.Table, passage: int) -> Iterator[pa.RecordBatch]:
    """Spans of windows that agree between documents, among the suffixes of some anchors.

    Where an anchor's suffixes are dealt out, a window that no lower document of its part has is left open: it comes
    out by itself, with its hash.
    """
    table = table.combine_chunks()
    windows = table["windows"].chunk(0) if table["windows"].num_chunks else pa.array([], pa.list_(pa.int32()))
    lengths = windows.value_lengths().to_numpy(zero_copy_only=False)
    flat = windows.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.cumsum(lengths) - lengths
    ids, g, parts, salt = (table[n].to_numpy() for n in ("id", "g", "parts", "salt"))
    start = table["start"].to_numpy()[row] + (np.arange(len(flat)) - begin[row])
    own = ids[row]
    order = np.lexsort((own, flat, salt[row], g[row]))
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    for key in (g[row], salt[row], flat):
        same &= key[order][1:] == key[order][:-1]
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    run = np.cumsum(np.concatenate([[True], ~same])) - 1
    least = own[order][heads][run]
    most = own[order][np.append(heads[1:], len(order)) - 1][run]
    repeated, redundant = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    repeated[order] = least != most
    redundant[order] = (least != most) & (own[order] != least)
    dealt = parts[row] > 1
    left = np.flatnonzero(dealt & ~redundant)
    if len(left):
        columns = {"id": own[left], "th": table["th"].to_numpy()[row[left]], "start": start[left].astype(np.int32), "stop": (start[left] + passage).astype(np.int32)}
        columns |= {"redundant": np.zeros(len(left), bool), "g": g[row[left]], "h": flat[left], "repeated": repeated[left]}
        yield from record_batches(columns, _SPANS)
    at = np.flatnonzero(repeated & ~(dealt & ~redundant))
    if not len(at):
        return
    fresh = (row[at][1:] != row[at][:-1]) | (start[at][1:] != start[at][:-1] + 1) | (redundant[at][1:] != redundant[at][:-1])
    first = np.flatnonzero(np.concatenate([[True], fresh]))
    last = np.append(first[1:], len(at)) - 1
    f, to = at[first], at[last]
    columns = {"id": own[f], "th": table["th"].to_numpy()[row[f]], "start": start[f].astype(np.int32), "stop": (start[to] + passage).astype(np.int32), "redundant": redundant[f]}
    columns |= {"g": pa.nulls(len(f), pa.int64()), "h": pa.nulls(len(f), pa.int32()), "repeated": np.ones(len(f), bool)}
    yield from record_batches(columns, _SPANS)


def _neighbours(passage: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Go through sorted suffixes, some anchors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < ROWS:
                continue
            table = pa.Table.from_batches(held)
            g, salt = table["g"].to_numpy(), table["salt"].to_numpy()
            others = np.flatnonzero((g != g[-1]) | (salt != salt[-1]))
            whole = int(others[-1]) + 1 if len(others) else 0
            if whole:
                yield from _compare(table.slice(0, whole), passage)
            held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield from _compare(pa.Table.from_batches(held), passage)

    return run


def _spans(docs: DataFrame, passage: int, anchor: int) -> DataFrame:
    """``id, th, start, stop, redundant``: repeated spans per anchor, in words, not yet merged."""
    keyed = docs.select(*document_key(), "text")
    found = keyed.mapInArrow(_anchors(passage, anchor), "id long, th long, g long")
    found = written(found, "anchors")
    seen = found.groupBy("g").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).where("least <> most")
    seen = written(seen.select("g", F.ceil(F.col("n") / HOT).cast("int").alias("parts")), "repeated")
    asked = found.join(seen.select("g"), "g").groupBy("id", "th").agg(F.collect_set("g").alias("gs"))
    suffixes = keyed.join(asked, ["id", "th"]).select("id", "th", "text", "gs").mapInArrow(
        _suffixes(passage, anchor), "id long, th long, g long, start int, windows array<int>"
    )
    suffixes = suffixes.join(small(checkpointed(seen.where("parts > 1"))), "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = suffixes.withColumn("salt", F.pmod(F.xxhash64("id", "th"), F.col("parts")).cast("int")).repartition("g", "salt").sortWithinPartitions("g", "salt")
    compared = dealt.select("id", "th", "g", "parts", "salt", "start", "windows").mapInArrow(_neighbours(passage), _SPANS_DDL)
    compared = written(compared, "compared")
    still_open = compared.where("g is not null")
    agree = still_open.groupBy("g", "h").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.max("repeated").alias("known"))
    hit = still_open.join(agree.where("least <> most or known"), ["g", "h"])
    columns = ["id", "th", "start", "stop"]
    return compared.where("g is null").select(*columns, "redundant").unionByName(hit.select(*columns, (F.col("id") != F.col("least")).alias("redundant")))


def _merged(spans: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping and touching spans of a document as one."""
    order = Window.partitionBy(*by).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    runs = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, start_word, end_word, n_words, redundant``: passages of ``passage`` words or more in two documents.

    ``redundant`` spans also stand in a document of a lower id; the others are where a passage is kept.
    Needs ``doc_id`` and ``text``.
    """
    spans = _merged(_spans(docs, passage, anchor), ["id", "th", "redundant"])
    return spans.select(
        outer_id().alias("doc_id"), F.col("start").cast("long").alias("start_word"), F.col("stop").cast("long").alias("end_word"),
        (F.col("stop") - F.col("start")).cast("long").alias("n_words"), "redundant",
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their spans, and how many words are left."""
    for batch in batches:
        for rows, data, offsets in text_slices(batch):
            words = Words(data, offsets)
            texts, left = [], []
            for r, spans in enumerate(rows.column(rows.schema.get_field_index("spans")).to_pylist()):
                first, end = int(words.first[r]), int(words.first[r + 1])
                keep, at, gone = [], int(offsets[r]), 0
                for span in sorted(spans or [], key=lambda s: s["start"]):
                    keep.append(data[at : words.starts[first + span["start"]]].tobytes())
                    at = int(words.ends[first + span["stop"] - 1])
                    gone += span["stop"] - span["start"]
                keep.append(data[at : offsets[r + 1]].tobytes())
                texts.append(b"".join(keep).decode())
                left.append(end - first - gone)
            old = rows.column(rows.schema.get_field_index("text"))
            new = pa.compute.if_else(pa.compute.is_null(old), pa.scalar(None, pa.string()), pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([rows.column(0), new, pa.array(left, pa.int64())], names=["row", "text", "left"])


def without_repeats(docs: DataFrame, passage: int = PASSAGE, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with redundant passages cut out of their texts, each left in the document of the lowest id.

    Documents that lose all their words go. All columns stay; ``n_chars``, where there is one, counts the new text.
    """
    spans = _merged(_spans(docs, passage, anchor).where("redundant"), ["id", "th"])
    gathered = spans.groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    keys = docs.select(whole_row(docs), *document_key(), F.col("text").cast("string").alias("text"))
    joined = keys.join(gathered, ["id", "th"], "left")
    cut = joined.select("row", "text", "spans").where("spans is not null").mapInArrow(_cut, StructType().add("row", docs.schema).add("text", StringType()).add("left", LongType()))
    whole = joined.where("spans is null").select("row", "text")
    both = whole.unionByName(cut.where("left > 0").select("row", "text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return both.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
