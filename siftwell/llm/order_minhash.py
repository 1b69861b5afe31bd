"""Near-duplicate documents by Order MinHash.

The five-word shingles of a text are labelled with their occurrence number. Each of ``sketches`` hash functions picks
the ``sample`` lowest of them, and their hashes in the order of the text are the key of a bucket: a pair of texts meets
where it shares shingles in the same order, so the sketch follows edit similarity. Candidates are verified by a banded
alignment of their shingle sequences: with ``m`` aligned of ``a`` and ``b`` shingles, ``m / (a + b - m)`` must
reach ``similarity``.

Equal texts are one node. Buckets propose pairs in rounds: rows of a bucket that already share a class are not compared,
a pair counts in the first sketch where it meets, and every node proposes a bounded number of its best pairs by a 256-fold
MinHash estimate, sixteen times as many each round. The rounds end when no bucket has an untested pair of two classes left whose
estimate is ``SLACK`` or more (three standard deviations below the bound). So no link between classes is left out but by
that estimate.

Texts without words, null ones too, are classes of their own. Texts of fewer than five words are one shingle. A null id
is one document with the id null; rows that repeat id and text share their class. Empty tables give empty results;
other columns are ignored, and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import NARROW_BYTES, Words, checkpointed, document_key, gathered, mix, numbers, outer_id, record_batches, row_columns, signed, small, text_slices, whole_row, written
from siftwell.llm.components import components
from siftwell.llm.pairs import GROUP, blocked, pair_slices, whole_groups

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 16
SAMPLE = 3
ESTIMATORS = 256
SLACK = 0.72
# An estimate from which a pair is taken as one, to choose whom a node is compared with first.
LIKELY = 0.84
PROPOSALS = 4
ROWS = 8192
# Pairs that are compared at once.
PAIRS = 1 << 15
# Rows of one block of a bucket.
BLOCK = 2048
# Shingles expected below the threshold that preselects the lowest ones of a text.
PRESELECTED = 24.0


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _labelled(shingles: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Shingle hashes with their occurrence number within the row."""
    order = np.argsort(mix(shingles + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    again = (shingles[order][1:] == shingles[order][:-1]) & (row[order][1:] == row[order][:-1])
    if not again.any():
        return shingles
    at = np.arange(len(order))
    head = np.maximum.accumulate(np.where(np.concatenate([[True], ~again]), at, 0))
    number = np.empty(len(order), dtype=np.uint64)
    number[order] = at - head
    return np.where(number > 0, mix(shingles + number * np.uint64(0xC2B2AE3D27D4EB4F)), shingles)


def _keys(labelled: np.ndarray, borders: np.ndarray, sketches: int, sample: int, seed: int) -> np.ndarray:
    """Bucket keys, one column per hash function. Rows must have ``sample`` shingles at least."""
    counts = np.diff(borders)
    row = np.repeat(np.arange(len(counts)), counts)
    share = np.minimum(1.0, PRESELECTED / np.maximum(counts, 1))
    below = np.where(share >= 1, 2.0**64 - 2048, share * 2.0**64).astype(np.uint64)[row]
    keys = np.empty((len(counts), sketches), dtype=np.uint64)
    for j, factor in enumerate(_odd(sketches, seed)):
        h = labelled * factor
        at = np.flatnonzero(h <= below)
        got = np.bincount(row[at], minlength=len(counts))
        if (got < sample).any():
            at = np.union1d(at, np.flatnonzero((got < sample)[row]))
        at = at[np.lexsort((h[at], row[at]))]
        heads = np.searchsorted(row[at], np.arange(len(counts)))
        lowest = np.sort(at[heads[:, None] + np.arange(sample)], axis=1)
        key = np.full(len(counts), j + 1, dtype=np.uint64)
        for k in range(sample):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + labelled[lowest[:, k]])
        keys[:, j] = key
    return keys


_SKETCH = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("wh", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())])
_SKETCH_DDL = "id long, th long, wh long, n int, keys array<long>, sig binary"


def _sketch(shingle: int, sketches: int, sample: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    factors = (_odd(ESTIMATORS, seed + 1) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, size=NARROW_BYTES):
                words = Words(data, offsets)
                some = np.flatnonzero(np.diff(words.first) > 0)
                if not len(some):
                    continue
                shingles, borders = words.shingles(shingle)
                borders = np.append(borders[:-1][some], borders[-1])
                counts = np.diff(borders)
                whole = words.spans(words.first[:-1][some], words.first[1:][some])
                labelled = _labelled(shingles, np.repeat(np.arange(len(some)), counts))
                sig = np.empty((len(some), ESTIMATORS), dtype=np.uint8)
                short = (labelled >> np.uint64(32)).astype(np.uint32)
                for j, factor in enumerate(factors):
                    sig[:, j] = mix(np.minimum.reduceat(short * factor, borders[:-1]).astype(np.uint64)) & np.uint64(0xFF)
                # A text of fewer shingles than a sample has one key, all its words.
                enough = counts >= sample
                keys = np.repeat(whole[:, None], sketches, axis=1)
                if enough.any():
                    inside = np.repeat(enough, counts)
                    keys[enough] = _keys(labelled[inside], np.concatenate([[0], np.cumsum(counts[enough])]), sketches, sample, seed)
                lengths = np.where(enough, sketches, 1)
                flat = keys[np.arange(sketches) < lengths[:, None]]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(signed(flat)))
                columns = {
                    "id": numbers(rows, "id")[some], "th": numbers(rows, "th")[some], "wh": signed(whole), "n": counts.astype(np.int32),
                    "keys": lists, "sig": pa.array([s.tobytes() for s in sig], pa.binary()),
                }
                yield from record_batches(columns, _SKETCH)

    return run


def _propose(similarity: float, proposals: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Best untested pairs of different classes, a bounded number for each node and group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, GROUP, ROWS):
            sig = np.frombuffer(b"".join(frame["sig"]), dtype=np.uint8).reshape(len(frame), ESTIMATORS)
            keys, sketch = np.zeros((len(frame), frame["keys"].map(len).max()), dtype=np.int64), frame["j"].to_numpy()
            for r, own in enumerate(frame["keys"]):
                keys[r, : len(own)] = own
            node, label, n = frame["node"].to_numpy(), frame["class"].to_numpy(), frame["n"].to_numpy()
            tested = {(a, b) for a, others in zip(node, frame["tested"], strict=True) if others is not None for b in others}
            found = []
            for a, b in pair_slices(frame, PAIRS):
                fit = (label[a] != label[b]) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]))
                a, b = a[fit], b[fit]
                first = ~((keys[a] == keys[b]) & (np.arange(keys.shape[1]) < sketch[a][:, None])).any(axis=1)
                a, b = a[first], b[first]
                estimate = (sig[a] == sig[b]).mean(axis=1)
                near = estimate >= SLACK
                found.append((a[near].astype(np.int32), b[near].astype(np.int32), estimate[near].astype(np.float32)))
            if not found:
                continue
            a, b, estimate = (np.concatenate(x) for x in zip(*found, strict=True))
            if tested:
                fresh = np.array([(x, y) not in tested and (y, x) not in tested for x, y in zip(node[a], node[b], strict=True)], dtype=bool)
                a, b, estimate = a[fresh], b[fresh], estimate[fresh]
            # Seen from either end: first the likely partner of the lowest place, then those of the best estimate.
            own, other, estimate = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([estimate, estimate])
            order = np.lexsort((other, estimate < LIKELY, own))
            lead = order[np.concatenate([[True], own[order][1:] != own[order][:-1]])] if len(order) else order
            order = np.lexsort((-estimate, own))
            heads = np.searchsorted(own[order], own[order], side="left")
            best = order[np.arange(len(order)) - heads < proposals]
            chosen = np.union1d(lead, best)
            # A pair that both ends propose is proposed once.
            ends = np.stack([np.minimum(own[chosen], other[chosen]), np.maximum(own[chosen], other[chosen])])
            chosen = chosen[np.unique(ends, axis=1, return_index=True)[1]]
            x, y = node[own[chosen]], node[other[chosen]]
            yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def aligned(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the best alignment of two shingle sequences reaches ``similarity``.

    Aligned shingles ``m`` must reach ``similarity * (a + b) / (1 + similarity)``, which leaves a bounded number of
    others, so only places that far apart can be aligned. Inside that band a bit-parallel column update finds the
    longest common subsequence.
    """
    total = len(x) + len(y)
    need = int(np.ceil(similarity * total / (1 + similarity) - 1e-9))
    band = total - 2 * need
    if abs(len(x) - len(y)) > band:
        return False
    short = min(len(x), len(y))
    differs = np.flatnonzero(x[:short] != y[:short])
    head = int(differs[0]) if len(differs) else short
    rest = short - head
    differs = np.flatnonzero(x[len(x) - rest :] != y[len(y) - rest :])
    tail = rest - 1 - int(differs[-1]) if len(differs) else rest
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    at, to = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
    need -= head + tail
    if min(len(at), len(to)) < need:
        return False
    masks: dict[int, int] = {}
    for k, token in enumerate(x[at].tolist()):
        masks[token] = masks.get(token, 0) | (1 << k)
    low, high = np.searchsorted(at, to - band).tolist(), np.searchsorted(at, to + band, side="right").tolist()
    full = (1 << len(at)) - 1
    free = full
    for token, lo, hi in zip(y[to].tolist(), low, high, strict=True):
        match = masks[token] & (((1 << (hi - lo)) - 1) << lo)
        hit = free & match
        free = ((free + hit) | (free - hit)) & full
    return len(at) - free.bit_count() >= need


def _verify(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = [aligned(x[i].values.to_numpy(), y[i].values.to_numpy(), similarity) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "near"])

    return run


def _sequences(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("node", pa.int64()), ("x", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch, size=NARROW_BYTES):
                shingles, borders = Words(data, offsets).shingles(shingle)
                short = (shingles >> np.uint64(32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(short))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists], schema=schema)

    return run


def classes(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, sketches: int = SKETCHES, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """``id, th, class_id, class_th`` of each different document with words; the class is named by its least member."""
    keyed = docs.select(*document_key(), "text")
    sketched = written(keyed.mapInArrow(_sketch(shingle, sketches, sample, seed), _SKETCH_DDL), "sketches")
    nodes = sketched.groupBy("th", "wh").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig")
    ).withColumn("node", F.xxhash64("th", "wh"))
    nodes = written(nodes, "nodes")
    slots = nodes.select("node", F.posexplode("keys").alias("j", "key"))
    crowded = slots.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(slots.join(crowded, "key").select("key", "size", "j", "node"), "members")
    inside = gathered(members.select("node").distinct())
    facts = written(nodes.select("node", "n", "sig", "keys").join(inside, "node", "left_semi"), "facts")
    wanted = small(gathered(nodes.select("id", "th", "node").join(inside, "node", "left_semi")))
    texts = keyed.join(wanted, ["id", "th"]).dropDuplicates(["id", "th"]).select("node", "text")
    sequences = written(texts.mapInArrow(_sequences(shingle), "node long, x array<int>"), "sequences")

    tested = labels = None
    proposals = PROPOSALS
    while True:
        # Narrow rows first; estimates' hashes join what is left of the buckets.
        if labels is None:
            rows = members.withColumn("class", F.col("node")).withColumn("tested", F.array().cast("array<long>"))
        else:
            partners = tested.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("tested"))
            state = inside.join(labels, "node", "left").join(partners, "node", "left")
            state = state.select("node", F.coalesce("component", "node").alias("class"), "tested")
            rows = members.join(small(gathered(state)), "node")
            open_keys = rows.groupBy("key").agg(F.min("class").alias("l"), F.max("class").alias("m")).where("l <> m").select("key")
            rows = rows.join(small(gathered(open_keys)), "key", "left_semi")
        rows = blocked(rows, F.col("size"), across=labels is not None, block=BLOCK).join(facts, "node")
        sorted_rows = rows.select(*GROUP, "block", "node", "class", "n", "sig", "tested", "j", "keys").repartition(*GROUP).sortWithinPartitions(*GROUP, "node")
        proposed = gathered(sorted_rows.mapInPandas(_propose(similarity, proposals), "a long, b long").distinct())
        if proposed.isEmpty():
            if labels is not None or members.where(F.col("size") > BLOCK).isEmpty():
                break
            tested, labels = proposed, inside.select("node", F.col("node").alias("component"))
            continue
        left, right = sequences.select(F.col("node").alias("a"), "x"), sequences.select(F.col("node").alias("b"), F.col("x").alias("y"))
        checked = proposed.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify(similarity), "a long, b long, near boolean")
        near = gathered(checked.where("near").select("a", "b"))
        tested = proposed if tested is None else tested.unionByName(proposed)
        if labels is None:
            labels = gathered(components(near))
        else:
            # Later links join classes, not documents.
            old = labels.select("node", "component")
            ends = near.join(old.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
            ends = ends.join(old.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
            joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
            renamed = joined.select(F.col("node").alias("class"), F.col("component").alias("to"))
            every = inside.join(old, "node", "left").select("node", F.coalesce("component", "node").alias("class"))
            labels = gathered(every.join(renamed, "class", "left").select("node", F.coalesce("to", "class").alias("component")))
        proposals *= 16

    named = nodes.select("node", "id", "th", "wh")
    if labels is None:
        named = named.withColumn("component", F.col("node"))
    else:
        named = named.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min(F.struct("id", "th")).alias("least"))
    of_text = named.join(least, "component").select("th", "wh", F.col("least.id").alias("class_id"), F.col("least.th").alias("class_th"))
    return sketched.select("id", "th", "wh").distinct().join(of_text, ["th", "wh"]).drop("wh")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, class_id, kept`` of each row: its class is named by the least id, which is the one kept."""
    found = classes(docs, **options)
    rows = docs.select(*document_key()).join(found, ["id", "th"], "left")
    own = F.coalesce("class_id", "id")
    return rows.select(outer_id().alias("doc_id"), F.when(own != -(2**63), own).alias("class_id"), (own == F.col("id")).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class, all columns as they are; of repeated rows one stays."""
    found = classes(docs, **options)
    gone = checkpointed(found.where("id <> class_id or th <> class_th").select(F.col("id").alias("__id"), F.col("th").alias("__th")))
    own_id, own_th = document_key()
    marked = docs.select(whole_row(docs), own_id.alias("__id"), own_th.alias("__th"))
    left = marked.join(small(gone), ["__id", "__th"], "left_anti")
    kept = left.select("row", "__id", "__th")
    repeated = kept.groupBy("__id", "__th").count().where("count > 1").select("__id", "__th")
    repeated = checkpointed(repeated)
    if repeated.isEmpty():
        rows = kept
    else:
        once = kept.join(small(repeated), ["__id", "__th"]).dropDuplicates(["__id", "__th"])
        rows = kept.join(small(repeated), ["__id", "__th"], "left_anti").unionByName(once.select("row", "__id", "__th"))
    return rows.select(*row_columns(docs))
