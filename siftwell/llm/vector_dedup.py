"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and quantised; ``bits`` such numbers are the key of
one table, and vectors that share a key in any of ``tables`` tables are compared by exact cosine in double precision.
Equal vectors are compared once and count as often as they occur. A pair is counted in the first table where it
meets, so no list of pairs is ever made: tasks return counts per vector and a spanning set of links.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of different
lengths with each other. A null id is kept; rows that repeat an id are vectors of their own that share its component.
Empty tables give empty results; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import checkpointed, written
from siftwell.llm.components import components
from siftwell.llm.pairs import FEW, GROUP, blocked, whole_groups

TABLES = 72
BITS = 18
WIDTH = 2.0
COSINE = 0.95
# Rows a task compares at a time; a group, two blocks at most, stays whole.
ROWS = 8192


def _normalised(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(tables: int, bits: int, width: float, seed: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for frame in frames:
            for size, part in frame.groupby(frame["v"].map(len)):
                if size not in drawn:
                    rng = np.random.default_rng([seed, size])
                    drawn[size] = rng.normal(size=(size, tables * bits)), rng.uniform(0, width, tables * bits)
                directions, shifts = drawn[size]
                cells = np.floor((_normalised(list(part["v"])) @ directions + shifts) / width).astype(np.int64)
                weights = np.random.default_rng(seed + 1).integers(-(2**62), 2**62, bits) | 1
                keys = ((cells.reshape(len(part), tables, bits) * weights).sum(axis=2) * 31 + size) >> 32
                yield pd.DataFrame({"node": part["node"], "n": part["n"], "v": part["v"], "keys": list(keys.astype(np.int32))})

    return run


def _pairs(frame: pd.DataFrame, vectors: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a group that are near each other; within one block, or across the two blocks of the group."""
    group = frame["group"].to_numpy()
    block = frame["block"].to_numpy()
    one = frame["low"].to_numpy() == frame["high"].to_numpy()
    sizes = np.bincount(group)
    few = sizes[group] <= FEW
    found = []
    for step in range(1, FEW):
        a = np.flatnonzero((group[step:] == group[:-step]) & few[:-step] & (one[:-step] | (block[step:] != block[:-step])))
        if not len(a):
            if step >= sizes[sizes <= FEW].max(initial=0):
                break
            continue
        near = np.einsum("ij,ij->i", vectors[a], vectors[a + step]) >= cosine
        found.append((a[near], a[near] + step))
    for g in np.flatnonzero(sizes > FEW):
        at = np.flatnonzero(group == g)
        left = at[block[at] == block[at].min()]
        right = left if one[at[0]] else at[block[at] != block[at].min()]
        i, j = np.nonzero(vectors[left] @ vectors[right].T >= cosine - 1e-9)
        a, b = left[i], right[j]
        if one[at[0]]:
            a, b = a[i < j], b[i < j]
        exact = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= cosine
        found.append((a[exact], b[exact]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least row that each row reaches over the pairs."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, before[a])
        least = least[least]
        if (least == before).all():
            return least


def _compared(frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Counts per node and spanning links of some whole groups."""
    keys, tables = np.array(frame["keys"].tolist()), frame["t"].to_numpy()
    outs = []
    size = frame["v"].map(len).to_numpy()
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        i, j = _pairs(frame.iloc[rows], _normalised(frame["v"].iloc[rows].tolist()), cosine)
        a, b = np.concatenate([a, rows[i]]), np.concatenate([b, rows[j]])
    for at in range(0, len(a), 1 << 18):
        i, j = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
        earlier = (keys[i] == keys[j]) & (np.arange(keys.shape[1]) < tables[i][:, None])
        first = ~earlier.any(axis=1)
        outs.append((i[first], j[first]))
    i, j = (np.concatenate([o[k] for o in outs]) if outs else np.zeros(0, np.int64) for k in (0, 1))
    node, n = frame["node"].to_numpy(), frame["n"].to_numpy()
    links = np.zeros(len(node), dtype=np.int64)
    np.add.at(links, i, n[j])
    np.add.at(links, j, n[i])
    some = links > 0
    return pd.DataFrame({"node": node[some], "links": links[some], "other": node[_spanning(i, j, len(node))][some]})


def _links(cosine: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Compare the groups of a sorted partition, some thousand rows of whole groups at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["t", *GROUP], ROWS):
            yield _compared(frame.reset_index(drop=True), cosine)

    return run


def linked(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, bits: int = BITS, width: float = WIDTH, seed: int = 7) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vectors (vec_id, embedding)``.

    ``n_links`` counts the other rows with a cosine of ``cosine`` or more that share a key in any table.
    """
    v = F.col("embedding")
    kind = vectors.schema["embedding"].dataType.simpleString()
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    scaled = F.when(usable, F.transform(v, lambda x: F.when(x == 0, F.lit(0).cast(kind[6:-1])).otherwise(x)))
    rows = vectors.select(F.col("vec_id").cast("long"), scaled.alias("v"))
    rows = rows.withColumn("same", F.md5(F.to_json(F.struct("v")).cast("binary")))
    own = F.coalesce("vec_id", F.lit(2**63 - 1))
    distinct = rows.where("v is not null").groupBy("same").agg(F.min(own).alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    distinct = distinct.select("same", "least", "n", "v", F.xxhash64("same").alias("node"))
    keyed = distinct.select("node", "n", "v").mapInPandas(_keys(tables, bits, width, seed), f"node long, n long, v {kind}, keys array<int>")
    keyed = written(keyed, "vectors")
    slots = keyed.select("node", F.posexplode("keys").alias("t", "key"))
    crowded = slots.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = slots.join(crowded, ["t", "key"])
    members = blocked(members, F.col("size")).select("node", "t", "block", *GROUP)
    blocks = members.join(keyed, "node").repartition("t", *GROUP).sortWithinPartitions("t", *GROUP)
    found = checkpointed(blocks.mapInPandas(_links(cosine), "node long, links long, other long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = distinct.select("same", "node", "n", "least").join(counts, "node", "left").join(joined, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "component").select("same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    full = rows.join(classes, "same", "left")
    shown = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.nullif("component_id", F.lit(2**63 - 1)))
    return full.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), shown.alias("component_id"),
        F.col("vec_id").eqNullSafe(shown).alias("kept"),
    )
