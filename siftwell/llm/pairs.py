"""Pairs of rows inside sorted groups, some thousand rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one block of a group. Larger groups are split, and all pairs of their blocks go to tasks of their own.
BLOCK = 512
GROUP = ["key", "low", "high"]
FEW = 32


def blocked(members: DataFrame, size: Column, across: bool = True, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """Add ``block, low, high``: a row goes to every pair of blocks that its own is part of (or to its own only)."""
    parts = F.ceil(size / block).cast("int")
    rows = members.withColumn("block", F.pmod(F.xxhash64("node", F.lit(seed)), parts).cast("int"))
    if not across:
        return rows.withColumn("low", F.col("block")).withColumn("high", F.col("block"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with")).drop("with")


def whole_groups(frames: Iterator[pd.DataFrame], names: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Sorted rows in frames of about ``rows`` rows that never part a group; ``group`` numbers the groups of a frame."""
    held: list[pd.DataFrame] = []

    def grouped() -> tuple[pd.DataFrame, int]:
        frame = pd.concat(held, ignore_index=True)
        marks = frame[names].to_numpy()
        frame["group"] = np.concatenate([[0], np.cumsum((marks[1:] != marks[:-1]).any(axis=1))])
        return frame, int(np.searchsorted(frame["group"], frame["group"].iloc[-1]))

    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        if sum(map(len, held)) >= rows:
            whole, last = grouped()
            if last:
                yield whole.iloc[:last]
            held = [whole.iloc[last:].drop(columns="group")]
    if held:
        yield grouped()[0]


def pair_slices(frame: pd.DataFrame, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs within each group (of one block, or across its two), at most about ``most`` at once."""
    group, block = frame["group"].to_numpy(), frame["block"].to_numpy()
    one = frame["low"].to_numpy() == frame["high"].to_numpy()
    sizes = np.bincount(group)
    few = sizes[group] <= FEW
    for step in range(1, min(FEW, int(sizes[sizes <= FEW].max(initial=0)))):
        a = np.flatnonzero((group[step:] == group[:-step]) & few[:-step] & (one[:-step] | (block[step:] != block[:-step])))
        yield a, a + step
    for g in np.flatnonzero(sizes > FEW):
        rows = np.flatnonzero(group == g)
        left = rows[block[rows] == block[rows].min()]
        right = left if one[rows[0]] else rows[block[rows] != block[rows].min()]
        chunk = max(1, most // max(len(right), 1))
        for at in range(0, len(left), chunk):
            a = np.repeat(left[at : at + chunk], len(right))
            b = np.tile(right, len(left[at : at + chunk]))
            if one[rows[0]]:
                a, b = a[a < b], b[a < b]
            yield a, b
