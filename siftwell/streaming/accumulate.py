"""Per-document counts carried between pieces of text that arrive over time."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftwell.functions import matching as m
from siftwell.functions.rules import RuleSet

# Counts so far, whether they are final, the next piece to take, and pieces that came too early: number and hits.
STATE = "counts array<bigint>, settled boolean, next bigint, early array<struct<chunk_no:bigint,codes:array<int>>>"


def accumulate_stream(
    pieces: DataFrame, key: str, rules: RuleSet, threshold: int, any_order: bool = False, waits_ms: int | None = None
) -> DataFrame:
    """``(key, rule_idx, match_count, is_sensitive)`` updates from ``(key, chunk_no, text)`` pieces.

    Matching happens before the shuffle and each piece sends on only the hits up to its own
    stopping point. The state of a document is one counter per rule; once a rule reaches
    the threshold it is frozen. Inside a micro-batch the hits are taken in ``(chunk_no, pos)``
    order, keeping no more than ``threshold`` per rule in memory; across micro-batches
    pieces must arrive in order.

    With ``any_order`` they need not: the pieces of a document are numbered from 0 without gaps, and
    a piece is held back, as its hits up to its own stopping point, until those before it are
    there. With ``waits_ms``, too, what is held is taken as it is when nothing new has come for so
    long; that is for streams that keep running, since one that stops when all is read
    (``availableNow``) would wait for its time-outs for ever.
    """
    need, k = max(threshold, 1), len(rules)
    coded = pieces.select(key, "chunk_no", m.fused_codes(F.col("text"), rules).alias("_codes"))
    found = m.early_stop(F.col("_codes"), k, need)
    length = F.aggregate(found, F.lit(0).cast("bigint"), lambda a, f: a + f["match_count"])
    short = coded.select(key, "chunk_no", F.slice("_codes", F.lit(1), length.cast("int")).alias("codes"))
    key_type = pieces.schema[key].dataType.simpleString()

    def result(group: tuple, counts: list[int], settled: bool) -> pd.DataFrame:
        hit = [i for i in range(k) if counts[i]]
        return pd.DataFrame(
            {
                key: [group[0]] * len(hit),
                "rule_idx": hit,
                "match_count": [counts[i] for i in hit],
                "is_sensitive": [settled] * len(hit),
            }
        )

    def in_order(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts, settled, following, early = [0] * k, False, 0, {}
        if state.exists:
            kept_counts, settled, following, kept = state.get
            counts, early = list(kept_counts), {int(n): [int(c) for c in codes] for n, codes in kept}
        if not state.hasTimedOut:
            for batch in batches:
                if not settled:
                    early |= {int(n): [int(c) for c in codes] for n, codes in zip(batch["chunk_no"], batch["codes"], strict=True) if n >= following}
        while early and not settled and (following in early or state.hasTimedOut):
            following = following if following in early else min(early)
            for code in early.pop(following):
                counts[code] += 1
                settled = counts[code] >= need
                if settled:
                    break
            following += 1
        state.update((counts, settled, following, [] if settled else sorted(early.items())))
        if early and not settled and waits_ms is not None:
            state.setTimeoutDuration(waits_ms)
        yield result(group, counts, settled)

    def absorb(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts, settled = (list(state.get[0]), state.get[1]) if state.exists else ([0] * k, False)
        nearest: list[list[tuple[int, int]]] = [[] for _ in range(k)]
        for batch in batches:
            if settled:
                continue
            fresh: list[list[tuple[int, int]]] = [[] for _ in range(k)]
            for chunk_no, codes in zip(batch["chunk_no"], batch["codes"]):
                for pos, code in enumerate(codes):
                    fresh[code].append((int(chunk_no), pos))
            for i in range(k):
                nearest[i] = heapq.nsmallest(need - counts[i], nearest[i] + fresh[i])
        for _, _, i in sorted((c, p, i) for i in range(k) for c, p in nearest[i]):
            if settled:
                break
            counts[i] += 1
            settled = counts[i] >= need
        state.update((counts, settled, 0, []))
        yield result(group, counts, settled)

    return short.groupBy(key).applyInPandasWithState(
        in_order if any_order else absorb,
        f"{key} {key_type}, rule_idx int, match_count bigint, is_sensitive boolean",
        STATE,
        "update",
        GroupStateTimeout.NoTimeout if waits_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )
