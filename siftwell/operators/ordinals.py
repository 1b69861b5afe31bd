"""Row numbers and running totals that do not put a group into one task.

``row_number() over (partition by key order by ord)`` sends all rows of a key to one task,
and without a key all rows of the table. Here the whole order (the keys, then the order
columns) is cut into ranges: rows are numbered inside ``(key, range)`` and a running total
over the few range counts of a key gives each range its offset. A key that holds a third of
the table, or an order column with one very common value, is spread over as many tasks as it
has ranges; a small group lies in one range.

It is one plan at all sizes, and nothing runs while it is made. The borders are quantiles of a
sample that the plan takes itself: the distinct places whose hash is below a bound, which is
set by the row count so that the sample has the same size for any table.
Which rows that are depends on their values alone, so every part of the plan, and a task that
is run again, sees the same borders; and any borders give the same numbers.

The input is read for its count, for the sample, for the totals and for the rows; all but the
last read the keys and the order only. It should be a table rather than the end of a long plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SAMPLE_PER_RANGE = 16
# Ranges per shuffle partition, so that partitions which get one more than others matter less.
_RANGES_PER_PARTITION = 2


def ranges_of(df: DataFrame) -> int:
    return _RANGES_PER_PARTITION * max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 4)


def beside(df: DataFrame, row: DataFrame, value: Column) -> DataFrame:
    """``df`` with the columns of a table of exactly one row, which is broadcast.

    ``value`` is any number of that row. Both keys are zero, but not constants, so this stays a hash join.
    A scalar subquery would do, but plans that nest several of them fail in Spark's optimizer.
    """
    one = F.broadcast(row.withColumn("_one", F.pmod(value.cast("bigint"), F.lit(1))))
    first = F.col("`" + df.columns[0].replace("`", "``") + "`")
    return df.withColumn("_one", F.pmod(F.xxhash64(first), F.lit(1))).join(one, "_one").drop("_one")


def range_borders(df: DataFrame, order: Sequence[str], ranges: int) -> DataFrame:
    """One row with ``borders``, the quantiles of the structs of ``order`` that cut ``df`` into ``ranges``."""
    place = F.struct(*order)
    share = F.shiftrightunsigned(F.xxhash64(place), 11) / F.lit(float(1 << 53))
    total = df.agg(F.count("*").alias("_total"))
    hashed = beside(df.select(place.alias("p"), share.alias("h")), total, F.col("_total"))
    sample = hashed.where(F.col("h") * F.col("_total") < float(ranges * _SAMPLE_PER_RANGE))
    sorted_set = sample.agg(F.sort_array(F.collect_set("p")).alias("s"))
    at = F.sequence(F.lit(1), F.lit(ranges - 1))
    picked = F.transform(at, lambda i: F.get(F.col("s"), F.floor(i * F.size("s") / F.lit(float(ranges))).cast("int")))
    return sorted_set.select(F.filter(picked, lambda b: b.isNotNull()).alias("borders"))


def _with_range(df: DataFrame, order: Sequence[str], ranges: int) -> DataFrame:
    """Add ``_range``: how many borders are not above the row's place, by bisection.

    A step is a projection of its own, so that each is computed once and all are compiled together.
    """
    rows = beside(df, range_borders(df, order, ranges).withColumnRenamed("borders", "_borders"), F.size("_borders"))
    rows = rows.withColumn("_place", F.struct(*order)).withColumn("_range", F.lit(0))
    for bit in range((ranges - 1).bit_length() - 1, -1, -1):
        above = F.get("_borders", F.col("_range") + ((1 << bit) - 1)) <= F.col("_place")
        rows = rows.withColumn("_range", F.when(above, F.col("_range") + (1 << bit)).otherwise(F.col("_range")))
    return rows.drop("_borders", "_place")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    weight: Column | None = None,
    out: str = "position",
    ranges: int | None = None,
    below: int | None = None,
) -> DataFrame:
    """Add ``out``: the total ``weight`` of the rows before this one in its group.

    With no weight it counts rows, so ``out`` is the 0-based position. Rows must be unique in
    ``keys + order`` for stable numbers. ``below`` keeps only rows whose total is under it; whole
    ranges beyond it are dropped before the rows are sorted.
    """
    value = F.lit(1).cast("bigint") if weight is None else F.coalesce(weight.cast("bigint"), F.lit(0).cast("bigint"))
    nothing = F.lit(0).cast("bigint")
    n = max(ranges or ranges_of(df), 2)
    whole = list(dict.fromkeys([*keys, *order]))
    # One struct for key and range: nulls in a key compare equal inside it, and the join and
    # the window below then ask for the same partitioning.
    rows = _with_range(df.withColumn("_w", value), whole, n).withColumn("_g", F.struct(*keys, "_range")).drop("_range")

    totals = rows.groupBy("_g").agg(F.sum("_w").alias("_sum"))
    before = W.partitionBy(*[F.col(f"_g.{k}") for k in keys]).orderBy(F.col("_g._range")).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_g", F.coalesce(F.sum("_sum").over(before), nothing).alias("_offset"))
    if below is not None:
        offsets = offsets.where(F.col("_offset") < below)

    inside = W.partitionBy("_g").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    numbered = (
        rows.join(offsets, "_g")
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum("_w").over(inside), nothing))
        .drop("_g", "_w", "_offset")
    )
    return numbered if below is None else numbered.where(F.col(out) < below)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "position", **how) -> DataFrame:
    """0-based position of each row in its group, or in the table when ``keys`` is empty."""
    return running_total(df, keys, order, None, out, **how)


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, out: str = "position") -> DataFrame:
    """The first ``n`` rows of each group with their 0-based position, for any ``n``."""
    return positions(df, keys, order, out, below=n)


def first_few(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, out: str = "position") -> DataFrame:
    """As :func:`first_n`, for an ``n`` that is a handful by what it means, like a match threshold.

    One pass: each map task keeps ``n`` rows a group before the shuffle, so a hot group reaches its
    task as a few rows per map task. It suits the end of a long plan, which is not run again.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    return kept.withColumn(out, (F.col("_rank") - 1).cast("bigint")).drop("_rank")
