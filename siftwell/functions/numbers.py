"""Small numeric and date scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES_PER_MB = 1024 * 1024


def size_mb(size_bytes: Column) -> Column:
    return size_bytes / F.lit(float(BYTES_PER_MB))


def size_ok(size_bytes: Column, max_bytes: int) -> Column:
    """Discovery keeps a file whose size is unknown; only a known excess drops it."""
    return size_bytes.isNull() | (size_bytes <= max_bytes)


def percent_done(done: Column, total: Column) -> Column:
    """Whole percent, rounded down."""
    return ((done * 100 - (done * 100) % total) / total).cast("bigint")


def batch_count(total: Column, batch_size: int) -> Column:
    return F.ceil(total / F.lit(float(batch_size)))


def day_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def second_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")
