"""Helpers the operators share: shared storage, in-row bindings, and word hashes computed on Arrow buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
# Python workers take rows in slices of about this many bytes of text, whatever the size of an Arrow batch.
SLICE_BYTES = 1 << 21
# Slices of steps that hold many numbers for each byte.
NARROW_BYTES = 1 << 19
# An Arrow batch is held whole by the executor and by the Python worker. Spark's own bounds, 10,000 rows and 64 MB, leave it to
# each of them to hold that for every task.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"
# Tables up to this many rows of a few numbers each may be broadcast; their rows are counted first.
BROADCAST_ROWS = 500_000
# Rows of a few numbers each that one task takes of a table cut to its size.
TASK_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only a local session gets a scratch folder instead."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="siftwell-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return context.getCheckpointDir() if not spark.conf.get("spark.checkpoint.dir", None) else folder


@contextmanager
def narrow_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside has Arrow batches of about ``BATCH_BYTES``, unless the session sets a bound itself."""
    if spark.conf.get(BATCH_SETTING, None) is not None:
        yield
        return
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with narrow_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as compressed Parquet into the shared folder and read again.

    What later stages read no longer depends on how a shuffle happened to order rows, nor on live executors.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/siftwell-{name}-{uuid.uuid4().hex}"
    with narrow_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """``df``, a few numbers a row, checkpointed; later stages read it in tasks of some ``TASK_ROWS`` rows, not in many tiny ones."""
    df = checkpointed(df)
    return df.coalesce(1 + df.count() // TASK_ROWS)


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint for a counted, written table of few rows; the table as it is beyond the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for the row, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def document_key() -> list[Column]:
    """Inner key of a document: its id (null: the lowest long) and a hash of its text."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull()).alias("th"),
    ]


def outer_id(column: str = "id") -> Column:
    """The document id behind an inner id."""
    return F.when(F.col(column) != -(2**63), F.col(column))


def whole_row(df: DataFrame) -> Column:
    """The row as one column ``row``, whatever its columns are called."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")


def row_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` out of ``row``."""
    return [F.col("row").getField(c).alias(c) for c in df.columns]


# --- word hashes --------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[base] = have
    return have[:n]


def _span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of ``values[start:end]`` that do not depend on where a span lies."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _power(base, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(pow(base, -1, 1 << 64), n + 1)[starts])


def byte_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans ``[start, end)``."""
    values = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    return _span_sums(values, starts, ends, _BYTE_BASE)


class Words:
    """Hashes of the words of some rows. Words of row ``r`` are ``first[r]:first[r + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        inside = ~_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        lasts = inside.copy()
        lasts[:-1] &= ~inside[1:]
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        begins[filled] = inside[filled]
        before = filled[filled > 0] - 1
        lasts[before] = inside[before]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(lasts) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._data = data
        self._sums: np.ndarray | None = None

    @cached_property
    def hashes(self) -> np.ndarray:
        return byte_spans(self._data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the word spans ``[start, end)``."""
        n = len(self.hashes)
        if self._sums is None:
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.hashes * _power(_WORD_BASE, n), out=self._sums[1:])
        back = _power(pow(_WORD_BASE, -1, 1 << 64), n + 1)
        return mix((self._sums[ends] - self._sums[starts]) * back[starts])

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``size``-word shingles, row by row, and where each row's begin (rows + 1 borders).

        A row of fewer words, one at least, has one shingle: all its words.
        """
        counts = np.diff(self.first)
        per_row = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        borders = np.zeros(len(counts) + 1, dtype=np.int64)
        np.cumsum(per_row, out=borders[1:])
        starts = np.arange(borders[-1]) + np.repeat(self.first[:-1] - borders[:-1], per_row)
        ends = np.minimum(starts + size, np.repeat(self.first[1:], per_row))
        return self.spans(starts, ends), borders


class Spans:
    """Hashes of spans of one sequence of hashes, each computed from prefix sums."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * _power(_WORD_BASE, n), out=self._sums[1:])
        self._back = _power(pow(_WORD_BASE, -1, 1 << 64), n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._back[starts])


def text_slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch in slices of about ``size`` bytes of text: the rows, their UTF-8 bytes, and offsets into them.

    Null texts are empty. A longer text is a slice of its own.
    """
    column = batch.column(batch.schema.get_field_index(text))
    wide = pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        to = min(max(to, row + 1), len(column))
        yield batch.slice(row, to - row), data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def record_batches(columns: dict[str, object], schema: pa.Schema, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Columns as Arrow batches of bounded length."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type) for n, c in columns.items()]
    n = len(arrays[0])
    for at in range(0, n, rows):
        yield pa.RecordBatch.from_arrays([a.slice(at, rows) for a in arrays], schema=schema)


