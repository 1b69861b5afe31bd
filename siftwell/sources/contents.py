"""Contents of the files a catalog table names, each opened by the task that needs it.

The catalog drives the read: nothing is listed, and no path reaches the driver. Files larger
than a piece are cut into byte ranges. A prefix sum over the pieces, in path order, gives every
task the same share of bytes (a small file counts as ``OPEN_BYTES``, since opening costs too),
and a task opens the files of its own pieces and no others.

Tasks open paths with Arrow's file systems (local, ``s3``, ``gs``, ``hdfs``, ``abfs``). For a store
that only Spark reaches, ``contents_below`` reads whole roots with the file source instead; that
is for the caller to say, not decided by sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.ordinals import beside, running_total
from siftwell.session import checkpointed

Opener = Callable[[str], BinaryIO]
# Bytes of a byte range, and what a file counts for at least when tasks are balanced.
PIECE_BYTES = 64 << 20
OPEN_BYTES = 64 << 10
# Bytes that a worker holds before it hands them on.
BATCH_BYTES = 32 << 20

_READ = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("content", pa.binary()), ("read_error", pa.string())])
_READ_DDL = "path string, offset bigint, content binary, read_error string"
CONTENT_DDL = "path string, content binary, read_error string"


def open_path(path: str) -> BinaryIO:
    """A file by the path Spark lists it under."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/") if scheme == "file" else path)
    scheme = "s3" if scheme in ("s3a", "s3n") else scheme
    system, inner = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    return system.open_input_file(inner)


def assigned_pieces(wanted: DataFrame, tasks: int, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``path, size_bytes, offset, task`` for each byte range of ``wanted (path, size_bytes)``.

    Tasks are numbered from 0; the pieces of one are neighbours in path order and have about the
    same bytes as those of any other. A path that is named twice is read once.
    """
    files = wanted.groupBy("path").agg(F.max("size_bytes").alias("size_bytes"))
    last = F.greatest(F.col("size_bytes") - 1, F.lit(0))
    starts = F.sequence(F.lit(0).cast("bigint"), F.coalesce(last, F.lit(0)).cast("bigint"), F.lit(piece_bytes).cast("bigint"))
    pieces = files.select("path", "size_bytes", F.explode(starts).alias("offset"))
    held = F.least(F.coalesce("size_bytes", F.lit(0)) - F.col("offset"), F.lit(piece_bytes))
    costs = pieces.withColumn("cost", F.greatest(held, F.lit(OPEN_BYTES)).cast("bigint"))
    placed = running_total(costs, [], ["path", "offset"], weight=F.col("cost"), out="before")
    placed = beside(placed, costs.agg(F.sum("cost").alias("whole")), F.coalesce("whole", F.lit(0)))
    task = F.floor(F.col("before") / F.col("whole") * F.lit(float(tasks)))
    return placed.select("path", "size_bytes", "offset", F.least(task, F.lit(tasks - 1)).cast("int").alias("task"))


def _reader(opener: Opener, piece_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = error = None
                try:
                    with opener(path) as file:
                        file.seek(offset)
                        content = file.read(piece_bytes)
                except Exception as problem:
                    error = f"{type(problem).__name__}: {problem}"
                rows.append((path, offset, content, error))
                held += len(content or b"")
                if held >= BATCH_BYTES:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)

    return run


def read_contents(
    wanted: DataFrame, tasks: int | None = None, piece_bytes: int = PIECE_BYTES, opener: Opener = open_path
) -> DataFrame:
    """``(path, content, read_error)`` of the files of ``wanted (path, size_bytes)``.

    ``tasks`` is how many tasks share the bytes, by default the number of shuffle partitions. A
    file that cannot be read has no content and says why; the others don't notice. Files of one
    piece go straight through; the pieces of a larger one meet once, in order.
    """
    spark = wanted.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    # Who reads what is settled once; two reads follow, of small files and of the pieces of large ones.
    pieces = checkpointed(assigned_pieces(wanted, tasks, piece_bytes))
    large = F.coalesce(F.col("size_bytes") > piece_bytes, F.lit(False))

    def read(mine: DataFrame) -> DataFrame:
        dealt = mine.repartitionById(tasks, F.col("task")).sortWithinPartitions("path", "offset")
        return dealt.select("path", "offset").mapInArrow(_reader(opener, piece_bytes), _READ_DDL)

    small = read(pieces.where(~large)).select("path", "content", "read_error")
    parts = F.array_sort(F.collect_list(F.struct("offset", "content")))
    joined = read(pieces.where(large)).groupBy("path").agg(parts.alias("parts"), F.min("read_error").alias("read_error"))
    glued = F.aggregate("parts", F.lit("").cast("binary"), lambda whole, part: F.concat(whole, part["content"]))
    return small.unionByName(joined.select("path", F.when(F.col("read_error").isNull(), glued).alias("content"), "read_error"))


def contents_below(spark: SparkSession, roots: Sequence[str], wanted: DataFrame) -> DataFrame:
    """As :func:`read_contents` for stores that only Spark opens: the file source reads all below the roots.

    The source cannot skip a file by a join, so this suits scans that want most of what is there.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots)).select("path", "content")
    kept = files.join(wanted.select("path").dropDuplicates(), "path", "left_semi")
    return kept.withColumn("read_error", F.lit(None).cast("string"))
