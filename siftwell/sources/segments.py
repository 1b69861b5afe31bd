"""Text, records, rows and units as segments.

Each source comes in two forms: a column (``array<string>`` of one document's segments,
for documents that are one row) and a DataFrame ``(keys..., unit_no, seg_no, text)``.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.cells import cell_to_str, join_cells
from siftwell.functions.paths import extension
from siftwell.functions.text import (
    lossy_utf8,
    non_blank,
    physical_lines,
    split_lines,
    stripped_lines,
    universal_newlines,
)
from siftwell.operators.ordinals import positions
from siftwell.session import spread

RECORDS_TYPE = T.StructType(
    [T.StructField("records", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]
)
EXTRACTED_TYPE = "array<struct<unit_no:int,text:string>>"


def text_of(df: DataFrame, name: str) -> Column:
    """A text column as it is, or a binary column decoded; newlines unified either way."""
    binary = isinstance(df.schema[name].dataType, T.BinaryType)
    return universal_newlines(lossy_utf8(F.col(name)) if binary else F.col(name))


def _exploded(df: DataFrame, keys: Sequence[str], segments: Column) -> DataFrame:
    return df.select(*keys, F.posexplode(segments).alias("seg_no", "text")).select(
        *keys, F.lit(0).alias("unit_no"), "seg_no", "text"
    )


def text_segments(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Physical lines of a text or binary column, newline kept."""
    texts = spread(df.select(*keys, text))
    return _exploded(texts, keys, physical_lines(text_of(texts, text)))


def _record_parser() -> Callable[[Column], Column]:
    """Parser of the documents that use quotes; null in, null out.

    A nested function travels to the workers by value, so the package need not be installed
    on them.
    """

    @F.pandas_udf(RECORDS_TYPE)
    def quoted_records(texts: pd.Series) -> pd.DataFrame:
        records, errors = [], []
        csv.field_size_limit(2**31 - 1)
        for text in texts:
            rows, error = None, None
            if text is not None:
                rows = []
                try:
                    for fields in csv.reader(io.StringIO(text)):
                        rows.append(" ".join(fields))
                except csv.Error as problem:
                    error = str(problem)
            records.append(rows)
            errors.append(error)
        return pd.DataFrame({"records": records, "error": errors})

    return quoted_records


def csv_records(text: Column) -> Column:
    """``struct<records, error>``: each record with its fields joined by one space.

    Without a quote character a record is a line and a comma a separator, which stays on
    the JVM. Only documents that hold a quote are handed to the record parser; the others
    travel to it as null. An error keeps the records before it.
    """
    quoted = text.contains('"')
    parsed = _record_parser()(F.when(quoted, text))
    plain = F.transform(split_lines(text), lambda line: F.replace(line, F.lit(","), F.lit(" ")))
    return F.when(quoted, parsed).otherwise(
        F.struct(plain.alias("records"), F.lit(None).cast("string").alias("error"))
    )


def csv_segments(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Records of a CSV text column, blank ones included so that a cap can count them.

    ``error`` says why a document ends early; one that has no record before its error is a
    row without ``seg_no``. The outer explode keeps the parser from running twice.
    """
    texts = spread(df.select(*keys, text))
    staged = texts.select(*keys, csv_records(text_of(texts, text)).alias("_r"))
    rows = staged.select(*keys, F.posexplode_outer("_r.records").alias("seg_no", "text"), F.col("_r.error").alias("error"))
    rows = rows.where(F.col("seg_no").isNotNull() | F.col("error").isNotNull())
    return rows.select(*keys, F.lit(0).alias("unit_no"), "seg_no", "text", "error")


def row_text(df: DataFrame, columns: Sequence[str], skip_empty: bool = False) -> Column:
    """One structured row as text: its non-null cells joined by a space."""
    return join_cells([cell_to_str(F.col(c), df.schema[c].dataType) for c in columns], skip_empty)


def row_has_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """Does any cell of a row print something? Decided on the cells, without joining them."""
    filled = F.lit(False)
    for name in columns:
        text = isinstance(df.schema[name].dataType, (T.StringType, T.VarcharType, T.CharType))
        shows = F.coalesce(non_blank(F.col(name)), F.lit(False)) if text else F.col(name).isNotNull()
        filled = filled | shows
    return filled


def row_segments(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], skip_empty: bool = False
) -> DataFrame:
    """``(keys..., text)``: one segment per non-blank row of any table."""
    return df.where(row_has_text(df, columns)).select(*keys, row_text(df, columns, skip_empty).alias("text"))


def ordered_parts(
    parts: Sequence[tuple[int, DataFrame]], keys: Sequence[str], order: str, text: str = "text"
) -> DataFrame:
    """Several segment tables per document, one after the other: all of rank 0, then rank 1, ...

    Adds ``position``. It is found per (document, part, range of the order column), so a
    document whose parts make up most of the table does not end up in one task.
    """
    ranked = None
    for rank, df in parts:
        one = df.select(*keys, F.lit(rank).alias("part_rank"), F.col(order).alias("ord"), F.col(text).alias("text"))
        ranked = one if ranked is None else ranked.unionByName(one)
    numbered = positions(ranked, keys, ["part_rank", "ord"])
    return numbered.select(*keys, "part_rank", "ord", "position", "text")


def unit_lines(df: DataFrame, keys: Sequence[str], unit: str, text: str = "text") -> DataFrame:
    """``(keys..., unit, lines)`` with the stripped, non-blank lines of each page or slide."""
    return df.select(*keys, unit, stripped_lines(F.col(text)).alias("lines"))


def unit_segments(df: DataFrame, keys: Sequence[str], unit: str, text: str = "text") -> DataFrame:
    """``(keys..., unit_no, seg_no, text)``; ``seg_no`` counts within the unit."""
    lines = F.posexplode(stripped_lines(F.col(text))).alias("seg_no", "text")
    return df.select(*keys, F.col(unit).alias("unit_no"), lines)


def stream_lines(content: Column, n_bytes: int | None = None) -> Column:
    """Stripped, non-blank lines of a binary stream, or of its first ``n_bytes``."""
    return stripped_lines(lossy_utf8(content if n_bytes is None else F.substring(content, 1, n_bytes)))


def utf16_carve(content: Column, n_bytes: int | None = None) -> Column:
    """Text from raw UTF-16LE units, or from the first ``n_bytes``: printable ones kept, CR as newline, the rest dropped."""

    @F.pandas_udf(T.StringType())
    def carve(contents: pd.Series) -> pd.Series:
        def units(data: bytes | None) -> str | None:
            if data is None:
                return None
            text = bytes(data[: len(data) // 2 * 2]).decode("utf-16-le", errors="replace")
            return "".join("\n" if ch == "\r" else ch for ch in text if ch == "\r" or (ch >= " " and ch != "\ufeff"))

        return contents.map(units)

    return carve(content if n_bytes is None else F.substring(content, 1, n_bytes))


Extractor = Callable[[str, bytes], Iterable[tuple[int, str]]]
# Characters of extracted text that a worker holds before it hands them on.
_EXTRACTED_CHARS = 16 << 20


def extract_segments(
    files: DataFrame, extractors: dict[str, Extractor], path: str = "path", content: str = "content"
) -> DataFrame:
    """Run user extractors by extension: ``(path, extracted, error)``.

    An extractor yields ``(unit_no, text)`` pairs for one file. A failure is recorded in
    ``error`` beside whatever the extractor had produced by then; no other file notices.
    """
    by_extension = {("." + e.lower().lstrip(".")): f for e, f in extractors.items()}
    schema = pa.schema([("path", pa.string()), ("extracted", pa.list_(pa.struct([("unit_no", pa.int32()), ("text", pa.string())]))), ("error", pa.string())])

    def extract(name: str, ext: str, data: bytes | None, failed: str | None) -> tuple[str, list[dict], str | None]:
        pieces: list[dict] = []
        if failed is not None or data is None:
            return name, pieces, failed
        try:
            for unit_no, text in by_extension[ext](name, data):
                pieces.append({"unit_no": int(unit_no), "text": text})
        except Exception as problem:
            failed = f"{type(problem).__name__}: {problem}"
        return name, pieces, failed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One file is turned into Python at a time, and what was extracted goes on after so many characters.
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                rows.append(extract(*(column[i].as_py() for column in batch.columns)))
                held += sum(len(piece["text"] or "") for piece in rows[-1][1])
                if held >= _EXTRACTED_CHARS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0

    failed = F.col("read_error") if "read_error" in files.columns else F.lit(None).cast("string")
    known = files.select(F.col(path).alias("path"), extension(F.col(path)).alias("ext"), F.col(content).alias("content"), failed.alias("failed"))
    return known.where(F.col("ext").isin(list(by_extension))).mapInArrow(
        run, f"path string, extracted {EXTRACTED_TYPE}, error string"
    )
