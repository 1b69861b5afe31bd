"""Scans: from texts, rows, units or files to verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import matching as m
from siftwell.functions.chunks import chunk_array, unit_chunk_array
from siftwell.functions.numbers import size_mb
from siftwell.functions.rules import RuleSet
from siftwell.functions.text import head_lines, lossy_utf8, non_blank, physical_lines, universal_newlines
from siftwell.operators.catalog import skip_scanned
from siftwell.operators.chunking import chunk_lines, chunk_units
from siftwell.operators.matching import FUSED, findings, pick_mode, row_findings
from siftwell.operators.ordinals import first_n, positions
from siftwell.operators.verdicts import classify, row_verdicts, verdicts
from siftwell.session import checkpointed, spread
from siftwell.sources.catalog import catalog_scan
from siftwell.sources.contents import contents_below, read_contents
from siftwell.sources.profiles import SUPPORTED_EXTENSIONS, with_profile
from siftwell.sources.segments import Extractor, csv_records, extract_segments, row_segments, text_of, unit_lines
from siftwell.sources.settings import Settings

# Fixed value: lines per match call of plain text.
TEXT_CHUNK_LINES = 500


def scan_text(
    df: DataFrame, keys: Sequence[str], rules: RuleSet, threshold: int, text: str = "text", mode: str = FUSED
) -> DataFrame:
    """Verdicts over whole texts, no caps and no chunks. One narrow stage."""
    found = row_findings(df, keys, rules, threshold, mode, text)
    return row_verdicts(found, keys, rules, threshold)


def with_verdicts(
    df: DataFrame, rules: RuleSet, threshold: int, text: str = "text", mode: str = FUSED
) -> DataFrame:
    """All columns of ``df`` plus ``is_sensitive`` and ``details``, added in place without a join."""
    columns = list(df.columns)
    others = [c for c in columns if c != text]
    found = row_findings(df, [*others, text], rules, threshold, mode, text)
    return row_verdicts(found, [*others, text], rules, threshold).select(*columns, "is_sensitive", "details")


def text_chunks(df: DataFrame, keys: Sequence[str], lines_per_chunk: int, cap: int | None, text: str) -> DataFrame:
    """``(keys..., chunks)`` of plain text: physical lines, capped, cut and glued back."""
    texts = spread(df.select(*keys, text))
    lines = head_lines(physical_lines(text_of(texts, text)), cap)
    staged = texts.select(*keys, lines.alias("_lines"))
    return staged.select(*keys, chunk_array(F.col("_lines"), lines_per_chunk, "").alias("chunks"))


def scan_chunked(
    df: DataFrame,
    keys: Sequence[str],
    rules: RuleSet,
    threshold: int,
    lines_per_chunk: int = TEXT_CHUNK_LINES,
    cap: int | None = None,
    text: str = "text",
    mode: str = FUSED,
) -> DataFrame:
    """Verdicts over plain text read chunk by chunk. One narrow stage."""
    chunks = text_chunks(df, keys, lines_per_chunk, cap, text)
    found = row_findings(chunks, keys, rules, threshold, mode, chunks="chunks")
    return row_verdicts(found, keys, rules, threshold)


def chunk_findings(
    chunks: DataFrame, keys: Sequence[str], rules: RuleSet, threshold: int, mode: str = FUSED
) -> DataFrame:
    """Early-stopped findings for ``(keys..., chunk_no, text)`` with many chunks per document.

    Inside a chunk nothing after the chunk's own stopping point can count, so only the hits
    before it leave the row.
    """
    need = max(threshold, 1)
    if pick_mode(rules, mode) == FUSED:
        staged = spread(chunks.select(*keys, "chunk_no", "text")).select(*keys, "chunk_no", m.fused_codes(F.col("text"), rules).alias("_codes"))
        kept = staged.select(*keys, "chunk_no", "_codes", m.early_stop(F.col("_codes"), len(rules), need).alias("_f"))
        length = F.aggregate("_f", F.lit(0).cast("bigint"), lambda a, f: a + f["match_count"])
        hits = kept.select(
            *keys,
            "chunk_no",
            F.posexplode(F.slice("_codes", F.lit(1), length.cast("int"))).alias("pos", "rule_idx"),
        )
        return findings(hits, keys, rules, need)
    counts = m.independent_counts(F.col("text"), rules)
    counted = spread(chunks.select(*keys, "chunk_no", "text")).select(
        *keys, "chunk_no", F.posexplode(counts).alias("rule_idx", "n")
    )
    numbers = F.sequence(F.lit(1), F.least(F.col("n"), F.lit(need)).cast("int"))
    hits = counted.where("n > 0").select(*keys, "chunk_no", "rule_idx", F.explode(numbers).alias("pos"))
    return findings(hits, keys, rules, need, order=("chunk_no", "rule_idx", "pos"))


def scan_units(
    df: DataFrame,
    keys: Sequence[str],
    unit: str,
    rules: RuleSet,
    threshold: int,
    lines_per_chunk: int = 5,
    cap: int | None = None,
    text: str = "text",
    mode: str = FUSED,
) -> DataFrame:
    """Verdicts over documents whose pages, slides or turns are rows of their own."""
    chunks = chunk_units(unit_lines(df, keys, unit, text), keys, unit, lines_per_chunk, cap=cap)
    found = chunk_findings(chunks, keys, rules, threshold, mode)
    return verdicts(df.select(*keys).dropDuplicates(list(keys)), found, keys, rules, threshold)


def scan_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    rules: RuleSet,
    threshold: int,
    rows_per_chunk: int = 100,
    cap: int | None = None,
    skip_empty: bool = False,
    mode: str = FUSED,
) -> DataFrame:
    """Verdicts over groups of structured rows, each group read like a spreadsheet."""
    rows = row_segments(df, [*dict.fromkeys([*keys, order])], columns, skip_empty)
    capped = positions(rows, keys, [order]) if cap is None else first_n(rows, keys, [order], cap)
    chunks = chunk_lines(capped, keys, rows_per_chunk, "\n", position="position")
    found = chunk_findings(chunks, keys, rules, threshold, mode)
    return verdicts(df.select(*keys).dropDuplicates(list(keys)), found, keys, rules, threshold)


def _native_chunks(files: DataFrame) -> DataFrame:
    """``(path, chunks, error)`` for text and CSV contents with their profile columns."""
    text = universal_newlines(lossy_utf8(F.col("content")))
    records = csv_records(F.when(F.col("kind") == "records", text))
    staged = files.withColumn("_text", text).withColumn("_records", records)
    lines = F.when(F.col("kind") == "records", F.col("_records.records")).otherwise(physical_lines(F.col("_text")))
    capped = F.when(F.col("segment_cap").isNull(), lines).otherwise(F.slice(lines, F.lit(1), F.col("segment_cap")))
    kept = F.when(F.col("drop_blank"), F.filter(capped, non_blank)).otherwise(capped)
    error = F.coalesce("read_error", "_records.error")
    cut = staged.select("path", "chunk_size", "joiner", kept.alias("_lines"), error.alias("error"))
    return cut.select("path", chunk_array(F.col("_lines"), F.col("chunk_size"), F.col("joiner")).alias("chunks"), "error")


def _extracted_chunks(extracted: DataFrame) -> DataFrame:
    """``(path, chunks, error)`` for what user extractors produced, cut by each profile."""
    pieces = F.col("extracted")
    kept = F.when(F.col("drop_blank"), F.filter(pieces, lambda p: non_blank(p["text"]))).otherwise(pieces)
    capped = F.when(F.col("segment_cap").isNull(), kept).otherwise(F.slice(kept, F.lit(1), F.col("segment_cap")))
    staged = extracted.select("path", "chunk_size", "chunk_at", "joiner", "error", capped.alias("_kept"))
    texts = F.transform("_kept", lambda p: p["text"])
    size = F.coalesce(F.col("chunk_size"), F.greatest(F.size("_kept"), F.lit(1)))
    by_unit = unit_chunk_array(F.col("_kept"), size, F.col("joiner"))
    chunks = F.when(F.col("chunk_at") == "unit", by_unit).otherwise(chunk_array(texts, size, F.col("joiner")))
    return staged.select("path", chunks.alias("chunks"), "error")


def file_chunks(
    contents: DataFrame,
    extractors: dict[str, Extractor] | None = None,
    chunk_sizes: dict[str, int] | None = None,
    caps: dict[str, int] | None = None,
) -> DataFrame:
    """``(path, chunks, error)`` from ``(path, content)``: every format by its profile.

    A ``read_error`` beside the content is passed on; such a file has no text.

    Text and CSV are cut natively. The other formats need an extractor; without one a
    listed format has no text, like an unknown one. ``chunk_sizes`` replaces the chunk size
    of a format, for instance ``{".pdf": PDF_FAST_CHUNK}``. All segments are read unless
    ``caps`` limits them by extension.
    """
    own = set() if extractors is None else {"." + e.lower().lstrip(".") for e in extractors}
    if "read_error" not in contents.columns:
        contents = contents.withColumn("read_error", F.lit(None).cast("string"))
    profiled = with_profile(contents, chunk_sizes=chunk_sizes, caps=caps)
    native = _native_chunks(
        profiled.where(F.col("kind").isin("lines", "records") & ~F.col("ext").isin(list(own) or [""]))
    )
    if not own:
        return native
    extracted = extract_segments(contents, extractors)
    return native.unionByName(_extracted_chunks(with_profile(extracted, chunk_sizes=chunk_sizes, caps=caps)))


def scan_contents(
    contents: DataFrame,
    rules: RuleSet,
    threshold: int,
    extractors: dict[str, Extractor] | None = None,
    mode: str = FUSED,
    caps: dict[str, int] | None = None,
    early: bool = True,
) -> DataFrame:
    """``(path, is_sensitive, details, error)`` for files with readable text.

    ``early=False`` counts all hits instead of stopping where a rule reaches the threshold.
    """
    chunks = file_chunks(contents, extractors, caps=caps)
    found = row_findings(chunks, ["path", "error"], rules, threshold, mode, chunks="chunks", early=early)
    return row_verdicts(found, ["path", "error"], rules, threshold)


def scan_files(
    spark: SparkSession,
    roots: Sequence[str],
    rules: RuleSet,
    settings: Settings | None = None,
    scan_log: DataFrame | None = None,
    extensions: Sequence[str] = SUPPORTED_EXTENSIONS,
    extractors: dict[str, Extractor] | None = None,
    mode: str = FUSED,
    style: str = "posix",
    through_spark: bool = False,
    early: bool = True,
) -> DataFrame:
    """``(path, size_bytes, size_mb, is_sensitive, details, error, status)`` for files under ``roots``.

    Already logged files are left out before any content is read; see :func:`scan_catalog`.
    """
    found = catalog_scan(spark, roots, extensions).select("path", "size_bytes").dropDuplicates(["path"])
    return scan_catalog(found, rules, settings, scan_log, extractors, mode, style, roots if through_spark else None, early)


def scan_catalog(
    catalog: DataFrame,
    rules: RuleSet,
    settings: Settings | None = None,
    scan_log: DataFrame | None = None,
    extractors: dict[str, Extractor] | None = None,
    mode: str = FUSED,
    style: str = "posix",
    roots: Sequence[str] | None = None,
    early: bool = True,
) -> DataFrame:
    """As :func:`scan_files` for the files of a table ``(path, size_bytes)``, whoever made it.

    Each file is opened by the task it is assigned to. With ``roots`` the file source reads
    all below them instead, for stores that only Spark opens.
    """
    settings = settings or Settings()
    todo = catalog.select("path", "size_bytes").dropDuplicates(["path"])
    if scan_log is not None:
        todo = skip_scanned(todo, scan_log, style=style)
    # A narrow table that is read several times below; the log is joined once.
    todo = checkpointed(todo)
    readable = todo.where(F.col("size_bytes") <= settings.max_bytes)
    contents = read_contents(readable) if roots is None else contents_below(catalog.sparkSession, roots, readable)
    judged = scan_contents(contents, rules, settings.match_threshold, extractors, mode, early=early)
    joined = todo.join(judged, "path", "left")
    return joined.select(
        "path",
        "size_bytes",
        size_mb(F.col("size_bytes")).alias("size_mb"),
        F.coalesce("is_sensitive", F.lit(False)).alias("is_sensitive"),
        F.coalesce("details", F.array().cast("array<struct<rule_name:string,match_count:bigint>>")).alias("details"),
        "error",
        classify(F.col("size_bytes"), F.col("is_sensitive"), settings.max_bytes, error=F.col("error")).alias("status"),
    )


def status_of(df: DataFrame, max_bytes: int, elapsed_ms: Column | None = None) -> DataFrame:
    """Add ``status`` to a table with ``size_bytes`` and ``is_sensitive``."""
    return df.withColumn("status", classify(F.col("size_bytes"), F.col("is_sensitive"), max_bytes, elapsed_ms))
