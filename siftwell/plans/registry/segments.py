"""Segments, caps, chunks and structured rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.chunks import chunk_array
from siftwell.functions.matching import independent_count
from siftwell.functions.text import cap_chars_array, physical_lines
from siftwell.operators import matching as ops
from siftwell.operators.chunking import cap_chars, cap_segments, chunk_lines, chunk_units
from siftwell.plans.registry.base import (
    CORPUS_PATTERNS,
    LINES_SQL,
    SPACES_SQL,
    THRESHOLD,
    chunk_ctes,
    corpus_rules,
    early_ctes,
    hits_ctes,
    query,
    table,
    verdict_select,
)
from siftwell.plans.registry.matching import DOC, _documents, _shown
from siftwell.plans.scan import scan_rows, scan_units
from siftwell.session import spread
from siftwell.sources.segments import (
    csv_segments,
    ordered_parts,
    row_segments,
    row_text,
    stream_lines,
    text_segments,
    unit_lines,
    unit_segments,
    utf16_carve,
)

CONV = ["conv_id"]
UNIT_CHUNK = 5
LINE_CAP = 20
CHAR_CAP = 2_000

_SEGMENTS_SQL = f"""
    line_lists AS (SELECT doc_id, {LINES_SQL} AS lines FROM documents),
    segs AS (SELECT doc_id, CAST(unnest(range(len(lines))) AS INTEGER) AS seg_no, unnest(lines) AS text FROM line_lists)"""


@query("text_segments", f"WITH {_SEGMENTS_SQL} SELECT doc_id, 0 AS unit_no, seg_no, text FROM segs")
def text_segments_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_segments(_documents(spark, sf_dir), DOC)


@query("chunk_lines", f"WITH {chunk_ctes(UNIT_CHUNK)} SELECT doc_id, chunk_no, text FROM chunks")
def chunk_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_lines(text_segments(_documents(spark, sf_dir), DOC), DOC, UNIT_CHUNK, "")


@query("chunk_lines_in_row", f"WITH {chunk_ctes(UNIT_CHUNK)} SELECT doc_id, chunk_no, text FROM chunks")
def chunk_lines_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _documents(spark, sf_dir).select("doc_id", physical_lines(F.col("text")).alias("lines"))
    return lines.select("doc_id", F.posexplode(chunk_array(F.col("lines"), UNIT_CHUNK, "")).alias("chunk_no", "text"))


@query(
    "cap_segments",
    f"WITH {_SEGMENTS_SQL} SELECT doc_id, CAST(seg_no AS BIGINT) AS position, text FROM segs WHERE seg_no < {LINE_CAP}",
)
def cap_segments_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cap_segments(text_segments(_documents(spark, sf_dir), DOC), DOC, ["seg_no"], LINE_CAP)
    return kept.select("doc_id", "position", "text")


@query(
    "cap_segments_kept",
    f"""WITH {_SEGMENTS_SQL}, kept AS (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) - 1 AS position, text
        FROM segs WHERE trim(text, {SPACES_SQL}) <> '')
    SELECT doc_id, position, text FROM kept WHERE position < {LINE_CAP}""",
)
def cap_segments_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = text_segments(_documents(spark, sf_dir), DOC)
    kept = cap_segments(segments, DOC, ["seg_no"], LINE_CAP, count_blank=False)
    return kept.select("doc_id", "position", "text")


ROW_CAP = 1_500


@query(
    "cap_rows_per_status",
    f"""WITH kept AS (
        SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS position
        FROM orders)
    SELECT * FROM kept WHERE position < {ROW_CAP}""",
)
def cap_rows_per_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap beyond the optimizer's own limit on groups that hold a third of the table each."""
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", F.lit("x").alias("text"))
    return cap_segments(orders, ["o_orderstatus"], ["o_orderkey"], ROW_CAP).drop("text")


_CAP_CHARS_SQL = f"""WITH {_SEGMENTS_SQL}, summed AS (
        SELECT doc_id, seg_no, text, coalesce(CAST(sum(length(text)) OVER (
            PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS chars_before
        FROM segs)"""


@query("cap_chars", f"{_CAP_CHARS_SQL} SELECT doc_id, seg_no, chars_before, text FROM summed WHERE chars_before < {CHAR_CAP}")
def cap_chars_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cap_chars(text_segments(_documents(spark, sf_dir), DOC), DOC, ["seg_no"], CHAR_CAP)
    return kept.select("doc_id", "seg_no", "chars_before", "text")


@query("cap_chars_in_row", f"{_CAP_CHARS_SQL} SELECT doc_id, seg_no, text FROM summed WHERE chars_before < {CHAR_CAP}")
def cap_chars_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _documents(spark, sf_dir).select("doc_id", physical_lines(F.col("text")).alias("lines"))
    return lines.select("doc_id", F.posexplode(cap_chars_array(F.col("lines"), CHAR_CAP)).alias("seg_no", "text"))


# A field is quoted (group 1, then any text after the closing quote in group 2) or plain
# (group 3), and ends at a comma, a newline or the end of the text (group 4).
_FIELD = r'(?:"((?:[^"]|"")*)(?:"([^,\n]*))?|([^,\n]*))(,|\n|\z)'


@query(
    "csv_segments",
    f"""WITH lists AS (
        SELECT doc_id, text, regexp_extract_all(text, '{_FIELD}', 1) AS a, regexp_extract_all(text, '{_FIELD}', 2) AS b,
               regexp_extract_all(text, '{_FIELD}', 3) AS c, regexp_extract_all(text, '{_FIELD}', 4) AS d
        FROM documents),
    fields AS (
        SELECT doc_id, text, unnest(range(len(d))) AS i, coalesce(unnest(d), '') AS sep,
               replace(coalesce(unnest(a), ''), '""', '"') || coalesce(unnest(b), '') || coalesce(unnest(c), '') AS field
        FROM lists),
    ended AS (SELECT *, min(CASE WHEN sep = '' THEN i END) OVER (PARTITION BY doc_id) AS last_i FROM fields),
    numbered AS (
        SELECT *, CAST(coalesce(sum(CASE WHEN sep = chr(10) THEN 1 ELSE 0 END) OVER (
            PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg_no
        FROM ended WHERE i <= last_i),
    sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, seg_no) AS n FROM numbered)
    SELECT doc_id, 0 AS unit_no, CAST(seg_no AS INTEGER) AS seg_no, string_agg(field, ' ' ORDER BY i) AS text
    FROM sized WHERE NOT (i = last_i AND n = 1 AND field = '' AND ends_with(text, chr(10)))
    GROUP BY doc_id, seg_no""",
)
def csv_segments_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_segments(_documents(spark, sf_dir), DOC).drop("error")


_UNITS_SQL = f"""
    unit_lists AS (SELECT conv_id, turn, string_split(text, chr(10)) AS lines FROM conversations),
    unit_rows AS (SELECT conv_id, turn, unnest(range(len(lines))) AS i, trim(unnest(lines), {SPACES_SQL}) AS line FROM unit_lists),
    unit_segs AS (
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS seg_no, line
        FROM unit_rows WHERE line <> '')"""


@query("unit_segments", f"WITH {_UNITS_SQL} SELECT conv_id, turn AS unit_no, CAST(seg_no AS INTEGER) AS seg_no, line AS text FROM unit_segs")
def unit_segments_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_segments(table(spark, sf_dir, "conversations"), CONV, "turn")


_UNIT_CHUNKS_SQL = f"""WITH RECURSIVE {_UNITS_SQL},
    units AS (
        SELECT conv_id, turn, count(*) AS n, string_agg(line, chr(10) ORDER BY seg_no) AS body,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS u
        FROM unit_segs GROUP BY conv_id, turn),
    walk AS (
        SELECT conv_id, u, 0 AS chunk_no, n AS held FROM units WHERE u = 1
        UNION ALL
        SELECT t.conv_id, t.u, w.chunk_no + CASE WHEN w.held >= {UNIT_CHUNK} THEN 1 ELSE 0 END,
               t.n + CASE WHEN w.held >= {UNIT_CHUNK} THEN 0 ELSE w.held END
        FROM walk w JOIN units t ON t.conv_id = w.conv_id AND t.u = w.u + 1),
    chunks AS (
        SELECT conv_id, chunk_no, string_agg(body, chr(10) ORDER BY u) AS text
        FROM walk JOIN units USING (conv_id, u) GROUP BY conv_id, chunk_no)"""


@query("unit_chunks", f"{_UNIT_CHUNKS_SQL} SELECT conv_id, chunk_no, text FROM chunks")
def unit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = unit_lines(table(spark, sf_dir, "conversations"), CONV, "turn")
    return chunk_units(units, CONV, "turn", UNIT_CHUNK)


@query(
    "scan_units",
    f"{_UNIT_CHUNKS_SQL}, {hits_ctes('chunks', 'conv_id, chunk_no')}, {early_ctes('conv_id', 'chunk_no, pos')} "
    + verdict_select("(SELECT DISTINCT conv_id FROM conversations)", "conv_id"),
)
def scan_units_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return _shown(scan_units(turns, CONV, "turn", corpus_rules(), THRESHOLD, UNIT_CHUNK), "conv_id")


@query(
    "ordered_parts",
    """WITH parts AS (
        SELECT conv_id, CASE role WHEN 'user' THEN 0 ELSE 1 END AS part_rank, turn AS ord, text FROM conversations)
    SELECT conv_id, part_rank, ord, row_number() OVER (PARTITION BY conv_id ORDER BY part_rank, ord) - 1 AS position, text
    FROM parts""",
)
def ordered_parts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns of a conversation first, then all others."""
    turns = table(spark, sf_dir, "conversations")
    first, rest = turns.where("role = 'user'"), turns.where("role <> 'user'")
    return ordered_parts([(0, first), (1, rest)], CONV, "turn")


def _cell_sql(column: str) -> str:
    return f"CASE WHEN {column} = floor({column}) THEN CAST(CAST({column} AS BIGINT) AS VARCHAR) ELSE CAST({column} AS VARCHAR) END"


@query(
    "row_segments_customer",
    f"SELECT c_custkey, concat_ws(' ', c_custkey, c_name, c_nationkey, {_cell_sql('c_acctbal')}, c_mktsegment) AS text FROM customer",
)
def row_segments_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return row_segments(customer, ["c_custkey"], ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_ORDER_TEXT = (
    f"concat_ws(' ', o_orderkey, o_custkey, o_orderstatus, {_cell_sql('o_totalprice')}, "
    "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderpriority)"
)


@query("row_segments_orders", f"SELECT o_orderkey, {_ORDER_TEXT} AS text FROM orders")
def row_segments_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_segments(table(spark, sf_dir, "orders"), ["o_orderkey"], _ORDER_COLUMNS)


@query(
    "row_segments_events",
    f"""SELECT event_id, concat_ws(' ', event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
        ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END, user_id, event_type, {_cell_sql('"value"')}, props) AS text FROM events""",
)
def row_segments_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return row_segments(events, ["event_id"], ["event_id", "ts", "user_id", "event_type", "value", "props"])


_SCAN_ROWS_SQL = f"""WITH placed AS (
        SELECT {{key}}, row_number() OVER (PARTITION BY {{key}} ORDER BY o_orderkey) - 1 AS p, {_ORDER_TEXT} AS line FROM orders),
    chunks AS (
        SELECT {{key}}, p // 100 AS chunk_no, string_agg(line, chr(10) ORDER BY p) AS text
        FROM placed GROUP BY {{key}}, p // 100),
    {{hits}}, {{found}} {{final}}"""


def _scan_rows_sql(key: str) -> str:
    return _SCAN_ROWS_SQL.format(
        key=key,
        hits=hits_ctes("chunks", f"{key}, chunk_no"),
        found=early_ctes(key, "chunk_no, pos", 50),
        final=verdict_select(f"(SELECT DISTINCT {key} FROM orders)", key, 50),
    )


@query("scan_rows_by_customer", _scan_rows_sql("o_custkey"))
def scan_rows_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of a customer as one sheet."""
    orders = table(spark, sf_dir, "orders")
    return _shown(scan_rows(orders, ["o_custkey"], "o_orderkey", _ORDER_COLUMNS, corpus_rules(), 50), "o_custkey")


@query("scan_rows_by_status", _scan_rows_sql("o_orderstatus"))
def scan_rows_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sheets, each with about a third of all orders."""
    orders = table(spark, sf_dir, "orders")
    return _shown(scan_rows(orders, ["o_orderstatus"], "o_orderkey", _ORDER_COLUMNS, corpus_rules(), 50), "o_orderstatus")


_LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
_LINE_TEXT = (
    f"concat_ws(' ', l_orderkey, l_partkey, l_suppkey, l_linenumber, {_cell_sql('l_quantity')}, {_cell_sql('l_extendedprice')}, "
    f"{_cell_sql('l_discount')}, {_cell_sql('l_tax')}, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'))"
)


@query(
    "row_counts_lineitem",
    f"""WITH src AS (SELECT l_returnflag, l_linestatus, {_LINE_TEXT} AS text FROM lineitem)
    SELECT l_returnflag, l_linestatus, {", ".join(
        f"CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS n_{n}" for n, p in CORPUS_PATTERNS)}
    FROM src GROUP BY l_returnflag, l_linestatus""",
)
def row_counts_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the largest table as a text of its own, counted per rule."""
    lineitem = spread(table(spark, sf_dir, "lineitem"))
    rules = corpus_rules()
    texts = lineitem.select("l_returnflag", "l_linestatus", row_text(lineitem, _LINE_COLUMNS).alias("text"))
    counted = texts.select("l_returnflag", "l_linestatus", *[independent_count(F.col("text"), r).alias(r.name) for r in rules])
    return counted.groupBy("l_returnflag", "l_linestatus").agg(*[F.sum(r.name).alias(f"n_{r.name}") for r in rules])


@query(
    "stream_lines",
    f"""WITH lists AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
    rows AS (SELECT doc_id, unnest(range(len(lines))) AS i, trim(unnest(lines), {SPACES_SQL}) AS text FROM lists)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS seg_no, text FROM rows WHERE text <> ''""",
)
def stream_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as raw streams, read within the stream limit and decoded leniently."""
    content = F.encode(F.col("text"), "UTF-8")
    return _documents(spark, sf_dir).select(
        "doc_id", F.posexplode(stream_lines(content)).alias("seg_no", "text")
    )


@query(
    "utf16_carve",
    # All characters of the corpus take one unit, so 20,000 bytes are 10,000 characters.
    "SELECT doc_id, regexp_replace(text, '[\\x00-\\x1f]', '', 'g') AS text FROM documents",
)
def utf16_carve_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as raw UTF-16LE, carved back; the first 20,000 bytes are the format's own limit."""
    return _documents(spark, sf_dir).select("doc_id", utf16_carve(F.encode(F.col("text"), "UTF-16LE")).alias("text"))


@query(
    "fused_counts_by_source",
    f"""WITH src AS (SELECT source, doc_id, text FROM documents), {hits_ctes('src', 'source, doc_id')}
    SELECT source, rule_idx, count(*) AS match_count FROM hits GROUP BY source, rule_idx""",
)
def fused_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as documents of many texts; counts are combined before they are shuffled."""
    docs = table(spark, sf_dir, "documents").select("source", "text")
    return ops.counts(docs, ["source"], corpus_rules())
