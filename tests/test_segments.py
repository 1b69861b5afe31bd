from __future__ import annotations

import csv
import datetime as dt
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import model
from siftwell.functions.cells import cell_to_str, join_cells
from siftwell.functions import chunks
from siftwell.functions.chunks import chunk_array, unit_chunk_array
from siftwell.functions.text import UNICODE_SPACES, binary_prefix_text, physical_lines, split_lines, strip, universal_newlines
from siftwell.operators import chunking
from siftwell.operators.chunking import cap_segments, chunk_units
from siftwell.plans.scan import file_chunks, scan_rows, scan_units
from siftwell.functions.rules import make_rules
from siftwell.sources.segments import csv_records, csv_segments, ordered_parts, row_segments, text_segments, utf16_carve


def _column(spark, values, expression, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_lossy_decoding_equals_pythons(spark):
    rng = random.Random(2)
    values = [bytes.fromhex(h) for h in ("efbbbf31", "61e4b862f09f987a", "ff", "", "c080", "eda080")]
    values += [bytes(rng.randrange(256) for _ in range(rng.randrange(12))) for _ in range(300)]
    got = _column(spark, values, lambda c: binary_prefix_text(c, 100), "binary")
    assert got == [v.decode("utf-8", errors="replace") for v in values]
    assert _column(spark, [b"abc\xe4\xb8"], lambda c: binary_prefix_text(c, 2), "binary") == ["ab"]


def test_lines(spark):
    values = ["a\rb\r\nc\n", "", "\n", "a", "a\n\nb", "\n\n"]
    unified = [v.replace("\r\n", "\n").replace("\r", "\n") for v in values]
    assert _column(spark, values, lambda c: split_lines(universal_newlines(c))) == [
        [line.rstrip("\n") for line in model.lines_of(v)] for v in unified
    ]
    assert _column(spark, values, lambda c: physical_lines(universal_newlines(c))) == [model.lines_of(v) for v in unified]


def test_strip_is_unicode_aware(spark):
    values = [UNICODE_SPACES + "a b" + UNICODE_SPACES, "x", UNICODE_SPACES, "\u200bz"]
    assert _column(spark, values, strip) == [v.strip() for v in values]


def test_byte_order_mark_stays(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xef\xbb\xbf1\n2"))], "d int, content binary")
    rows = [r.text for r in text_segments(df, ["d"], "content").orderBy("seg_no").collect()]
    assert rows == ["\ufeff1\n", "2"]


def test_csv_records_equal_the_standard_reader(spark):
    rng = random.Random(4)
    texts = ["a,,b", '"x, y",z', '"q""r",1', 'a\n\n"b\nc",d\n', 'plain,"open', "", "a,b\nc,d\n", 'x"y,z', '"a"b,c']
    texts += ["".join(rng.choice('ab,"\n ') for _ in range(rng.randrange(25))) for _ in range(300)]
    got = _column(spark, texts, lambda c: csv_records(c)["records"])
    assert got == [[" ".join(row) for row in csv.reader(io.StringIO(t))] for t in texts]


def test_a_bad_record_keeps_those_before_it(spark):
    text = 'a,"b"\nc\rd'
    [(records, error)] = _column(spark, [text], csv_records)
    assert records == ["a b"] and "new-line" in error
    rows = csv_segments(spark.createDataFrame([(1, text)], "d int, text string"), ["d"]).collect()
    assert [(r.text, r.error) for r in rows] == [("a b", None), ("c", None), ("d", None)]


def test_a_long_quoted_field_is_read(spark):
    text = 'a,"' + "x" * 200_000 + '"\nhit'
    rows = csv_segments(spark.createDataFrame([(1, text)], "d int, text string"), ["d"]).collect()
    assert [len(r.text) for r in rows] == [200_002, 3] and rows[0].error is None


def test_blank_csv_records_use_up_the_cap_and_blank_rows_do_not(spark):
    text = "\n" * 10_000 + "hit\n"
    df = spark.createDataFrame([(1, text)], "d int, text string")
    kept = cap_segments(csv_segments(df, ["d"]), ["d"], ["seg_no"], 10_000)
    assert kept.where("text = 'hit'").count() == 0
    kept = cap_segments(csv_segments(df, ["d"]), ["d"], ["seg_no"], 10_000, count_blank=False)
    assert [(r.text, r.position) for r in kept.collect()] == [("hit", 0)]


def _python_cell(v):
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def test_cells_print_like_python_values(spark):
    floats = [100.0, 1863.84, -0.5, 123456789.25, 1e15, 1e16, 123456789012345678.0, 1e22, 0.001, 0.0001, 0.00012345,
              1e-05, 1.5e-07, -2.5e-10, 12345678.9, -98765432.125, 0.1, 1 / 3, 2.0**53, -7.0, 1e7, 9999999.5]
    assert _column(spark, floats, lambda c: cell_to_str(c, T.DoubleType()), "double") == [_python_cell(v) for v in floats]
    special = [float("nan"), float("inf"), float("-inf"), None]
    assert _column(spark, special, lambda c: cell_to_str(c, T.DoubleType()), "double") == ["nan", "inf", "-inf", None]
    assert _column(spark, [True, False], lambda c: cell_to_str(c, T.BooleanType()), "boolean") == ["True", "False"]
    stamps = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 120)]
    assert _column(spark, stamps, lambda c: cell_to_str(c, T.TimestampNTZType()), "timestamp_ntz") == [str(s) for s in stamps]


def test_joined_cells_skip_null_and_optionally_empty(spark):
    df = spark.createDataFrame([(100.0, 1863.84, None, "")], "a double, b double, c string, d string")
    cells = [cell_to_str(F.col(c), df.schema[c].dataType) for c in df.columns]
    row = df.select(join_cells(cells).alias("kept"), join_cells(cells, skip_empty=True).alias("skipped")).first()
    assert row.kept == "100 1863.84 " and row.skipped == "100 1863.84"


def test_blank_rows_are_dropped(spark):
    df = spark.createDataFrame([(1, None, " \t"), (2, "", None), (3, None, "x"), (4, 1.5, "")], "k int, a string, b string")
    assert [r.k for r in row_segments(df, ["k"], ["a", "b"]).orderBy("k").collect()] == [3, 4]


def test_utf16_carve(spark):
    def expected(data):
        text = data[: len(data) // 2 * 2].decode("utf-16-le", errors="replace")
        return "".join("\n" if c == "\r" else c for c in text if (c >= " " or c == "\r") and c != "\ufeff")

    values = ["\ufeffab\rc\n\x01d中".encode("utf-16-le"), b"a", b"", b"a\x00\x00\xd8b\x00"]
    got = _column(spark, values, utf16_carve, "binary")
    assert got == [expected(v) for v in values] and got[0] == "ab\ncd中"


def test_chunk_array_and_units(spark):
    rng = random.Random(1)
    docs = [[[f"{d}.{u}.{i}" for i in range(rng.randrange(5))] for u in range(rng.randrange(9))] for d in range(200)]
    flat = [[(u, text) for u, unit in enumerate(units) for text in unit] for units in docs]
    df = spark.createDataFrame(list(enumerate(flat)), "d int, segs array<struct<unit_no:int,text:string>>")
    for size in (5, 1, 4):
        texts = F.transform("segs", lambda s: s["text"])
        cut = unit_chunk_array(F.col("segs"), size).alias("c")
        for row, units in zip(df.select("d", cut, chunk_array(texts, size, "|").alias("s")).orderBy("d").collect(), docs):
            assert row.c == ["\n".join(c) for c in model.cut_units(units, size)]
            assert row.s == model.cut([x for u in units for x in u], size, "|")


@pytest.mark.parametrize("cap", [1000, 6])
def test_unit_chunks_of_rows(spark, cap):
    rng = random.Random(8)
    docs = {d: [[f"{d}.{u}.{i}" for i in range(rng.randrange(5))] for u in range(rng.randrange(9))] for d in range(60)}
    rows = [(d, u, lines) for d, units in docs.items() for u, lines in enumerate(units)]
    df = spark.createDataFrame(rows, "d int, u int, lines array<string>")
    got = {}
    for r in chunk_units(df, ["d"], "u", 5, cap=cap).orderBy("d", "chunk_no").collect():
        got.setdefault(r.d, []).append(r.text)
    expected = {d: ["\n".join(c) for c in model.cut_units(units, 5, cap)] for d, units in docs.items()}
    assert got == {d: c for d, c in expected.items() if c}


def test_unit_sizes_from_the_table(spark):
    rows = [(1, u, ["x"] * n) for u, n in enumerate((3, 1, 4, 2, 2))]
    df = spark.createDataFrame(rows, "d int, u int, lines array<string>")
    sizes = [len(r.text.split("\n")) for r in chunk_units(df, ["d"], "u", 5).orderBy("chunk_no").collect()]
    assert sizes == [8, 4]


def test_parts_follow_each_other(spark):
    paragraphs = spark.createDataFrame([(d, i, f"p{i}") for d in (1, 2) for i in range(5)], "d int, o int, text string")
    tables = spark.createDataFrame([(d, i, f"t{i}") for d in (1, 3) for i in range(3)], "d int, o int, text string")
    rows = ordered_parts([(0, paragraphs), (1, tables)], ["d"], "o").orderBy("d", "position").collect()
    got = {d: [r.text for r in rows if r.d == d] for d in (1, 2, 3)}
    assert got[1] == ["p0", "p1", "p2", "p3", "p4", "t0", "t1", "t2"]
    assert got[2] == ["p0", "p1", "p2", "p3", "p4"] and got[3] == ["t0", "t1", "t2"]
    assert [r.position for r in rows if r.d == 1] == list(range(8))


def test_scans_over_units_and_rows_equal_the_loop(spark):
    rng = random.Random(6)
    texts = [(d, u, "".join(rng.choice("ab1 \n") for _ in range(20))) for d in range(40) for u in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(texts, "d int, u int, text string")
    patterns = ["ab", r"\d", r"a\s+b"]
    rules = make_rules([(str(i), p) for i, p in enumerate(patterns)])
    by_unit, by_row = {}, {}
    for d, u, text in texts:
        by_unit.setdefault(d, []).append([s.strip() for s in text.split("\n") if s.strip()])
        by_row.setdefault(d, []).append(f"{u} {text}")

    def rows(scanned):
        return {r.d: (r.is_sensitive, [(int(x.rule_name), x.match_count) for x in r.details]) for r in scanned.collect()}

    assert rows(scan_units(df, ["d"], "u", rules, 3, 2)) == {
        d: model.scan(["\n".join(c) for c in model.cut_units(units, 2)], patterns, 3) for d, units in by_unit.items()
    }
    assert rows(scan_rows(df, ["d"], "u", ["u", "text"], rules, 4, rows_per_chunk=2)) == {
        d: model.scan(model.cut(lines, 2, "\n"), patterns, 4) for d, lines in by_row.items()
    }


def test_files_are_cut_by_their_profile(spark):
    contents = [
        ("a.txt", "".join(f"{i}\n" for i in range(1200))),
        ("b.CSV", "".join(f"{i},x\n\n" for i in range(250))),
        ("c.exe", "x"),
        ("d.md", "one\r\ntwo"),
    ]
    df = spark.createDataFrame([(p, t.encode()) for p, t in contents], "path string, content binary")
    got = {r.path: r.chunks for r in file_chunks(df).collect()}
    assert set(got) == {"a.txt", "b.CSV", "d.md"}
    assert [c.count("\n") for c in got["a.txt"]] == [500, 500, 200]
    assert [len(c.split("\n")) for c in got["b.CSV"]] == [100, 100, 50] and got["b.CSV"][0].startswith("0 x\n1 x")
    assert got["d.md"] == ["one\ntwo"]


def _greedy(sizes, n):
    held = chunk = 0
    out = []
    for size in sizes:
        out.append(chunk)
        held += size
        if held >= n:
            held, chunk = 0, chunk + 1
    return out


@pytest.mark.parametrize("n", [1, 5, 40])
def test_unit_chunks_equal_a_greedy_walk(spark, monkeypatch, n):
    """Documents shorter and longer than a block, null keys, gaps between units, and units that are no numbers."""
    monkeypatch.setattr(chunking, "BLOCK_UNITS", 16)
    rng = random.Random(n)
    rows, expected = [], {}
    for key, count in ((1, 100), (2, 1), (3, 16), (None, 17), (4, 333)):
        units = sorted(rng.sample(range(-50, 1000), count))
        sizes = [rng.choice([1, 1, 2, 7, 60]) for _ in units]
        rows += [(key, u, f"u{u + 50:05d}", s) for u, s in zip(units, sizes, strict=True)]
        expected |= {(key, u): c for u, c in zip(units, _greedy(sizes, n), strict=True)}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, u int, name string, size bigint")
    assert {(r.k, r.u): r.chunk_no for r in chunking.unit_chunks(df.drop("name"), ["k"], "u", n).collect()} == expected
    named = chunking.unit_chunks(df.drop("u"), ["k"], "name", n).collect()
    assert {(r["k"], int(r["name"][1:]) - 50): r["chunk_no"] for r in named} == expected
    assert chunking.unit_chunks(df.limit(0).drop("name"), ["k"], "u", n).count() == 0


def test_a_document_of_very_many_units(spark):
    units = spark.range(300_000).select(F.lit("d").alias("k"), F.col("id").alias("u"), (1 + F.col("id") % 3).alias("size"))
    got = chunking.unit_chunks(units, ["k"], "u", 5).agg(F.count("*").alias("n"), F.max("chunk_no").alias("last")).first()
    assert (got.n, got.last) == (300_000, _greedy([1 + i % 3 for i in range(300_000)], 5)[-1])


@pytest.mark.parametrize("count", [0, 1, 64, 65, 200])
def test_unit_chunks_of_one_row(spark, count):
    rng = random.Random(count)
    sizes = [rng.choice([1, 2, 9]) for _ in range(count)]
    segments = [(unit, f"{unit}.{i}") for unit, size in enumerate(sizes) for i in range(size)]
    df = spark.createDataFrame([(sizes, segments)], "s array<bigint>, g array<struct<unit_no:int,text:string>>")
    row = df.select(chunks.unit_chunk_ids(F.col("s"), 4).alias("ids"), chunks.unit_chunk_array(F.col("g"), 4, "|").alias("texts")).first()
    assert row.ids == _greedy(sizes, 4)
    texts, open_, last = [], [], None
    for unit, text in segments:
        if unit != last and len(open_) >= 4:
            texts.append("|".join(open_))
            open_ = []
        open_.append(text)
        last = unit
    assert row.texts == texts + (["|".join(open_)] if open_ else [])
