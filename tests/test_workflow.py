from __future__ import annotations

import datetime as dt
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import model
from siftwell.functions.paths import path_key
from siftwell.functions.rules import make_rules
from siftwell.operators.catalog import dedupe_first, skip_scanned, with_batch, with_progress
from siftwell.operators.quarantine import build_manifest, quarantine, resolve_names, restore
from siftwell.operators.reporting import run_report
from siftwell.operators.verdicts import classify
from siftwell.plans.scan import scan_catalog, scan_files
from siftwell.sinks.encryption import decrypt_payload, encrypt_payload
from siftwell.sinks.quarantine import write_bundle, write_quarantine
from siftwell.sinks.scan_log import append_scan_log, scan_log_rows
from siftwell.sources.catalog import catalog_scan
from siftwell.sources.contents import OPEN_BYTES, assigned_pieces, open_path, read_contents
from siftwell.sources.scan_log import read_scan_log, read_text_log
from siftwell.sources.segments import extract_segments
from siftwell.sources.settings import Settings

DAY = "2024-06-01"
RULES = make_rules([("number", r"\d{3}")])


def _names(spark, paths, existing):
    flagged = spark.createDataFrame([(p,) for p in paths], "path string")
    taken = spark.createDataFrame([(n,) for n in existing], "dest_name string")
    rows = resolve_names(flagged, taken).collect()
    assert len(rows) == len(paths)
    return {r.path: r.dest_name for r in rows}


def test_the_first_of_each_name_keeps_it(spark):
    paths = ["/a/f.txt", "/b/f.txt", "/c/f_1.txt", "/d/f.txt"]
    assert _names(spark, paths, []) == {"/a/f.txt": "f.txt", "/b/f.txt": "f_2.txt", "/c/f_1.txt": "f_1.txt", "/d/f.txt": "f_3.txt"}


def test_names_of_earlier_runs_are_skipped(spark):
    got = _names(spark, ["/a/f.txt", "/b/f.txt", "/c/g"], ["f.txt", "f_2.txt", "g", "h"])
    assert got == {"/a/f.txt": "f_1.txt", "/b/f.txt": "f_3.txt", "/c/g": "g_1"}


def test_names_equal_a_greedy_loop(spark):
    rng = random.Random(9)
    pool = [f"{s}{n}{e}" for s in ("f", "f_1", ".h", "f_01") for n in ("", "_1", "_2", "_3", "_12") for e in (".txt", "", ".tar.gz")]
    paths = [f"/{i:03d}/{'f.txt' if i % 3 == 0 else rng.choice(pool)}" for i in range(300)]
    existing = rng.sample(pool, 12)
    got = _names(spark, paths, existing)
    assert got == model.name_claims(paths, existing)
    assert len(set(got.values()) | set(existing)) == len(paths) + len(set(existing))


def test_move_then_restore_gives_the_source_back(spark):
    rows = [(f"C:\\d{i % 3}\\f.txt", f"text {i}") for i in range(3)] + [("C:\\x\\safe.txt", "safe")]
    source = spark.createDataFrame(rows, "path string, text string")
    verdicts = source.select("path", F.col("path").endswith("f.txt").alias("is_sensitive"))
    gone = spark.createDataFrame([("C:\\gone.txt", True)], verdicts.schema)
    taken, remaining = quarantine(source, verdicts.union(gone), ["path"], "move")
    assert taken.count() == 3 and remaining.count() == 1
    none = spark.createDataFrame([], "dest_name string")
    manifest = build_manifest(resolve_names(taken, none), "q/20240601/target", "move", "r1", DAY)
    listed = sorted(manifest.collect(), key=lambda r: r.seq)
    assert [r.seq for r in listed] == [1, 2, 3] and [r.renamed for r in listed] == [False, True, True]
    assert listed[1].dest_path == "q/20240601/target/f_1.txt" and listed[1].scan_date == dt.date(2024, 6, 1)
    stored = taken.join(manifest.select(F.col("src_path").alias("path"), "dest_path"), "path").select("dest_path", "text")
    back = restore(manifest, stored, remaining)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    # A file that has appeared at the original path in the meantime is replaced.
    newer = remaining.union(spark.createDataFrame([(rows[0][0], "newer")], remaining.schema))
    assert sorted(map(tuple, restore(manifest, stored, newer).collect())) == sorted(rows)
    copied, whole = quarantine(source, verdicts, ["path"], "copy")
    assert copied.count() == 3 and whole.count() == 4
    with pytest.raises(ValueError):
        quarantine(source, verdicts, ["path"], "shred")


def test_restoring_one_path_twice_keeps_the_later_entry(spark):
    manifest = spark.createDataFrame(
        [("p", "q/1", "r1", 1), ("p", "q/2", "r2", 1)], "src_path string, dest_path string, run_id string, seq bigint"
    ).withColumn("scan_date", F.lit(DAY).cast("date"))
    stored = spark.createDataFrame([("q/1", "old"), ("q/2", "new")], "dest_path string, text string")
    empty = spark.createDataFrame([], "path string, text string")
    assert [tuple(r) for r in restore(manifest, stored, empty).collect()] == [("p", "new")]


def test_outcomes(spark):
    rows = [(1, True, None, None), (9, True, None, None), (5, False, 10.0, None), (5, False, 300.0, None), (11, False, 1.0, None),
            (None, False, 1.0, None), (5, False, 1.0, "boom"), (10, False, 200.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, size bigint, hit boolean, ms double, err string")
    status = classify(F.col("size"), F.col("hit"), 10, F.col("ms"), F.col("err")).alias("status")
    out = df.select("i", status).orderBy("i")
    expected = ["sensitive", "sensitive", "quick", "safe", "oversize", "unreadable", "error", "quick"]
    assert [r.status for r in out.collect()] == expected
    report = {r.metric: r.value for r in run_report(out).collect()}
    assert report == {"scanned": 8, "sensitive": 2, "error": 1, "unreadable": 1, "oversize": 1, "quick": 2, "safe": 1}
    known = df.select("i", classify(F.col("size"), F.col("hit"), 10, size_prefiltered=True).alias("status")).orderBy("i")
    assert [r.status for r in known.collect()][4] == "safe"


def test_batches_progress_and_duplicates(spark):
    df = spark.createDataFrame([(f"p{i:04d}", i) for i in range(25)], "path string, ord int")
    batches = {r.path: r.batch_no for r in with_batch(df, 10).collect()}
    assert batches == {f"p{i:04d}": i // 10 for i in range(25)}
    done = sorted((r.path, r.completed, r.pct) for r in with_progress(df, ["path"]).collect())
    assert done == [(f"p{i:04d}", i + 1, (i + 1) * 100 // 25) for i in range(25)]
    twice = df.union(df.withColumn("ord", F.col("ord") + 100)).withColumn("x", F.col("ord") * 2)
    assert sorted(tuple(r) for r in dedupe_first(twice).collect()) == [(f"p{i:04d}", i, i * 2) for i in range(25)]


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"111 222\r\n333 \xff")
    (root / "sub" / "b.CSV").write_bytes(b'"1,11",222\n333')
    (root / "c.log").write_bytes(b"111 222 333")
    (root / "d.pdf").write_bytes(b"111\n222\f333")
    (root / "e.docx").write_bytes(b"broken")
    (root / "big.txt").write_bytes(b"111 222 333" * 200_000)
    (root / "odd [1].md").write_bytes(b"safe 111")
    return root


def _short(rows):
    return {r.path.rsplit("/", 1)[-1]: (r.status, [tuple(d) for d in r.details]) for r in rows}


def test_scanning_files_and_resuming(spark, folder, tmp_path):
    def pages(path, data):
        for page, text in enumerate(data.decode().split("\f")):
            for line in text.split("\n"):
                yield page, line

    def broken(path, data):
        yield 0, "111 222"
        raise ValueError("cannot read the rest")

    settings = Settings(max_file_size_mb=1)
    extractors = {"pdf": pages, ".docx": broken}
    root = [str(folder)]
    first = scan_files(spark, root, RULES, settings, extractors=extractors)
    expected = {
        "a.txt": ("sensitive", [("number", 3)]),
        "b.CSV": ("safe", [("number", 2)]),
        "d.pdf": ("sensitive", [("number", 3)]),
        "e.docx": ("error", [("number", 2)]),
        "big.txt": ("oversize", []),
        "odd [1].md": ("safe", [("number", 1)]),
    }
    assert _short(first.collect()) == expected

    log = str(tmp_path / "log")
    append_scan_log(first, log, DAY, "r1", style="posix")
    again = scan_files(spark, root, RULES, settings, read_scan_log(spark, log, DAY), extractors=extractors)
    assert _short(again.collect()) == {"e.docx": expected["e.docx"]}
    assert read_scan_log(spark, log, "2024-06-02").count() == 0

    (folder / "new.txt").write_bytes(b"444")
    third = scan_files(spark, root, RULES, settings, read_scan_log(spark, log, DAY), extractors=extractors)
    assert set(_short(third.collect())) == {"e.docx", "new.txt"}


@pytest.mark.parametrize("piece_bytes", [4, 1 << 20])
def test_tasks_open_the_files_of_the_catalog_only(spark, folder, tmp_path, piece_bytes):
    """The catalog table drives the read; each file is opened once a piece, and no other file is opened."""
    opened = tmp_path / "opened"
    opened.mkdir()

    def counting(path):
        import tempfile

        with tempfile.NamedTemporaryFile("w", dir=opened, delete=False) as note:
            note.write(path)
        return open_path(path)

    wanted = catalog_scan(spark, [str(folder)], ["txt", "md"], 1000).select("path", "size_bytes")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1000)" in plan and "content" not in plan.split("ReadSchema")[1]
    listed = [(r.path, r.size_bytes) for r in wanted.collect()]
    table = spark.createDataFrame([*listed, listed[0], ("file:" + str(folder / "gone.txt"), 3)], "path string, size_bytes bigint")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in read_contents(table, 3, piece_bytes, counting).collect()}
    assert sorted(rows) == ["a.txt", "gone.txt", "odd [1].md"]
    assert rows["gone.txt"].content is None and "FileNotFoundError" in rows["gone.txt"].read_error
    for path, _ in listed:
        assert bytes(rows[path.rsplit("/", 1)[-1]].content) == (folder / path.rsplit("/", 1)[-1]).read_bytes()
    notes = Counter(note.read_text() for note in opened.iterdir())
    pieces = {path: -(-max(size, 1) // piece_bytes) for path, size in listed}
    assert notes == pieces | {"file:" + str(folder / "gone.txt"): 1}


def test_bytes_are_shared_by_the_tasks(spark):
    files = spark.range(500).select(F.concat(F.lit("/f"), "id").alias("path"), (F.col("id") * 4000 + 1).alias("size_bytes"))
    big = files.unionByName(spark.createDataFrame([("/big", 50_000_000), ("/empty", 0), ("/odd", None)], "path string, size_bytes bigint"))
    pieces = assigned_pieces(big, 10, 1 << 20).collect()
    assert {p.task for p in pieces} == set(range(10))
    held = Counter()
    for p in pieces:
        held[p.task] += max(min((p.size_bytes or 0) - p.offset, 1 << 20), OPEN_BYTES)
    assert max(held.values()) - min(held.values()) <= 2 * (1 << 20)
    assert sorted(p.offset for p in pieces if p.path == "/big") == list(range(0, 50_000_000, 1 << 20))
    assert len([p for p in pieces if p.path in ("/empty", "/odd")]) == 2
    assert assigned_pieces(big.limit(0), 10).count() == 0 and read_contents(big.limit(0)).count() == 0


def test_a_catalog_table_is_scanned(spark, folder):
    """By tasks and by the file source: the same verdicts, and a file that is gone is an error of its own."""
    settings = Settings(max_file_size_mb=1)
    listed = catalog_scan(spark, [str(folder)]).select("path", "size_bytes")
    gone = spark.createDataFrame([("file:" + str(folder / "gone.txt"), 3)], "path string, size_bytes bigint")
    by_tasks = _short(scan_catalog(listed.unionByName(gone), RULES, settings).collect())
    assert by_tasks.pop("gone.txt") == ("error", [])
    assert by_tasks == _short(scan_catalog(listed, RULES, settings, roots=[str(folder)]).collect())
    counted = _short(scan_catalog(listed, RULES, settings, early=False).collect())
    assert counted["a.txt"][1][0][1] >= by_tasks["a.txt"][1][0][1]


def test_overlapping_roots_count_a_file_once(spark, folder):
    rows = scan_files(spark, [str(folder), str(folder / "sub")], RULES, Settings(max_file_size_mb=1)).collect()
    assert len(rows) == len({r.path for r in rows})


def test_one_failing_extractor_leaves_the_others_alone(spark):
    files = spark.createDataFrame([("a.x", b"1"), ("b.x", b""), ("c.y", b"1")], "path string, content binary")

    def numbers(path, data):
        yield 0, str(1 // len(data))

    rows = {r.path: (len(r.extracted), r.error) for r in extract_segments(files, {"x": numbers}).collect()}
    assert rows["a.x"] == (1, None) and rows["b.x"][0] == 0 and "ZeroDivisionError" in rows["b.x"][1] and len(rows) == 2


def test_a_plain_text_log_is_normalised(spark, tmp_path):
    (tmp_path / "scan.log").write_text("C:\\A\\b.txt\n\n  c:/a/./B.txt \nD:\\x\n", encoding="utf-8")
    log = read_text_log(spark, str(tmp_path / "scan.log"))
    assert sorted(r.path_key for r in log.collect()) == ["c:\\a\\b.txt", "d:\\x"]
    catalog = spark.createDataFrame([("C:/a/B.TXT",), ("D:\\y",)], "path string")
    assert [r.path for r in skip_scanned(catalog, log).collect()] == ["D:\\y"]


def test_failed_items_stay_out_of_the_log(spark):
    df = spark.createDataFrame([("a", "safe"), ("b", "error"), ("c", "sensitive"), ("d", "oversize")], "path string, status string")
    assert sorted(r.path_key for r in scan_log_rows(df, DAY, "r", style="posix").collect()) == ["a", "c", "d"]


def test_a_repeated_run_replaces_its_own_rows_only(spark, tmp_path):
    target = str(tmp_path / "q")
    one = spark.createDataFrame([("a", "x")], "path string, text string")
    two = spark.createDataFrame([("b", "y"), ("c", "z")], "path string, text string")
    write_quarantine(one, target, DAY, "r1")
    write_quarantine(two, target, DAY, "r2")
    write_quarantine(two, target, DAY, "r2")
    assert sorted(r.path for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]
    assert (tmp_path / "q" / "scan_day=20240601").is_dir()


def test_bundles(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x" * 10)], "path string, text string")
    folder = write_bundle(rows, str(tmp_path), "2024-06-01 10:20:30", "text")
    assert folder.endswith("bundle=20240601_102030") and spark.read.parquet(folder).count() == 1
    assert write_bundle(rows.where("false"), str(tmp_path), "2024-06-01 10:20:31", "text") is None
    assert not (tmp_path / "bundle=20240601_102031").exists()


def test_encryption_round_trip_and_refusals(spark):
    rows = spark.createDataFrame([(1, "geheim ü"), (2, None)], "i int, text string")
    closed = encrypt_payload(rows, "text", "k")
    assert closed.where("i = 1").first().text != "geheim ü".encode()
    assert [r.text for r in decrypt_payload(closed, "text", "k").orderBy("i").collect()] == ["geheim ü", None]
    with pytest.raises(Exception):
        decrypt_payload(closed, "text", "other").collect()
    with pytest.raises(ValueError):
        encrypt_payload(rows, "text", "")


def test_the_key_is_not_in_the_plan(spark):
    key = "a very secret key"
    derived = hashlib.sha256(key.encode()).hexdigest()
    rows = spark.createDataFrame([(1, "x")], "i int, `a.b` string").withColumnRenamed("a.b", "text")
    plan = decrypt_payload(encrypt_payload(rows, "text", key), "text", key)._jdf.queryExecution()
    shown = plan.toString() + plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "aes_encrypt" in shown.lower() or "AESEncrypt" in shown or "aesEncrypt" in shown
    assert key not in shown and derived not in shown.lower()


def test_path_keys_agree_between_log_and_catalog(spark):
    df = spark.createDataFrame([("C:\\A\\..\\B.txt",)], "path string")
    assert df.select(path_key(F.col("path")).alias("k")).first().k == "c:\\b.txt"
