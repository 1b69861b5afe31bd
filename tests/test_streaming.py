from __future__ import annotations

import datetime as dt
import random

import model
from siftwell.functions.rules import make_rules
from siftwell.plans.registry import QUERIES
from siftwell.plans.scan import chunk_findings
from siftwell.sources.settings import Settings
from siftwell.streaming.accumulate import accumulate_stream
from siftwell.streaming.scan_stream import foreach_batch_scan, scan_stream

PATTERNS = ["ab", r"\d", "[A-Z]"]
RULES = make_rules([(str(i), p) for i, p in enumerate(PATTERNS)])


def test_only_new_files_are_scanned(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    source.mkdir()
    rules = make_rules([("number", r"\d{3}")])

    def run():
        scan_stream(spark, str(source), target, checkpoint, rules, Settings(match_threshold=2)).awaitTermination()
        return {r.path.rsplit("/", 1)[-1]: r.status for r in spark.read.parquet(f"{target}/verdicts").collect()}

    (source / "a.txt").write_text("111 222")
    (source / "b.txt").write_text("safe")
    (source / "c.log").write_text("111 222")
    assert run() == {"a.txt": "sensitive", "b.txt": "safe"}
    (source / "d.txt").write_text("333 444")
    assert run() == {"a.txt": "sensitive", "b.txt": "safe", "d.txt": "sensitive"}
    assert run() == {"a.txt": "sensitive", "b.txt": "safe", "d.txt": "sensitive"}
    held = spark.read.parquet(f"{target}/quarantine").collect()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in held) == ["a.txt", "d.txt"]
    listed = spark.read.parquet(f"{target}/manifest").orderBy("seq").collect()
    assert [(r.seq, r.backup_name) for r in listed] == [(1, "a.txt"), (2, "d.txt")]
    assert {r.scan_date for r in listed} == {dt.date.today()}
    assert spark.read.parquet(f"{target}/scan_log").count() == 3


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    schema = "path string, length bigint, content binary"
    batch = spark.createDataFrame([("x/a.txt", 7, b"111 222"), ("x/b.txt", 4, b"safe")], schema)
    scan_batch = foreach_batch_scan(str(tmp_path), make_rules([("number", r"\d{3}")]), Settings(match_threshold=2), "2024-06-01")
    for batch_id in (0, 1, 1):
        scan_batch(batch, batch_id)
    for table, rows in (("verdicts", 4), ("manifest", 2), ("quarantine", 2), ("scan_log", 4)):
        assert spark.read.parquet(f"{tmp_path}/{table}").count() == rows
    listed = spark.read.parquet(f"{tmp_path}/manifest").orderBy("seq").collect()
    assert [(r.seq, r.backup_name, r.renamed, r.run_id) for r in listed] == [(1, "a.txt", False, "batch-0"), (2, "a_1.txt", True, "batch-1")]
    held = spark.read.parquet(f"{tmp_path}/quarantine").collect()
    assert {r.dest_path for r in held} == {r.dest_path for r in listed} and {r.scan_day for r in listed} == {20240601}
    assert "PartitionFilters: [isnotnull(scan_day" in spark.read.parquet(f"{tmp_path}/scan_log").where("scan_day = 20240601")._jdf.queryExecution().executedPlan().toString()


def test_pieces_may_arrive_in_any_order(spark, tmp_path):
    """Shuffled over micro-batches, the counts are those of the pieces in order."""
    rng = random.Random(4)
    pieces = [(d, n, "".join(rng.choice("abAB1 ") for _ in range(6))) for d, count in ((1, 30), (2, 7), (3, 1)) for n in range(count)]
    shuffled = rng.sample(pieces, len(pieces))
    schema = "d int, chunk_no int, text string"
    source, got = tmp_path / "pieces", {}

    def keep(batch, batch_id):
        for r in batch.collect():
            got[r.d, r.rule_idx] = (r.match_count, r.is_sensitive)

    for part in range(3):
        spark.createDataFrame(shuffled[part::3], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = accumulate_stream(stream, "d", RULES, 9, any_order=True).writeStream.outputMode("update").foreachBatch(keep)
        query.option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    expected = {}
    for d in (1, 2, 3):
        flagged, counts = model.scan([t for k, _, t in pieces if k == d], PATTERNS, 9)
        expected.update({(d, rule): (n, flagged) for rule, n in counts})
    assert got == expected


def test_counts_carry_over_micro_batches(spark, tmp_path):
    rng = random.Random(11)
    pieces = [(0 if i % 3 else i % 5, i, "".join(rng.choice("abAB1 ") for _ in range(6))) for i in range(120)]
    schema = "d int, chunk_no int, text string"
    source = tmp_path / "pieces"
    got = {}

    def keep(batch, batch_id):
        for r in batch.collect():
            got[r.d, r.rule_idx] = (r.match_count, r.is_sensitive)

    # Each run sees one more file; pieces arrive in order, shuffled only inside a file.
    for part in range(3):
        rows = pieces[part * 40 : part * 40 + 40]
        rng.shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        (
            accumulate_stream(stream, "d", RULES, 15)
            .writeStream.outputMode("update")
            .foreachBatch(keep)
            .option("checkpointLocation", str(tmp_path / "ckpt"))
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    expected = {}
    for d in {p[0] for p in pieces}:
        texts = [t for k, _, t in sorted(pieces, key=lambda p: p[1]) if k == d]
        flagged, counts = model.scan(texts, PATTERNS, 15)
        expected.update({(d, rule): (n, flagged) for rule, n in counts})
    assert got == expected
    table = spark.createDataFrame(pieces, schema)
    batch = {(r.d, r.rule_idx): r.match_count for r in chunk_findings(table, ["d"], RULES, 15).collect()}
    assert {k: n for k, (n, _) in got.items()} == batch


def test_the_documents_table_may_be_a_file_a_folder_or_empty(spark, tmp_path):
    texts = [(d, "x@y.org 12 34 ABC " * (d % 4)) for d in range(60)]
    rows = spark.createDataFrame([*texts, (None, "AB 12"), (100, None)], "doc_id long, text string")
    rows.repartition(5).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    rows.where("false").coalesce(1).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    (tmp_path / "file").mkdir()
    rows.toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "file" / "documents.parquet", index=False)
    found = {k: {tuple(r) for r in QUERIES["stream_accumulate"](spark, str(tmp_path / k)).collect()} for k in ("folder", "file", "empty")}
    assert found["folder"] == found["file"] and found["empty"] == set()
    assert {r[0] for r in found["folder"]} == {None, *(d for d, _ in texts if d % 4)}
