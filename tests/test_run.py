from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions.rules import make_rules
from siftwell.operators.quarantine import restore
from siftwell.plans.run import run_scan
from siftwell.sinks.encryption import decrypt_payload
from siftwell.sources.settings import Settings

RULES = make_rules([("number", r"\d{3}")])


def _base(path):
    return path.rsplit("/", 1)[-1]


def test_two_runs_of_a_day(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    for folder in ("a", "b"):
        (source / folder).mkdir(parents=True)
        (source / folder / "f.txt").write_text(f"111 222 333 {folder}")
    (source / "safe.txt").write_text("nothing")
    settings = Settings(dev=True)

    first = run_scan(spark, [str(source)], target, RULES, settings, "2024-06-01 10:00:00", "r1")
    assert {r.metric: r.value for r in first.report.collect()}["sensitive"] == 2
    assert sorted(r.backup_name for r in first.manifest.collect()) == ["f.txt", "f_1.txt"]
    assert first.bundle.endswith("20240601/bundle=20240601_100000")
    first.create_views()
    assert spark.sql("SELECT count(*) FROM scan_verdicts WHERE is_sensitive").first()[0] == 2

    # Repeating a run before its log counts is the same as running it once.
    (source / "c").mkdir()
    (source / "c" / "f.txt").write_text("444 555 666")
    for _ in range(2):
        second = run_scan(spark, [str(source)], target, RULES, settings, "2024-06-01 11:00:00", "r2", key="k")
        if not second.verdicts.isEmpty():
            assert [r.backup_name for r in second.manifest.collect()] == ["f_2.txt"]
            bundle = decrypt_payload(spark.read.parquet(second.bundle), "content", "k")
            assert [r.content for r in bundle.collect()] == ["444 555 666"]

    third = run_scan(spark, [str(source)], target, RULES, settings, "2024-06-01 12:00:00", "r3")
    assert third.verdicts.isEmpty() and third.bundle is None

    held = spark.read.parquet(f"{target}/quarantine").where("run_id = 'r1'")
    manifest = spark.read.parquet(f"{target}/manifest").where("run_id = 'r1'")
    back = restore(manifest, held.select("dest_path", "content"), spark.createDataFrame([], "path string, content binary"))
    assert {(_base(r.path), bytes(r.content).decode()[-1]) for r in back.collect()} == {("f.txt", "a"), ("f.txt", "b")}
    assert manifest.where(F.col("mode") != "copy").isEmpty()


def test_a_run_without_findings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("nothing")
    run = run_scan(spark, [str(tmp_path / "in")], str(tmp_path / "out"), RULES, Settings(), "2024-06-01 10:00:00", "r1")
    assert run.bundle is None and run.manifest.isEmpty()
    assert {r.metric: r.value for r in run.report.collect()}["safe"] == 1
