"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   table folder           (default /root/testdata/sf0.1)
BENCH_CPUS     local cores            (default all)
BENCH_QUERIES  comma-separated names  (default the list below)
BENCH_LOOP=1   also time the plain single-process loop of the tests on the same documents
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from siftwell.functions.rules import make_rules  # noqa: E402
from siftwell.operators import matching as ops  # noqa: E402
from siftwell.plans.registry import QUERIES  # noqa: E402
from siftwell.plans.registry.base import CORPUS_PATTERNS, THRESHOLD, table  # noqa: E402
from siftwell.session import local_session  # noqa: E402

HEADLINE = (
    "full_counts",
    "verdict_whole_text",
    "early_stop_fused",
    "scan_chunked",
    "scan_chunk_rows",
    "independent_counts",
    "default_rule_counts",
    "page_verdicts",
    "csv_segments",
    "scan_units",
    "row_counts_lineitem",
    "scan_rows_by_customer",
    "scan_rows_by_status",
    "skip_scanned",
    "dedupe_first",
    "quarantine_move",
    "resolve_names",
)


def _many_rules(n: int) -> list[tuple[str, str]]:
    """``n`` rules: the default kinds, then words that end in two given letters."""
    words = [(f"word{i}", f"{chr(97 + i % 26)}{chr(97 + i * 7 % 26)}[0-9]+") for i in range(n)]
    return [*CORPUS_PATTERNS[:3], *words][:n]


def _by_rule_count(n: int, mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        return ops.counts(docs, ["doc_id"], make_rules(_many_rules(n)), mode)

    return run


def _timed(run, spark: SparkSession, sf_dir: str) -> float:
    started = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def _loop_seconds(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """The same work as ``scan_chunked`` and ``full_counts`` in one plain Python process."""
    sys.path.insert(0, os.path.join(ROOT, "tests"))
    import model
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()
    patterns = [p for _, p in CORPUS_PATTERNS]
    started = time.perf_counter()
    for text in texts:
        model.scan(model.cut(model.lines_of(text), 5), patterns, THRESHOLD)
    scanned = time.perf_counter()
    for text in texts:
        model.hits_in(text, patterns, True)
    counted = time.perf_counter()
    return {"loop_scan_chunked": scanned - started, "loop_full_counts": counted - scanned}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("OFF")
    chosen = os.environ.get("BENCH_QUERIES")
    runs = {name: QUERIES[name] for name in (chosen.split(",") if chosen else HEADLINE)}
    if not chosen:
        for n in (3, 10, 30):
            runs[f"fused_{n}_rules"] = _by_rule_count(n, ops.FUSED)
            runs[f"independent_{n}_rules"] = _by_rule_count(n, ops.INDEPENDENT)
    seconds = {}
    for name, run in runs.items():
        seconds[name] = round(min(_timed(run, spark, sf_dir) for _ in range(2)), 3)
    result = {
        "metric": "headline queries, best of two",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    if os.environ.get("BENCH_LOOP"):
        result["loop"] = {k: round(v, 3) for k, v in _loop_seconds(spark, sf_dir).items()}
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
