"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as driver
from siftwell.plans.registry import QUERIES, SQL
from siftwell.sources.catalog import list_files

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    return round(value, 9) if isinstance(value, float) else value


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(_plain(row[c]) for c in columns) for row in df.collect()]
    result = duck.sql(SQL[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    expected = [tuple(_plain(row[i]) for i in order) for row in result.fetchall()]
    assert len(got) > 0
    assert _sorted(got) == _sorted(expected)


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0


def test_listed_files_are_the_directory(spark, sf_dir):
    found = {os.path.basename(r.path): r.size_bytes for r in list_files(spark, [sf_dir]).collect()}
    assert found == {n: os.path.getsize(f"{sf_dir}/{n}") for n in os.listdir(sf_dir)}
