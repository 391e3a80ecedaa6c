"""Every query with SQL gives the same rows in DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

#: Small tables first; a query that finds nothing there is held against larger ones.
SIZES = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")
SF = SIZES[0]
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def connections():
    out = {}
    for folder in SIZES:
        out[folder] = duckdb.connect()
        for f in Path(folder).iterdir():
            out[folder].sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return out


def plain(v):
    return v if v is None or isinstance(v, (bool, str)) else float(v)


def rows(columns, values):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(repr(plain(r[i])) for i in at) for r in values)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connections, name):
    for folder in SIZES:
        got, want = entry.queries()[name](spark, folder), connections[folder].sql(entry.oracle_sql()[name])
        assert sorted(got.columns) == sorted(want.columns)
        found = rows(got.columns, got.collect())
        assert found == rows(list(want.columns), want.fetchall())
        if found:
            return
    raise AssertionError("no rows")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_each_query_has_sql():
    assert {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"} == set(NAMES)
