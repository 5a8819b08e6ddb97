"""Every registered query with SQL gives the rows DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for file in sorted(Path(tables).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v
        return v

    return sorted((tuple(plain(row[i]) for i in order) for row in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, tables, name):
    got = QUERIES[name](spark, tables)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    got_rows, want_rows = rows(got.columns, got.collect()), rows(columns, want.fetchall())
    assert len(got_rows) == len(want_rows)
    for a, b in zip(got_rows, want_rows):
        for x, y in zip(a, b):
            if isinstance(x, float) or isinstance(y, float):
                assert x is not None and y is not None and abs(float(x) - float(y)) < 2e-6 or x == y
            else:
                assert x == y


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    row = driver.entry(spark).collect()
    assert len(row) == 1 and 0 <= row[0]["macro_F1"] <= 1
