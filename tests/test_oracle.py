"""Every registered query against DuckDB on the whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as spark_entry

SF_DIR = "/root/testdata/sf0.01"
QUERIES, ORACLES = spark_entry._own_queries(), spark_entry._own_oracle_sql()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _sorted_rows(table):
    names = sorted(table.column_names)
    return sorted(zip(*(table[name].to_pylist() for name in names)), key=repr)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and type(a) is type(b)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, SF_DIR).toArrow()
    theirs = duck.sql(ORACLES[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    for column in ours.column_names:
        assert ours.schema.field(column).type == theirs.schema.field(column).type, column
    assert ours.num_rows == theirs.num_rows
    rows = list(zip(_sorted_rows(ours), _sorted_rows(theirs)))
    assert rows
    different = [(a, b) for a, b in rows if not all(map(_same, a, b))]
    assert not different, different[:5]


def test_entry(spark):
    rows = spark_entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0].n_points == 500
