"""Queries that have SQL against DuckDB on the whole tables."""

from pathlib import Path

import duckdb
import pytest

from mrkit.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query(spark, name):
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    theirs = connection.execute(queries.oracle_sql()[name]).to_arrow_table()
    ours = queries.queries()[name](spark, SF).toArrow()
    assert ours.column_names == theirs.column_names and ours.schema.types == theirs.schema.types
    assert sorted(zip(*ours.to_pydict().values())) == sorted(zip(*theirs.to_pydict().values())) != []
