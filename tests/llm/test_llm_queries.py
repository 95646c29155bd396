"""The registered queries with SQL give DuckDB's rows on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from sieveline.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    frame = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(frame.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in frame.select(*columns).collect()))) == sorted(map(repr, want))
