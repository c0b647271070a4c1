"""The numbered queries that SQL can express give the SQL's rows."""

from __future__ import annotations

import duckdb
import pytest

from gleanery.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
