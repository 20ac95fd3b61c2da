"""The numbered queries that SQL can express give DuckDB's rows."""

from __future__ import annotations

import duckdb
import pytest

from gridloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    made, want = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: kinds[t] for c, t in made.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    names = sorted(made.columns)
    got = sorted(map(repr, map(tuple, made.select(*names).collect())))
    assert got == sorted(map(repr, want.select(", ".join(names)).fetchall()))
