"""Every registered query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(records: list[tuple]) -> list[str]:
    def text(v: object) -> str:
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return repr(v)

    return sorted("|".join(map(text, r)) for r in records)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    yield con
    con.close()


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal(name, spark, duck, sf_dir):
    made = QUERIES[name](spark, sf_dir)
    names = sorted(made.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == names
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS.get(t, t) for c, t in made.dtypes} == kinds
    got = rows_of([tuple(r) for r in made.select(*names).collect()])
    expected = rows_of(want.select(", ".join(f'"{c}"' for c in names)).fetchall())
    assert len(got) == len(expected)
    different = [(a, b) for a, b in zip(got, expected, strict=True) if a != b]
    assert not different, different[:3]


@pytest.mark.parametrize(("name", "source", "key"), [("letter_sequence", "customer", "c_custkey"), ("letter_sequence_of_all", "customer", "c_custkey"), ("conversions", "part", "p_partkey"), ("conversions_of_all", "part", "p_partkey")])
def test_whole_tables_are_read(name, source, key, spark, duck):
    """At sf0.1, where letters run to three."""
    large = "/root/testdata/sf0.1"
    got = sorted(map(tuple, QUERIES[name](spark, large).collect()))
    assert len(got) == spark.read.parquet(f"{large}/{source}.parquet").count() and got[0][0] == 0
    assert got == sorted(duck.sql(SQL[name].replace(f"FROM {source}", f"FROM '{large}/{source}.parquet'")).fetchall())
    if source == "customer":
        assert {len(r[1]) for r in got} == {1, 2, 3}


def test_sequences_of_dates_past_the_year_9999(spark, duck, tmp_path):
    """A week for each of 420,000 customers runs to the year 10074."""
    duck.execute(f"COPY (SELECT range AS c_custkey FROM range(420000)) TO '{tmp_path}/customer.parquet'")
    want = SQL["sequence_columns"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet'")
    got = sorted(map(tuple, QUERIES["sequence_columns"](spark, str(tmp_path)).collect()))
    assert got[-1][4].startswith("10074-") and got == sorted(duck.execute(want).fetchall())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
