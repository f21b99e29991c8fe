"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomwork.plans import REGISTRIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {n: q for r in REGISTRIES for n, q in r.queries.items()}
SQL = {n: q for r in REGISTRIES for n, q in r.sql.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def rows_of(rows, columns):
    order = sorted(columns)
    show = lambda x: "null" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[columns.index(c)]) for c in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of([tuple(r) for r in got.collect()], got.columns) == rows_of(want.fetchall(), list(want.columns))


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_query_has_a_name_of_its_own():
    assert len(QUERIES) == sum(len(r.queries) for r in REGISTRIES)
    assert set(SQL) <= set(QUERIES)
