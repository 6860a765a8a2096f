"""Every registered query with SQL, next to DuckDB on the same files."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

ORACLES = contract.oracle_sql()
#: These need the rows of sf0.01: with fewer than a thousand, the weakly penalised linear model
#: fits the planted errors, and the search takes long for what ``test_jobs`` also covers.
LARGER = {"ml_logreg", "ml_search"}


@pytest.fixture(scope="module")
def duck(tiny_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{tiny_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def sortable(record):
    return tuple("NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v) for v in record)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - LARGER))
def test_same_rows_as_sql(spark, duck, tiny_dir, name):
    df = contract.queries()[name](spark, tiny_dir)
    columns = ",".join(f'"{c}"' for c in df.columns)
    want = duck.sql(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(map(sortable, got)) == sorted(map(sortable, want))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries())


def test_flagship_runs(spark):
    assert contract.entry(spark).count() > 0
