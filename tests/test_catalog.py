"""Every registered graph query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from arcwell.catalog import ORACLE_SQL, QUERIES

DATA = os.environ.get("ARCWELL_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_has_the_rows_of_its_sql(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    found = tables.execute(ORACLE_SQL[name])
    cols = [c[0] for c in found.description]
    want = sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in found.fetchall()), key=repr)
    assert sorted(cols) == sorted(df.columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_return_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_flow_equals_cut(spark):
    row = QUERIES["max_flow"](spark, DATA).first()
    assert abs(row["value"] - row["cut_capacity"]) < 1e-9 and row["bottlenecks"] > 0


def test_entry_and_registration():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
