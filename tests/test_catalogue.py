"""Every registered query of the profiling operators against its SQL twin in DuckDB."""

import os

import duckdb
import pytest

from gaugeframe.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    want = db.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), names)


def test_profile_has_the_fixed_fields(spark):
    rows = catalogue.column_profiles(spark, DATA).collect()
    assert len(rows) == 11 and rows[0]["table_name"] == "lineitem"


def test_entry_point_imports():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
