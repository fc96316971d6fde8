"""Every query of the catalogue against its SQL on the smallest tables; those without SQL give rows."""

import math
import os

import duckdb
import pytest

from chronolake.plans.catalogue import ORACLE, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value).replace("+00:00", "")


def cells(table, columns):
    return sorted(tuple(plain(r[c]) for c in columns) for r in table.select(columns).to_pylist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    if name not in ORACLE:
        assert got.num_rows > 0
        return
    true = db.sql(ORACLE[name]).fetch_arrow_table()
    columns = sorted(true.column_names)
    assert sorted(got.column_names) == columns
    assert cells(got, columns) == cells(true, columns)
