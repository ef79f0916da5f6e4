"""Every registered query against DuckDB on the same tables (CATALOG_SF_DIR; sf0.001 by default)."""

import datetime as dt
import math
import os

import duckdb
import pytest

from tessara.plans.catalog_queries import ORACLE_SQL, QUERIES
from tessara.plans.registry import TABLES

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, df.collect())
    if name not in ORACLE_SQL:
        assert got[1]
        return
    found = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    want = table(columns, found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    wrong = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
