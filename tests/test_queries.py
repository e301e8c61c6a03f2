"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

from larkspur.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, tables, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(repr(plain(tuple(r))) for r in df.select(*columns).collect())
    if name in catalog.oracle_sql():
        found = tables.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rows == sorted(repr(plain(tuple(r[names.index(c)] for c in columns))) for r in found.fetchall())
