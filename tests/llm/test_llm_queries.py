"""The pN_ queries on the smallest tables, against SQL where there is any."""

from __future__ import annotations

import os

import duckdb
import pytest

from larkspur.llm import oracles, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
COLUMNS = {
    "p1_found": ["person_id_a", "person_id_b"], "p2_found": ["memory_id", "field", "plain"], "p3_found": ["item_table", "item_id", "cut"], "p4_found": ["field", "item_id", "pos", "kind"],
    "p5_found": ["path_a", "path_b"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id_a", "doc_id_b"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    rows = [repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect()]
    assert len(set(rows)) == len(rows)
    if name in oracles.oracle_sql():
        con = duckdb.connect()
        for file in os.listdir(FOLDER):
            con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{FOLDER}/{file}'")
        found = con.execute(oracles.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(rows) == sorted(repr(tuple(r[names.index(c)] for c in sorted(df.columns))) for r in found.fetchall())
