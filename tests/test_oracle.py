"""Registered queries against their DuckDB twins on the smallest tables."""

import math
import os

import duckdb
import pytest

from ionweave.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def plain(rows):
    def cell(v):
        return round(v, 5) + 0.0 if isinstance(v, float) and math.isfinite(v) else v

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in ("part", "events", "documents", "embeddings", "orders", "customer", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = db.execute(f"SELECT {quoted} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert plain(map(tuple, df.select(*columns).collect())) == plain(want)
