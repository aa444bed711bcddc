"""Every registered query against its SQL on DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tarnwick.plans import catalog
from tarnwick.sources import TABLES


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.4f}" if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf, t)}.parquet'")
    want = db.execute(catalog.SQL[name])
    want = rows([c[0] for c in want.description], want.fetchall())
    got = catalog.QUERIES[name](spark, sf)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
