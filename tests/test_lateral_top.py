"""The dearest orders of a customer over several files, whose rows come in any order."""

import duckdb

from tarnwick.plans import catalog


def test_lateral_top_over_files(spark, tmp_path):
    db = duckdb.connect()
    source = "/root/testdata/sf0.1"
    db.execute(f"CREATE TABLE customer AS SELECT * REPLACE (c_custkey + i * 15000 AS c_custkey) FROM '{source}/customer.parquet', range(8) r(i)")
    db.execute(f"CREATE TABLE orders AS SELECT * REPLACE (o_orderkey + i * 150000 AS o_orderkey, o_custkey + i * 15000 AS o_custkey) FROM '{source}/orders.parquet', range(8) r(i)")
    for t in ("customer", "orders"):
        db.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet, ROW_GROUP_SIZE 100000)")
    keys = {"spark.sql.files.maxPartitionBytes": "2m", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = {tuple(r) for r in catalog.QUERIES["lateral_top"](spark, str(tmp_path)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == set(db.execute(catalog.SQL["lateral_top"]).fetchall())
