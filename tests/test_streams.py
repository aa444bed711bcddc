"""Outer joins of streams, timers, initial state and time to live, and the Python data source's commits, offsets and filters."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from tarnwick import streaming
from tarnwick.sources import ledger, table

DAY = datetime.datetime(2024, 1, 1)


def at(hour, minute=0):
    return DAY + datetime.timedelta(hours=hour, minutes=minute)


def batch(spark, rows, path):
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").parquet(path).withWatermark("ts", "1 hour")


def run(df, path, mode="append"):
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    return q.recentProgress


def test_outer_join_of_streams_expires_its_state(spark, tmp_path):
    """A click's null row comes once its hour is behind the watermark, a late purchase for it is dropped, and state goes."""
    def joined(path):
        clicks = stream(spark, path).where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("u"), F.col("ts").alias("at"))
        bought = stream(spark, path).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", "ts")
        return clicks.join(bought, F.expr("u = user_id AND ts >= at AND ts <= at + INTERVAL 1 HOUR"), "left_outer").select("click", "purchase")

    out = lambda: sorted((r.click, r.purchase) for r in spark.read.schema("click long, purchase long").parquet(f"{tmp_path}/out").collect())
    batch(spark, [(1, at(1), 7, "click", 0.0), (2, at(1, 10), 8, "click", 0.0), (3, at(1, 30), 7, "purchase", 0.0)], f"{tmp_path}/in")
    run(joined(f"{tmp_path}/in"), tmp_path)
    assert out() == [(1, 3)]  # click 2 may still find one
    batch(spark, [(4, at(9), 9, "click", 0.0), (5, at(9), 1, "purchase", 0.0)], f"{tmp_path}/in")
    progress = run(joined(f"{tmp_path}/in"), tmp_path)
    assert out() == [(1, 3), (2, None)]
    assert progress[-1].stateOperators[0].numRowsTotal == 2  # click 4 and purchase 5
    batch(spark, [(6, at(1, 20), 8, "purchase", 0.0), (7, at(9, 30), 9, "purchase", 0.0)], f"{tmp_path}/in")
    progress = run(joined(f"{tmp_path}/in"), tmp_path)
    assert out() == [(1, 3), (2, None), (4, 7)]
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress if p.stateOperators) == 1


def test_inactivity_alerts(spark, tmp_path):
    """Rows out of order and late ones over three batches, equal times, a key seen before, null times."""
    gap = 2 * 3600 * 1000
    out = lambda: sorted((r.user_id, r.last_seen) for r in spark.read.schema("user_id long, last_seen timestamp").parquet(f"{tmp_path}/out").collect())
    seen = spark.createDataFrame([(3, at(0)), (1, at(0, 30))], "user_id long, last_seen timestamp")
    with streaming.rocksdb(spark):
        go = lambda: run(streaming.inactivity(stream(spark, f"{tmp_path}/in"), "user_id", "ts", gap, seen), tmp_path)
        batch(spark, [(1, at(1), 1, "x", 0.0), (2, at(1), 1, "x", 0.0), (3, at(4), 1, "x", 0.0), (4, at(4, 30), 2, "x", 0.0), (9, None, 2, "x", 0.0)], f"{tmp_path}/in")
        go()  # watermark 3:30
        assert out() == [(1, at(1)), (3, at(0))]  # 0:30 of user 1, known from before, is followed by 1:00
        batch(spark, [(5, at(3, 40), 2, "x", 0.0), (6, at(5, 30), 1, "x", 0.0), (7, at(7), 4, "x", 0.0)], f"{tmp_path}/in")
        go()  # watermark 6:00
        assert out() == [(1, at(1)), (3, at(0))]  # 4:00 is followed by 5:30, 3:40 of user 2 by 4:30; 4:30 ends at 6:30
        batch(spark, [(8, at(20), 4, "x", 0.0)], f"{tmp_path}/in")
        go()
        assert out() == [(1, at(1)), (1, at(5, 30)), (2, at(4, 30)), (3, at(0)), (4, at(7))]


def test_state_with_a_time_to_live(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else clock time keeps the run going
    try:
        _time_to_live(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def _time_to_live(spark, tmp_path):
    for ttl, name, want in ((1, "short", [1, 1]), (3_600_000, "long", [1, 2])):
        path = f"{tmp_path}/{name}"
        with streaming.rocksdb(spark):
            for k in range(2):
                batch(spark, [(k, at(k), 5, "x", 2.0)], f"{path}/in")
                run(streaming.totals_by_processor(stream(spark, f"{path}/in"), "user_id", "value", ttl), path)
                time.sleep(0.05)
        assert sorted(r.n for r in spark.read.schema("user_id long, n long, total double").parquet(f"{path}/out").collect()) == want


@pytest.fixture
def source(spark):
    spark.dataSource.register(ledger.Ledger)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_failed_write_leaves_no_rows(spark, source, tmp_path):
    path = str(tmp_path / "l")
    spark.range(10).repartition(3).write.format("ledger").mode("append").save(path)

    @F.udf("long")
    def fails(i):
        if i == 17:
            raise ValueError("planted")
        return i

    with pytest.raises(Exception, match="planted"):
        spark.range(10, 20).repartition(3).select(fails("id").alias("id")).write.format("ledger").mode("append").save(path)
    read = lambda: sorted(r.id for r in spark.read.format("ledger").load(path).collect())
    assert read() == list(range(10)) and ledger.commits(path) == [0]
    assert len([f for f in os.listdir(path) if f.endswith(".arrow")]) <= 3  # the first write's
    spark.range(3).write.format("ledger").mode("append").save(path)
    assert read() == sorted([*range(10), *range(3)])
    spark.range(100, 102).write.format("ledger").mode("overwrite").save(path)
    assert read() == [100, 101] and len([f for f in os.listdir(path) if f.endswith(".arrow")]) <= 2


def test_filters_reach_the_reader(spark, source, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull

    path = str(tmp_path / "l")
    for k in range(4):
        spark.range(100 * k, 100 * k + 100).selectExpr("id", "concat('n', id % 3) AS name", "if(id % 10 = 0, null, id * 0.5D) AS x").coalesce(1).write.format("ledger").mode("append").save(path)
    reader = ledger.FilteringReader(path)
    assert list(reader.pushFilters([GreaterThan(("id",), 250), IsNull(("x",)), EqualTo(("name",), "n1")])) == [IsNull(("x",))]
    assert len(reader.partitions()) == 2  # two of the four files may hold such rows
    df = spark.read.format("ledger").option("filters", "true").load(path)
    for condition, files in (("id > 250", 2), ("id >= 100 AND id < 150", 1), ("id = 399", 1), ("name = 'n1' AND x <= 20", 1), ("x IS NULL", 4), ("id < 0", 1)):
        got = df.where(condition)
        assert got.rdd.getNumPartitions() == files
        want = spark.range(400).selectExpr("id", "concat('n', id % 3) AS name", "if(id % 10 = 0, null, id * 0.5D) AS x").where(condition)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stream_of_commits(spark, source, sf, tmp_path):
    """Each run takes the commits since the last; a batch written twice stands once."""
    path, e = str(tmp_path), table(spark, sf, "region")
    go = lambda: spark.readStream.format("ledger").load(f"{path}/in").writeStream.format("ledger").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    out = lambda: sorted(r.r_regionkey for r in spark.read.format("ledger").load(f"{path}/out").collect())
    e.where("r_regionkey < 2").write.format("ledger").mode("append").save(f"{path}/in")
    go()
    assert out() == [0, 1]
    e.where("r_regionkey >= 2").write.format("ledger").mode("append").save(f"{path}/in")
    go()
    go()
    assert out() == [0, 1, 2, 3, 4]
    writer = ledger.LedgerStreamWriter(f"{path}/out", e.schema, False)
    again = writer.write(iter(e.toArrow().to_batches()))
    writer.commit([again], 0)
    assert out() == [0, 1, 2, 3, 4] and not os.path.exists(again.file)
