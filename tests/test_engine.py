"""Streaming against batch, sources' round trips, joins' edge cases."""

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwick import sources, streaming
from tarnwick.functions import ascii_words, ngrams
from tarnwick.operators.frames import sum_excluding_current, sum_excluding_peers
from tarnwick.operators.joins import asof_join, range_join


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = sources.table(spark, sf, "events")
    stream = streaming.events_stream(spark, f"{sf}/event*.parquet", batch.schema, "1 hour")
    out = streaming.run_once(streaming.windowed(stream, "1 day"), "daily", "complete", str(tmp_path / "c"))
    want = streaming.windowed(batch.withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))


def test_round_trips(spark, sf, tmp_path):
    df = sources.table(spark, sf, "nation")
    for kind, options in (("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"header": "true"})):
        sources.write(df, f"{tmp_path}/{kind}", kind, **options)
        back = sources.read(spark, f"{tmp_path}/{kind}", kind, "n_nationkey int, n_name string, n_regionkey int", **options)
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_range_join_has_no_nested_loop(spark):
    p, r = spark.range(100).selectExpr("cast(id AS double) AS x"), spark.createDataFrame([(1, 2.0, 5.5), (2, 5.0, 5.0), (3, 90.0, 400.0)], "k int, low double, high double")
    got = range_join(p, r, "x", "low", "high", 10.0)
    assert sorted((g.k, g.x) for g in got.collect()) == [(1, float(x)) for x in range(2, 6)] + [(3, float(x)) for x in range(90, 100)]
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_asof_nulls_and_cells(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 25, "b"), (None, 5, "c"), (1, None, "d"), (2, 5, "e"), (1, 95, "f")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 1, 10), (1, 20, None), (None, 1, 30), (1, None, 40), (2, 6, 50)], "k int, t int, v int")
    for cell in (None, lambda t: F.floor(t / 10)):
        got = asof_join(left, right, "k", "t", "v", "last", cell)
        assert sorted((r.x, r.last) for r in got.collect()) == [("a", 10), ("b", None), ("c", None), ("d", None), ("e", None), ("f", None)]


def test_sum_excluding_current_with_nulls(spark):
    rows = spark.createDataFrame([(1, 1, None), (1, 2, 5), (1, 3, 7), (2, 1, 4), (3, 1, None), (3, 2, None)], "k int, t int, v int")
    w = Window.partitionBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    got = rows.select("k", "t", sum_excluding_current("v", w).alias("s")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == [(1, 1, 12), (1, 2, 7), (1, 3, 5), (2, 1, None), (3, 1, None), (3, 2, None)]


def test_late_rows_are_dropped_and_counted(spark, sf, tmp_path):
    """Two batches: the second brings rows of the first day, long behind the watermark, and one new day."""
    e = sources.table(spark, sf, "events").limit(0).schema
    row = lambda i, day: (i, day, 1, "click", 1.0, "{}")
    day = lambda d, h=1: datetime.datetime(2024, 1, d, h)
    for k, rows in enumerate(([row(1, day(1)), row(2, day(1, 2)), row(3, day(9))], [row(4, day(1, 3)), row(5, day(9, 2)), row(6, day(20))])):
        spark.createDataFrame(rows, e).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streaming.windowed(streaming.events_stream(spark, f"{tmp_path}/in", e, "1 hour"), "1 day")
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
        assert dropped == k  # the late row, one group of it
    out = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
    assert sorted((r.start.day, r.n) for r in out.collect()) == [(1, 2), (9, 2)]


def test_running_totals_over_batches(spark, sf, tmp_path):
    e = sources.table(spark, sf, "events")
    for k in range(2):
        e.where(f"event_id % 2 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streaming.events_stream(spark, f"{tmp_path}/in", e.schema, "1 hour")
    out = streaming.run_to_table(streaming.running_totals(stream, "user_id", "value"), "totals")
    want = {r.user_id: r["count"] for r in e.groupBy("user_id").count().collect()}
    assert {r.user_id: r.n for r in out.groupBy("user_id").agg(F.max("n").alias("n")).collect()} == want


def test_ngrams(spark):
    rows = spark.createDataFrame([("a b  c\td",), ("a",), ("",), (None,)], "t string")
    got = [r.g for r in rows.select(ngrams(ascii_words(F.col("t")), 3).alias("g")).collect()]
    assert got == [["a b c", "b c d"], [], [], []]


def test_asof_hot_key_has_no_join_of_rows_by_key_alone(spark, sf):
    """With cells, rows are windowed by (key, cell); what is carried over is one row a cell."""
    e = sources.table(spark, sf, "events").withColumn("half", F.col("event_id") % 2)
    got = asof_join(e.select("event_id", "half", "ts"), e.where("event_type = 'error'"), "half", "ts", "event_id", "last", lambda at: F.date_trunc("day", at))
    plain = asof_join(e.select("event_id", "half", "ts"), e.where("event_type = 'error'"), "half", "ts", "event_id", "last")
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_jdbc_round_trip_in_parts(spark, sf):
    """Against the database that Spark ships with; in memory, so on one machine alone."""
    url, df = "jdbc:derby:memory:tarnwick;create=true", sources.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    sources.write_jdbc(df.coalesce(2), url, "orders_copy")
    back = sources.read_jdbc(spark, url, "orders_copy", "o_orderkey", 4)
    assert back.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sources.write_jdbc(df.limit(0), url, "empty_copy")
    assert sources.read_jdbc(spark, url, "empty_copy", "o_orderkey").count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    import pytest

    class Elsewhere:
        conf, sparkContext = type("Conf", (), {"get": staticmethod(lambda key, default: None)}), type("Context", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sources.scratch(Elsewhere, "x")


def test_excluded_peers_with_nulls(spark):
    rows = [("a", 1, 5), ("a", 1, None), ("a", 2, 7), ("a", 2, 1), ("a", 3, None), ("b", 1, 2)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = df.select("k", "o", "v", sum_excluding_peers("v", "k", "o").alias("no_group"), sum_excluding_peers("v", "k", "o", True).alias("no_ties")).collect()
    want = []
    for k, o, v in rows:
        rest = [x for kk, oo, x in rows if kk == k and oo < o and x is not None]
        own = rest + ([v] if v is not None else [])
        want.append((k, o, v, sum(rest) if rest else None, sum(own) if own else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_batches_replayed_stand_once(spark, sf):
    stream = streaming.events_stream(spark, f"{sf}/event*.parquet", sources.table(spark, sf, "events").schema, "1 hour").select("event_id")
    out = streaming.run_batches(stream, "replayed", "append")
    assert out.count() == sources.table(spark, sf, "events").count() == out.select("event_id").distinct().count()
