"""Structured Streaming queries over the event table, run to the end of what is there and read back.

In append mode a window is out once the watermark (an hour behind the last event) has passed its end; the SQL says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick import streaming
from tarnwick.plans.registry import query
from tarnwick.sources import scratch, table, write
from tarnwick.sources.ledger import Ledger


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.events_stream(spark, f"{sf_dir}/event*.parquet", table(spark, sf_dir, "events").schema, "1 hour")


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
GROUP BY 1, 2 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streaming.run_to_table(streaming.windowed(_events(spark, sf_dir), "1 day"), "tumbling")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT *, time_bucket(INTERVAL '6 hours', ts) - to_hours(6 * k) AS start FROM events, (SELECT unnest([0, 1, 2, 3]) AS k))
GROUP BY 1, 2 HAVING start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streaming.run_to_table(streaming.windowed(_events(spark, sf_dir), "1 day", "6 hours"), "sliding")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS no
FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events))
GROUP BY user_id, no HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return streaming.run_to_table(e.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), "sessions")


@query("SELECT event_id, user_id FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream twice over, each event once."""
    twice = _events(spark, sf_dir).unionByName(_events(spark, sf_dir))
    return streaming.run_to_table(twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id"), "deduplicated")


@query("SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    e = _events(spark, sf_dir).where("event_type = 'purchase'").join(customers, F.col("user_id") == F.col("c_custkey"))
    return streaming.run_to_table(e.select("event_id", "c_name"), "static-join")


@query("""SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR
WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = _events(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("u"), F.col("ts").alias("at"))
    bought = _events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", "ts")
    near = (F.col("u") == F.col("user_id")) & (F.col("ts") >= F.col("at")) & (F.col("ts") <= F.col("at") + F.expr("INTERVAL 1 HOUR"))
    return streaming.run_to_table(clicks.join(bought, near).select("click", "purchase"), "interval-join")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streaming.run_to_table(streaming.running_totals(_events(spark, sf_dir), "user_id", "value"), "running-totals")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def stream_foreach_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.run_batches(_events(spark, sf_dir).where("event_type = 'error'").select("event_id", "user_id"), "foreach-batch", "append").drop("batch")


def _last(rows: DataFrame) -> DataFrame:
    """Of each window and type the row of the last batch."""
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "v.n", "v.total")


_DAYS = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query(_DAYS)
def stream_update_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode gives every window, open ones included, as it changes."""
    return _last(streaming.run_batches(streaming.windowed(_events(spark, sf_dir), "1 day"), "update", "update"))


@query(_DAYS)
def stream_complete_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last(streaming.run_batches(streaming.windowed(_events(spark, sf_dir), "1 day"), "complete", "complete"))


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-11'
GROUP BY 1, 2 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty days come first, in two batches; the ten days before are behind the first one's watermark and are dropped."""
    events, path = table(spark, sf_dir, "events"), scratch(spark, "late")
    for part in ("ts >= timestamp_ntz '2024-01-11' AND ts < timestamp_ntz '2024-01-29'", "ts >= timestamp_ntz '2024-01-29'", "ts < timestamp_ntz '2024-01-11'"):
        write(events.where(part), f"{path}/in", mode="append")
        days = streaming.windowed(streaming.events_stream(spark, f"{path}/in", events.schema, "1 hour"), "1 day")
        # Each part is a run of its own with the checkpoint of the one before, however many files it has.
        days.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(days.schema).parquet(f"{path}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_state_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed state in RocksDB; the store is chosen for this query alone."""
    with streaming.rocksdb(spark):
        out = streaming.run_to_table(streaming.totals_by_processor(_events(spark, sf_dir), "user_id", "value"), "state-processor")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


_CLICKS = "(SELECT event_id AS click, user_id, ts FROM events WHERE event_type = 'click') c"
_BOUGHT = "(SELECT event_id AS purchase, user_id, ts FROM events WHERE event_type = 'purchase') p"
#: The watermark of a join: an hour behind the last row of the side whose last row is earlier.
_BOTH = "(SELECT least(max(ts) FILTER (WHERE event_type = 'click'), max(ts) FILTER (WHERE event_type = 'purchase')) - INTERVAL 1 HOUR FROM events)"
_WITHIN = "c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR"
_MARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _outer(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    clicks = _events(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("u"), F.col("ts").alias("at"))
    bought = _events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", "ts")
    near = (F.col("u") == F.col("user_id")) & (F.col("ts") >= F.col("at")) & (F.col("ts") <= F.col("at") + F.expr("INTERVAL 1 HOUR"))
    return streaming.run_to_table(clicks.join(bought, near, how).select("click", "purchase"), f"{how}-join")


@query(f"SELECT click, purchase FROM {_CLICKS} LEFT JOIN {_BOUGHT} ON {_WITHIN} WHERE purchase IS NOT NULL OR c.ts + INTERVAL 1 HOUR <= {_BOTH}")
def stream_left_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A click without a purchase is out once the watermark is an hour past it."""
    return _outer(spark, sf_dir, "left_outer")


@query(f"SELECT click, purchase FROM {_CLICKS} FULL JOIN {_BOUGHT} ON {_WITHIN} WHERE (purchase IS NOT NULL OR c.ts + INTERVAL 1 HOUR <= {_BOTH}) AND (click IS NOT NULL OR p.ts <= {_BOTH})")
def stream_full_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase without a click before it is out once the watermark has passed it."""
    return _outer(spark, sf_dir, "full_outer")


@query(f"SELECT user_id, ts AS last_seen FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM events) WHERE (following IS NULL OR following > ts + INTERVAL 2 HOUR) AND ts + INTERVAL 2 HOUR <= {_MARK}")
def stream_inactivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time timers: users of whom nothing is seen for two hours."""
    with streaming.rocksdb(spark):
        out = streaming.run_to_table(streaming.inactivity(_events(spark, sf_dir), "user_id", "ts", 2 * 3600 * 1000), "inactivity")
    return out.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'view'")
def stream_python_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one Python data source to another: three commits are read as a stream and written as one."""
    spark.dataSource.register(Ledger)
    path, e = scratch(spark, "ledger"), table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    for kind in ("event_type = 'click'", "event_type = 'view'", "event_type NOT IN ('click', 'view')"):
        e.where(kind).write.format("ledger").mode("append").save(f"{path}/in")
    stream = spark.readStream.format("ledger").load(f"{path}/in").where("event_type <> 'view'")
    stream.writeStream.format("ledger").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.format("ledger").load(f"{path}/out")
