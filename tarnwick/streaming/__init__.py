"""Structured Streaming over event tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnwick.sources import scratch


def events_stream(spark: SparkSession, path_glob: str, schema, watermark: str) -> DataFrame:
    """A file stream of events with event time as a zoned timestamp (session zone UTC) and a watermark."""
    return spark.readStream.schema(schema).parquet(path_glob).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def windowed(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Counts and values by window and type; the same call serves batch and stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs what is there to its end into a memory table of that name."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_table(df: DataFrame, tag: str) -> DataFrame:
    """Runs what is there to its end in append mode into Parquet in the shared folder, so no result meets on the driver."""
    path = scratch(df.sparkSession, tag)
    df.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_batches(df: DataFrame, tag: str, mode: str) -> DataFrame:
    """Runs what is there to its end; foreachBatch appends each batch's rows, with its number, to Parquet in the shared folder.

    A batch that is run again after a failure replaces its own folder, so its rows stand once.
    """
    path = scratch(df.sparkSession, tag)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, batch int").option("basePath", path).parquet(path)


def totals_by_processor(events: DataFrame, by: str, value: str, ttl_ms: int | None = None) -> DataFrame:
    """running_totals() by transformWithStateInPandas; needs the RocksDB state store.

    ttl_ms: a key's state is forgotten when no batch has touched it for so long (by the clock), and its totals start anew.
    A run of what is there then ends only where spark.sql.streaming.noDataMicroBatches.enabled is false.
    """
    kind = events.schema[by].dataType.simpleString()

    class Totals(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.total = handle.getValueState("total", "n long, total double", ttl_ms)

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            n, total = self.total.get() if self.total.exists() else (0, 0.0)
            for f in rows:
                n, total = n + len(f), total + float(f[value].sum())
            self.total.update((n, total))
            yield pd.DataFrame({by: [key[0]], "n": [n], "total": [total]})

        def close(self) -> None:
            pass

    return events.select(by, value).groupBy(by).transformWithStateInPandas(Totals(), f"{by} {kind}, n long, total double", "Append", "ProcessingTime" if ttl_ms else "none")


def running_totals(events: DataFrame, by: str, value: str) -> DataFrame:
    """After each batch a row (by, n, total) of every key in it, by state that Spark keeps per key.

    A value of null counts as a row and adds nothing; total rises with the batches only where values are not negative.
    """

    def add(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
        state.update((n, total))
        yield pd.DataFrame({by: [key[0]], "n": [n], "total": [total]})

    kind = events.schema[by].dataType.simpleString()
    return events.select(by, value).groupBy(by).applyInPandasWithState(add, f"{by} {kind}, n long, total double", "n long, total double", "append", "NoTimeout")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which transformWithState needs."""
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def inactivity(events: DataFrame, by: str, at: str, gap_ms: int, seen: DataFrame | None = None) -> DataFrame:
    """A row (by, last_seen) for each time of a key that no row follows within the gap, once the watermark is past its end.

    A key has one event-time timer, at the end of its first open gap; when it fires, all gaps that are over by then come out
    at once and the timer moves to the next, so calls grow with keys and batches and not with rows.
    Rows may come out of order within the watermark's delay: the state keeps the times that late rows may still need and
    those whose timers are to come, and drops the others. seen(by, last_seen): initial state, such as an earlier run's
    last times. Rows of null time are ignored.
    """
    kind = events.schema[by].dataType.simpleString()
    gap = gap_ms * 1000
    micros = lambda s: s.dropna().astype("datetime64[us, UTC]" if s.dt.tz is not None else "datetime64[us]").astype("int64")

    def ends(times: list[int]) -> list[int]:
        """Those of the sorted times that no other follows within the gap."""
        return [t for t, after in zip(times, [*times[1:], None], strict=True) if after is None or after > t + gap]

    due = lambda t: -(-(t + gap) // 1000)

    class Idle(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.times = handle, handle.getValueState("times", "times array<long>")

        def _held(self) -> list[int]:
            held = self.times.get()
            return list(held[0]) if held else []

        def _add(self, new: set[int], watermark: int) -> None:
            held = self._held()
            times = sorted({*held, *new})
            last = ends(times)
            before = due(ends(held)[0]) if held else None
            if due(last[0]) != before:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(due(last[0]))
            wanted = set(last)
            self.times.update(([t for t in times if t in wanted or t >= watermark * 1000],))

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            new = {int(t) for f in rows for t in micros(f[at])}
            if new:
                self._add(new, timerValues.getCurrentWatermarkInMs())
            return iter(())

        def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
            new = {int(t) for t in micros(initialState["last_seen"])}
            if new:
                self._add(new, 0)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            watermark, held = timerValues.getCurrentWatermarkInMs(), self._held()
            last = ends(held)
            over = [t for t in last if due(t) <= watermark]
            wanted = set(last[len(over) :])
            kept = [t for t in held if t in wanted or (t >= watermark * 1000 and t not in over)]
            if wanted:
                self.handle.registerTimer(due(last[len(over)]))
            self.times.update((kept,)) if kept else self.times.clear()
            if over:
                yield pd.DataFrame({by: [key[0]] * len(over), "last_seen": pd.to_datetime(over, unit="us", utc=True)})

        def close(self) -> None:
            pass

    state = {"initialState": seen.select(by, F.col("last_seen").cast("timestamp")).groupBy(by)} if seen is not None else {}
    return events.select(by, at).groupBy(by).transformWithStateInPandas(Idle(), f"{by} {kind}, last_seen timestamp", "Append", "EventTime", **state)
