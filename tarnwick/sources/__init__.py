"""Sources and sinks: fixture tables, and a writer that deals rows by key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The fixture tables.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of all fixture tables, for SQL."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """parquet, orc, json, csv, xml or text, with a stated schema where the format has none of its own."""
    r = spark.read.format(kind).options(**options)
    return (r.schema(schema) if schema else r).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "error", **options: str) -> None:
    w = df.write.format(kind).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, parts: int = 8, quote: str = '"', **options: str) -> DataFrame:
    """A database's table; with a numeric or date column the read is split between its least and greatest value. quote: the database's mark around names."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        low, high = spark.read.format("jdbc").options(url=url, query=f"SELECT min({quote}{column}{quote}) AS lo, max({quote}{column}{quote}) AS hi FROM {table}", **options).load().first()
        if low is not None:
            r = r.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return r.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "error", **options: str) -> None:
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, **options).save()


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a temporary one only for a local master, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names the folder that driver and executors share; it is not set")
        at = "file://" + tempfile.mkdtemp(prefix="tarnwick-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it is computed once and outlives the executors that made it."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
