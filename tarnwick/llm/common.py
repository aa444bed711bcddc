"""Shared helpers: scratch tables in the cluster's shared folder, hashing, column choice."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only for a local master, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names the folder that driver and executors share; it is not set")
        at = "file://" + tempfile.mkdtemp(prefix="tarnwick-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_scopes: list[list[DataFrame]] = []


def materialize(df: DataFrame, tag: str, lasting: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again; discard() deletes it, or, unless it is lasting,
    the end of the scope around it.

    It cuts the lineage, survives the loss of executors and keeps column pruning for later reads.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return placed(spark.read.schema(df.schema).parquet(path), path, lasting=lasting)


def placed(df: DataFrame, path: str, table: str | None = None, lasting: bool = False) -> DataFrame:
    """Notes where a table of the shared folder lies, and its name in the catalog if it has one."""
    df._placed = (path, table)
    if _scopes and not lasting:
        _scopes[-1].append(df)
    return df


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that materialize() wrote and that no later plan reads."""
    for df in tables:
        if df is None or getattr(df, "_placed", None) is None:
            continue
        spark, (path, name) = df.sparkSession, df._placed
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        df._placed = None


@contextmanager
def scope() -> Iterator[None]:
    """Tables materialized inside are deleted at its end, when what was made of them has been written."""
    _scopes.append([])
    try:
        yield
    finally:
        discard(*_scopes.pop())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5 (an id of null: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _murmur3(v: int, seed: int = 42) -> int:
    """Spark's hash() of a bigint."""
    m = 0xFFFFFFFF
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    h = seed
    for k in (v & m, (v >> 32) & m):
        k = rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
        h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & m
    h ^= 8
    h = (h ^ (h >> 16)) * 0x85EBCA6B & m
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def even_keys(n: int, parts: int) -> list[int]:
    """n bigints that hash partitioning deals evenly over parts partitions, so that buckets don't collide by chance."""
    quota, found, v = [0] * parts, [], 0
    most = -(-n // parts)
    while len(found) < n:
        p = _murmur3(v) % parts
        if quota[p] < most:
            quota[p] += 1
            found.append(v)
        v += 1
    return found
