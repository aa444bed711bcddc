"""Where queries and the SQL they are held against are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwick.sources import TABLES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def plain(name: str, sql: str, spark_sql: str | None = None) -> None:
    """A query stated in SQL for both engines (spark_sql where the dialects differ)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", sql)}
        return spark.sql(re.sub(r"\b(" + "|".join(tables) + r")\b(?=[\s,)]|$)", r"{\1}", spark_sql or sql), **tables)

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = sql
