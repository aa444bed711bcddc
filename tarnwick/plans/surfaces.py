"""Sources and sinks, and the user-defined function surface, as registered queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.plans.registry import query
from tarnwick.sources import read, scratch, table, write
from tarnwick.sources.calendar import Calendar
from tarnwick.sources.embedded import read_databases, write_databases
from tarnwick.sources.ledger import Ledger


def _round_trip(kind: str, **options: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, path = table(spark, sf_dir, "customer"), scratch(spark, kind)
        write(df, path, kind, **options)
        return read(spark, path, kind, df.schema.simpleString()[7:-1].replace(":", " "), **options)

    run.__name__ = f"round_trip_{kind}"
    return query("SELECT * FROM customer")(run)


for _kind, _options in (("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"header": "true"}), ("xml", {"rowTag": "row"})):
    _round_trip(_kind, **_options)


@query("SELECT count(*) AS n, count(DISTINCT value) AS lines FROM (SELECT c_name AS value FROM customer)")
def round_trip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "text")
    write(table(spark, sf_dir, "customer").select(F.col("c_name").alias("value")), path, "text")
    return read(spark, path, "text").agg(F.count("*").alias("n"), F.countDistinct("value").alias("lines"))


@query("SELECT r_regionkey, r_name FROM region")
def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table's CSV files read as bytes and taken apart."""
    path = scratch(spark, "binary")
    write(table(spark, sf_dir, "region"), path, "csv")
    lines = read(spark, path, "binaryFile", pathGlobFilter="*.csv").select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    cells = F.split("line", ",")
    return lines.where("line <> ''").select(cells[0].cast("int").alias("r_regionkey"), cells[1].alias("r_name"))


@query("SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_with_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    return left.unionByName(right, allowMissingColumns=True)


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_returnflag")
def partitioned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by flag, so the read opens one folder."""
    path = scratch(spark, "partitioned")
    write(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), path, partition_by=("l_returnflag",))
    return read(spark, path, schema="l_orderkey long, l_returnflag string").where("l_returnflag = 'R'").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT CAST(date_trunc('day', o_orderdate) AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01' GROUP BY 1")
def python_data_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(Calendar)
    days = spark.read.format("calendar").option("from", "1996-01-01").option("until", "1996-03-01").load()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return orders.join(days, "day").groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root FROM orders")
def udf_vectorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def root(x: pd.Series) -> pd.Series:
        return np.sqrt(x)

    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(root("o_totalprice"), 6).alias("root"))


@query("SELECT n_nationkey, lower(n_name) AS name FROM nation")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain Python function of one value, sent in Arrow batches."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.udf(str.lower, "string", useArrow=True)("n_name").alias("name"))


@query("SELECT n_regionkey, CAST(sum(n_nationkey * n_nationkey) AS DOUBLE) AS squares FROM nation GROUP BY n_regionkey")
def udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-defined aggregate in two steps: partial sums by batch, then Spark's own sum, so no group meets in Python."""

    def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield (b["n_nationkey"].astype("float64") ** 2).groupby(b["n_regionkey"]).sum().rename("s").reset_index()

    parts = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").mapInPandas(squares, "n_regionkey int, s double")
    return parts.groupBy("n_regionkey").agg(F.round(F.sum("s"), 4).alias("squares"))


@query("SELECT c_nationkey, round(median(c_acctbal), 4) AS mid FROM customer GROUP BY c_nationkey")
def udf_grouped_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def middle(x: pd.Series) -> float:
        return float(x.median())

    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(middle("c_acctbal"), 4).alias("mid"))


@query("SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS off FROM customer")
def udf_grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def centred(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c_custkey": f["c_custkey"], "off": (f["c_acctbal"] - f["c_acctbal"].mean()).round(4)})

    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal").groupBy("c_nationkey").applyInPandas(centred, "c_custkey long, off double")


@query("""SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation""")
def udf_cogrouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def sizes(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n_nationkey": [key[0]], "customers": [int(left["n"].sum())], "suppliers": [int(right["n"].sum())]})

    count = lambda name, key: table(spark, sf_dir, name).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    both = count("customer", "c_nationkey").groupBy("k").cogroup(count("supplier", "s_nationkey").groupBy("k")).applyInPandas(sizes, "n_nationkey int, customers long, suppliers long")
    every = table(spark, sf_dir, "nation").select("n_nationkey").join(both, "n_nationkey", "left")
    return every.na.fill(0, ["customers", "suppliers"])


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm FROM embeddings")
def udf_arrow_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.linalg.norm(np.asarray(v.as_py(), float)) for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(x, 4), pa.float64())], names=["vec_id", "norm"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(norms, "vec_id long, norm double")


@query("SELECT n_nationkey, CAST(i AS INTEGER) AS step FROM (SELECT n_nationkey, unnest(range(0, n_regionkey + 1)) AS i FROM nation)")
def udf_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="step int")
    class Steps:
        def eval(self, n: int):
            for i in range(n + 1):
                yield (i,)

    spark.udtf.register("steps_upto", Steps)
    return spark.sql("SELECT n_nationkey, step FROM {n} , LATERAL steps_upto(n_regionkey)", n=table(spark, sf_dir, "nation"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION net_price(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN round(price * (1 - discount), 4)")
    return spark.sql("SELECT l_orderkey, l_partkey, l_linenumber, net_price(l_extendedprice, l_discount) AS net FROM {l}", l=table(spark, sf_dir, "lineitem"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey >= 9000 AND o_orderstatus = 'F'")
def python_data_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read by a Python data source; both comparisons are pushed down to its reader."""
    spark.dataSource.register(Ledger)
    path, key = scratch(spark, "ledger"), "spark.sql.python.filterPushdown.enabled"
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.format("ledger").mode("append").save(path)
    spark.conf.set(key, "true")
    return spark.read.format("ledger").option("filters", "true").load(path).where("o_orderkey >= 9000 AND o_orderstatus = 'F'")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def jdbc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the database in Spark's jars: loaded and read by the executors, a part each."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return read_databases(spark, write_databases(df, scratch(spark, "jdbc"), "customer"), "customer", df.schema)
