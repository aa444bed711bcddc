"""A table in databases of its own, one a task, which all executors read over JDBC.

Derby, the database in Spark's jars, lives in one JVM, and no server for it is among them: a table that the driver or one
executor makes is not seen by the others. So each task loads its rows into a database of its own (a bulk import, in a
small JVM beside the Python worker), closes it, and puts it into the shared folder as a jar. Derby opens databases in
jars read-only and without locks, from any number of JVMs, so a read may be repeated anywhere.

A task that runs again makes a database of another name; only those of tasks that ended well are returned.
The folder has to be mounted on the driver and on all executors. Derby holds no NaN or infinite double, which is an error, and
takes -0.0 as 0.0.
"""

from __future__ import annotations

import glob
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tarnwick.sources import read_jdbc
from tarnwick.sources.ledger import _folder

#: Spark's types that are taken, with Derby's.
_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "CLOB", "date": "DATE"}


def _import(at: str, statements: list[str]) -> None:
    """Runs statements over JDBC against a new database, at/db, and closes it."""
    from py4j.java_gateway import JavaGateway
    from py4j.protocol import Py4JJavaError
    from pyspark.find_spark_home import _find_spark_home

    jars = os.path.join(_find_spark_home(), "jars")
    options = ["-Xmx128m", "-XX:+UseSerialGC", "-XX:TieredStopAtLevel=1", f"-Dderby.system.home={at}", "-Dderby.storage.pageSize=8192"]
    gateway = JavaGateway.launch_gateway(jarpath=glob.glob(f"{jars}/py4j-*.jar")[0], classpath=os.pathsep.join(glob.glob(f"{jars}/derby*.jar")), javaopts=options, die_on_exit=True, enable_auth=True)
    try:
        drivers = gateway.jvm.java.sql.DriverManager
        con = drivers.getConnection("jdbc:derby:db;create=true")
        for s in statements:
            con.createStatement().execute(s)
        con.close()
        drivers.getConnection("jdbc:derby:db;shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # Derby's word for a database that closed well
            raise ValueError(f"{statements}: {e.java_exception.toString()}") from None
    finally:
        gateway.shutdown()
        gateway.java_process.stdin.close()
        gateway.java_process.wait()


def _packed(at: str, jar: str) -> None:
    """at/db as a jar, uncompressed, so that pages are found by their offset."""
    with zipfile.ZipFile(jar, "w", zipfile.ZIP_STORED) as z:
        for folder, _, files in os.walk(f"{at}/db"):
            for f in files:
                if not f.endswith(".lck"):
                    z.write(f"{folder}/{f}", os.path.relpath(f"{folder}/{f}", at))


def write_databases(df: DataFrame, folder: str, table: str, parts: int = 8) -> list[str]:
    """df's rows, dealt to parts databases in folder, a path that driver and executors share; their URLs."""
    at = _folder({"path": folder})
    columns = ", ".join(f'"{c.name}" {_TYPES[c.dataType.simpleString()]}' for c in df.schema)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as own:
            rows, out = 0, None
            for b in batches:
                out = out or csv.CSVWriter(f"{own}/rows.csv", b.schema, write_options=csv.WriteOptions(include_header=False))
                out.write(b)
                rows += b.num_rows
            if not rows:
                return
            out.close()
            _import(own, [f'CREATE TABLE "{table}" ({columns})', f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{table}', '{own}/rows.csv', ',', '\"', 'UTF-8', 1)"])
            os.makedirs(at, exist_ok=True)
            jar = f"{at}/{uuid.uuid4().hex}.jar"
            _packed(own, jar)
        yield pa.RecordBatch.from_arrays([pa.array([f"jdbc:derby:jar:({jar})db"])], names=["url"])

    return [r.url for r in df.repartition(parts).mapInArrow(load, "url string").collect()]


def read_databases(spark: SparkSession, urls: list[str], table: str, schema: StructType) -> DataFrame:
    """The rows of write_databases, one partition a database; schema: that of a table without rows."""
    return reduce(DataFrame.unionAll, [read_jdbc(spark, url, f'"{table}"') for url in urls] or [spark.createDataFrame([], schema)])
