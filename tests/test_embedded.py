import datetime
import os
import subprocess
import sys

import pytest

from tarnwick.sources import scratch
from tarnwick.sources.embedded import read_databases, write_databases

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ON_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__
shared, sf = sys.argv[1:]
conf = {"spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"{shared}/warehouse", "spark.ui.enabled": "false", "spark.executor.memory": "1g"}
b = SparkSession.builder.master("local-cluster[2,1,1024]")
for k, v in conf.items():
    b = b.config(k, v)
spark = b.getOrCreate()
df = __spark_entry__.queries()["jdbc_round_trip"](spark, sf)
want = spark.read.parquet(f"{sf}/customer.parquet").select(df.columns)
assert df.dtypes == want.dtypes, df.dtypes
for _ in range(2):
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
spark.stop()
"""


def test_jdbc_round_trip_on_executors_of_their_own(sf, tmp_path):
    """Driver and executors are different processes here, which share a folder and no memory."""
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", ON_A_CLUSTER, str(tmp_path), sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, "\n".join(line for line in done.stderr.splitlines() if "Error" in line or "Exception" in line)[:3000]


@pytest.mark.parametrize("parts", [1, 5])
def test_databases_return_odd_values(spark, parts):
    texts = ["", None, '"', 'a"b', '""', "a,b", "a\nb", "a\r\nb", "\r", "\n", " lead", "trail ", "ü\U0001f600", "x" * 100000, "NULL", "\\", "\x01", '",', ',"']
    doubles = [0.1, -1e300, 5e-324, None, 1 / 3]
    rows = [(k, t, doubles[k % 5], k if k % 3 else None, datetime.date(1900 + k, 2, 3) if k % 4 else None) for k, t in enumerate(texts)]
    rows += [(None,) * 5, (2**63 - 1, "m", 1.7976931348623157e308, -(2**31), datetime.date(1, 1, 1)), (-(2**63), "m", 1e-310, 2**31 - 1, None)]
    df = spark.createDataFrame(rows, "key long, t string, x double, i int, d date")
    urls = write_databases(df, scratch(spark, "odd"), "odd", parts)
    back = read_databases(spark, urls, "odd", df.schema)
    assert len(urls) == parts and back.dtypes == df.dtypes
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, rows))


def test_databases_of_nulls_alone_and_of_no_rows(spark):
    for rows in ([(None,), ("",), (None,)], []):
        df = spark.createDataFrame(rows, "t string")
        urls = write_databases(df, scratch(spark, "few"), "few", 1)
        back = read_databases(spark, urls, "few", df.schema)
        assert len(urls) == bool(rows) and back.dtypes == df.dtypes
        assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, rows))


def test_a_value_that_the_database_refuses_is_an_error(spark):
    with pytest.raises(Exception, match="SYSCS_IMPORT_TABLE"):
        write_databases(spark.createDataFrame([(1, float("nan"))], "k long, x double"), scratch(spark, "nan"), "nan", 1)
