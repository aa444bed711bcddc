"""Exact quantiles against Spark's percentile, and that no task reads a group's rows."""

import random

from pyspark.sql import functions as F

from tarnwick.operators.quantiles import quantiles
from tarnwick.plans import catalog


def test_quantiles(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 1.5, r.random() * 100, r.random() * 100])) for _ in range(20_000)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"p0": 0.0, "p25": 0.25, "p90": 0.9, "p100": 1.0}
    got = {x.k: x for x in quantiles(df, "k", "v", shares).collect()}
    want = df.groupBy("k").agg(*(F.percentile("v", F.lit(p)).alias(a) for a, p in shares.items())).collect()
    assert len(got) == len(want) == 6
    for w in want:
        assert all((got[w.k][a] is None) == (w[a] is None) and (w[a] is None or abs(got[w.k][a] - w[a]) < 1e-9) for a in shares)


def test_no_buffer_of_a_group(spark, sf):
    plan = catalog.QUERIES["quantiles"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan
