"""Interval joins, as-of joins in all directions, and the cells under them, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwick.operators.asof import asof_merge
from tarnwick.operators.cells import Cells
from tarnwick.operators.intervals import interval_join, stab_join


def plan(df):
    return df._jdf.queryExecution().toString()


def intervals(seed, n, top=1000, dense=0.5):
    """Half of them in a hundredth of the line, some long, empty, inverted or null."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        low = r.randrange(500, 510) if r.random() < dense else r.randrange(top)
        high = r.choice([low, low + 1, low + r.randrange(30), low + top, low - 5])
        rows.append((i, r.choice(["a", "a", "a", "b", None]), None if r.random() < 0.03 else low, None if r.random() < 0.03 else high))
    return rows


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("closed", [False, True])
def test_interval_join(spark, by, closed):
    a, b = intervals(1, 150), intervals(2, 130)
    left = spark.createDataFrame(a, "i int, k string, low int, high int").repartition(3)
    right = spark.createDataFrame(b, "j int, k2 string, low2 int, high2 int").withColumnRenamed("k2", "k" if by else "k2").repartition(2)
    got = interval_join(left, right, ("low", "high"), ("low2", "high2"), by, closed, most=16)
    less = (lambda x, y: x <= y) if closed else (lambda x, y: x < y)
    want = sorted((x[0], y[0]) for x in a for y in b if None not in (x[2], x[3], y[2], y[3]) and less(x[2], x[3]) and less(y[2], y[3]) and less(x[2], y[3]) and less(y[2], x[3]) and (not by or x[1] is not None and x[1] == y[1]))
    pairs = [(r.i, r.j) for r in got.collect()]
    assert sorted(pairs) == want and len(set(pairs)) == len(pairs) > 500
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_interval_join_of_no_rows(spark):
    none = spark.createDataFrame([], "i int, low int, high int")
    some = spark.createDataFrame([(1, 2, 5)], "j int, low2 int, high2 int")
    assert interval_join(none, some, ("low", "high"), ("low2", "high2")).count() == 0
    assert interval_join(some, none, ("low2", "high2"), ("low", "high")).count() == 0


def test_dense_stretch_and_hot_key_are_many_cells(spark):
    """A tenth of the line holds 90 % of the points, one key 80 %: no cell holds much of either, and copies stay few."""
    n = 20_000
    points = spark.range(n).select(F.when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("k"), F.when(F.col("id") % 10 > 0, F.rand(3) * 100).otherwise(F.rand(4) * 1000).alias("x"))
    points = spark.createDataFrame(points.collect(), points.schema)  # the same numbers at every use
    cells = Cells(points, [], "x", most=64)
    sizes = [r["count"] for r in cells.add(points, _cell=F.col("x")).groupBy("_cell").count().collect()]
    assert 32 <= len(sizes) <= 66 and max(sizes) < 4 * n / len(sizes)
    by_key = Cells(points, ["k"], "x", most=64)
    sizes = by_key.add(points, _cell=F.col("x")).groupBy("k", "_cell").count().collect()
    hot = [r["count"] for r in sizes if r.k == "hot"]
    assert len(hot) > 25 and max(hot) < 4 * 0.8 * n / len(hot)
    assert by_key.n <= 64  # bounded, whatever the number of keys
    spans = spark.range(300).select(F.col("id").alias("j"), (F.col("id") * 3.0).alias("low"), (F.col("id") * 3.0 + 40).alias("high"))
    copies = cells.add(spans, a=F.col("low"), b=F.col("high")).agg(F.sum(F.col("b") - F.col("a") + 1)).first()[0]
    assert copies <= 300 * 2 + stab_join(points, spans, "x", "low", "high").count() / (n / 64 / 4)


def brute_asof(left, right, direction, tolerance, exact):
    out = []
    for i, k, t in left:
        found = None
        if k is not None and t is not None:
            mine = [(rt, v) for rk, rt, v in right if rk == k and rt is not None and (exact or rt != t)]
            back, ahead = max((x for x in mine if x[0] <= t), default=None), min((x for x in mine if x[0] >= t), default=None)
            if direction == "nearest":
                found = ahead if back is None or (ahead is not None and ahead[0] - t < t - back[0]) else back
            else:
                found = back if direction == "backward" else ahead
            if found is not None and tolerance is not None and abs(found[0] - t) > tolerance:
                found = None
        out.append((i, k, t, *(found or (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof_merge(spark, direction, exact, tolerance):
    """Ties on either side, nulls, keys of one side alone; one cell a key, and a hot key in many cells, some without a row of right."""
    r = random.Random(7)
    time = lambda: None if r.random() < 0.05 else r.randrange(400) // r.choice([1, 8])
    left = [(i, r.choice(["hot", "hot", "b", "c", None]), time()) for i in range(300)]
    right = [(r.choice(["hot", "hot", "b", "d", None]), time(), r.randrange(5)) for _ in range(120)]
    ldf = spark.createDataFrame(left, "i int, k string, t int").repartition(3)
    rdf = spark.createDataFrame(right, "k string, t int, v int").withColumn("at", F.col("t")).repartition(3)
    want = brute_asof(left, right, direction, tolerance, exact)
    for most in (4096, 24):
        got = asof_merge(ldf, rdf, ["k"], "t", {"at": "found_at", "v": "found"}, direction, None if tolerance is None else F.lit(tolerance), exact, ties=["v"], most=most)
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert "NestedLoop" not in plan(got)


def test_asof_merge_null_value_matches(spark):
    left = spark.createDataFrame([(1, "a", 5)], "i int, k string, t int")
    right = spark.createDataFrame([("a", 1, 9), ("a", 4, None)], "k string, t int, v int")
    assert asof_merge(left, right, ["k"], "t", {"v": "v"}).first().v is None
    assert asof_merge(left, right.limit(0), ["k"], "t", {"v": "v"}).first().v is None
    assert asof_merge(left.limit(0), right, ["k"], "t", {"v": "v"}).count() == 0
