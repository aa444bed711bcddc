"""Peer-group frames, frames with exclusions, vector search and count-min sketches against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.operators.frames import exclude_frame, groups_frame
from tarnwick.operators.sketches import CountMin
from tarnwick.operators.vectors import top_products


def fold(fn, values, order=None):
    if fn in ("first", "last"):
        return None if not values else values[0 if fn == "first" else -1]
    known = [v for v in values if v is not None]
    if fn == "count":
        return len(known)
    if not known:
        return None
    return {"min": min, "max": max, "sum": sum, "avg": lambda x: sum(x) / len(x)}[fn](known)


def rows_of(seed, n=160):
    """A hot key, null keys, orders and values, and many ties."""
    r = random.Random(seed)
    return [(i, r.choice(["hot", "hot", "hot", "b", None]), r.choice([None, *range(25)]), r.choice([None, *range(50)])) for i in range(n)]


FRAMES = [(0, 0), (1, 1), (3, 0), (0, 4), (None, 0), (None, 2), (1, None), (0, None), (None, None)]


@pytest.mark.parametrize("before,after", FRAMES)
def test_groups_frame(spark, before, after):
    rows, functions = rows_of(1), ("sum", "count", "min", "max", "avg")
    df = spark.createDataFrame(rows, "i int, k string, o int, v int").repartition(3)
    want = []
    for i, k, o, v in rows:
        own = [x for x in rows if x[1] == k]
        order = sorted({x[2] for x in own}, key=lambda x: (x is not None, x or 0))
        at = order.index(o)
        near = set(order[0 if before is None else max(at - before, 0) : None if after is None else at + after + 1])
        values = [x[3] for x in own if x[2] in near]
        want.append((i, *(fold(f, values) for f in functions)))
    for most, block in ((None, 1 << 16), (32, 3)):
        got = groups_frame(df, ["k"], "o", {f: (f, "v") for f in functions}, before, after, most, block).select("i", *functions)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_groups_frame_sorts_groups_not_rows(spark):
    """No row is in a window: the table of rows is aggregated and joined, and a hot key's groups are in many blocks."""
    df = spark.range(20_000).selectExpr("id", "id % 2 AS k", "id % 5000 AS o", "id % 7 AS v")
    got = groups_frame(df, ["k"], "o", {"least": ("min", "v")}, 1, 1, 64, 256)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in text.split("\n") if "Window" in x and "windowspec" in x]
    assert windows and all("_block" in x for x in windows)
    assert got.count() == 20_000


@pytest.mark.parametrize("exclude", ["no others", "current row", "group", "ties"])
@pytest.mark.parametrize("kind,start,end", [("rows", -2, 3), ("rows", None, 0), ("rows", None, 2), ("rows", -1, None), ("rows", None, None), ("rows", 0, 0), ("range", None, 0), ("range", 0, None), ("range", None, None), ("range", -2, 1), ("range", 0, 0)])
def test_exclude_frame(spark, kind, start, end, exclude):
    rows, functions = rows_of(2, 90), ("min", "max", "first", "last", "sum", "count")
    df = spark.createDataFrame(rows, "i int, k string, o int, v int").repartition(3)
    got = exclude_frame(df, ["k"], "o", ["i"], {f: (f, "v") for f in functions}, kind, start, end, exclude).select("i", *functions)
    want = []
    for row in rows:
        own = sorted((x for x in rows if x[1] == row[1]), key=lambda x: (x[2] is not None, x[2] or 0, x[0]))
        at = own.index(row)
        if kind == "rows":
            frame = own[0 if start is None else max(at + start, 0) : None if end is None else at + end + 1]
        else:
            o = row[2]
            low = (lambda x: True) if start is None else (lambda x: x == o if o is None or x is None else x >= o + start)
            high = (lambda x: True) if end is None else (lambda x: x == o if o is None or x is None else x <= o + end)
            place = lambda x: (x is not None, x or 0)
            low = low if start != 0 else (lambda x: place(x) >= place(o))
            high = high if end != 0 else (lambda x: place(x) <= place(o))
            frame = [x for x in own if low(x[2]) and high(x[2])]
        if exclude == "current row":
            frame = [x for x in frame if x is not row]
        elif exclude != "no others":
            frame = [x for x in frame if x[2] != row[2] or (exclude == "ties" and x is row)]
        want.append((row[0], *(fold(f, [x[3] for x in frame]) for f in functions)))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def brute_top(base, probes, k, other):
    out = []
    for p, q in probes:
        scored = sorted((-float((np.array(x, float) * np.array(q, float)).sum()), i) for i, x in base if len(x) == len(q) and not (other and i == p))
        out += [(p, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("memory", [64 << 20, 4000])
def test_top_products(spark, memory):
    """Many equal vectors (ties go to the smaller id), two lengths, vectors that take no part; probes broadcast and in stripes."""
    r = np.random.default_rng(3)
    few = r.normal(size=(6, 8)).round(2)
    base = [(i, few[i % 6].tolist() if i % 3 else r.normal(size=8).round(3).tolist()) for i in range(400)] + [(1000 + i, r.normal(size=5).tolist()) for i in range(40)]
    odd = [(2000, None), (2001, []), (2002, [1.0, None] + [0.0] * 6), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8)]
    probes = base[::7]
    df = lambda rows: spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    got = sorted(map(tuple, top_products(df(base + odd), df(probes + odd), 9, True, memory).collect()))
    want = brute_top(base, probes, 9, True)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)
    assert top_products(df(base).limit(0), df(probes), 3, False, memory).count() == 0
    assert top_products(df(base), df(probes).limit(0), 3, False, memory).count() == 0


def test_top_products_has_no_pairs_in_the_plan(spark):
    e = spark.range(3000).selectExpr("id", "array(cast(id % 17 AS double), cast(id % 5 AS double)) AS vector")
    got = top_products(e, e, 3)
    text = got._jdf.queryExecution().toString()
    assert "Join" not in text and "Cartesian" not in text and got.count() == 9000


def test_count_min(spark):
    """Never below the count; above the bound no oftener than stated; parts add up to the whole, whatever the split."""
    rows = [(f"i{int(x)}",) for x in np.random.default_rng(1).zipf(1.2, 30_000) % 5000] + [(None,)] * 50
    df = spark.createDataFrame(rows, "item string").repartition(4)
    cm = CountMin(0.002, 0.95)
    whole = cm.sketch(df, "item")
    parts = cm.merged(*(cm.sketch(df.where(F.pmod(F.xxhash64("item"), F.lit(3)) == k), "item") for k in range(3)))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    assert whole.count() <= cm.width * cm.lines
    counts = {r.item: r["count"] for r in df.where("item IS NOT NULL").groupBy("item").count().collect()}
    asked = df.unionByName(spark.createDataFrame([("never",)], "item string"))
    estimates = {r.item: r.estimate for r in cm.estimates(whole, asked, "item").collect()}
    assert estimates.pop(None) is None and estimates.pop("never") <= 0.002 * len(rows)
    assert estimates.keys() == counts.keys() and all(estimates[i] >= n for i, n in counts.items())
    over = sum(estimates[i] > n + 0.002 * 30_000 for i, n in counts.items())
    assert over <= 0.05 * len(counts) and sum(estimates[i] > n for i, n in counts.items()) > 100  # the sketch is smaller than its items
