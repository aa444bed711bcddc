"""Exact vector search: scores as the SQL adds them up, copies, repeated ids and unlike norms, and what a pair costs."""

import time

import numpy as np
import pytest

from tarnwick.operators.vectors import top_products


def added(x, q):
    total = 0.0
    for a, b in zip(x, q, strict=True):
        total += a * b
    return total


def brute(base, probes, k, other):
    """Rows of a repeated probe id are ranked together, as the SQL does."""
    found = {}
    for p, q in probes:
        found.setdefault(p, []).extend((-added(x, q), i) for i, x in base if len(x) == len(q) and not (other and i == p))
    return sorted((p, n, i, -s + 0.0) for p, rows in found.items() for n, (s, i) in enumerate(sorted(rows)[:k], 1))


@pytest.mark.parametrize("memory", [64 << 20, 4000])
@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("other", [True, False])
def test_scores_copies_and_repeated_ids(spark, memory, kind, other):
    r = np.random.default_rng(8)
    few = r.normal(size=(5, 24)).astype(np.float32).astype(float)
    rows = [(i, r.normal(size=24).astype(np.float32).astype(float).tolist()) for i in range(300)]
    rows += [(300 + i, few[i % 5 if i < 60 else 0].tolist()) for i in range(140)]  # copies
    rows += [(7, few[0].tolist()), (7, few[0].tolist()), (8, (few[1] / 2).tolist()), (305, few[0].tolist())]  # repeated ids, and a repeated row
    if kind == "double":
        rows += [(600 + i, (r.normal(size=24) * 10.0 ** r.choice([-170, -160, -30, 30, 140])).tolist()) for i in range(120)]
    rows += [(800, [0.0] * 24), (801, [-0.0] * 24), (802, [1.0] * 3), (803, [1.0] * 3), (804, [2.0, -1.0, 0.5])]
    df = spark.createDataFrame(rows, f"id long, vector array<{kind}>").repartition(3).cache()
    asked = [x for x in rows if x[0] % 3]
    for probes, of in ((df, rows), (df.where("id % 3 <> 0"), asked)):
        assert sorted(map(tuple, top_products(df, probes, 6, other, memory).collect())) == brute(rows, of, 6, other)
    df.unpersist()


def test_a_pair_costs_little_more_than_its_product(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(12_000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").cache()
    frame, scans = type(df), []
    run = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: scans.append(f) or run(self, f, *a, **b))
    top_products(df, df, 5, other=True)
    batch = df.limit(4096).toArrow().to_batches()
    took = []
    for _ in range(2):
        began = time.process_time()
        assert sum(b.num_rows for b in scans[0](iter(batch))) == 60_000
        done = time.process_time()
        q = x.astype(float)
        for at in range(0, 4096, 512):
            q[at : at + 512] @ q.T
        took.append((done - began) / (time.process_time() - done))
    assert min(took) < 6  # products in double precision; a selection in every block took 20 times as long
    df.unpersist()
