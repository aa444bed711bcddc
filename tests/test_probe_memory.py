"""Exact vector search: what a task holds does not grow with blocks times probes."""

import tracemalloc

import numpy as np

from tarnwick.operators.vectors import top_products


def test_products_of_many_probes(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(12_000, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    frame, scans = type(df), []
    run = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: scans.append(f) or run(self, f, *a, **b))
    got = {}
    for r in top_products(df, df, 3, other=True).where("probe_id % 1000 = 7").collect():
        got.setdefault(r.probe_id, {})[r.rank] = r.id
    for i in range(7, 12_000, 1000):
        s = x @ x[i]
        s[i] = -np.inf
        assert [got[i][k] for k in (1, 2, 3)] == np.argsort(-s)[:3].tolist()
    batch = df.limit(4096).toArrow().to_batches()
    tracemalloc.start()
    found = sum(b.num_rows for b in scans[0](iter(batch)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 36_000 and most < 100e6  # 2048 x 12000 products alone are 197 MB
