"""Additive quantisation over vectors of unlike norms, of many components and of extreme size, against brute force."""

import numpy as np
import pytest

from tarnwick.llm import additive_ann

G = np.random.default_rng(8)
ROWS = {
    "heavy norms": (G.normal(size=(6000, 48)) * np.abs(G.standard_cauchy(size=(6000, 1)))).astype(np.float32),
    "many components": G.normal(size=(6000, 200)).astype(np.float32),
    "huge": G.normal(size=(2000, 12)) * 1e120,
    "tiny": G.normal(size=(2000, 12)) * 1e-100,
}


@pytest.mark.parametrize("name", ROWS)
def test_recall(spark, name):
    x, kind = ROWS[name], "float" if ROWS[name].dtype == np.float32 else "double"
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>").repartition(4)
    got = {}
    for r in additive_ann.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    product = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(product, -np.inf)
    hits = [len(set(np.argsort(-product[q])[:20].tolist()) & got[q]) for q in range(0, len(x), 20)]
    assert np.mean(hits) / 20 >= 0.97
