"""Additive quantisation: lanes of several blocks and several groups of queries find what one block finds."""

import numpy as np
import pytest

from tarnwick.llm import additive_ann


@pytest.mark.parametrize("lane_blocks,block_rows,query_rows", [(64, 16_384, 8192), (3, 64, 16), (100, 50, 7)])
def test_recall_by_lanes(spark, lane_blocks, block_rows, query_rows):
    g = np.random.default_rng(5)
    x = g.normal(size=(1500, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in additive_ann.nearest(df, n_books=8, n_codes=32, shortlist=160, lane_blocks=lane_blocks, block_rows=block_rows, query_rows=query_rows).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = [i for i in range(1500) if i % 20 == 0]
    assert sorted(got) == asked and all(sorted(r for r, _, _ in v) == list(range(1, 21)) for v in got.values())
    product = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(product, -np.inf)
    hits = sum(len(set(np.argsort(-product[q])[:20].tolist()) & {i for _, i, _ in got[q]}) for q in asked)
    assert hits / (20 * len(asked)) >= 0.9
    assert all(abs(s - product[q, i]) < 1e-12 for q in asked for _, i, s in got[q])
