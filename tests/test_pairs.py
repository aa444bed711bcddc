"""Exact pairs against brute force, over many stripes, sets whose bits are shared, and the registered queries."""

import random

import numpy as np
import pytest

from tarnwick.operators.pairs import near_vectors, similar_sets
from tarnwick.plans import catalog


@pytest.mark.parametrize("items,most_rows,least", [(40, 8192, 0.8), (3000, 64, 0.7), (3000, 8192, 0.5)])
def test_sets(spark, items, most_rows, least):
    r, sets = random.Random(items), []
    for i in range(700):
        base = random.Random(i // 10).sample(range(items), 30)
        sets.append([x if r.random() > 0.08 else r.randrange(items) for x in base])
    rows = [*enumerate(sets), (900, None), (901, []), (902, [None]), (903, sets[0][::-1] + [None])]
    got = {(p.a, p.b): p.jaccard for p in similar_sets(spark.createDataFrame(rows, "id long, items array<int>"), "items", least, most_rows).collect()}
    first = sorted({frozenset(x): i for i, x in reversed(list(enumerate(sets)))}.values())
    s = {i: set(sets[i]) for i in first}
    share = lambda i, j: len(s[i] & s[j]) / len(s[i] | s[j])
    assert got == {(i, j): share(i, j) for i in first for j in first if i < j and share(i, j) >= least} and len(got) > 100


@pytest.mark.parametrize("most_rows", [64, 16_384])
def test_vectors(spark, most_rows):
    g = np.random.default_rng(4)
    x = g.normal(size=(60, 8))[g.integers(0, 60, 900)] + g.normal(size=(900, 8)) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [float("nan")] * 8), (2002, x[0].tolist()), (2003, [1.0]), (2004, [1.2])]
    got = {(p.a, p.b) for p in near_vectors(spark.createDataFrame(rows, "id long, v array<double>"), "v", 0.5, most_rows).collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    assert got == {(i, j) for i in range(900) for j in range(i + 1, 900) if d[i, j] <= 0.5} | {(2003, 2004)}


def test_all_pairs_of_users(spark, sf):
    days = {}
    for r in catalog.table(spark, sf, "events").selectExpr("user_id", "CAST(ts AS DATE) AS d").distinct().collect():
        days.setdefault(r.user_id, set()).add(r.d)
    first = sorted({frozenset(days[u]): u for u in sorted(days, reverse=True)}.values())
    got = {(p.a, p.b) for p in catalog.QUERIES["similar_users"](spark, sf).collect()}
    assert got == {(a, b) for a in first for b in first if a < b and len(days[a] & days[b]) >= 0.9 * len(days[a] | days[b])}
