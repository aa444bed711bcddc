"""Locality-sensitive hashing against all exact pairs at two sizes, hot buckets, and Spark's own hashes computed anew."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnwick.operators.hashing import members, near_vectors, similar_sets
from tarnwick.plans import catalog


def sets_of(n, seed):
    """Families of sets that differ in a few items, among sets of their own."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3:
            rows.append(r.sample(range(10_000), r.randrange(20, 60)))
        else:
            base = random.Random(i // 30).sample(range(10_000), 50)
            rows.append([x if r.random() > 0.05 else r.randrange(10_000) for x in base])
    return rows


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("n", [300, 1200])
def test_recall_of_sets(spark, n):
    rows = list(enumerate(sets_of(n, 1)))
    got = {(r.a, r.b): r.jaccard for r in similar_sets(spark.createDataFrame(rows, "id long, items array<int>"), "items", 0.7).collect()}
    sets = [set(x) for _, x in rows]
    first = sorted({frozenset(x): i for i, x in reversed(list(enumerate(sets)))}.values())  # of equal sets the least id
    want = {(i, j) for i in first for j in first if i < j and jaccard(sets[i], sets[j]) >= 0.7}
    assert set(got) <= want and len(want) > n / 4
    assert len(got) / len(want) > 0.95
    assert all(abs(s - jaccard(sets[a], sets[b])) < 1e-12 for (a, b), s in got.items())


@pytest.mark.parametrize("n", [300, 1200])
def test_recall_of_vectors(spark, n):
    g = np.random.default_rng(2)
    centres = g.normal(size=(n // 10, 16))
    x = centres[g.integers(0, len(centres), n)] + g.normal(size=(n, 16)) * 0.08
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [float("nan")] * 16)], "id long, v array<double>")
    got = {(r.a, r.b): r.distance for r in near_vectors(df, "v", 0.5, 1.5).collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if d[i, j] <= 0.5}
    assert set(got) <= want and len(want) > n
    assert len(got) / len(want) > 0.95


def test_hot_bucket_of_copies(spark):
    """A third of the rows are one set, in unlike orders: one representative, so its buckets hold one row."""
    rows = [(i, [3, 1, 2, 4, 5][i % 5 :] + [3, 1, 2, 4, 5][: i % 5]) for i in range(5000)] + [(5000 + i, x) for i, x in enumerate(sets_of(60, 4))] + [(9000, [1, 2, 3, 4, 5, 6]), (9001, []), (9002, None), (9003, [None])]
    df = spark.createDataFrame(rows, "id long, items array<int>").withColumn("items", F.col("items"))
    got = similar_sets(df, "items", 0.8)
    assert [(r.a, r.b) for r in got.collect() if r.b == 9000] == [(0, 9000)]
    sets = df.withColumn("s", F.array_sort(F.array_distinct(F.array_compact("items"))))
    of = {r.id: r.representative for r in members(sets, "s").collect()}
    assert all(of[i] == 0 for i in range(5000)) and of[9000] == 9000 and of[9001] is None and of[9002] is None and of[9003] is None


def test_registered_searches(spark, sf):
    got = {(r.a, r.b) for r in catalog.QUERIES["similar_users"](spark, sf).collect()}
    e = catalog.table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("d")).distinct().collect()
    days = {}
    for r in e:
        days.setdefault(r.user_id, set()).add(r.d)
    one = {}
    for u in sorted(days):
        one.setdefault(frozenset(days[u]), u)
    users = sorted(one.values())
    want = {(a, b) for i, a in enumerate(users) for b in users[i + 1 :] if jaccard(days[a], days[b]) >= 0.9}
    assert got <= want and len(got) > 0.9 * len(want) > 0
    x = {r.vec_id: np.array(r.embedding) for r in catalog.table(spark, sf, "embeddings").collect()}
    near = {(r.a, r.b) for r in catalog.QUERIES["near_embeddings"](spark, sf).collect()}
    want = {(a, b) for a in x for b in x if a < b and np.sqrt(((x[a] - x[b]) ** 2).sum()) <= 0.9}
    assert near <= want and len(near) >= 0.9 * len(want)


def soundex(word):
    codes = {c: str(d) for d, cs in enumerate(("", "BFPV", "CGJKQSXZ", "DT", "L", "MN", "R")) for c in cs}
    out, last = word[0], codes.get(word[0])
    for c in word[1:]:
        code = codes.get(c)
        if code and code != last:
            out += code
        if c not in "HW":
            last = code
    return (out + "000")[:4]


def test_hash_codes(spark, sf):
    rows = catalog.QUERIES["hash_codes"](spark, sf).join(catalog.table(spark, sf, "customer"), "c_custkey").collect()
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    for r in rows:
        assert r.x == signed(xxhash.xxh64_intdigest(r.c_name.encode(), 42))
        assert r.xk == signed(xxhash.xxh64_intdigest(int(r.c_custkey).to_bytes(8, "little"), 42))
        assert r.m == murmur(r.c_custkey)
        assert r.s == soundex(r.c_mktsegment)


def murmur(v):
    """MurmurHash3 of a bigint's two halves with seed 42."""
    m, h = 0xFFFFFFFF, 42
    turn = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    for k in (v & m, (v >> 32) & m):
        h = (turn(h ^ (turn(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m), 13) * 5 + 0xE6546B64) & m
    h ^= 8
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> shift)) * factor & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h
