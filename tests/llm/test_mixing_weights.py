"""Source mixing over documents of many quality weights: brute force, the SQL, and what the weights do."""

import hashlib
import math
import random
import re
from itertools import accumulate

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tarnwick.llm import mixing, oracles


def fixture(n=900):
    """Prose, numbers, symbols, long and short words and lists, in three hosts of unlike size and a null one."""
    r = random.Random(5)
    word = lambda k: "".join(r.choice("abcdefghij") for _ in range(k))
    rows = []
    for i in range(n):
        kind, size = i % 6, r.randrange(1, 60)
        words = [word(r.randrange(2, 9)) for _ in range(size)]
        if kind == 1:
            words = [str(r.randrange(10**6)) for _ in words]
        elif kind == 2:
            words = [w + r.choice("#*$%&|<>") * 3 for w in words]
        elif kind == 3:
            words = [w * 5 for w in words]
        elif kind == 4:
            words = [w[:1] for w in words]
        text = " ".join(w + ("." if k % 12 == 11 or kind == 5 else "") for k, w in enumerate(words))
        rows.append((i, r.choice(["a", "b", "b", "c", "c", "c", None]), text))
    return [*rows, (None, "a", "no id here."), (n, "a", None), (n + 1, "b", ""), (n + 2, "c", rows[0][2]), (n + 2, "c", rows[0][2])]


def weight(text, size):
    near = lambda x, usual, slope: 1.0 / (1.0 + abs(x - usual) * slope)
    chars = len(text)
    length = near(chars / max(size, 1), 6.0, 0.125)
    odd = near(len(re.findall(mixing.ODD, text)) / max(chars, 1), 0.0, 16.0)
    marks = near(len(re.findall(mixing.MARKS, text)) / max(size, 1), 0.08, 4.0)
    return 0.25 + 0.75 * (length * odd * marks)


def uniform(doc_id, text):
    m = 2147483647
    x = (((-1 if doc_id is None else doc_id) % m) + int(hashlib.md5(text.encode()).hexdigest()[:12], 16)) % m
    for k in (48271, 69621, 16807):
        x = (x * k + 11) % m
        x = (x * x + 12345) % m
    return (x + 1) / (m + 1.0)


def targets(sizes):
    """Shares by weight, what is over three times a source's size shared again until none is."""
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, full = float(sum(sizes.values())), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        each = left / max(sum(weights[s] for s in sizes if s not in full), 1)
        over = {s for s in sizes if s not in full and weights[s] * each >= 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weights[s] * each for s in sizes}
        full |= over


def brute(rows):
    docs = [(i, s, t or "", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows]
    sizes = {}
    for _, s, _, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    out = []
    for s, target in targets(sizes).items():
        epochs = int(target // sizes[s])
        budget = target - epochs * sizes[s]
        own = sorted((d for d in docs if d[1] == s), key=lambda d: (d[3] == 0, -math.log(uniform(d[0], d[2])) / weight(d[2], d[3]), d[0] or -1, d[3]))
        for d, upto in zip(own, accumulate(d[3] for d in own), strict=True):
            copies = min(epochs + (d[3] > 0 and upto - d[3] / 2 <= budget), 3)
            out.append((d[0], d[3], sizes[s], round(target, 4), d[3] * copies))
    return sorted(out, key=str)


def test_many_weights_equal_brute_force_and_sql(spark):
    rows = fixture()
    weights = {round(weight(t or "", len((t or "").split())), 3) for _, _, t in rows}
    assert len(weights) > 200 and min(weights) < 0.4 and max(weights) > 0.9
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)).select("doc_id", "size", "source_size", F.round("target", 4), "taken")
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == brute(rows)
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert sorted(((a, b, c, round(d, 4), e) for a, b, c, d, e in db.execute(oracles.SOURCE_MIXING).fetchall()), key=str) == got


def test_good_texts_are_taken_oftener(spark):
    """Of a source cut to a part of its words, the share taken rises with the weight, as keys divided by weights give."""
    rows = [(i, "b" if r % 4 == 0 else "a", t) for r, (i, _, t) in enumerate(fixture(6000)) if t and i is not None and i < 6000]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).where("source = 'a'").collect()
    taken = {r.doc_id: r.copies for r in mixed}
    assert abs(sum(r.taken for r in mixed) / mixed[0].target - 1) < 0.01 and mixed[0].target < 0.6 * mixed[0].source_size
    own = [(weight(t, len(t.split())), taken[i]) for i, s, t in rows if s == "a"]
    low, high = [x for w, x in own if w < 0.4], [x for w, x in own if w > 0.75]
    assert min(len(low), len(high)) > 300
    assert 0 < np.mean(low) < np.mean(high) - 0.2


def test_bins_stay_even_for_weights_between(spark):
    keys = spark.range(200_000).select((-F.log(F.rand(1)) / (0.25 + 0.75 * F.pmod("id", F.lit(11)) / 10)).alias("key"))
    most = keys.select(mixing.key_bin(F.col("key"), F.lit(1)).alias("bin")).groupBy(F.floor(F.col("bin") / 64).alias("b")).count().agg(F.max("count")).first()[0]
    assert most < 3 * 200_000 / 64
