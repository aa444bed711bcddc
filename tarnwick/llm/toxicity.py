"""Toxicity by non-negative positive-unlabelled learning (operator 7).

Confirmed toxic documents are the positives; a sample of all training documents, whatever their labels, is the
unlabelled set. A linear model over the presence of words and word starts minimises the non-negative risk
pi*R_p(+) + max(0, R_u(-) - pi*R_p(-)) in numpy, pi being the class prior. Only weighted words are broadcast (at most
``most_words``). The decision threshold comes from the scores of all training documents: the emptiest stretch of their
histogram near the share that the class prior puts above it (the prior is that of the labelled rows; where labels are
much richer in toxic rows than documents are, the cut falls too low).

Bounds on the fit: the first ``most_positive`` and ``most_unlabelled`` rows by a hash of doc_id, exactly so many at any
size of table, rows of repeated ids included. Labels, lang, source and doc_id are no inputs.
Defined cases: null or empty text has no words and scores by the bias alone; a label of null counts as none; a doc_id
with both labels counts as toxic; without any positive the model is the prior alone; a null doc_id is not held out and
not learnt from; equal rows (doc_id and words) are learnt from once and scored each; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize

_LETTERS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> set[bytes]:
    """Distinct lower-case words, and the longer ones' first 4 to 8 bytes marked with ^."""
    words = set((text or b"").translate(_LETTERS).split())
    starts = {b"^" + w[:k] for w in words for k in (4, 5, 6, 7, 8) if len(w) > k}
    return words | starts


def training_sample(docs: DataFrame, labels: DataFrame, most_positive: int, most_unlabelled: int) -> tuple[list, float]:
    """((words, positive, unlabelled), ...) of the bounded sample, and the class prior among labelled training rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isNotNull() & (fold("labelled_id") != 0)).groupBy("labelled_id").agg(F.max("toxic").alias("toxic"))
    n, prior = known.agg(F.count("*"), F.avg("toxic")).first()
    if not n or not prior:
        return [], 0.0
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).where(fold() != 0)
    by_hash = lambda c: (F.xxhash64(c, F.lit(7)), c)
    ids = lambda df, c, most: F.broadcast(df.select(F.col(c).alias("chosen")).distinct().orderBy(*by_hash("chosen")).limit(most))
    positive = d.join(ids(known.where("toxic = 1"), "labelled_id", most_positive), F.col("doc_id") == F.col("chosen"), "left_semi").withColumn("positive", F.lit(True))
    drawn = d.join(ids(d, "doc_id", most_unlabelled), F.col("doc_id") == F.col("chosen"), "left_semi").withColumn("positive", F.lit(False))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b" ".join(sorted(set((x.as_py() or b"").translate(_LETTERS).split()))) for x in b.column(1)], pa.binary())], names=["doc_id", "words"])

    rows: dict[tuple, list[bool]] = {}
    for part, most, at in ((positive, most_positive, 0), (drawn, most_unlabelled, 1)):
        # An id may stand in many rows: the rows themselves are bounded too.
        for r in part.select("doc_id", "text").mapInArrow(gather, "doc_id long, words binary").orderBy(*by_hash("doc_id"), "words").limit(most).collect():
            rows.setdefault((r[0], bytes(r[1])), [False, False])[at] = True
    return [(words, *flags) for (_, words), flags in rows.items()], float(prior)


def risk(z: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The positives' part of the logistic risk and the estimate of the negatives', which may not fall below 0."""
    p, u = positive / max(1, positive.sum()), unlabelled / max(1, unlabelled.sum())
    return prior * float((p * np.logaddexp(0, -z)).sum()), float((u * np.logaddexp(0, z)).sum() - prior * (p * np.logaddexp(0, z)).sum())


def slope(z: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """The step direction for each score: the risk's gradient, or, with the negatives' part below 0, that part's ascent."""
    p, u = positive / max(1, positive.sum()), unlabelled / max(1, unlabelled.sum())
    up = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    part = u * up - prior * p * up
    return prior * p * (up - 1) + part if risk(z, positive, unlabelled, prior)[1] >= 0 else -part


def nnpu(rows: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, prior: float, n_features: int, steps: int = 500, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias. rows: feature ids of each document; positive, unlabelled: which documents are in either set."""
    flat, lens = np.concatenate([np.zeros(0, np.int64), *rows]), np.array([len(x) for x in rows])
    doc = np.repeat(np.arange(len(rows)), lens)
    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        z = np.bincount(doc, w[flat], minlength=len(rows)) + w[-1]
        g = slope(z, positive, unlabelled, prior)
        grad = np.append(np.bincount(flat, g[doc], minlength=n_features), g.sum())
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(sample: list, prior: float, most_words: int) -> tuple[dict[bytes, float], float]:
    if not sample:
        return {}, -10.0
    prior = min(max(prior, 1e-4), 0.9)
    positive, drawn = np.array([x[1] for x in sample], bool), np.array([x[2] for x in sample], bool)
    in_p: Counter = Counter()
    for words, is_p, _ in sample:
        if is_p:
            in_p.update(words_of(words))
    in_p = {x: n for x, n in in_p.items() if n >= 3}
    in_all: Counter = Counter()
    for words, _, _ in sample:
        in_all.update(in_p.keys() & words_of(words))
    base = max(1, positive.sum()) / len(sample)
    # Words that positives hold significantly more often than their share of the sample: a few, so few to overfit.
    excess = {x: (k - in_all[x] * base) / np.sqrt(in_all[x] * base * (1 - base) + 0.1) for x, k in in_p.items()}
    kept = sorted((x for x, z in excess.items() if z >= 4), key=lambda x: (-excess[x], x))[:most_words]
    index = {x: i for i, x in enumerate(kept)}
    rows = [np.array(sorted(index[x] for x in index.keys() & words_of(words)), np.int64) for words, _, _ in sample]
    w, bias = nnpu(rows, positive, drawn, prior, len(kept))
    return {x: float(w[i]) for x, i in index.items() if abs(w[i]) > 1e-3}, bias


def gap(bins: np.ndarray, counts: np.ndarray, prior: float, step: float) -> float:
    """The middle of the emptiest stretch of the histogram where 0.7 to 1.3 times the prior's share of documents lies above."""
    order = np.argsort(-bins)
    bins, above = bins[order], np.cumsum(counts[order]) / counts.sum()
    high, low = (int(bins[min(np.searchsorted(above, part * prior), len(bins) - 1)]) for part in (0.7, 1.3))
    full = np.zeros(high - low + 1)
    inside = (bins >= low) & (bins <= high)
    full[bins[inside] - low] = counts[order][inside]
    # The least count, then the longest run of it: a stretch is empty where no document of the corpus lies.
    edges = np.flatnonzero(np.diff(np.concatenate([[0], full == full.min(), [0]]).astype(int)))
    starts, ends = edges[::2], edges[1::2]
    at = np.argmax(ends - starts)
    return float(low + (starts[at] + ends[at]) / 2) * step


def toxicity(docs: DataFrame, labels: DataFrame, most_positive: int = 3000, most_unlabelled: int = 6000, most_words: int = 10_000, step: float = 0.05) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> doc_id, held_out, score, predicted."""
    sample, prior = training_sample(docs, labels, most_positive, most_unlabelled)
    weights, bias = fit(sample, prior, most_words)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), F.col("text").cast("binary"))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        known = frozenset(weights)
        for b in batches:
            z = np.array([bias + sum(sorted(map(weights.__getitem__, known & words_of(x.as_py())))) for x in b.column(2)], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z)], names=["doc_id", "held_out", "z"])

    scored = materialize(d.mapInArrow(raw, "doc_id long, held_out boolean, z double"), "toxicity-scores")
    cut = 0.0
    if sample:
        bins = scored.where("NOT held_out AND doc_id IS NOT NULL").groupBy(F.floor(F.col("z") / step).alias("bin")).count().collect()
        if bins:
            cut = gap(np.array([r[0] for r in bins], int), np.array([r[1] for r in bins], float), prior, step)
    score = 1 / (1 + F.exp(-F.greatest(F.least(F.col("z") - F.lit(cut), F.lit(50.0)), F.lit(-50.0))))
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
