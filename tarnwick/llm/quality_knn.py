"""Quality by nearest-neighbour voting in a latent-semantic space (operator 9).

A bounded sample of labelled documents gives tf-idf vectors of hashed words and word shapes; a truncated SVD (numpy)
projects them to ``rank`` dimensions. Projection and labelled vectors are broadcast, both of a size fixed by the
parameters. Every document is projected, its cosines to all labelled vectors are computed exactly in blocks, and the
``neighbours`` nearest vote with their similarity as weight.

Bounds on the fit: ``most_labelled`` documents, first by a hash of their id, rows of repeated ids included. Labels, lang, source and doc_id are no inputs.
Defined cases: null or empty text has the zero vector and gets the labelled mean; a label of null counts as none;
without labels the score is 0.5; ties in similarity go to the earlier sample row (by that hash); repeated rows are
scored each; a doc_id with two labels has the smaller one; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

WORDS, SHAPES, EXTRAS = 2048, 256, 32
DIM = WORDS + SHAPES + EXTRAS
_CLASS = bytes(97 if c >= 128 or 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_STRIP = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_RUNS = re.compile(rb"(.)\1+", re.S)


class _Codes(dict):
    """word -> hashed word and shape in one number; emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        shape = _RUNS.sub(rb"\1", word.translate(_CLASS))
        code = self[word] = zlib.crc32(word.strip(_STRIP).lower()) % WORDS * SHAPES + zlib.crc32(shape) % SHAPES
        return code


def term_counts(text: bytes | None, codes: _Codes) -> np.ndarray:
    """Counts of hashed words, shares of shapes and document-level marks, as one float32 vector."""
    b = text or b""
    words = b.split()
    v = np.zeros(DIM, np.float32)
    if not words:
        return v
    c = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    v[:WORDS] = np.bincount(c // SHAPES, minlength=WORDS)
    v[WORDS : WORDS + SHAPES] = np.sqrt(np.bincount(c % SHAPES, minlength=SHAPES) / len(words))
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    repeats, lines_twice = 1 - len(set(words)) / len(words), 1 - len(set(lines)) / max(1, len(lines))
    v[WORDS + SHAPES + min(9, int(10 * repeats))] = 0.5
    v[WORDS + SHAPES + 10 + min(9, int(10 * lines_twice))] = 0.5
    v[WORDS + SHAPES + 20 + min(11, len(words).bit_length())] = 0.3
    return v


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf of the words at half the weight, shapes and marks beside it. counts: rows of term_counts."""
    x = counts.astype(np.float32)
    w = np.log1p(x[:, :WORDS]) * idf
    x[:, :WORDS] = 0.5 * w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
    return x


def unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


def fit(counts: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """idf, projection (DIM x rank) and the labelled unit vectors, by randomised SVD with power iterations."""
    idf = np.log((1 + len(counts)) / (1 + (counts[:, :WORDS] > 0).sum(0))).astype(np.float32) + 0.1
    x = weighted(counts, idf)
    q = np.linalg.qr(x.T @ np.random.default_rng(5).standard_normal((len(x), min(rank + 8, len(x)))).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    projection = (q @ vt.T)[:, :rank].astype(np.float32)
    return idf, projection, unit(x @ projection)


def nearest(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k greatest values, in column order; of equal values the earlier columns."""
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    above, equal = s > least, s == least
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True))))[1].reshape(len(s), k)


def distinct(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different vectors, and which of them each row is: equal rows then have one cosine, so ties are ties."""
    return np.unique(vectors, axis=0, return_inverse=True)


def vote(z: np.ndarray, vectors: np.ndarray, which: np.ndarray, labels: np.ndarray, neighbours: int) -> np.ndarray:
    """Similarity-weighted mean label of each row's nearest labelled vectors; rows without a vector get the mean."""
    s = (z @ vectors.T)[:, which]
    k = min(neighbours, len(labels))
    near = nearest(s, k)
    w = np.clip(np.take_along_axis(s, near, 1), 0, 1).astype(float) ** 8
    total = w.sum(1)
    return np.where(total > 1e-12, (w * labels[near]).sum(1) / np.maximum(total, 1e-12), labels.mean())


def quality(docs: DataFrame, labels: DataFrame, most_labelled: int = 4096, rank: int = 48, neighbours: int = 15, threshold: float = 0.3) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isNotNull() & (fold("labelled_id") != 0)).groupBy("labelled_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("labelled_id", F.lit(9)), "labelled_id").limit(most_labelled)
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            rows = []
            for x in b.column(1):
                v = term_counts(x.as_py(), codes)
                at = np.flatnonzero(v).astype("<u2")
                rows.append(at.tobytes() + v[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), b.column(2)], names=["doc_id", "counts", "quality"])

    sample = d.join(F.broadcast(known), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", "quality")
    # At most that many rows, repeated ids included, in the order of the ids' hash: the sample's order settles ties.
    sample = sample.mapInArrow(gather, "doc_id long, counts binary, quality int").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id", "counts").limit(most_labelled).collect()
    model = None
    if sample:
        counts, y = np.zeros((len(sample), DIM), np.float32), np.array([float(r[2]) for r in sample])
        for i, r in enumerate(sample):
            n = len(r[1]) // 6
            counts[i, np.frombuffer(r[1], "<u2", n)] = np.frombuffer(r[1], "<f4", n, 2 * n)
        idf, projection, vectors = fit(counts, rank)
        model = (idf, projection, *distinct(vectors), y)
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            p = np.full(b.num_rows, 0.5)
            for i in range(0, b.num_rows if sent.value else 0, 256):
                idf, projection, vectors, which, y = sent.value
                z = unit(weighted(np.stack([term_counts(x.as_py(), codes) for x in b.column(2)[i : i + 256]]), idf) @ projection)
                p[i : i + 256] = vote(z, vectors, which, y, neighbours)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), F.col("text").cast("binary"))
    return d.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
