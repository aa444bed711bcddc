"""Exact pairs of similar sets and of near vectors: every stripe of rows meets every other in a task of its own.

Equal rows are one representative (the least id; ``hashing.members`` gives each id its own) before anything meets. All
pairs are compared, by bitmaps or by matrix products and then exactly, so the work grows with the square of the
representatives; no pair that fails leaves its task. A task holds two stripes of at most ``most_rows`` rows and the pairs
of one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.sources import stored

#: Rows of a block of one stripe that meets the other at once, and bits of a set's map.
BLOCK, BITS = 256, 1024


def _meet(rows: DataFrame, prepare: Callable, compare: Callable, measure: str, most_rows: int) -> DataFrame:
    """rows(id, _value, _kind) -> a, b (a < b) and the measure; rows of unlike _kind don't meet.

    prepare(values) makes a group's rows into arrays, compare(arrays, left, right) -> places in left and in right, and measures.
    """
    spark, rows = rows.sparkSession, stored(rows, "representatives")
    n, parts = rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    stripes = max(1, -(-n // most_rows), min(int(np.ceil(np.sqrt(2 * parts))), -(-n // BLOCK)))
    own = rows.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(stripes)))
    later = F.sequence(F.col("_s"), F.lit(stripes - 1).cast("long"))
    left = own.select("*", F.explode(later).alias("_j")).withColumnRenamed("_s", "_i").withColumn("_left", F.lit(True))
    right = own.where("_s > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s") - 1)).alias("_i")).withColumnRenamed("_s", "_j").withColumn("_left", F.lit(False))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        ids, first = table["id"].combine_chunks(), table["_left"].to_numpy()
        lefts, same = np.flatnonzero(first), table["_i"][0].as_py() == table["_j"][0].as_py()
        rights, arrays = lefts if same else np.flatnonzero(~first), prepare(table["_value"].combine_chunks())
        for at in range(0, len(lefts), BLOCK):
            block = lefts[at : at + BLOCK]
            for other in range(at if same else 0, len(rights), 16 * BLOCK):
                x, y, m = compare(arrays, block, rights[other : other + 16 * BLOCK])
                if same:
                    x, y, m = x[x < y], y[x < y], m[x < y]
                if len(x):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(m, pa.float64())], names=["x", "y", "m"])

    found = left.unionByName(right).groupBy("_kind", "_i", "_j").applyInArrow(run, f"x {kind}, y {kind}, m double")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("m").alias(measure))


def similar_sets(df: DataFrame, items: str, least: float, most_rows: int = 8192) -> DataFrame:
    """df(id, items array) -> a, b, jaccard: representatives whose sets' intersection is at least that share (above 0) of their union.

    Nulls and repeated items within a set don't count; null and empty sets meet nothing.
    """
    sets = df.withColumn("_value", F.array_sort(F.array_distinct(F.array_compact(F.transform(items, lambda x: x.cast("string"))))))
    sets = sets.where(F.col("id").isNotNull() & (F.size("_value") > 0)).groupBy("_value").agg(F.min("id").alias("id"))

    def prepare(values: pa.ListArray) -> tuple:
        """Sizes, bitmaps of the items' numbers, items that share a bit with another of their set, and the sets where bits are shared."""
        sizes, coded = np.diff(values.offsets.to_numpy()), values.flatten().dictionary_encode()
        codes, n = coded.indices.to_numpy(), len(coded.dictionary)
        bits = np.zeros((len(sizes), min(-(-n // 64) * 64, BITS)), bool)
        bits[np.repeat(np.arange(len(sizes)), sizes), codes % bits.shape[1]] = True
        shared = [frozenset(c.tolist()) for c in np.split(codes, np.cumsum(sizes)[:-1])] if n > BITS else None
        return sizes, np.packbits(bits, axis=1).view(np.uint64), sizes - bits.sum(1), shared

    def compare(arrays: tuple, left: np.ndarray, right: np.ndarray) -> tuple:
        sizes, bits, lost, shared = arrays
        common = np.zeros((len(left), len(right)), np.int64)
        for word in range(bits.shape[1]):
            common += np.bitwise_count(bits[left, word][:, None] & bits[right, word])
        if shared:
            common += np.minimum(lost[left][:, None], lost[right])
        both = sizes[left][:, None] + sizes[right]
        x, y = np.nonzero((common > 0) & (common >= least * (both - common) - 1e-6))
        common, both, x, y = common[x, y], both[x, y], left[x], right[y]
        if shared:
            common = np.fromiter((len(shared[i] & shared[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)), np.int64, len(x))
        m = common / (both - common)
        keep = (m >= least) & (common > 0)
        return x[keep], y[keep], m[keep]

    return _meet(sets.select("id", "_value", F.lit(0).alias("_kind")), prepare, compare, "jaccard", most_rows)


def near_vectors(df: DataFrame, vector: str, most: float, most_rows: int = 16_384) -> DataFrame:
    """df(id, vector array) -> a, b, distance: representatives whose vectors are at most that far apart (Euclidean).

    Vectors that are null or empty, or hold a null or a number that is not finite, meet nothing; those of unlike lengths don't meet.
    """
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(whole & F.col("id").isNotNull() & (F.size(vector) > 0)).withColumn("_value", F.transform(vector, lambda x: x.cast("double") + F.lit(0.0)))
    rows = rows.groupBy("_value").agg(F.min("id").alias("id"))

    def prepare(values: pa.ListArray) -> tuple:
        x = values.flatten().to_numpy().reshape(len(values), -1)
        return x, (x * x).sum(1)

    def compare(arrays: tuple, left: np.ndarray, right: np.ndarray) -> tuple:
        x, square = arrays
        size = square[left][:, None] + square[right]
        apart = size - 2 * (x[left] @ x[right].T)
        i, j = np.nonzero(~(apart - 8 * x.shape[1] * np.finfo(float).eps * size > most * most))  # also what overflows
        i, j = left[i], right[j]
        total = np.zeros(len(i))
        for c in range(x.shape[1]):  # one fixed order of additions
            total += (x[i, c] - x[j, c]) ** 2
        m = np.sqrt(total)
        return i[m <= most], j[m <= most], m[m <= most]

    return _meet(rows.select("id", "_value", F.size("_value").alias("_kind")), prepare, compare, "distance", most_rows)
