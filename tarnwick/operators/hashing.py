"""Similar sets and near vectors by locality-sensitive hashing: Spark's MinHash and random projections in bands, then an exact check.

Rows are alike in a band if all its hashes agree; a pair is looked at in its first common band alone, so none comes
twice and nothing is made distinct afterwards. Equal rows are one representative (the least id) before anything is
joined, so a group of copies of any size is one row in its buckets; members() gives each id its representative. The
exact check stands in the join's condition: a bucket's pairs that fail it never leave the join. Recall of a pair of
similarity s is 1 - (1 - s^rows)^bands for sets.
"""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH, HashingTF, MinHashLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.sources import stored


def members(df: DataFrame, value: str) -> DataFrame:
    """df(id, value) -> id, representative: the least id of the rows of an equal value (null where the value is null or empty)."""
    ready = _ready(df, value)
    first = ready.groupBy("_value").agg(F.min("id").alias("representative"))
    known = ready.join(first, "_value").select("id", "representative")
    return df.select("id").join(known, "id", "left")


def _ready(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col("id").isNotNull() & (F.size(value) > 0)).select("id", F.col(value).alias("_value"))


def _banded(hashed: DataFrame, bands: int, rows: int, holds, measure) -> DataFrame:
    """hashed(id, _value, _hashes) -> a, b (a < b) and the measure, of pairs that agree in a band and hold.

    The keys are written once and read for both sides.
    """
    keys = F.array(*(F.xxhash64(F.slice("_hashes", 1 + rows * b, rows)) for b in range(bands)))
    keyed = stored(hashed.select("id", "_value", keys.alias("_keys")), "hashed")
    side = lambda s: keyed.select(F.col("id").alias(s), F.col("_value").alias(f"_v{s}"), F.col("_keys").alias(f"_k{s}")).select("*", F.posexplode(f"_k{s}").alias("_band", "_key"))
    earlier = F.exists(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: (i < F.col("_band")) & (F.col("_ka")[i] == F.col("_kb")[i]))
    pairs = side("a").join(side("b"), ["_band", "_key"]).where((F.col("a") < F.col("b")) & ~earlier)
    return pairs.withColumn("_m", measure).where(holds(F.col("_m"))).select("a", "b", "_m")


def similar_sets(df: DataFrame, items: str, least: float, bands: int = 24, rows: int = 4, seed: int = 1) -> DataFrame:
    """df(id, items array) -> a, b, jaccard: representatives whose sets' intersection is at least that share of their union.

    Nulls and repeated items within a set don't count; null and empty sets meet nothing.
    """
    sets = df.withColumn("_set", F.array_sort(F.array_distinct(F.array_compact(F.transform(items, lambda x: x.cast("string"))))))
    sets = _ready(sets, "_set").groupBy("_value").agg(F.min("id").alias("id"))
    featured = HashingTF(numFeatures=1 << 24, binary=True, inputCol="_value", outputCol="_features").transform(sets)
    model = MinHashLSH(inputCol="_features", outputCol="_hashes", numHashTables=bands * rows, seed=seed).fit(featured.limit(1))
    hashed = model.transform(featured).select("id", "_value", "_hashes")
    shared: Column = F.size(F.array_intersect("_va", "_vb"))
    jaccard = shared / (F.size("_va") + F.size("_vb") - shared)
    return _banded(hashed, bands, rows, lambda m: m >= least, jaccard).withColumnRenamed("_m", "jaccard")


def near_vectors(df: DataFrame, vector: str, most: float, width: float, bands: int = 24, rows: int = 4, seed: int = 1) -> DataFrame:
    """df(id, vector array) -> a, b, distance: representatives whose vectors are at most that far apart (Euclidean).

    width: of the projections' buckets, some three times the distance. Vectors have one length; null, empty and those with
    a null or a number that is not finite meet nothing.
    """
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows_ = df.where(whole).withColumn("_d", F.transform(vector, lambda x: x.cast("double")))
    rows_ = _ready(rows_, "_d").groupBy("_value").agg(F.min("id").alias("id")).withColumn("_features", array_to_vector("_value"))
    one = rows_.limit(1)
    if not one.count():
        return df.sparkSession.createDataFrame([], f"a {df.schema['id'].dataType.simpleString()}, b {df.schema['id'].dataType.simpleString()}, distance double")
    model = BucketedRandomProjectionLSH(inputCol="_features", outputCol="_hashes", bucketLength=width, numHashTables=bands * rows, seed=seed).fit(one)
    hashed = model.transform(rows_).select("id", "_value", "_hashes")
    distance = F.sqrt(F.aggregate(F.zip_with("_va", "_vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return _banded(hashed, bands, rows, lambda m: m <= most, distance).withColumnRenamed("_m", "distance")

