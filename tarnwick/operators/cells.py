"""Cells of neighbouring values, so that a stretch or a key with any share of the rows is many tasks.

Cut points come from a bounded sample, in the order (key, value), one after every SPREAD sampled rows: a key that holds a
third of the rows has a third of the cuts, a key with few rows has none and is one cell. They decide where rows meet,
never what a result is. Cells are numbered in their key from 0 by a binary search in the key's cuts, an expression of
some dozen steps. A single value is one cell however many rows it has.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: Sampled rows between two cuts, and the most cells of a table.
SPREAD, MOST = 20, 8192


class Cells:
    """Cut points of a table of (by, value); at most ``most`` in all, whatever the table's size, so they are broadcast."""

    def __init__(self, points: DataFrame, by: list[str], value: str, most: int | None = None, seed: int = 1):
        spark = points.sparkSession
        self.by, self.most = list(by), most or min(MOST, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = points.select(*by, F.col(value).alias("_value")).where(F.col("_value").isNotNull())
        n = rows.count()
        share = min(1.0, SPREAD * self.most / max(n, 1))
        drawn = (rows if share == 1.0 else rows.sample(share, seed)).limit(2 * SPREAD * self.most).collect()
        order = sorted((tuple((x is not None, x) for x in r[:-1]), r[-1]) for r in drawn)
        cuts = [order[i] for i in range(SPREAD, len(order), max(SPREAD, -(-len(order) // self.most)))]
        found = [(*(x for _, x in key), sorted({v for _, v in own})) for key, own in groupby(cuts, lambda c: c[0])]
        kinds = [StructField(f"_by{i}", rows.schema[b].dataType) for i, b in enumerate(by)]
        self.bits = max((len(r[-1]) for r in found), default=0).bit_length()
        self.n = sum(len(r[-1]) for r in found)
        self.cuts = spark.createDataFrame(found, StructType([*kinds, StructField("_cuts", ArrayType(rows.schema["_value"].dataType))])) if found else None

    def add(self, df: DataFrame, **values: Column) -> DataFrame:
        """df with a column of that name for each value: its cell among its key's (0 where the key has no cut, null for null)."""
        if self.cuts is None:
            return df.withColumns({name: F.when(v.isNotNull(), F.lit(0)) for name, v in values.items()})
        if self.by:
            same = None
            for i, b in enumerate(self.by):
                one = F.col(b).eqNullSafe(F.col(f"_by{i}"))
                same = one if same is None else same & one
            df = df.join(F.broadcast(self.cuts), same, "left").drop(*(f"_by{i}" for i in range(len(self.by))))
        else:
            df = df.withColumn("_cuts", self.cuts.scalar())
        return df.withColumns({name: self._search(v) for name, v in values.items()}).drop("_cuts")

    def _search(self, x: Column) -> Column:
        """How many of the key's cuts are at or below x."""
        step = lambda at, bit: F.when(F.try_element_at("_cuts", at + bit) <= x, at + bit).otherwise(at)
        bits = F.array(*(F.lit(1 << b) for b in range(self.bits - 1, -1, -1)))
        return F.when(x.isNotNull(), F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.aggregate(bits, F.lit(0), step)))
