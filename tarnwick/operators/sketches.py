"""Count-min sketches as tables: they add up over tasks, tables and days, and give estimates by a join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CountMin:
    """An estimate is at least the item's count, and above it by more than eps times all rows with a chance of 1 - confidence at most.

    A sketch is a table (line, cell, n) of at most lines * width rows, however many items were counted. Null items are
    not counted and have an estimate of null.
    """

    def __init__(self, eps: float, confidence: float, seed: int = 0):
        self.width, self.lines, self.seed = math.ceil(math.e / eps), math.ceil(-math.log(1 - confidence)), seed

    def _cells(self, item: Column) -> Column:
        """The item's cell on each line: 32 bits of a sha256, eight lines to a hash."""

        def cell(line: int) -> Column:
            named = F.sha2(F.concat(F.lit(f"{self.seed + line // 8}:"), item.cast("string")).cast("binary"), 256)
            return F.struct(F.lit(line).alias("line"), (F.conv(F.substring(named, 1 + 8 * (line % 8), 8), 16, 10).cast("long") % self.width).alias("cell"))

        return F.array(*map(cell, range(self.lines)))

    def sketch(self, df: DataFrame, item: str) -> DataFrame:
        """Items are counted first (each task its own), then their cells, so a frequent item is one row a task."""
        items = df.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("_item")).agg(F.count("*").alias("n"))
        return items.select(F.inline(self._cells(F.col("_item"))), "n").groupBy("line", "cell").agg(F.sum("n").alias("n"))

    def merged(self, *sketches: DataFrame) -> DataFrame:
        one = sketches[0]
        for s in sketches[1:]:
            one = one.unionByName(s)
        return one.groupBy("line", "cell").agg(F.sum("n").alias("n"))

    def estimates(self, sketch: DataFrame, items: DataFrame, item: str, alias: str = "estimate") -> DataFrame:
        """Each different item with the least of its cells."""
        asked = items.select(item).distinct().withColumn("_at", F.explode(self._cells(F.col(item)))).select(item, "_at.line", "_at.cell")
        held = F.broadcast(sketch) if self.width * self.lines <= 1_000_000 else sketch
        return asked.join(held, ["line", "cell"], "left").groupBy(item).agg(F.min(F.when(F.col(item).isNotNull(), F.coalesce("n", F.lit(0)))).alias(alias))
