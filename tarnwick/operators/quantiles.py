"""Exact quantiles of groups of any size: no group meets in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.operators.cells import Cells
from tarnwick.sources import stored


def quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """df -> by and, for each alias, percentile(value, share) of its group: interpolated between the two values at its place.

    Equal values are one row with their number. Cells (see ``cells``) cut a group's values; the numbers of rows in them
    tell which cells hold the places wanted, and only those cells' values are put in order. Nulls of value don't count.
    """
    counted = stored(df.groupBy(by, F.col(value).cast("double").alias("_v")).agg(F.count(value).alias("_n")), "values")
    v = Cells(counted, [by], "_v").add(counted.where("_v IS NOT NULL"), _cell=F.col("_v"))
    cells = v.groupBy(F.col(by).alias("_by"), F.col("_cell").alias("_c")).agg(F.sum("_n").alias("_rows"))
    group = Window.partitionBy("_by")
    passed = F.coalesce(F.sum("_rows").over(group.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_passed", passed).withColumn("_all", F.sum("_rows").over(group))
    place = {a: F.lit(float(p)) * (F.col("_all") - 1) for a, p in shares.items()}
    ends = {(a, f): f(at).cast("long") for a, at in place.items() for f in (F.floor, F.ceil)}
    inside = lambda at, start, n: (start <= at) & (at < start + n)
    cells = cells.where(reduce(lambda a, b: a | b, (inside(at, F.col("_passed"), F.col("_rows")) for at in ends.values())))
    v = v.join(F.broadcast(cells), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_cell") == F.col("_c")))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v = v.withColumn("_start", F.col("_passed") + before)
    held = lambda a, f: F.max(F.when(inside(ends[a, f], F.col("_start"), F.col("_n")), F.col("_v")))
    found = v.groupBy(F.col(by).alias("_by"), "_all").agg(*(held(a, f).alias(f"_{n}_{a}") for a in shares for n, f in (("low", F.floor), ("high", F.ceil))))

    def between(a: str):
        low, high, part = F.col(f"_low_{a}"), F.col(f"_high_{a}"), place[a] - F.floor(place[a])
        return F.when(part == 0, low).otherwise((1 - part) * low + part * high)

    found = found.select("_by", *(between(a).alias(a) for a in shares))
    return counted.select(by).distinct().join(found, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
