"""As-of and range joins without nested loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str, alias: str, cell: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with the value of right's last row of the same key at or before its time; null where there is none.

    One union and one window: a single shuffle by key. Among rows of one time right's come first. A null key or time
    meets nothing; a matched row's null value counts as a match. ``cell``, a step function that rises with time (such
    as the day), splits a hot key: the window runs in each (key, cell), and the last value of the cells before is
    carried over by a window over one row a cell.
    """
    rest = [c for c in left.columns if c not in (by, at)]
    held = F.struct(F.col(value).alias("v"))
    r = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(by, at, F.lit(0).alias("_side"), held.alias("_value"))
    l = left.select(by, at, F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_value"].dataType).alias("_value"), F.struct(*rest).alias("_row"))  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_cell", cell(F.col(at)) if cell else F.lit(0))
    w = Window.partitionBy(by, "_cell").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last("_value", ignorenulls=True).over(w)
    out = both.withColumn("_found", found)
    if cell:
        ends = both.groupBy(by, "_cell").agg(F.max_by("_value", F.when(F.col("_side") == 0, F.col(at))).alias("_end"))
        before = Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(F.col(by).alias("_by"), F.col("_cell").alias("_at"), F.last("_end", ignorenulls=True).over(before).alias("_before"))
        out = out.join(carried, (F.col(by) == F.col("_by")) & (F.col("_cell") == F.col("_at")), "left").withColumn("_found", F.coalesce("_found", "_before"))
    matched = F.when(F.col(by).isNotNull() & F.col(at).isNotNull(), F.col("_found.v"))
    return out.where("_side = 1").select(by, at, "_row.*", matched.alias(alias))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points joined with the ranges [low, high) that hold them: each range goes to the cells of that width it meets."""
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    r = ranges.where(F.col(high) > F.col(low)).withColumn("_cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    p = points.withColumn("_cell", cell(F.col(point)))
    return p.join(r, "_cell").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_cell")


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products of two numeric arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays over their lengths; null where one has length 0."""
    norms = F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b))
    return F.when(norms > 0, inner_product(a, b) / norms)
