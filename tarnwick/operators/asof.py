"""As-of joins in either direction, with a tolerance and an exact-match rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.operators.cells import Cells


def asof_merge(
    left: DataFrame, right: DataFrame, by: list[str], at: str, values: dict[str, str], direction: str = "backward", tolerance: Column | None = None, exact: bool = True, ties: list[str] | None = None, most: int | None = None
) -> DataFrame:
    """left with columns of one row of right of its key: the last at or before its time (backward), the first at or after
    (forward), or the nearer of the two, the earlier if they are equally near (nearest).

    values: right's columns and their names in the result. tolerance: the longest distance (a number or an interval).
    exact: whether right's row of the same time counts. Among right's rows of one time the last by ``ties`` (its columns;
    by default the values) is taken backward, the first forward. A null key or time meets nothing; a null value of a
    matched row is a match.

    One union of both sides. It is sorted by (key, cell), cells being cut by the rows' own quantiles, so a hot key is
    many tasks; what reaches over a cell's end, its last and first row of right, is carried by a window over one row a
    cell. Looking ahead is looking back in descending order: each way is one pass.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"direction: {direction}")
    ties = ties or list(values)
    rest = [c for c in left.columns if c not in (*by, at)]
    known = " AND ".join(f"`{c}` IS NOT NULL" for c in (*by, at))
    held = F.struct(F.col(at).alias("t"), F.struct(*(F.col(c) for c in ties)).alias("tie"), *(F.col(c).alias(f"v{i}") for i, c in enumerate(values)))
    r = right.where(known).select(*by, at, held.alias("_held"))
    l = left.select(*by, at, F.struct(F.lit(1), *rest).alias("_row"))  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True)
    cells = Cells(both.where(known), by, at, most)
    both = cells.add(both, _cell=F.col(at)).withColumn("_side", F.col("_row").isNotNull().cast("int"))
    keys = [*by, "_cell"]

    def seek(back: bool) -> Column:
        """Right's last row before in ascending order, or in descending order."""
        turn = (lambda c: F.col(c).asc()) if back else (lambda c: F.col(c).desc())
        first = F.col("_side").asc() if exact else F.col("_side").desc()  # right's row of the same time before or behind left's
        w = Window.partitionBy(*keys).orderBy(turn(at), first, turn("_held.tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.last("_held", ignorenulls=True).over(w)

    ways = {"backward": [True], "forward": [False], "nearest": [True, False]}[direction]
    out = both.withColumns({f"_found{int(back)}": seek(back) for back in ways})
    if cells.n:
        ends = both.groupBy(*keys).agg(F.max("_held").alias("_last"), F.min("_held").alias("_first"))
        over = lambda back: Window.partitionBy(*by).orderBy(F.col("_cell").asc() if back else F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), *(F.last("_last" if back else "_first", ignorenulls=True).over(over(back)).alias(f"_carried{int(back)}") for back in ways))
        same = F.lit(True)
        for i, c in enumerate(keys):
            same = same & (F.col(c) == F.col(f"_k{i}"))
        out = out.join(ends, same, "left").withColumns({f"_found{int(back)}": F.coalesce(f"_found{int(back)}", f"_carried{int(back)}") for back in ways})
    out = out.where("_side = 1")
    one = lambda back: F.col(f"_found{int(back)}")
    distance = lambda back: F.col(at) - one(back)["t"] if back else one(back)["t"] - F.col(at)
    if direction == "nearest":
        ahead = one(False).isNotNull() & (one(True).isNull() | (distance(False) < distance(True)))
        found = F.when(ahead, one(False)).otherwise(one(True))
    else:
        found = one(ways[0])
    # A null key or time shares its cell with others of that kind: right has none of them.
    out = out.withColumn("_one", found)
    if tolerance is not None:
        t = F.col("_one.t")
        out = out.withColumn("_one", F.when((t <= F.col(at) + tolerance) & (F.col(at) <= t + tolerance), F.col("_one")))
    kept = [F.col(c) if c in (*by, at) else F.col(f"_row.{c}") for c in left.columns]
    return out.select(*kept, *(F.col(f"_one.v{i}").alias(name) for i, name in enumerate(values.values())))
