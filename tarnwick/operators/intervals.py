"""Joins of intervals with points and with intervals, without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.operators.cells import Cells


def stab_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, by: list[str] | None = None, strict: bool = False, closed: bool = False, most: int | None = None) -> DataFrame:
    """Points with the intervals of their key that hold them: low <= point < high; strict: low < point; closed: point <= high.

    A point lies in one cell, an interval goes to the cells it meets. Cells are cut by the points' own quantiles, so an
    interval in k cells holds about k - 2 cells full of points, all of them results: its copies are bounded by the rows
    it gives, and a dense stretch is many cells. Null keys (where there are keys), points and ends meet nothing.
    """
    by = by or []
    upto: Column = F.col(point) <= F.col(high) if closed else F.col(point) < F.col(high)
    inside = (F.col(low) < F.col(point) if strict else F.col(low) <= F.col(point)) & upto
    known = lambda df, *cols: df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*by, *cols)))
    points, intervals = known(points, point), known(intervals, low, high).where(F.col(low) <= F.col(high) if closed else F.col(low) < F.col(high))
    cells = Cells(points, by, point, most)
    p = cells.add(points, _cell=F.col(point))
    i = cells.add(intervals, _from=F.col(low), _upto=F.col(high)).withColumn("_cell", F.explode(F.sequence("_from", "_upto"))).drop("_from", "_upto")
    return p.join(i, [*by, "_cell"]).where(inside).drop("_cell")


def interval_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], by: list[str] | None = None, closed: bool = False, most: int | None = None) -> DataFrame:
    """Pairs of intervals of one key that overlap: [low, high), or [low, high] if closed; columns of both, the key's once.

    Of two that overlap, either right starts in left (at its start too), or left starts in right behind its start: never
    both. So two joins of starts with intervals give each pair once, with no pair to drop. Empty intervals (high <= low;
    closed: high < low) and null ends or keys meet nothing. Other columns of left and right must have different names.
    """
    by = by or []
    full = lambda df, ends: df.where(F.col(ends[0]) <= F.col(ends[1]) if closed else F.col(ends[0]) < F.col(ends[1]))
    left, right = full(left, left_ends), full(right, right_ends)
    columns = [*by, *(c for c in left.columns if c not in by), *(c for c in right.columns if c not in by)]
    first = stab_join(right, left, right_ends[0], *left_ends, by=by, closed=closed, most=most)
    second = stab_join(left, right, left_ends[0], *right_ends, by=by, strict=True, closed=closed, most=most)
    return first.select(*columns).unionByName(second.select(*columns))
