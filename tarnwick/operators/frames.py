"""Window frames that Spark's SQL has no syntax for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.operators.cells import Cells
from tarnwick.sources import stored


#: Partial aggregates of each function, by how two of them become one.
_PARTS = {"sum": ("sum",), "count": ("count",), "min": ("min",), "max": ("max",), "avg": ("sum", "count")}
_MERGED = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _two(kind: str, a: Column, b: Column) -> Column:
    """Two partial aggregates, either of which may be of no rows (null), as one."""
    return {"min": F.least, "max": F.greatest}[kind](a, b) if kind in ("min", "max") else F.coalesce(a + b, a, b)


def groups_frame(df: DataFrame, by: list[str], order: str, aggregates: dict[str, tuple[str, str]], before: int | None, after: int | None, most: int | None = None, block: int = 1 << 16) -> DataFrame:
    """df with fn(value) OVER (PARTITION BY by ORDER BY order GROUPS BETWEEN before PRECEDING AND after FOLLOWING) as alias.

    aggregates: alias -> (sum, count, min, max or avg; column). before, after: 0 or more, None for UNBOUNDED.

    Rows are aggregated by peer group first; no row is sorted by its key. Groups get their rank in the key from cells
    (see ``cells``), and frames run over blocks of ``block`` ranks, so a key with many groups is many tasks: bounded ends
    bring their neighbours' groups along, an unbounded one is the carried aggregate of all blocks before. Then each row
    gets its group's result. Null orders are one group, the first; null keys are a key.
    """
    if before is None and after is not None:  # looking back without a bound is looking ahead in reverse order
        return _groups_frame(df, by, order, aggregates, after, None, most, block, True)
    return _groups_frame(df, by, order, aggregates, before, after, most, block, False)


def _groups_frame(df: DataFrame, by: list[str], order: str, aggregates: dict[str, tuple[str, str]], before: int | None, after: int | None, most: int | None, block: int, reverse: bool) -> DataFrame:
    parts = {f"_{kind}_{value}": (kind, value) for fn, value in aggregates.values() for kind in _PARTS[fn]}
    keys = [f"_k{i}" for i in range(len(by))]
    groups = df.groupBy(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col(order).alias("_o")).agg(*(getattr(F, kind)(value).alias(name) for name, (kind, value) in parts.items()))
    if before is None and after is None:
        done = groups.groupBy(*keys).agg(*(_MERGED[kind](name).alias(name) for name, (kind, _) in parts.items()))
        on = [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys, strict=True)]
    else:
        done = _framed(stored(groups, "peer-groups"), keys, parts, before, after, most, block, reverse)
        on = [F.col(b).eqNullSafe(F.col(k)) for b, k in zip((*by, order), (*keys, "_o"), strict=True)]
    value = lambda fn, v: F.coalesce(f"_count_{v}", F.lit(0)) if fn == "count" else F.col(f"_sum_{v}") / F.col(f"_count_{v}") if fn == "avg" else F.col(f"_{fn}_{v}")
    joined = df.join(done, reduce(lambda a, b: a & b, on)) if on else df.crossJoin(F.broadcast(done))  # no key, whole table: one row
    return joined.select(*df.columns, *(value(fn, v).alias(alias) for alias, (fn, v) in aggregates.items()))


def _framed(groups: DataFrame, keys: list[str], parts: dict[str, tuple[str, str]], before: int, after: int | None, most: int | None, block: int, reverse: bool) -> DataFrame:
    """groups(keys, _o, parts) -> with the parts of their frames; after None: to the key's end (reverse: to its beginning)."""
    cells = Cells(groups, keys, "_o", most)
    g = cells.add(groups, _cell=F.col("_o")).withColumn("_cell", F.coalesce("_cell", F.lit(0)))
    counts = g.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    key = Window.partitionBy(*keys)
    passed = F.coalesce(F.sum("_n").over(key.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(k).alias(f"{k}c") for k in keys), F.col("_cell").alias("_c"), passed.alias("_passed"), F.sum("_n").over(key).alias("_all"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}c")) for k in keys], F.col("_cell") == F.col("_c"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy("_o")) - 1 + F.col("_passed")
    g = g.join(counts, same).withColumn("_rank", F.col("_all") - 1 - rank if reverse else rank).select(*keys, "_o", "_rank", *parts)
    g = stored(g, "ranked-groups")
    at = lambda rank: F.floor(rank / F.lit(block)).cast("long")
    reach = after or 0
    copies = F.sequence(F.greatest(at(F.col("_rank") - reach), F.lit(0)), at(F.col("_rank") + before))
    halo = g.withColumn("_block", F.explode(copies))
    w = Window.partitionBy(*keys, "_block").orderBy("_rank").rowsBetween(-before, Window.unboundedFollowing if after is None else after)
    if after is None:  # the same in descending order, where an unbounded start is one pass
        w = Window.partitionBy(*keys, "_block").orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, before)
    own = halo.withColumns({name: _MERGED[kind](name).over(w) for name, (kind, _) in parts.items()}).where(at(F.col("_rank")) == F.col("_block"))
    if after is None:
        later = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
        sums = g.groupBy(*keys, at(F.col("_rank")).alias("_block")).agg(*(_MERGED[kind](name).alias(name) for name, (kind, _) in parts.items()))
        sums = sums.select(*(F.col(k).alias(f"{k}c") for k in keys), F.col("_block").alias("_b"), *(_MERGED[kind](name).over(later).alias(f"{name}_later") for name, (kind, _) in parts.items()))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}c")) for k in keys], F.col("_block") == F.col("_b"))
        own = own.join(sums, same).withColumns({name: _two(kind, F.col(name), F.col(f"{name}_later")) for name, (kind, _) in parts.items()})
    return own.select(*keys, "_o", *parts)


def exclude_frame(df: DataFrame, by: list[str], order: str, then: list[str], aggregates: dict[str, tuple[str, ...]], kind: str, start: int | None, end: int | None, exclude: str = "no others") -> DataFrame:
    """df with fn(value) OVER (PARTITION BY by ORDER BY order kind BETWEEN start AND end EXCLUDE exclude) as alias.

    aggregates: alias -> (sum, count, min, max, first or last; column), or with an exclude of its own as third; together
    they share their windows and sorts. kind: rows or range. start: None for UNBOUNDED
    PRECEDING, 0 or -n; end: None, 0 or n; offsets of a range need an order of whole numbers. exclude: current row,
    group, ties or no others. ``then``: columns that with order make rows of a key unique; they decide the order of peers.

    What is left is three parts, none of which needs a subtraction, so it serves min, max and first too: the frame before
    the excluded rows, what of the peers stays, and the frame after. Unbounded parts are running aggregates in ascending
    and in descending order; parts of bounded ROWS frames that must leave out peers are the frame's rows as an array.
    """
    if kind not in ("rows", "range") or exclude not in ("current row", "group", "ties", "no others") or (start or 0) > 0 or (end or 0) < 0:
        raise ValueError(f"frame: {kind}, {start}, {end}, {exclude}")
    place = F.struct(order, *then)
    whole = Window.partitionBy(*by)
    up, down = whole.orderBy(order, *then), whole.orderBy(F.col(order).desc(), *(F.col(c).desc() for c in then))
    d = df.withColumn("_g", F.dense_rank().over(whole.orderBy(order)))

    def over(fn: str, value: str, w) -> Column:
        if fn in ("first", "last"):  # a struct tells a null value from no row
            return (F.min_by if fn == "first" else F.max_by)(F.struct(value), place).over(w)
        return getattr(F, fn)(value).over(w)

    def listed(fn: str, value: str, first: int, last: int, behind: bool) -> Column:
        """Over those rows of the frame that are no peers."""
        rows = F.collect_list(F.struct("_g", F.col(value).alias("v"))).over(up.rowsBetween(first, last))
        kept = F.transform(F.filter(rows, lambda x: x["_g"] > F.col("_g") if behind else x["_g"] < F.col("_g")), lambda x: F.struct(x["v"].alias(value)))
        if fn in ("first", "last"):
            return F.try_element_at(kept, F.lit(1 if fn == "first" else -1))
        values = F.filter(F.transform(kept, lambda x: x[value]), lambda x: x.isNotNull())
        if fn == "count":
            return F.size(values).cast("long")
        return F.array_min(values) if fn == "min" else F.array_max(values) if fn == "max" else F.when(F.size(values) > 0, F.aggregate(values, F.lit(0).cast(total_of(value)), lambda s, x: s + x))

    def total_of(value: str) -> str:
        return df.select(F.sum(value).alias("s")).schema["s"].dataType.simpleString()

    def side(fn: str, value: str, bound: int | None, behind: bool, exclude: str) -> Column | None:
        """The frame's part before or behind the current row, without its peers where those are left out."""
        if bound == 0:
            return None
        peers = exclude in ("group", "ties") or kind == "range"
        if bound is None:
            groups = whole.orderBy(F.col("_g").desc() if behind else F.col("_g").asc()).rangeBetween(Window.unboundedPreceding, -1)
            return over(fn, value, groups if peers else (down if behind else up).rowsBetween(Window.unboundedPreceding, -1))
        first, last = (1, bound) if behind else (bound, -1)
        if kind == "range":
            return F.when(F.col(order).isNotNull(), over(fn, value, whole.orderBy(order).rangeBetween(first, last)))
        return listed(fn, value, first, last, behind) if peers else over(fn, value, up.rowsBetween(first, last))

    def middle(fn: str, value: str, exclude: str) -> list[Column]:
        own = F.struct(value) if fn in ("first", "last") else F.col(value).isNotNull().cast("long") if fn == "count" else F.col(value)
        if exclude == "group":
            return []
        if exclude == "ties" or kind == "rows":
            return [] if exclude == "current row" else [own]
        peers = Window.partitionBy(*by, "_g")
        others = [over(fn, value, peers.orderBy(*turn).rowsBetween(Window.unboundedPreceding, -1)) for turn in ([F.col(c).asc() for c in then], [F.col(c).desc() for c in then])]
        return others if exclude == "current row" else [others[0], own, others[1]]

    def result(fn: str, value: str, exclude: str = exclude) -> Column:
        if exclude not in ("current row", "group", "ties", "no others"):
            raise ValueError(f"exclude: {exclude}")
        parts = [p for p in (side(fn, value, start, False, exclude), *middle(fn, value, exclude), side(fn, value, end, True, exclude)) if p is not None]
        if not parts:
            return F.lit(0).cast("long") if fn == "count" else F.lit(None).cast(df.schema[value].dataType)
        if fn in ("first", "last"):
            return F.coalesce(*(parts if fn == "first" else parts[::-1]))[value]
        both = reduce(lambda a, b: _two(fn, a, b), parts)
        return F.coalesce(both, F.lit(0)) if fn == "count" else both

    return d.withColumns({alias: result(*of) for alias, of in aggregates.items()}).drop("_g")


def sum_excluding_current(value: str, window: Window) -> Column:
    """sum(value) OVER (window EXCLUDE CURRENT ROW); null where no other row of the frame has a value."""
    others = F.count(value).over(window) - F.col(value).isNotNull().cast("int")
    return F.when(others > 0, F.sum(value).over(window) - F.coalesce(F.col(value), F.lit(0)))


def sessions(df: DataFrame, by: str, at: str, gap: str, alias: str = "session_no") -> DataFrame:
    """Numbers a key's sessions: a new one starts after more than gap without a row."""
    w = Window.partitionBy(by).orderBy(at)
    new = (F.col(at) > F.lag(at).over(w) + F.expr(f"INTERVAL {gap}")).cast("long")
    return df.withColumn(alias, F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def sum_excluding_peers(value: str, by: str, order: str, keep_current: bool = False) -> Column:
    """sum(value) OVER (PARTITION BY by ORDER BY order RANGE UNBOUNDED PRECEDING EXCLUDE GROUP, or EXCLUDE TIES with keep_current).

    The running frame holds all peers of its row, so theirs is subtracted from it; null where no row with a value is left.
    """
    w = Window.partitionBy(by).orderBy(order)
    frame, peers = w.rangeBetween(Window.unboundedPreceding, Window.currentRow), w.rangeBetween(Window.currentRow, Window.currentRow)
    own = lambda c: F.coalesce(c, F.lit(0)) if keep_current else F.lit(0)
    left = F.count(value).over(frame) - F.count(value).over(peers) + own(F.col(value).isNotNull().cast("int"))
    total = F.sum(value).over(frame) - F.coalesce(F.sum(value).over(peers), F.lit(0)) + own(F.col(value))
    return F.when(left > 0, total)
