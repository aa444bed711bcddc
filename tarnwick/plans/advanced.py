"""Queries of the library's own joins, frames, sketches and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators.asof import asof_merge
from tarnwick.operators.frames import exclude_frame, groups_frame
from tarnwick.operators.intervals import interval_join
from tarnwick.operators.pairs import near_vectors, similar_sets
from tarnwick.operators.sketches import CountMin
from tarnwick.operators.vectors import top_products
from tarnwick.plans.registry import query
from tarnwick.sources import table


@query("""SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, c_acctbal AS a, c_acctbal + 15 AS b FROM customer) JOIN (SELECT s_suppkey, s_acctbal AS c, s_acctbal + 10 AS d FROM supplier) ON a < d AND c < b""")
def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("a"), (F.col("c_acctbal") + 15).alias("b"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("c"), (F.col("s_acctbal") + 10).alias("d"))
    return interval_join(c, s, ("a", "b"), ("c", "d")).select("c_custkey", "s_suppkey")


@query("""SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON c.user_id = p.user_id AND c.ts <= p.ts + INTERVAL 3 HOUR AND p.ts - INTERVAL 3 HOUR <= c.ts + INTERVAL 6 HOUR
WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def interval_overlaps_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed intervals around a user's clicks and purchases."""
    e = table(spark, sf_dir, "events")
    around = lambda kind, name, before, after, ends: e.where(f"event_type = '{kind}'").select("user_id", F.col("event_id").alias(name), (F.col("ts") - F.expr(f"INTERVAL {before} HOUR")).alias(ends[0]), (F.col("ts") + F.expr(f"INTERVAL {after} HOUR")).alias(ends[1]))
    return interval_join(around("click", "click", 0, 6, ("a", "b")), around("purchase", "purchase", 3, 3, ("c", "d")), ("a", "b"), ("c", "d"), ["user_id"], closed=True).select("click", "purchase")


def _clicks_and_purchases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"))


_SIDES = "(SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')"


@query(f"SELECT e.event_id, b.event_id AS next_purchase FROM {_SIDES} b ON e.user_id = b.user_id AND e.ts <= b.ts")
def asof_next_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, bought = _clicks_and_purchases(spark, sf_dir)
    return asof_merge(clicks, bought, ["user_id"], "ts", {"purchase": "next_purchase"}, "forward").select("event_id", "next_purchase")


@query(f"SELECT e.event_id, CASE WHEN e.ts - b.ts <= INTERVAL 2 HOUR THEN b.event_id END AS recent_purchase FROM {_SIDES} b ON e.user_id = b.user_id AND e.ts > b.ts")
def asof_recent_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictly before, two hours back at most."""
    clicks, bought = _clicks_and_purchases(spark, sf_dir)
    return asof_merge(clicks, bought, ["user_id"], "ts", {"purchase": "recent_purchase"}, "backward", F.expr("INTERVAL 2 HOUR"), exact=False).select("event_id", "recent_purchase")


@query(f"""SELECT event_id, CASE WHEN least(coalesce(back, INTERVAL 1000 DAY), coalesce(ahead, INTERVAL 1000 DAY)) > INTERVAL 6 HOUR THEN NULL WHEN ahead IS NULL OR back <= ahead THEN was ELSE next END AS nearest_purchase
FROM (SELECT e.event_id, b.event_id AS was, e.ts - b.ts AS back FROM {_SIDES} b ON e.user_id = b.user_id AND e.ts >= b.ts) JOIN (SELECT e.event_id, b.event_id AS next, b.ts - e.ts AS ahead FROM {_SIDES} b ON e.user_id = b.user_id AND e.ts <= b.ts) USING (event_id)""")
def asof_nearest_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, bought = _clicks_and_purchases(spark, sf_dir)
    return asof_merge(clicks, bought, ["user_id"], "ts", {"purchase": "nearest_purchase"}, "nearest", F.expr("INTERVAL 6 HOUR")).select("event_id", "nearest_purchase")


_GROUPS = "(PARTITION BY o_orderpriority ORDER BY o_orderdate GROUPS BETWEEN {} AND {})"
_FOUR = {"least": ("min", "o_custkey"), "most": ("max", "o_custkey"), "n": ("count", "o_custkey"), "mean": ("avg", "o_custkey"), "total": ("sum", "o_custkey")}


def _groups_sql(start: str, end: str) -> str:
    w = _GROUPS.format(start, end)
    return f"SELECT o_orderkey, min(o_custkey) OVER {w} AS least, max(o_custkey) OVER {w} AS most, count(o_custkey) OVER {w} AS n, round(avg(o_custkey) OVER {w}, 4) AS mean, CAST(sum(o_custkey) OVER {w} AS BIGINT) AS total FROM orders"


def _groups_query(name: str, start: str, end: str, before: int | None, after: int | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = groups_frame(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderdate", _FOUR, before, after)
        return rows.select("o_orderkey", "least", "most", "n", F.round("mean", 4).alias("mean"), "total")

    run.__name__ = name
    query(_groups_sql(start, end))(run)


_groups_query("groups_frame_aggregates", "2 PRECEDING", "CURRENT ROW", 2, 0)
_groups_query("groups_frame_running", "UNBOUNDED PRECEDING", "1 FOLLOWING", None, 1)
_groups_query("groups_frame_remaining", "1 PRECEDING", "UNBOUNDED FOLLOWING", 1, None)

_EXCLUDE = {"current row": "CURRENT ROW", "group": "GROUP", "ties": "TIES"}


def _exclude_query(name: str, source: str, key: str, by: str, order: str, then: list[str], functions: dict[str, tuple[str, str]], kind: str, start: int | None, end: int | None, excludes: tuple[str, ...] = tuple(_EXCLUDE)) -> None:
    bound = lambda n, side: f"UNBOUNDED {side}" if n is None else "CURRENT ROW" if n == 0 else f"{abs(n)} {side}"
    frame = f"(PARTITION BY {by} ORDER BY {order} {kind.upper()} BETWEEN {bound(start, 'PRECEDING')} AND {bound(end, 'FOLLOWING')} EXCLUDE "
    sql = {"first": "first_value", "last": "last_value"}
    each = {f"{alias}_{x.split()[-1]}": (fn, v, x) for x in excludes for alias, (fn, v) in functions.items()}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return exclude_frame(table(spark, sf_dir, source), [by], order, then, each, kind, start, end).select(key, *each)

    run.__name__ = name
    query(f"SELECT {key}, {', '.join(f'{sql.get(fn, fn)}({v}) OVER {frame}{_EXCLUDE[x]}) AS {a}' for a, (fn, v, x) in each.items())} FROM {source}")(run)


_exclude_query("exclude_from_whole_range", "orders", "o_orderkey", "o_custkey", "o_orderpriority", ["o_orderkey"], {"low": ("min", "o_totalprice"), "high": ("max", "o_totalprice"), "n": ("count", "o_totalprice")}, "range", None, None)
_exclude_query("exclude_from_running_range", "orders", "o_orderkey", "o_custkey", "o_orderpriority", ["o_orderkey"], {"low": ("min", "o_totalprice"), "high": ("max", "o_totalprice")}, "range", None, 0)
_exclude_query("exclude_from_value_range", "part", "p_partkey", "p_brand", "p_size", ["p_partkey"], {"low": ("min", "p_retailprice"), "high": ("max", "p_retailprice"), "n": ("count", "p_partkey")}, "range", -3, 5)
_exclude_query("exclude_from_near_rows", "events", "event_id", "user_id", "ts", ["event_id"], {"low": ("min", "value"), "first": ("first", "event_id"), "last": ("last", "event_id")}, "rows", -3, 2)
_exclude_query("exclude_from_all_rows", "orders", "o_orderkey", "o_custkey", "o_orderpriority", ["o_orderkey"], {"low": ("min", "o_totalprice"), "high": ("max", "o_totalprice")}, "rows", None, None)


@query("""SELECT probe_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT a.vec_id AS probe_id, b.vec_id AS id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score,
row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5""")
def vector_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector, exactly."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_products(e, e, 5, other=True).select("probe_id", "rank", "id", F.round("score", 6).alias("score"))


_CELLS = ", ".join(f"{{'line': {i}, 'cell': CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT) % 2719}}" for i in range(5))


@query(f"""WITH i AS (SELECT l_partkey, sha256('0:' || l_partkey) AS h, count(*) AS n FROM lineitem GROUP BY l_partkey), c AS (SELECT l_partkey, n, unnest([{_CELLS}]) AS place FROM i),
s AS (SELECT place, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY place) SELECT l_partkey, min(s.n) AS estimate, min(c.n) AS n FROM c JOIN s USING (place) GROUP BY l_partkey""")
def count_min_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of every part's lines, from sketches of two halves of the table that are added up, beside their counts.

    Within a thousandth of the table's rows above the count, at 99 %.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    cm = CountMin(0.001, 0.99)
    sketch = cm.merged(cm.sketch(lines.where("l_returnflag = 'R'"), "l_partkey"), cm.sketch(lines.where("l_returnflag <> 'R' OR l_returnflag IS NULL"), "l_partkey"))
    return cm.estimates(sketch, lines, "l_partkey").join(lines.groupBy("l_partkey").agg(F.count("*").alias("n")), "l_partkey")


@query(None)
def similar_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who were active on nearly the same days: all pairs, held against brute force in a test."""
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.collect_set(F.date_format("ts", "yyyy-MM-dd")).alias("days"))
    return similar_sets(days, "days", 0.9)


@query(None)
def near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors at most 0.9 apart: all, as above."""
    return near_vectors(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "embedding", 0.9)


@query(None)
def hash_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that are Spark's own, and soundex; a test computes them anew."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.xxhash64("c_name").alias("x"), F.xxhash64("c_custkey").alias("xk"), F.hash("c_custkey").alias("m"), F.soundex("c_mktsegment").alias("s"))
