"""Registered queries of the relational engine and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwick.functions import ascii_words, ngrams
from tarnwick.operators.frames import groups_frame as peer_groups, sessions, sum_excluding_current, sum_excluding_peers
from tarnwick.operators.joins import asof_join, cosine, inner_product, range_join
from tarnwick.operators.quantiles import quantiles as exact_quantiles
from tarnwick.plans.registry import QUERIES, SQL, plain, query  # noqa: F401
from tarnwick.sources import table

@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_regionkey = 1 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
GROUP BY n_name""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").where("o_orderdate >= timestamp_ntz '1996-01-01' AND o_orderdate < timestamp_ntz '1997-01-01'")
    places = t("nation").join(t("region").where("r_regionkey = 1"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


plain("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
plain("filter_project", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
plain("left_join_counts", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
plain("full_outer_join", "SELECT count(*) AS n, count(o_orderkey) AS n_left, count(l_orderkey) AS n_right FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') o FULL OUTER JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 25) l ON o_orderkey = l_orderkey")
plain("semi_join_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
plain("anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
plain("correlated_scalar", "SELECT c_custkey FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) * 1.5 FROM customer d WHERE d.c_nationkey = c.c_nationkey)")
plain("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
plain("cube_counts", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
plain("rollup_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
plain("filtered_aggregates", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS n_large, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY o_orderstatus")
plain("having_top", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) >= 40")
plain("rank_functions", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
"SELECT o_orderkey, cast(row_number() OVER w AS bigint) AS rn, cast(rank() OVER w AS bigint) AS rk, cast(dense_rank() OVER w AS bigint) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
plain("lag_lead", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM events")
plain("running_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n FROM events")
plain("top_k_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) t WHERE rn <= 3")
plain("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
plain("union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
plain("intersect_all", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 48 INTERSECT ALL SELECT l_partkey FROM lineitem WHERE l_discount > 0.08")
plain("except_all", "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 48 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_discount > 0.08")
plain("string_functions", "SELECT c_custkey, upper(c_name) AS up, substring(c_name, 2, 4) AS piece, replace(c_mktsegment, 'A', '_') AS swapped, reverse(c_name) AS back FROM customer")
plain("case_when_null", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'F'), 'done') AS status FROM orders")
plain("json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", "SELECT event_id, get_json_object(props, '$.k') AS k FROM events")
plain("date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders")
plain("text_digest", "SELECT doc_id, sha256(text) AS sha FROM documents", "SELECT doc_id, sha2(text, 256) AS sha FROM documents")
plain("exact_copies", "SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY sha256(text) HAVING count(*) > 1", "SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY sha2(text, 256) HAVING count(*) > 1")
plain("conversation_turns", "SELECT conv_id, count(*) AS turns, min(role) AS first_role, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")


@query("""SELECT e.event_id, e.user_id, e.ts, b.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON e.user_id = b.user_id AND e.ts >= b.ts""")
def asof_last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return asof_join(clicks, e.where("event_type = 'purchase'"), "user_id", "ts", "event_id", "last_purchase", lambda at: F.date_trunc("day", at))


@query("""SELECT event_id, event_id % 2 AS half, ts, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY event_id % 2 ORDER BY ts) AS last_error FROM events""")
def asof_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("half", F.col("event_id") % 2)
    day = lambda at: F.date_trunc("day", at)
    return asof_join(e.select("event_id", "half", "ts"), e.where("event_type = 'error'"), "half", "ts", "event_id", "last_error", day)


@query("""SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 25""")
def range_join_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 25).alias("high"))
    return range_join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), s, "c_acctbal", "low", "high", 25.0).select("c_custkey", "s_suppkey")


@query("""SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS total FROM orders""")
def groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peer_groups(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderdate", {"total": ("sum", "o_custkey")}, 1, 1).select("o_orderkey", "total")


@query("""SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS around FROM events""")
def exclude_current_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(-2, 2)
    return table(spark, sf_dir, "events").select("event_id", sum_excluding_current("event_id", w).alias("around"))


_PEERS = "(PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE "


@query(f"SELECT o_orderkey, CAST(sum(o_orderkey) OVER {_PEERS} GROUP) AS BIGINT) AS no_peers, CAST(sum(o_orderkey) OVER {_PEERS} TIES) AS BIGINT) AS no_ties FROM orders")
def exclude_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = [sum_excluding_peers("o_orderkey", "o_custkey", "o_orderpriority", ties).alias(name) for name, ties in (("no_peers", False), ("no_ties", True))]
    return table(spark, sf_dir, "orders").select("o_orderkey", *sums)


@query("""SELECT user_id, session_no, count(*) AS n FROM (SELECT user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session_no
FROM (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, session_no""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"), "user_id", "ts", "2 HOURS").groupBy("user_id", "session_no").agg(F.count("*").alias("n"))


@query("""SELECT vec_id, label, round(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 4) AS product FROM embeddings""")
def inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    probe = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 0").first()["embedding"]])
    return e.select("vec_id", "label", F.round(inner_product(F.col("embedding"), probe), 4).alias("product"))


@query("""WITH c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre), 6) AS cosine FROM embeddings JOIN c USING (label)""")
def cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against its own label's mean."""
    e = table(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("centre"))
    return e.join(centres, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"))


@query("""SELECT doc_id, CAST(greatest(len(w) - 1, 0) AS BIGINT) AS n_bigrams, CASE WHEN len(w) >= 2 THEN w[1] || ' ' || w[2] END AS first_bigram
FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents)""")
def word_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = ngrams(ascii_words(F.col("text")), 2)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(grams).cast("long").alias("n_bigrams"), F.try_element_at(grams, F.lit(1)).alias("first_bigram"))


@query("""PIVOT (SELECT o_custkey % 7 AS k, o_orderstatus FROM orders) ON o_orderstatus IN ('F', 'O', 'P') USING count(*) GROUP BY k""")
def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("k"), "o_orderstatus")
    return rows.groupBy("k").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


plain("right_join_counts", "SELECT n_nationkey, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey")
plain("theta_join", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_nationkey < r_regionkey * 3")
plain("using_join", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
plain("in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
plain("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
plain("lateral_top", "SELECT c_custkey, o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t",
# (Spark's own ORDER BY with LIMIT in a lateral subquery gives other rows on large tables)
"SELECT c_custkey, o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) r WHERE o_custkey = c_custkey AND place <= 2) t")
plain("recursive_walk", "WITH RECURSIVE walk(k, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, depth + 1 FROM walk JOIN nation ON n_nationkey = k * 2 + 1) SELECT k, depth FROM walk")
plain("statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(median(l_quantity), 4) AS med FROM lineitem GROUP BY l_returnflag")


@query("SELECT l_linestatus, round(quantile_cont(l_extendedprice, 0.9), 2) AS p90, round(quantile_cont(l_extendedprice, 0.25), 2) AS p25 FROM lineitem GROUP BY l_linestatus")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_extendedprice", {"p90": 0.9, "p25": 0.25})
    return found.select("l_linestatus", F.round("p90", 2).alias("p90"), F.round("p25", 2).alias("p25"))


plain("arg_extremes", "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS dearest, min_by(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY o_custkey")
plain("logic_aggregates", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS every_large, bool_or(o_totalprice > 400000) AS any_large, bit_xor(o_orderkey) AS x FROM orders GROUP BY o_orderstatus")
plain("string_aggregate", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
plain("several_distincts", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_quantity) AS quantities FROM lineitem GROUP BY l_returnflag")
plain("window_distribution", "SELECT o_orderkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
plain("window_values", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
plain("range_interval_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM events")
plain("latest_order", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
"SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t WHERE rn = 1")
plain("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
plain("intersect_distinct", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
plain("except_distinct", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
plain("regex_functions", "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '*', 'g') AS masked, regexp_matches(p_name, '[0-9]$') AS ends_in_digit, regexp_extract(p_brand, '([0-9]+)', 1) AS digits FROM part",
"SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '*') AS masked, p_name RLIKE '[0-9]$' AS ends_in_digit, regexp_extract(p_brand, '([0-9]+)', 1) AS digits FROM part")
plain("pad_and_split", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, split_part(c_name, '_', 2) AS tail, concat_ws('-', c_mktsegment, c_name) AS both_names, CAST(levenshtein(c_name, c_mktsegment) AS BIGINT) AS edits FROM customer",
"SELECT c_custkey, lpad(CAST(c_custkey AS STRING), 8, '0') AS padded, split_part(c_name, '_', 2) AS tail, concat_ws('-', c_mktsegment, c_name) AS both_names, CAST(levenshtein(c_name, c_mktsegment) AS BIGINT) AS edits FROM customer")
plain("math_functions", "SELECT o_orderkey, round(ln(o_totalprice), 6) AS ln_price, round(sqrt(o_totalprice), 6) AS root, CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands, o_orderkey % 7 AS rest, greatest(o_custkey, o_orderkey) AS larger FROM orders")
plain("date_arithmetic", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS month_start, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(datediff('day', TIMESTAMP '1995-01-01', o_orderdate) AS BIGINT) AS days FROM orders",
"SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS month_start, quarter(o_orderdate) AS q, CAST(datediff(o_orderdate, TIMESTAMP_NTZ '1995-01-01') AS BIGINT) AS days FROM orders")
plain("array_functions", "SELECT doc_id, CAST(len(w) AS BIGINT) AS n, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, list_contains(w, 'the') AS has_the FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)",
"SELECT doc_id, CAST(size(w) AS BIGINT) AS n, CAST(size(array_distinct(w)) AS BIGINT) AS n_distinct, array_contains(w, 'the') AS has_the FROM (SELECT doc_id, split(text, ' ', -1) AS w FROM documents)")
plain("higher_order", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n_positive FROM embeddings", "SELECT vec_id, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS n_positive FROM embeddings")
plain("word_counts", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word", "SELECT word, count(*) AS n FROM (SELECT explode(split(text, ' ', -1)) AS word FROM documents) GROUP BY word")
plain("daily_events", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('day', ts), event_type",
"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('day', ts), event_type")


@query("""SELECT time_bucket(INTERVAL '6 hours', ts) - to_hours(6 * k) AS start, count(*) AS n FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.window("ts", "1 day", "6 hours").alias("w"))
    return rows.groupBy(F.col("w.start").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, name, value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) UNPIVOT (value FOR name IN (p_size, p_retailprice))""")
def unpivot_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rows.unpivot("p_partkey", ["p_size", "p_retailprice"], "name", "value")


from tarnwick.plans import advanced, scalars, streams, surfaces  # noqa: E402, F401  (they register their queries)
