"""Scalar, array, map, JSON and date functions and further aggregates, each as SQL for both engines."""

from __future__ import annotations

from tarnwick.plans.registry import plain

# Strings, hashes, encodings
plain("string_trims", "SELECT p_partkey, trim('  ' || p_name || ' ') AS t, ltrim('xx' || p_name, 'x') AS l, rtrim(p_name || 'yy', 'y') AS r, left(p_brand, 3) AS lead3, right(p_brand, 2) AS tail2 FROM part",
"SELECT p_partkey, trim('  ' || p_name || ' ') AS t, ltrim('x', 'xx' || p_name) AS l, rtrim('y', p_name || 'yy') AS r, left(p_brand, 3) AS lead3, right(p_brand, 2) AS tail2 FROM part")
plain("string_search", "SELECT p_partkey, starts_with(p_name, 'P') AS s, contains(p_type, 'A') AS c, suffix(p_type, 'L') AS e, CAST(instr(p_type, 'E') AS BIGINT) AS at, p_type LIKE '%S_E%' AS lk FROM part",
"SELECT p_partkey, startswith(p_name, 'P') AS s, contains(p_type, 'A') AS c, endswith(p_type, 'L') AS e, CAST(instr(p_type, 'E') AS BIGINT) AS at, p_type LIKE '%S_E%' AS lk FROM part")
plain("string_build", "SELECT s_suppkey, repeat(s_name, 2) AS twice, translate(s_name, 'abc', 'xyz') AS tr, rpad(s_name, 20, '.') AS padded, CAST(ascii(s_name) AS BIGINT) AS code, chr(65 + CAST(s_suppkey % 26 AS INTEGER)) AS letter, lower(s_name) AS low FROM supplier",
"SELECT s_suppkey, repeat(s_name, 2) AS twice, translate(s_name, 'abc', 'xyz') AS tr, rpad(s_name, 20, '.') AS padded, CAST(ascii(s_name) AS BIGINT) AS code, chr(65 + s_suppkey % 26) AS letter, lower(s_name) AS low FROM supplier")
plain("hash_functions", "SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha256(text) AS s2 FROM documents", "SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha2(text, 256) AS s2 FROM documents")
plain("encodings", "SELECT n_nationkey, hex(n_name) AS hx, to_base64(encode(n_name)) AS b64, CAST(octet_length(encode(n_name)) AS BIGINT) AS bytes, CAST(bit_length(n_name) AS BIGINT) AS bits FROM nation",
"SELECT n_nationkey, hex(n_name) AS hx, base64(encode(n_name, 'UTF-8')) AS b64, CAST(octet_length(n_name) AS BIGINT) AS bytes, CAST(bit_length(n_name) AS BIGINT) AS bits FROM nation")
plain("url_parts", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages",
"SELECT page_id, coalesce(try_parse_url(url, 'HOST'), '') AS host, coalesce(try_parse_url(url, 'PROTOCOL'), '') AS scheme FROM pages")
plain("html_text_length", "SELECT page_id, CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) AS BIGINT) AS chars, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs FROM pages",
"SELECT page_id, CAST(length(regexp_replace(html, '<[^>]*>', '')) AS BIGINT) AS chars, CAST(regexp_count(html, '<p[ >]') AS BIGINT) AS paragraphs FROM pages")

# Numbers
plain("trigonometry", "SELECT l_orderkey, l_linenumber, l_partkey, round(sin(l_quantity), 6) AS s, round(atan2(l_tax, l_discount + 1), 6) AS a, round(exp(l_tax), 6) AS e, round(pow(l_quantity, 1.5), 4) AS p, round(cbrt(l_quantity), 6) AS c, round(log10(l_quantity), 6) AS lg, round(degrees(l_tax), 6) AS d FROM lineitem")
plain("rounding", "SELECT o_orderkey, CAST(ceil(o_totalprice) AS BIGINT) AS up, CAST(floor(-o_totalprice) AS BIGINT) AS down, round(o_totalprice, -2) AS hundreds, CAST(sign(o_totalprice - 150000) AS INTEGER) AS side, abs(o_totalprice - 150000) AS distance FROM orders",
"SELECT o_orderkey, CAST(ceil(o_totalprice) AS BIGINT) AS up, CAST(floor(-o_totalprice) AS BIGINT) AS down, round(o_totalprice, -2) AS hundreds, CAST(sign(o_totalprice - 150000) AS INT) AS side, abs(o_totalprice - 150000) AS distance FROM orders")
plain("bit_operations", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 7 AS o, xor(o_orderkey, o_custkey) AS x, o_custkey << 3 AS l, o_custkey >> 2 AS r, CAST(bit_count(o_orderkey) AS BIGINT) AS ones FROM orders",
"SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 7 AS o, o_orderkey ^ o_custkey AS x, shiftleft(o_custkey, 3) AS l, shiftright(o_custkey, 2) AS r, CAST(bit_count(o_orderkey) AS BIGINT) AS ones FROM orders")
plain("safe_arithmetic", "SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS ratio, TRY_CAST(l_returnflag AS INTEGER) AS flag_number, TRY_CAST('12' AS BIGINT) + l_partkey AS k FROM lineitem",
"SELECT l_orderkey, l_partkey, l_linenumber, round(try_divide(l_tax, l_discount), 6) AS ratio, try_cast(l_returnflag AS INT) AS flag_number, try_cast('12' AS BIGINT) + l_partkey AS k FROM lineitem")
plain("width_buckets", "SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS bucket, count(*) AS n FROM orders GROUP BY 1", "SELECT CAST(width_bucket(o_totalprice, 0, 1000000, 20) - 1 AS BIGINT) AS bucket, count(*) AS n FROM orders GROUP BY 1")
plain("decimals", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS total FROM lineitem GROUP BY l_returnflag")

# Dates
plain("date_shifts", "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS month_later, CAST(o_orderdate AS DATE) - 10 AS earlier, last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy, CAST(dayofweek(o_orderdate) AS BIGINT) AS dow, CAST(weekofyear(o_orderdate) AS BIGINT) AS week FROM orders",
"SELECT o_orderkey, add_months(CAST(o_orderdate AS DATE), 1) AS month_later, date_sub(CAST(o_orderdate AS DATE), 10) AS earlier, last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy, CAST(dayofweek(o_orderdate) - 1 AS BIGINT) AS dow, CAST(weekofyear(o_orderdate) AS BIGINT) AS week FROM orders")
plain("date_formats", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS stamp, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS m, CAST(floor(epoch(ts)) AS BIGINT) AS unix, make_date(CAST(year(ts) AS BIGINT), CAST(month(ts) AS BIGINT), 1) AS month_start FROM events",
"SELECT event_id, date_format(ts, 'yyyy-MM-dd HH:mm') AS stamp, hour(ts) AS h, minute(ts) AS m, unix_seconds(CAST(ts AS TIMESTAMP)) AS unix, make_date(year(ts), month(ts), 1) AS month_start FROM events")

# Arrays, maps, JSON
plain("array_sets", "SELECT doc_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS shared, list_has_any(a, b) AS overlap, array_to_string(list_sort(list_distinct(a)), ' ') AS sorted FROM (SELECT doc_id, string_split(lang || ',' || source || ',x', ',') AS a, string_split('en,x,' || lang, ',') AS b FROM documents)",
"SELECT doc_id, CAST(size(array_intersect(a, b)) AS BIGINT) AS shared, arrays_overlap(a, b) AS overlap, array_join(array_sort(array_distinct(a)), ' ') AS sorted FROM (SELECT doc_id, split(lang || ',' || source || ',x', ',') AS a, split('en,x,' || lang, ',') AS b FROM documents)")
plain("array_shapes", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS head, round(CAST(embedding[len(embedding)] AS DOUBLE), 6) AS tail, CAST(len(embedding[3:10]) AS BIGINT) AS n_slice, CAST(len(list_concat(embedding, embedding)) AS BIGINT) AS n_twice, round(CAST(list_max(embedding) AS DOUBLE), 6) AS top FROM embeddings",
"SELECT vec_id, round(CAST(element_at(embedding, 1) AS DOUBLE), 6) AS head, round(CAST(element_at(embedding, -1) AS DOUBLE), 6) AS tail, CAST(size(slice(embedding, 3, 8)) AS BIGINT) AS n_slice, CAST(size(concat(embedding, embedding)) AS BIGINT) AS n_twice, round(CAST(array_max(embedding) AS DOUBLE), 6) AS top FROM embeddings")
plain("array_folds", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 4) AS l1, len(list_filter(embedding, lambda x: x > 0.4)) > 0 AS any_large, len(list_filter(embedding, lambda x: x < 0.9)) = len(embedding) AS all_small FROM embeddings",
"SELECT vec_id, round(aggregate(transform(embedding, x -> abs(CAST(x AS DOUBLE))), CAST(0 AS DOUBLE), (a, x) -> a + x), 4) AS l1, exists(embedding, x -> x > 0.4) AS any_large, forall(embedding, x -> x < 0.9) AS all_small FROM embeddings")
plain("explode_positions", "SELECT vec_id, i - 1 AS pos, round(CAST(embedding[i] AS DOUBLE), 6) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
"SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(CAST(x AS DOUBLE), 6) AS x FROM (SELECT vec_id, posexplode(embedding) AS (pos, x) FROM embeddings)")
plain("maps", "SELECT user_id, CAST(count(DISTINCT event_type) AS BIGINT) AS n_types, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks FROM events GROUP BY user_id",
"SELECT user_id, CAST(size(map_keys(m)) AS BIGINT) AS n_types, coalesce(m['click'], 0) AS clicks FROM (SELECT user_id, map_from_entries(collect_list(struct(event_type, n))) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id)")
plain("json_parse", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, CAST(len(json_keys(props)) AS BIGINT) AS n_keys FROM events",
"SELECT event_id, from_json(props, 'k STRING').k AS k, CAST(size(json_object_keys(props)) AS BIGINT) AS n_keys FROM events")
plain("variants", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", "SELECT event_id, variant_get(parse_json(props), '$.k', 'string') AS k FROM events")
plain("structs", "SELECT c_custkey, c_name AS label, c_mktsegment AS segment FROM customer", "SELECT s.k AS c_custkey, s.v.label AS label, s.v.segment AS segment FROM (SELECT named_struct('k', c_custkey, 'v', named_struct('label', c_name, 'segment', c_mktsegment)) AS s FROM customer)")

# Aggregates and relational forms
plain("covariances", "SELECT l_linestatus, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(regr_intercept(l_extendedprice, l_quantity), 2) AS inter, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(stddev_pop(l_tax), 8) AS sp FROM lineitem GROUP BY l_linestatus")
plain("conditional_counts", "SELECT o_custkey, CAST(count_if(o_totalprice > 100000) AS BIGINT) AS big, count(o_orderkey) AS n, any_value(o_custkey) AS k, CAST(bit_and(o_orderkey) AS BIGINT) AS ba, CAST(bit_or(o_orderkey) AS BIGINT) AS bo FROM orders GROUP BY o_custkey",
"SELECT o_custkey, count_if(o_totalprice > 100000) AS big, count(o_orderkey) AS n, any_value(o_custkey) AS k, bit_and(o_orderkey) AS ba, bit_or(o_orderkey) AS bo FROM orders GROUP BY o_custkey")
plain("third_moment", "SELECT l_returnflag, round(avg(d * d * d) / pow(avg(d * d), 1.5), 6) AS skew FROM (SELECT l_returnflag, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS d FROM lineitem) GROUP BY l_returnflag",
"SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS skew FROM lineitem GROUP BY l_returnflag")
plain("collected_lists", "SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_nationkey), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_join(transform(array_sort(collect_list(struct(n_nationkey, n_name))), x -> x.n_name), '|') AS names FROM nation GROUP BY n_regionkey")
plain("grouping_ids", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS gid, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
"SELECT l_returnflag, l_linestatus, grouping_id() AS gid, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
# Below their sketches' sizes these are exact, so they are held against the counts themselves.
plain("approximate_distinct", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, approx_count_distinct(c_nationkey, 0.01) AS n FROM customer GROUP BY c_mktsegment")
plain("sketch_union", "SELECT count(DISTINCT k) AS n FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey + 10 FROM customer)",
"SELECT hll_sketch_estimate(hll_union_agg(s)) AS n FROM (SELECT hll_sketch_agg(s_nationkey) AS s FROM supplier UNION ALL SELECT hll_sketch_agg(c_nationkey + 10) FROM customer)")
plain("theta_sketches", "SELECT (SELECT count(DISTINCT c_nationkey) FROM customer) AS n, (SELECT count(DISTINCT s_nationkey) FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 9)) AS both",
"SELECT theta_sketch_estimate(c) AS n, theta_sketch_estimate(theta_intersection(few, s)) AS both FROM (SELECT theta_sketch_agg(c_nationkey) AS c, theta_sketch_agg(CASE WHEN c_nationkey < 9 THEN c_nationkey END) AS few FROM customer), (SELECT theta_sketch_agg(s_nationkey) AS s FROM supplier)")
plain("kll_sketches", "SELECT min(o_custkey) AS least, max(o_custkey) AS most, count(*) AS n FROM orders",
"SELECT kll_sketch_get_quantile_bigint(s, 0.0D) AS least, kll_sketch_get_quantile_bigint(s, 1.0D) AS most, kll_sketch_get_n_bigint(s) AS n FROM (SELECT kll_sketch_agg_bigint(o_custkey) AS s FROM orders)")
plain("approximate_quantile", "SELECT quantile_disc(p_size, 0.5) AS mid, quantile_disc(p_size, 0.9) AS high FROM part", "SELECT percentile_approx(p_size, 0.5, 100000) AS mid, percentile_approx(p_size, 0.9, 100000) AS high FROM part")
plain("approximate_top", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type", "SELECT top.item AS event_type, top.count AS n FROM (SELECT explode(approx_top_k(event_type, 5)) AS top FROM events)")
plain("numeric_histogram", "SELECT CAST(c_nationkey AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM customer GROUP BY c_nationkey", "SELECT bin.x AS x, bin.y AS y FROM (SELECT explode(histogram_numeric(CAST(c_nationkey AS DOUBLE), 25)) AS bin FROM customer)")
plain("kurtoses", "SELECT l_returnflag, round(kurtosis_pop(l_quantity), 6) AS k FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(kurtosis(l_quantity), 6) AS k FROM lineitem GROUP BY l_returnflag")
plain("bitmap_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus",
"SELECT o_orderstatus, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_orderstatus, bitmap_bucket_number(o_custkey) AS b, bitmap_count(bitmap_construct_agg(bitmap_bit_position(o_custkey))) AS n FROM orders GROUP BY o_orderstatus, bitmap_bucket_number(o_custkey)) GROUP BY o_orderstatus")
plain("modes", "SELECT o_orderpriority, max(n) AS top FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderpriority",
"SELECT o.o_orderpriority, count(*) AS top FROM orders o JOIN (SELECT o_orderpriority AS p, mode(o_orderstatus) AS m FROM orders GROUP BY o_orderpriority) t ON o.o_orderpriority = t.p AND o.o_orderstatus = t.m GROUP BY o.o_orderpriority")
plain("null_handling_windows", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS last_click FROM events",
"SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts) AS last_click FROM events")
plain("ordered_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40")
plain("values_join", "SELECT n_nationkey, label FROM nation JOIN (VALUES (0, 'a'), (1, 'b'), (4, 'c')) AS v(k, label) ON n_regionkey = k")
plain("common_tables", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), most AS (SELECT max(n) AS m FROM big) SELECT o_custkey, n FROM big, most WHERE n >= m - 2")
plain("pipe_syntax", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey", "FROM customer |> WHERE c_acctbal > 0 |> AGGREGATE count(*) AS n GROUP BY c_nationkey")
plain("merge_join", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey", "SELECT /*+ MERGE(l) */ o.o_orderkey, count(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey")
plain("hash_join", "SELECT o_orderstatus, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus", "SELECT /*+ SHUFFLE_HASH(o) */ o.o_orderstatus, count(*) AS n FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderstatus")

# Further functions
plain("masks", "SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS masked FROM customer", "SELECT c_custkey, mask(c_name) AS masked FROM customer")
plain("collations", "SELECT count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building'", "SELECT count(*) AS n FROM customer WHERE c_mktsegment COLLATE UTF8_LCASE = 'building'")
plain("luhn_checks", """SELECT o_orderkey, list_sum(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN (len(s) - i) % 2 = 0 THEN CAST(s[i] AS INTEGER) ELSE (2 * CAST(s[i] AS INTEGER)) // 10 + (2 * CAST(s[i] AS INTEGER)) % 10 END)) % 10 = 0 AS ok
FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s FROM orders)""", "SELECT o_orderkey, luhn_check(CAST(o_orderkey AS STRING)) AS ok FROM orders")
plain("utf8_checks", "SELECT c_custkey, true AS ok, c_name AS name FROM customer", "SELECT c_custkey, is_valid_utf8(c_name) AS ok, make_valid_utf8(c_name) AS name FROM customer")
plain("sentence_words", "SELECT c_custkey, string_split(replace(c_name, '#', '') || ' of ' || c_mktsegment, ' ') AS words FROM customer", "SELECT c_custkey, sentences(replace(c_name, '#', '') || ' of ' || c_mktsegment)[0] AS words FROM customer")
plain("xml_paths", "SELECT c_custkey, c_nationkey AS place, c_mktsegment AS segment FROM customer", "SELECT c_custkey, xpath_int(x, 'c/n') AS place, from_xml(x, 'n INT, s STRING').s AS segment FROM (SELECT c_custkey, concat('<c><n>', c_nationkey, '</n><s>', c_mktsegment, '</s></c>') AS x FROM customer)")
plain("intervals", "SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY + INTERVAL 2 HOUR + INTERVAL 3 MINUTE AS later, CAST(o_orderdate + INTERVAL 14 MONTH AS TIMESTAMP) AS month_later FROM orders",
"SELECT o_orderkey, o_orderdate + make_dt_interval(1, 2, 3, 0) AS later, o_orderdate + make_ym_interval(1, 2) AS month_later FROM orders")
plain("json_made", "SELECT event_id, json_extract_string(props, '$.k') AS k, to_json(struct_pack(user_id := user_id, event_type := event_type)) AS made FROM events", "SELECT event_id, k, to_json(named_struct('user_id', user_id, 'event_type', event_type)) AS made FROM (SELECT *, json_tuple(props, 'k') AS k FROM events)")
plain("nested_arrays", "SELECT o_orderkey, [o_custkey, o_custkey + 1, o_orderkey] AS flat, o_custkey * 2 AS twice FROM orders",
"SELECT o_orderkey, flatten(array(array(o_custkey, o_custkey + 1), array(o_orderkey))) AS flat, transform_values(map_from_arrays(array('k'), array(o_custkey)), (k, v) -> v * 2)['k'] AS twice FROM orders")
plain("bank_rounding", "SELECT l_orderkey, l_partkey, l_linenumber, round_even(l_quantity / 2, 0) AS even FROM lineitem", "SELECT l_orderkey, l_partkey, l_linenumber, bround(l_quantity / 2, 0) AS even FROM lineitem")
plain("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation", "SELECT /*+ SHUFFLE_REPLICATE_NL(r) */ r_name, n_name FROM region r CROSS JOIN nation")
plain("whole_sample", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(*) AS n FROM lineitem TABLESAMPLE (100 PERCENT) REPEATABLE (1) GROUP BY l_returnflag")

# Set differences that leave rows, samples below the whole, bytes that are no UTF-8
plain("except_all_rest", "SELECT l_suppkey AS k FROM lineitem WHERE l_discount > 0.02 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_discount > 0.05")
plain("except_distinct_rest", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
plain("sampled_share", "SELECT l_returnflag, count(*) AS n, true AS within, 0 AS foreign_rows FROM lineitem GROUP BY l_returnflag",
"""WITH s AS (SELECT * FROM lineitem TABLESAMPLE (20 PERCENT) REPEATABLE (7)), c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag), d AS (SELECT l_returnflag, count(*) AS drawn FROM s GROUP BY l_returnflag)
SELECT c.l_returnflag, n, abs(coalesce(drawn, 0) - 0.2 * n) <= 5 * sqrt(0.16 * n) AS within, CAST((SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM lineitem)) AS INT) AS foreign_rows FROM c LEFT JOIN d ON c.l_returnflag = d.l_returnflag""")
plain("utf8_repairs", "SELECT c_custkey, c_custkey % 3 <> 0 AS ok, CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(65533) ELSE c_name || 'é' END AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_name || 'é' END AS valid_or_null FROM customer",
"SELECT c_custkey, is_valid_utf8(s) AS ok, make_valid_utf8(s) AS name, try_validate_utf8(s) AS valid_or_null FROM (SELECT c_custkey, CAST(substring(encode(c_name || 'é', 'UTF-8'), 1, octet_length(c_name) + IF(c_custkey % 3 = 0, 1, 2)) AS STRING) AS s FROM customer)")

# Approximate aggregates above their sketches' sizes: beside the exact figure, whether the estimate is within the stated error
# (an exact distinct count beside sketches in one aggregate would make Spark keep sketches for every value)
plain("approximate_distinct_error", "SELECT count(DISTINCT l_orderkey) AS n, true AS hll, true AS sketch, true AS theta FROM lineitem",
"""SELECT n, abs(a - n) <= 3 * 0.01 * n AS hll, abs(b - n) <= 3 * 0.02 * n AS sketch, abs(t - n) <= 3 * 0.02 * n AS theta FROM (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem), (SELECT approx_count_distinct(l_orderkey, 0.01) AS a, hll_sketch_estimate(hll_sketch_agg(l_orderkey)) AS b, theta_sketch_estimate(theta_sketch_agg(l_orderkey)) AS t FROM lineitem)""")
plain("approximate_quantile_error", "SELECT count(*) AS n, true AS p10, true AS p50, true AS p99 FROM lineitem",
"""WITH q AS (SELECT percentile_approx(l_extendedprice, array(0.1, 0.5, 0.99), 200) AS q FROM lineitem)
SELECT count(*) AS n, abs(sum(IF(l_extendedprice <= q[0], 1, 0)) - 0.1 * count(*)) <= count(*) / 200 AS p10, abs(sum(IF(l_extendedprice <= q[1], 1, 0)) - 0.5 * count(*)) <= count(*) / 200 AS p50, abs(sum(IF(l_extendedprice <= q[2], 1, 0)) - 0.99 * count(*)) <= count(*) / 200 AS p99 FROM lineitem, q""")
plain("kll_quantile_error", "SELECT count(*) AS n, true AS p25, true AS p50, true AS p90 FROM orders",
"""WITH k AS (SELECT kll_sketch_agg_double(o_totalprice) AS s FROM orders), q AS (SELECT kll_sketch_get_quantile_double(s, 0.25D) AS a, kll_sketch_get_quantile_double(s, 0.5D) AS b, kll_sketch_get_quantile_double(s, 0.9D) AS c FROM k)
SELECT count(*) AS n, abs(sum(IF(o_totalprice <= a, 1, 0)) - 0.25 * count(*)) <= 0.0266 * count(*) AS p25, abs(sum(IF(o_totalprice <= b, 1, 0)) - 0.5 * count(*)) <= 0.0266 * count(*) AS p50, abs(sum(IF(o_totalprice <= c, 1, 0)) - 0.9 * count(*)) <= 0.0266 * count(*) AS p90 FROM orders, q""")
plain("approximate_top_error", "SELECT word, n, true AS within FROM (SELECT word, count(*) AS n, sum(count(*)) OVER () AS total FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word) WHERE n > total * 0.02",
"""WITH w AS (SELECT explode(split(text, ' ', -1)) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w GROUP BY word), a AS (SELECT inline(approx_top_k(word, 100, 1000)) FROM w)
SELECT word, n, coalesce(abs(count - n) <= total / 250, false) AS within FROM (SELECT word, n, sum(n) OVER () AS total FROM c) LEFT JOIN a ON item = word WHERE n > total * 0.02""")
