"""Queries of the SQL surface: name to Spark SQL, and DuckDB's wording where it differs."""

from __future__ import annotations

SQL: dict[str, str] = {
    "sql_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "sql_projection": "SELECT o_orderkey, o_totalprice * 2 AS twice, o_totalprice > 100000 AS large FROM orders",
    "sql_filter": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND NOT (l_discount > 0.05 OR l_tax IS NULL)",
    "sql_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'X%'",
    "sql_like_ci": "SELECT p_partkey, p_brand FROM part WHERE p_brand ILIKE 'brand%1%'",
    "sql_join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    "sql_join_left": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "sql_join_right": "SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 200000",
    "sql_join_full": "SELECT coalesce(s_suppkey, -1) AS s_suppkey, coalesce(c_custkey, -1) AS c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey",
    "sql_join_self": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_join_many": "SELECT r_name, count(*) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name",
    "sql_join_range": "SELECT s_suppkey, p_partkey FROM supplier JOIN part ON p_size BETWEEN s_suppkey AND s_suppkey + 2 AND p_retailprice > s_acctbal",
    "sql_join_using": "SELECT n_name, r_name FROM nation JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r USING (n_regionkey)",
    "sql_join_natural": "SELECT n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r",
    "sql_join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "sql_join_theta": "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey",
    "sql_is_null": "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL",
    "sql_not_in": "SELECT n_name FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')",
    "sql_greatest_least": "SELECT s_suppkey, greatest(s_suppkey, 50) AS g, least(s_suppkey, 50) AS l, coalesce(nullif(s_suppkey, 3), -1) AS c FROM supplier",
    "sql_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)",
    "sql_semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "sql_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_agg_group": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, min(l_tax) AS min_tax, max(l_tax) AS max_tax, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "sql_agg_having": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20",
    "sql_agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "sql_agg_filter": "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS large, count(*) FILTER (WHERE l_discount = 0) AS full_price FROM lineitem GROUP BY l_linestatus",
    "sql_agg_total": "SELECT coalesce(sum(CAST(o_totalprice AS DOUBLE)), 0.0) AS total FROM orders WHERE o_orderkey < 0",
    "sql_group_concat": "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "sql_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "sql_window_rank": "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER p AS BIGINT) AS rk, CAST(dense_rank() OVER p AS BIGINT) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), p AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)",
    "sql_window_ratio": "SELECT o_orderkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS quarter FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)",
    "sql_window_offset": "SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 1, 0.0) OVER w AS after, first_value(event_id) OVER w AS first_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "sql_window_nth": "SELECT event_id, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_id, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id FROM events",
    "sql_window_rows": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s3 FROM events",
    "sql_window_range": "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM lineitem",
    "sql_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "sql_union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    "sql_union": "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer",
    "sql_intersect": "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer",
    "sql_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "sql_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "sql_correlated": "SELECT p_partkey FROM part p WHERE p_retailprice >= (SELECT max(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "sql_derived": "SELECT seg, max(n) AS most FROM (SELECT c_mktsegment AS seg, c_nationkey, count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey) t GROUP BY seg",
    "sql_recursive": "SELECT * FROM (WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t) x",
    "sql_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'F'), 'done') AS status FROM orders",
    "sql_scalar_string": "SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, substr(c_name, 2, 5) AS part, replace(c_name, '#', '-') AS dashed, trim('  x ') AS trimmed, CAST(length(c_name) AS BIGINT) AS n, CAST(instr(c_name, '0') AS BIGINT) AS at, c_name || '/' || c_mktsegment AS both FROM customer",
    "sql_scalar_math": "SELECT s_suppkey, round(abs(s_acctbal), 2) AS a, round(sqrt(abs(s_acctbal)), 6) AS r, round(ln(abs(s_acctbal) + 1), 6) AS l, round(power(s_suppkey, 2), 2) AS p, round(log10(s_suppkey + 1), 6) AS l10, CAST(sign(s_acctbal) AS DOUBLE) AS sg, s_suppkey % 7 AS m FROM supplier",
    "sql_scalar_date": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR(10)) AS first_day, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY AS DATE) AS VARCHAR(10)) AS next_day FROM orders",
    "sql_intdiv": "SELECT l_orderkey, l_linenumber, l_orderkey div 7 AS week FROM lineitem",
    "sql_scalar_json": "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
    "sql_null_order": "SELECT coalesce(b, -1) AS b, n FROM (SELECT c_custkey AS n, max(o_orderkey) AS b FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) t ORDER BY t.b NULLS FIRST, n LIMIT 25",
}

DUCK = {
    "sql_group_concat": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "sql_intdiv": "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS week FROM lineitem",
    "sql_scalar_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}

#: Statements as the tables' users write them, which go through the guard and the translation, and the same in DuckDB.
SURFACE = {
    "surface_concat": ("SELECT n_regionkey, group_concat(DISTINCT n_regionkey) AS names, total(n_nationkey) AS total FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(DISTINCT n_regionkey::VARCHAR, ',') AS names, sum(n_nationkey)::DOUBLE AS total FROM nation GROUP BY n_regionkey"),
    "surface_like": ("SELECT \"c_custkey\", [c_name] FROM customer WHERE c_name LIKE 'cUSTOMER%1' AND c_mktsegment GLOB '[A-F]*I?G'", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE 'cUSTOMER%1' AND regexp_matches(c_mktsegment, '^[A-F].*I.G$')"),
    "surface_limit": ("SELECT o_orderkey, iif(o_totalprice > 100000, 'high', 'low') AS price FROM orders ORDER BY o_orderkey LIMIT 10, 25", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS price FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 10"),
    "surface_cast": ("SELECT p_partkey, CAST(p_size || 'x' AS INTEGER) AS size, CAST(p_size AS TEXT) AS text, max(p_size, 20) AS most, min(p_size, NULL) AS least, ifnull(NULL, p_size) AS own FROM part", "SELECT p_partkey, p_size::BIGINT AS size, p_size::VARCHAR AS text, greatest(p_size, 20) AS most, NULL::INTEGER AS least, p_size AS own FROM part"),
    "surface_dates": ("SELECT strftime('%Y-%m', o_orderdate) AS month, COUNT(*) AS n FROM orders GROUP BY strftime('%Y-%m', o_orderdate)", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL"),
    "surface_division": ("SELECT o_orderkey, o_orderkey / 7 AS week, o_orderkey / 7 / 2 AS half_week, o_totalprice / 2 AS half, o_custkey / 0 AS none, o_custkey % 7 AS rest FROM orders WHERE o_orderkey / 3 > 10", "SELECT o_orderkey, o_orderkey // 7 AS week, o_orderkey // 7 // 2 AS half_week, o_totalprice / 2 AS half, NULL AS none, o_custkey % 7 AS rest FROM orders WHERE o_orderkey // 3 > 10"),
    "surface_nested_division": ("SELECT o_custkey, x / 2 AS y, sum(x) / count(*) AS mean FROM (SELECT o_custkey, o_orderkey / 5 AS x FROM orders) GROUP BY o_custkey, x", "SELECT o_custkey, x // 2 AS y, sum(x)::BIGINT // count(*) AS mean FROM (SELECT o_custkey, o_orderkey // 5 AS x FROM orders) GROUP BY o_custkey, x"),
    "surface_texts_as_numbers": ("SELECT p_partkey, p_brand + 1 AS a, substr(p_brand, 7) * '2' AS b, -substr(p_brand, 7) AS c FROM part", "SELECT p_partkey, 1.0::DOUBLE AS a, substr(p_brand, 7)::DOUBLE * 2 AS b, -(substr(p_brand, 7)::DOUBLE) AS c FROM part"),
    "surface_text_comparison": ("SELECT p_partkey FROM part WHERE p_size < 'x' AND p_size >= '20' AND p_brand > p_size", "SELECT p_partkey FROM part WHERE p_size >= 20 AND p_brand IS NOT NULL"),
    "surface_truth": ("SELECT s_suppkey, CASE WHEN s_suppkey % 2 THEN 'odd' ELSE 'even' END AS kind FROM supplier WHERE s_suppkey % 3 AND NOT s_nationkey % 5", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 <> 0 THEN 'odd' ELSE 'even' END AS kind FROM supplier WHERE s_suppkey % 3 <> 0 AND s_nationkey % 5 = 0"),
    "surface_text_truth": ("SELECT p_partkey FROM part WHERE substr(p_brand, 7) AND NOT p_name", "SELECT p_partkey FROM part WHERE substr(p_brand, 7)::INT <> 0"),
    "surface_log": ("SELECT p_partkey, round(log(p_retailprice), 6) AS l, round(log(2, p_size), 6) AS two, log(0) AS none FROM part", "SELECT p_partkey, round(log10(p_retailprice), 6) AS l, round(log10(p_size) / log10(2), 6) AS two, NULL AS none FROM part"),
    "surface_bare_max": ("SELECT o_custkey, o_orderkey, max(o_totalprice) AS most FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS o_orderkey, max(o_totalprice) AS most FROM orders GROUP BY o_custkey"),
    "surface_bare_min": ("SELECT o_orderstatus, o_orderkey / 2 AS half, min(o_totalprice) AS least, count(*) AS n FROM orders GROUP BY 1", "SELECT o_orderstatus, arg_min(o_orderkey, o_totalprice) // 2 AS half, min(o_totalprice) AS least, count(*) AS n FROM orders GROUP BY 1"),
    "surface_bare_whole": ("SELECT s_suppkey, s_name, max(s_acctbal) AS most FROM supplier", "SELECT arg_max(s_suppkey, s_acctbal) AS s_suppkey, arg_max(s_name, s_acctbal) AS s_name, max(s_acctbal) AS most FROM supplier"),
    "surface_date_modifiers": ("SELECT o_orderkey, date(o_orderdate, '+1 month') AS later, date(o_orderdate, 'start of month', '-1 day') AS before, datetime(o_orderdate, '+90 minutes') AS soon, strftime('%d.%m.%Y at %H', o_orderdate, '+1 year') AS said FROM orders", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days((day(o_orderdate) - 1)::INT), '%Y-%m-%d') AS later, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 DAY, '%Y-%m-%d') AS before, strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS soon, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 YEAR + to_days((day(o_orderdate) - 1)::INT) + (o_orderdate - date_trunc('day', o_orderdate)), '%d.%m.%Y at %H') AS said FROM orders"),
    "surface_julianday": ("SELECT l_orderkey, l_linenumber, round(julianday(l_shipdate) - julianday('1992-01-01'), 6) AS days FROM lineitem", "SELECT l_orderkey, l_linenumber, round(epoch(l_shipdate) / 86400 - epoch(TIMESTAMP '1992-01-01') / 86400, 6) AS days FROM lineitem"),
    "surface_json_each": ("SELECT event_id, json_each.key AS name, CAST(json_each.value AS INTEGER) / 2 AS half FROM events, json_each(props)", "SELECT event_id, name, json_extract_string(props, '$.' || name)::BIGINT // 2 AS half FROM (SELECT event_id, props, unnest(json_keys(props)) AS name FROM events)"),
    "surface_in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey IN(SELECT o_custkey FROM orders ORDER BY o_orderkey LIMIT 5, 100)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 5)"),
}
