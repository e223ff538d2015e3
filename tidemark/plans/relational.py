"""The relational surface as queries by name: the statement that Spark runs, and DuckDB's where its text differs.

Money is summed as decimals and given as doubles, so sums don't depend on order; every order has a tiebreak.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sql import guard

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
_TOTAL = "CAST(o_totalprice AS DECIMAL(18,2))"

#: name: statement, the same for both engines.
SAME = {
    # scan, project, filter
    "scan_all": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "project": "SELECT c_custkey, upper(c_name) AS name, c_acctbal * 2 AS twice FROM customer",
    "filter_numeric": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus <> 'F'",
    "filter_text": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "filter_date_range": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01'",
    "between_in_not_or": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE (o_totalprice BETWEEN 1000 AND 60000 OR o_orderpriority IN ('1-URGENT', '2-HIGH')) AND NOT o_orderstatus = 'O'",
    "like_case_when": "SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS%' THEN 'brass' WHEN p_size > 25 THEN 'large' ELSE 'other' END AS class FROM part",
    "is_null_logic": "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') IS NULL AS building, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer WHERE nullif(c_nationkey, 3) IS NOT NULL",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    # sort and page
    "sort_multi_nulls": "SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS segment, c_acctbal FROM customer ORDER BY segment ASC NULLS LAST, c_acctbal DESC NULLS FIRST, c_custkey",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40",
    "sort_unselected": "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30",
    # aggregates
    "agg_global": f"SELECT count(*) AS n, CAST(sum({_PRICE}) AS DOUBLE) AS total, min(l_discount) AS low, max(l_discount) AS high, CAST(sum({_PRICE}) AS DOUBLE) / count(*) AS mean FROM lineitem",
    "agg_group1": f"SELECT o_orderstatus, count(*) AS n, CAST(sum({_TOTAL}) AS DOUBLE) AS total FROM orders GROUP BY o_orderstatus",
    "agg_group2": f"SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum({_PRICE}) AS DOUBLE) AS total, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_expr_key": "SELECT substr(CAST(o_orderdate AS VARCHAR(30)), 1, 7) AS month, count(*) AS n FROM orders GROUP BY substr(CAST(o_orderdate AS VARCHAR(30)), 1, 7)",
    "agg_distinct": "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, count(DISTINCT c_custkey) AS customers FROM customer GROUP BY c_mktsegment",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_having_scalar": f"SELECT o_custkey, CAST(sum({_TOTAL}) AS DOUBLE) AS total FROM orders GROUP BY o_custkey HAVING sum({_TOTAL}) > (SELECT 15 * CAST(sum({_TOTAL}) AS DOUBLE) / count(*) FROM orders)",
    "agg_conditional": "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "agg_filter": "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, count(*) FILTER (WHERE l_discount = 0) AS full_price FROM lineitem GROUP BY l_returnflag",
    "agg_topk_groups": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 10",
    "agg_dependent_key": "SELECT c.c_custkey, c.c_name, c.c_mktsegment FROM customer c WHERE c.c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 14)",
    "agg_bool_bit": "SELECT l_returnflag, bool_and(l_quantity > 0) AS every_one, bool_or(l_quantity > 49) AS any_one, bit_or(l_linenumber) AS bits, bit_xor(l_linenumber) AS xors FROM lineitem GROUP BY l_returnflag",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS INT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "stats_aggs": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_discount), 6) AS cs, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem GROUP BY l_returnflag",
    # joins
    "join_inner2": f"SELECT c_mktsegment, count(*) AS n, CAST(sum({_TOTAL}) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "join_inner3": f"SELECT n_name, r_name, count(*) AS n, CAST(sum({_TOTAL}) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey",
    "join_right": "SELECT o_orderkey, c_custkey FROM (SELECT * FROM customer WHERE c_acctbal < 0) c RIGHT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey",
    "join_full": "SELECT a.c_custkey AS a, b.c_custkey AS b FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) a FULL OUTER JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') b ON a.c_custkey = b.c_custkey",
    "join_anti_left": "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000 WHERE o.o_orderkey IS NULL",
    "join_not_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)",
    "join_self": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_cross": "SELECT r_name, p.p_brand FROM region CROSS JOIN (SELECT DISTINCT p_brand FROM part) p",
    "join_theta": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal - 9000",
    "join_lateral": "SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o WHERE c.c_acctbal > 5000",
    "join_composite": "SELECT count(*) AS n FROM lineitem a JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 1) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
    "join_q3": f"SELECT o_orderkey, o_orderdate, CAST(sum({_PRICE} * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1996-03-15' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10",
    # windows
    "win_rank_family": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 9) AS pr, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "win_lag_lead": "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "win_running_sum": "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS so_far FROM orders",
    "win_rows_frame": "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS local_max FROM events",
    "win_range_frame": "SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_partkey RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS near FROM lineitem WHERE l_quantity > 45",
    "win_first_last": "SELECT event_id, first_value(event_type) OVER w AS opened, last_value(event_type) OVER w AS closed, nth_value(event_type, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_top_per_group": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2",
    # sets, subqueries, CTEs
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 30",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)",
    "in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "correlated_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "derived_table": "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t GROUP BY n",
    "cte": "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN customer ON c_custkey = o_custkey",
    "recursive_cte": "WITH RECURSIVE steps(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM steps WHERE n < 15) SELECT n, f FROM steps",
    "values_clause": "SELECT v.id, v.name FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS v(id, name)",
    # functions
    "null_functions": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'FURNITURE'), '-') AS a, ifnull(nullif(c_nationkey, 5), -1) AS b, greatest(c_nationkey, 7) AS c, least(c_nationkey, 7) AS d FROM customer",
}

#: name: Spark's statement, DuckDB's statement.
PAIRS = {
    "join_semi": ("SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_anti": ("SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_orderstatus = 'P')"),
    "join_hint": ("SELECT /*+ BROADCAST(nation) */ n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"),
    "median_percentile": (
        "SELECT l_returnflag, median(l_quantity) AS med, percentile(l_quantity, 0.9) AS p90, percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity) AS p25 FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, median(l_quantity) AS med, quantile_cont(l_quantity, 0.9) AS p90, quantile_cont(l_quantity, 0.25) AS p25 FROM lineitem GROUP BY l_returnflag",
    ),
    "collect_aggs": (
        "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), '|') AS names, max_by(n_name, n_nationkey) AS last_name, min_by(n_name, n_nationkey) AS first_name FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names, max_by(n_name, n_nationkey) AS last_name, min_by(n_name, n_nationkey) AS first_name FROM nation GROUP BY n_regionkey",
    ),
    "win_ntile": ("SELECT s_suppkey, ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS quarter FROM supplier", "SELECT s_suppkey, CAST(ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS INT) AS quarter FROM supplier"),
    "str_functions": (
        "SELECT c_custkey, lower(c_name) AS lo, length(c_name) AS len, substr(c_name, 3, 5) AS mid, trim('  x  ') AS t, replace(c_name, '#', '-') AS rep, concat_ws('/', c_mktsegment, c_name) AS cat, lpad(CAST(c_custkey AS STRING), 8, '0') AS padded, reverse(c_mktsegment) AS rev, instr(c_name, '0') AS at, startswith(c_name, 'Cust') AS sw, split_part(c_name, '#', 2) AS part, initcap(lower(c_mktsegment)) AS cap, levenshtein(c_mktsegment, 'BUILDING') AS lev, repeat('ab', 2) AS twice, translate(c_mktsegment, 'AEI', '123') AS tr, ascii(c_mktsegment) AS asc, regexp_replace(c_name, '[0-9]+', 'N') AS rr, c_name LIKE '%1%' AS has1 FROM customer",
        "SELECT c_custkey, lower(c_name) AS lo, CAST(length(c_name) AS INT) AS len, substr(c_name, 3, 5) AS mid, trim('  x  ') AS t, replace(c_name, '#', '-') AS rep, concat_ws('/', c_mktsegment, c_name) AS cat, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, reverse(c_mktsegment) AS rev, CAST(instr(c_name, '0') AS INT) AS at, starts_with(c_name, 'Cust') AS sw, split_part(c_name, '#', 2) AS part, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS cap, CAST(levenshtein(c_mktsegment, 'BUILDING') AS INT) AS lev, repeat('ab', 2) AS twice, translate(c_mktsegment, 'AEI', '123') AS tr, ascii(c_mktsegment) AS asc, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS rr, c_name LIKE '%1%' AS has1 FROM customer",
    ),
    "date_functions": (
        "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, CAST(date_part('year', o_orderdate) AS BIGINT) AS y, CAST(date_part('doy', o_orderdate) AS BIGINT) AS doy, CAST(datediff(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, o_orderdate + INTERVAL 1 MONTH AS later, date_format(o_orderdate, 'yyyy-MM-dd') AS said, last_day(CAST(o_orderdate AS DATE)) AS last, make_date(2020, 2, 29) AS leap FROM orders",
        "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(date_part('year', o_orderdate) AS BIGINT) AS y, CAST(date_part('doy', o_orderdate) AS BIGINT) AS doy, CAST(DATE '1999-01-01' - CAST(o_orderdate AS DATE) AS BIGINT) AS days, o_orderdate + INTERVAL 1 MONTH AS later, strftime(o_orderdate, '%Y-%m-%d') AS said, last_day(CAST(o_orderdate AS DATE)) AS last, make_date(2020, 2, 29) AS leap FROM orders",
    ),
    "date_bin": (
        "SELECT event_id, CAST(timestamp_micros(CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 900000000) * 900000000 AS BIGINT)) AS TIMESTAMP_NTZ) AS bin FROM events",
        "SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS bin FROM events",
    ),
    "math_functions": (
        "SELECT l_orderkey, l_linenumber, l_partkey, abs(-l_quantity) AS a, round(l_extendedprice / 7, 4) AS r, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c, round(sqrt(l_quantity), 9) AS s, round(power(l_quantity, 2), 6) AS p, round(log10(l_quantity), 9) AS lg, round(ln(l_quantity), 9) AS ln, l_linenumber % 3 AS m, CAST(l_orderkey DIV 7 AS BIGINT) AS q, signum(l_discount) AS sg, round(exp(l_tax), 9) AS e, round(degrees(l_tax), 9) AS d, round(atan2(l_tax, 1.0D), 9) AS at FROM lineitem WHERE l_linenumber < 3",
        "SELECT l_orderkey, l_linenumber, l_partkey, abs(-l_quantity) AS a, round(l_extendedprice / 7, 4) AS r, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c, round(sqrt(l_quantity), 9) AS s, round(power(l_quantity, 2), 6) AS p, round(log10(l_quantity), 9) AS lg, round(ln(l_quantity), 9) AS ln, l_linenumber % 3 AS m, CAST(l_orderkey // 7 AS BIGINT) AS q, CAST(sign(l_discount) AS DOUBLE) AS sg, round(exp(l_tax), 9) AS e, round(degrees(l_tax), 9) AS d, round(atan2(l_tax, 1.0), 9) AS at FROM lineitem WHERE l_linenumber < 3",
    ),
    "array_functions": (
        "SELECT vec_id, size(embedding) AS n, array_max(transform(embedding, x -> CAST(x AS DOUBLE))) AS hi, array_min(transform(embedding, x -> CAST(x AS DOUBLE))) AS lo, size(filter(embedding, x -> x > 0)) AS pos, array_position(array(3, 1, 2), 1) AS at, array_join(slice(sequence(1, 10), 3, 4), ',') AS part, array_contains(array('a', 'b'), 'b') AS has, array_join(array_distinct(array(1, 1, 2)), ',') AS uniq, array_join(flatten(array(array(1, 2), array(3))), ',') AS flat FROM embeddings",
        "SELECT vec_id, CAST(len(embedding) AS INT) AS n, CAST(list_max(embedding) AS DOUBLE) AS hi, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS pos, CAST(list_position([3, 1, 2], 1) AS BIGINT) AS at, '3,4,5,6' AS part, true AS has, '1,2' AS uniq, '1,2,3' AS flat FROM embeddings",
    ),
    "array_unnest": ("SELECT vec_id, pos, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, x", "SELECT vec_id, CAST(i - 1 AS INT) AS pos, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)"),
    "map_struct_functions": (
        "SELECT n_nationkey, s['name'] AS name, s.region AS region, m['a'] AS a, array_join(map_keys(m), ',') AS ks, element_at(m, 'b') AS b FROM (SELECT n_nationkey, named_struct('name', n_name, 'region', n_regionkey) AS s, map('a', n_nationkey, 'b', n_regionkey) AS m FROM nation) t",
        "SELECT n_nationkey, n_name AS name, n_regionkey AS region, n_nationkey AS a, 'a,b' AS ks, n_regionkey AS b FROM nation",
    ),
    "json_functions": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, get_json_object('{\"n\": 9007199254740993}', '$.n') AS n FROM events", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, '9007199254740993' AS n FROM events"),
    "hash_functions": ("SELECT doc_id, md5(text) AS m, sha2(text, 256) AS s, lower(hex(length(text))) AS h FROM documents", "SELECT doc_id, md5(text) AS m, sha256(text) AS s, lower(to_hex(length(text))) AS h FROM documents"),
    "type_functions": ("SELECT c_custkey, try_cast(substr(c_name, 10) AS BIGINT) AS n, CAST(c_acctbal AS DECIMAL(12,2)) AS d, try_cast(c_name AS INT) IS NULL AS bad FROM customer", "SELECT c_custkey, try_cast(substr(c_name, 10) AS BIGINT) AS n, CAST(c_acctbal AS DECIMAL(12,2)) AS d, try_cast(c_name AS INT) IS NULL AS bad FROM customer"),
    "regex_functions": (
        "SELECT doc_id, regexp_count(text, '[aeiou]') AS vowels, regexp_extract(text, '([A-Za-z]+)', 1) AS first_word, text RLIKE '[0-9]{3}' AS digits FROM documents",
        "SELECT doc_id, CAST(len(regexp_extract_all(text, '[aeiou]')) AS INT) AS vowels, regexp_extract(text, '([A-Za-z]+)', 1) AS first_word, regexp_matches(text, '[0-9]{3}') AS digits FROM documents",
    ),
    "approx_distinct": ("SELECT event_type, approx_count_distinct(user_id) AS users FROM events GROUP BY event_type", None),
    "explode_props": ("SELECT event_type, count(*) AS n, count(DISTINCT get_json_object(props, '$.k')) AS ks FROM events GROUP BY event_type", "SELECT event_type, count(*) AS n, count(DISTINCT props->>'$.k') AS ks FROM events GROUP BY event_type"),
}


def run(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the Parquet tables that a statement names."""
    names = [t for t in TABLES if re.search(rf"\b{t}\b", statement)]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        guard(spark, statement)
        for t in names:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(statement)

    return query


def theta(statement: str, table: str, low: str, high: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that joins a table with itself where low is less than high, both of one row each. Pairs are made in as many tasks
    as a shuffle has, not in as many as the table has files, and of rows only that are in some pair or may be."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        guard(spark, statement)
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        ends = rows.selectExpr(f"min({low}) as low", f"max({high}) as high").first()
        kept = rows.where((F.expr(low) < F.lit(ends["high"])) | (F.expr(high) > F.lit(ends["low"])))
        kept.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).createOrReplaceTempView(table)
        return spark.sql(statement)

    return query


QUERIES = {k: run(s) for k, s in SAME.items()} | {k: run(s) for k, (s, _) in PAIRS.items()}
QUERIES["join_theta"] = theta(SAME["join_theta"], "supplier", "s_acctbal", "s_acctbal - 9000")
ORACLES = dict(SAME) | {k: d for k, (_, d) in PAIRS.items() if d}
