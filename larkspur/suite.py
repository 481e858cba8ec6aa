"""Queries over the test tables, one for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import aggregates, dml, joins, recursive, relational, statistics, windows
from larkspur.session import Session
from larkspur.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
RELATIONAL = "region nation customer supplier part orders lineitem events".split()


def session(spark: SparkSession, folder: str, text: str) -> Session:
    s = Session(spark)
    s.register_parquet(folder, [n for n in RELATIONAL if n in text])
    return s


def sql(key: str, text: str, oracle: str | None = "same", params=None) -> None:
    """A query in the dialect, and its oracle (the same text where both agree)."""
    QUERIES[key] = lambda spark, folder: session(spark, folder, text).sql(text, params)
    if oracle:
        ORACLE[key] = text if oracle == "same" else oracle


def frame(key: str, oracle: str | None):
    """Decorator for a query made of DataFrame operators."""

    def keep(f: Query) -> Query:
        QUERIES[key] = f
        if oracle:
            ORACLE[key] = oracle
        return f

    return keep


FLAGSHIP = """
SELECT o_orderpriority, COUNT(*) AS n_lines, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(AVG(l_quantity), 4) AS avg_quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1997-01-01' && l_shipdate > o_orderdate
GROUP BY o_orderpriority HAVING COUNT(*) > 10 ORDER BY revenue DESC LIMIT 0, 5"""
sql("sql_flagship", FLAGSHIP, FLAGSHIP.replace("&&", "AND").replace("LIMIT 0, 5", "LIMIT 5"))

# scans
frame("scan_full", "SELECT * FROM orders")(lambda s, d: relational.scan(s, f"{d}/orders.parquet"))
frame("scan_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 100 AND 500")(
    lambda s, d: relational.range_scan(relational.scan(s, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"]), "l_orderkey", 100, 500)
)
frame("scan_point_lookup", "SELECT * FROM customer WHERE c_custkey = 42")(lambda s, d: relational.point_lookup(table(s, d, "customer"), {"c_custkey": 42}))
frame("scan_covering_columns", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey < 50")(
    lambda s, d: relational.range_scan(relational.scan(s, f"{d}/orders.parquet", ["o_custkey", "o_orderkey"]), "o_custkey", high=50, include_high=False)
)
frame("scan_key_list_lookup", "SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")(
    lambda s, d: relational.lookup_by_keys(table(s, d, "part"), table(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")
)
sql("scan_dual", "SELECT 1 AS one, 'x' AS letter FROM dual", "SELECT 1 AS one, 'x' AS letter")

# filters
O = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE "
sql("filter_eq", O + "o_orderpriority = '1-URGENT'")
sql("filter_ne", O + "o_orderstatus != 'F' AND o_orderpriority <> '5-LOW'")
sql("filter_range", O + "o_totalprice >= 1000 AND o_totalprice < 20000.5")
sql("filter_and_or_not", O + "NOT (o_orderstatus = 'F' || o_totalprice > 30000) && o_custkey > 10", O + "NOT (o_orderstatus = 'F' OR o_totalprice > 30000) AND o_custkey > 10")
sql("filter_in", O + "o_orderpriority IN ('1-URGENT', '2-HIGH')")
sql("filter_not_in", O + "o_custkey NOT IN (1, 2, 3, 5, 8)")
sql("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE '_z%'")
sql("filter_like_escape", "SELECT event_id FROM events WHERE props LIKE '%|_%' ESCAPE '|' OR event_type LIKE 'c%'")
sql("filter_regexp", "SELECT c_custkey, c_name FROM customer WHERE c_name REGEXP '[05]$'", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[05]$')")
sql("filter_between", O + "o_totalprice NOT BETWEEN 5000 AND 25000")
sql("filter_is_null", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 40000 WHERE o_orderkey IS NULL")
sql("filter_is_true", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 40000 WHERE (o_totalprice > 1) IS NOT TRUE")
sql("filter_nullsafe_eq", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 40000 WHERE o_orderkey <=> NULL",
    "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 40000 WHERE o_orderkey IS NOT DISTINCT FROM NULL")
sql("filter_row_tuple_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('R', 'O'))")

# projections
sql("project_columns", "SELECT t.n_name, t.n_regionkey FROM nation t")
sql("project_star", "SELECT r.*, n.n_name FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey")
sql("project_arith", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, -l_quantity AS minus FROM lineitem")
sql("project_div_mod", "SELECT o_orderkey, o_custkey DIV 7 AS d, o_custkey % 7 AS m, o_custkey MOD 5 AS m5, ROUND(o_custkey / 8, 4) AS q, o_custkey / (o_custkey % 2) AS z FROM orders",
    "SELECT o_orderkey, o_custkey // 7 AS d, o_custkey % 7 AS m, o_custkey % 5 AS m5, ROUND(o_custkey / 8, 4) AS q, CAST(o_custkey AS DOUBLE) / nullif(o_custkey % 2, 0) AS z FROM orders")
sql("project_bitops", "SELECT o_orderkey, o_custkey & 15 AS a, o_custkey | 8 AS o, o_custkey ^ 3 AS x, o_custkey << 2 AS l, o_custkey >> 1 AS r, ~o_custkey AS n FROM orders",
    "SELECT o_orderkey, o_custkey & 15 AS a, o_custkey | 8 AS o, xor(o_custkey, 3) AS x, o_custkey << 2 AS l, o_custkey >> 1 AS r, ~o_custkey AS n FROM orders")
sql("project_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 30000 THEN 'big' WHEN o_totalprice > 10000 THEN 'mid' ELSE 'small' END AS size, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS done FROM orders")
sql("project_json_extract", "SELECT event_id, CAST(props->'$.k' AS SIGNED) AS k FROM events", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
sql("project_interval", "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS later, o_orderdate - INTERVAL 2 MONTH AS earlier FROM orders",
    "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS later, o_orderdate - INTERVAL 2 MONTH AS earlier FROM orders")
sql("project_literals", "SELECT n_nationkey, b'101' AS b, 7.5 AS f, NULL IS NULL AS t FROM nation", "SELECT n_nationkey, 5 AS b, 7.5 AS f, NULL IS NULL AS t FROM nation")
sql("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")

# joins
sql("join_inner", "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey")
sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'")
sql("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT OUTER JOIN customer ON c_custkey = o_custkey AND o_totalprice > 20000")
sql("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey AND c_acctbal > 0")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
sql("join_straight", "SELECT n_name, r_name FROM nation STRAIGHT_JOIN region ON n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
sql("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey >= b.n_regionkey")
sql("join_using", "SELECT k, a.n_name, b.r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)")
frame("join_natural", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)")(
    lambda s, d: joins.natural(table(s, d, "nation").selectExpr("n_regionkey AS k", "n_name"), table(s, d, "region").selectExpr("r_regionkey AS k", "r_name"))
)
sql("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
sql("join_multiway", "SELECT r_name, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name")
frame("join_semi", "SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 30000)")(
    lambda s, d: joins.join(c := table(s, d, "customer"), o := table(s, d, "orders").where("o_totalprice > 30000"), c.c_custkey == o.o_custkey, "semi")
)
frame("join_anti", "SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 30000)")(
    lambda s, d: joins.join(c := table(s, d, "customer"), o := table(s, d, "orders").where("o_totalprice > 30000"), c.c_custkey == o.o_custkey, "anti")
)
sql("join_null_keys", "SELECT x.k AS k, COUNT(*) AS n FROM (SELECT NULLIF(o_custkey % 5, 0) AS k FROM orders) x JOIN (SELECT NULLIF(n_nationkey % 5, 0) AS k FROM nation) y ON x.k = y.k GROUP BY x.k")
sql("join_derived_table", "SELECT c_name, t.n FROM customer JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS t ON t.o_custkey = c_custkey WHERE t.n > 12")
frame("join_salted", "SELECT c_custkey, c_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey")(
    lambda s, d: joins.salted(table(s, d, "orders").selectExpr("o_custkey AS c_custkey", "o_orderkey"), table(s, d, "customer").select("c_custkey", "c_name"), "c_custkey", 4)
)

# aggregation
sql("agg_count", "SELECT o_orderpriority, COUNT(*) AS n, COUNT(o_totalprice) AS m FROM orders GROUP BY o_orderpriority")
sql("agg_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag")
sql("agg_count_distinct_rows", "SELECT COUNT(DISTINCT l_returnflag, l_linestatus) AS n FROM lineitem", "SELECT COUNT(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL)")
sql("agg_sum", "SELECT l_returnflag, ROUND(SUM(l_extendedprice), 2) AS total, SUM(l_orderkey) AS keys FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, ROUND(SUM(l_extendedprice), 2) AS total, CAST(SUM(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY l_returnflag")
sql("agg_avg", "SELECT l_linestatus, ROUND(AVG(l_discount), 6) AS d, ROUND(AVG(l_linenumber), 6) AS n FROM lineitem GROUP BY l_linestatus")
sql("agg_min_max", "SELECT c_mktsegment, MIN(c_name) AS lo, MAX(c_name) AS hi, MIN(c_acctbal) AS lob, MAX(c_acctbal) AS hib FROM customer GROUP BY c_mktsegment")
sql("agg_global_empty", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MAX(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
frame("agg_multi_key", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")(
    lambda s, d: aggregates.aggregate(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], n="count(*)", q="round(sum(l_quantity), 2)")
)
sql("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 14 AND MIN(o_totalprice) > 100")
STD = "SELECT l_returnflag, ROUND({std}(l_quantity), 4) AS a, ROUND({var}(l_quantity), 4) AS b, ROUND(STDDEV_SAMP(l_quantity), 4) AS c, ROUND(VAR_SAMP(l_quantity), 4) AS d FROM lineitem GROUP BY l_returnflag"
sql("agg_std_var", STD.format(std="STD", var="VARIANCE"), STD.format(std="STDDEV_POP", var="VAR_POP"))
sql("agg_bit", "SELECT o_orderstatus, BIT_AND(o_custkey) AS a, BIT_OR(o_custkey) AS o, BIT_XOR(o_custkey) AS x FROM orders GROUP BY o_orderstatus")
sql("agg_group_concat", "SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name DESC SEPARATOR '|') AS names, GROUP_CONCAT(DISTINCT n_regionkey) AS k FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, STRING_AGG(n_name, '|' ORDER BY n_name DESC) AS names, STRING_AGG(DISTINCT CAST(n_regionkey AS VARCHAR), ',') AS k FROM nation GROUP BY n_regionkey")
sql("agg_expr_key", "SELECT YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate)", "SELECT CAST(YEAR(o_orderdate) AS INTEGER) AS y, COUNT(*) AS n FROM orders GROUP BY 1")
sql("agg_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus WITH ROLLUP", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("agg_approx_ndv", "SELECT l_returnflag, APPROX_COUNT_DISTINCT(l_partkey) AS n FROM lineitem GROUP BY l_returnflag", None)
frame("agg_salted_distinct", "SELECT l_returnflag, CAST(COUNT(DISTINCT l_partkey) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag")(
    lambda s, d: aggregates.salted_aggregate(table(s, d, "lineitem"), ["l_returnflag"], 8, "l_partkey", "n")
)
frame("agg_list", "SELECT vec_id, len(embedding) AS n, CAST(list_max(embedding) AS FLOAT) AS hi FROM embeddings")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", aggregates.list_aggregate("COUNT", "embedding").cast("long").alias("n"), aggregates.list_aggregate("MAX", "embedding").alias("hi"))
)

# windows
W = "SELECT o_orderkey, {f} AS v FROM orders WHERE o_custkey < 200"
P = "(PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"
for name, call in {"row_number": "ROW_NUMBER()", "ntile": "NTILE(4)"}.items():
    sql(f"window_{name}", W.format(f=f"CAST({call} OVER {P} AS SIGNED)"), W.format(f=f"CAST({call} OVER {P} AS BIGINT)"))
for name in ("rank", "dense_rank"):
    over = "(PARTITION BY o_orderstatus ORDER BY o_orderpriority)"
    sql(f"window_{name}", W.format(f=f"CAST({name.upper()}() OVER {over} AS SIGNED)"), W.format(f=f"CAST({name.upper()}() OVER {over} AS BIGINT)"))
sql("window_lag", W.format(f=f"LAG(o_totalprice, 2) OVER {P}"))
sql("window_lead", W.format(f=f"LEAD(o_orderkey, 1) OVER {P}"))
sql("window_first_value", W.format(f=f"FIRST_VALUE(o_orderkey) OVER {P}"))
sql("window_last_value", W.format(f="LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
frame("window_frame_rows", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS v FROM orders")(
    lambda s, d: windows.window(table(s, d, "orders"), "sum", "v", "o_totalprice", partition=["o_custkey"], order=["o_orderkey"], rows=(-2, 1)).select("o_orderkey", F.round("v", 2).alias("v"))
)
sql("window_frame_range", "SELECT l_orderkey, l_linenumber, COUNT(*) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS v FROM lineitem")
sql("window_no_partition", "SELECT n_nationkey, CAST(RANK() OVER (ORDER BY n_regionkey) AS SIGNED) AS v FROM nation", "SELECT n_nationkey, RANK() OVER (ORDER BY n_regionkey) AS v FROM nation")
sql("window_named", "SELECT o_orderkey, COUNT(*) OVER w AS n, MAX(o_totalprice) OVER w AS m FROM orders WINDOW w AS (PARTITION BY o_custkey)")
frame("top_k_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")(
    lambda s, d: relational.top_k_per_group(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), 2, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])
)

# sort, limit, set operations
sql("sort_multi", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 100")
sql("sort_nulls", "SELECT o_orderkey, NULLIF(o_custkey % 3, 0) AS k FROM orders ORDER BY k, o_orderkey LIMIT 50", "SELECT o_orderkey, NULLIF(o_custkey % 3, 0) AS k FROM orders ORDER BY k NULLS FIRST, o_orderkey LIMIT 50")
sql("sort_string", "SELECT c_name FROM customer ORDER BY c_name DESC LIMIT 10")
sql("limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")
sql("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0")
sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 20")
sql("sql_limit_comma", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 3, 9", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 9 OFFSET 3")
frame("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")(
    lambda s, d: relational.top_k(table(s, d, "orders").select("o_orderkey", "o_totalprice"), 25, "o_totalprice desc", "o_orderkey")
)
sql("union_all", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("union_ordered_limited", "(SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 3) UNION ALL (SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 2) ORDER BY k LIMIT 4")
sql("set_intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 30000")
sql("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 30000")

# functions
sql("fn_concat", "SELECT n_nationkey, CONCAT(n_name, '-', n_regionkey) AS a, CONCAT('x', NULLIF(n_regionkey, 1)) AS b, CONCAT_WS('/', n_name, n_regionkey) AS c FROM nation",
    "SELECT n_nationkey, n_name || '-' || n_regionkey AS a, 'x' || NULLIF(n_regionkey, 1) AS b, CONCAT_WS('/', n_name, n_regionkey) AS c FROM nation")
sql("fn_substring", "SELECT c_custkey, SUBSTRING(c_name, 2, 3) AS a, SUBSTR(c_name FROM 3 FOR 2) AS b, SUBSTRING(c_name, -4) AS c, SUBSTRING(c_name, 0, 2) AS d FROM customer",
    "SELECT c_custkey, SUBSTRING(c_name, 2, 3) AS a, SUBSTRING(c_name, 3, 2) AS b, SUBSTRING(c_name, -4) AS c, '' AS d FROM customer")
sql("fn_left_right", "SELECT c_custkey, LEFT(c_name, 4) AS a, RIGHT(c_name, 3) AS b FROM customer")
sql("fn_if", "SELECT o_orderkey, IF(o_totalprice > 20000, 'hi', 'lo') AS a, IFNULL(NULLIF(o_custkey, 7), -1) AS b FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 20000 THEN 'hi' ELSE 'lo' END AS a, COALESCE(NULLIF(o_custkey, 7), -1) AS b FROM orders")
sql("fn_replace", "SELECT c_custkey, REPLACE(c_mktsegment, 'E', '3') AS a, UPPER(c_name) AS u, LOWER(c_name) AS l, TRIM(BOTH 'C' FROM c_name) AS t FROM customer", "SELECT c_custkey, REPLACE(c_mktsegment, 'E', '3') AS a, UPPER(c_name) AS u, LOWER(c_name) AS l, TRIM(c_name, 'C') AS t FROM customer")
sql("fn_mod", "SELECT o_orderkey, MOD(o_custkey, 9) AS a, ABS(-o_custkey) AS b FROM orders", "SELECT o_orderkey, o_custkey % 9 AS a, ABS(-o_custkey) AS b FROM orders")
sql("fn_cast", "SELECT o_orderkey, CAST(o_custkey AS CHAR) AS a, CAST(o_orderpriority AS SIGNED) AS b, CONVERT('12', SIGNED) AS c, CAST(o_orderdate AS DATE) AS d FROM orders",
    "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS a, TRY_CAST(o_orderpriority AS BIGINT) AS b, CAST(12 AS BIGINT) AS c, CAST(o_orderdate AS DATE) AS d FROM orders")
sql("fn_current", "SELECT NOW() >= CURRENT_DATE AS a, DATABASE() AS d, VERSION() AS v, USER() AS u", "SELECT true AS a, 'default' AS d, '8.0.32' AS v, 'root@localhost' AS u")
sql("fn_date_parts", "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, QUARTER(o_orderdate) AS q, DATE_FORMAT(o_orderdate, '%Y-%m-%d') AS f FROM orders",
    "SELECT o_orderkey, CAST(YEAR(o_orderdate) AS INTEGER) AS y, CAST(MONTH(o_orderdate) AS INTEGER) AS m, CAST(DAY(o_orderdate) AS INTEGER) AS d, CAST(QUARTER(o_orderdate) AS INTEGER) AS q, strftime(o_orderdate, '%Y-%m-%d') AS f FROM orders")
sql("fn_greatest", "SELECT n_nationkey, GREATEST(n_nationkey, n_regionkey, 3) AS g, LEAST(n_nationkey, n_regionkey) AS l, CAST(LENGTH(n_name) AS SIGNED) AS n FROM nation", "SELECT n_nationkey, GREATEST(n_nationkey, n_regionkey, 3) AS g, LEAST(n_nationkey, n_regionkey) AS l, CAST(LENGTH(n_name) AS BIGINT) AS n FROM nation")

# subqueries and CTEs
sql("subq_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)")
sql("subq_scalar_correlated", "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
sql("subq_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 35000)")
sql("subq_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 35000)")
sql("subq_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
sql("subq_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
sql("subq_any", "SELECT c_custkey FROM customer WHERE c_acctbal > ANY (SELECT s_acctbal FROM supplier) AND c_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql("subq_all", "SELECT c_custkey, c_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_suppkey < 5) AS a, c_acctbal < ALL (SELECT s_acctbal FROM supplier WHERE s_suppkey < 0) AS e FROM customer")
sql("subq_derived", "SELECT seg, n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) t WHERE n > 10")
for how, kind, want in (("inner", "JOIN", "c_custkey, o_orderkey"), ("left", "LEFT JOIN", "c_custkey, o_orderkey")):
    frame(f"apply_{how}", f"SELECT {want} FROM customer {kind} orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 3")(
        lambda s, d, how=how: joins.apply(c := table(s, d, "customer"), o := table(s, d, "orders"), (o.o_custkey == c.c_custkey) & (o.o_totalprice > c.c_acctbal * 3), how).select("c_custkey", "o_orderkey")
    )
for how, no in (("semi", ""), ("anti", "NOT ")):
    frame(f"apply_{how}", f"SELECT c_custkey FROM customer WHERE {no}EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 3)")(
        lambda s, d, how=how: joins.apply(c := table(s, d, "customer"), o := table(s, d, "orders"), (o.o_custkey == c.c_custkey) & (o.o_totalprice > c.c_acctbal * 3), how).select("c_custkey")
    )
sql("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 30000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey")
sql("cte_multi_ref", "WITH t AS (SELECT o_custkey AS k, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT a.k FROM t a WHERE a.s > (SELECT AVG(s) * 1.8 FROM t)")
sql("cte_recursive", "WITH RECURSIVE r(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 10) SELECT n, f FROM r")
frame("cte_recursive_frame", "WITH RECURSIVE r(n) AS (SELECT n_nationkey FROM nation WHERE n_nationkey < 3 UNION SELECT n + 7 FROM r WHERE n < 60) SELECT n FROM r")(
    lambda s, d: recursive.recursive(table(s, d, "nation").where("n_nationkey < 3").selectExpr("n_nationkey AS n"), lambda r: r.where("n < 60").selectExpr("n + 7 AS n"), distinct=True)
)

# changes; each returns the table as it is afterwards
N = "n_nationkey, n_name, n_regionkey"


def nation(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation")


def _new(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(3, "CHANGED", 9), (30, "NEW", 9), (31, "NEWER", 1)], "n_nationkey int, n_name string, n_regionkey int")


VALUES = "(VALUES (3, 'CHANGED', 9), (30, 'NEW', 9), (31, 'NEWER', 1)) v(n_nationkey, n_name, n_regionkey)"
KEY = [["n_nationkey"]]
frame("dml_insert_values", f"SELECT {N} FROM nation UNION ALL SELECT * FROM {VALUES}")(lambda s, d: dml.insert(nation(s, d), _new(s)))
frame("dml_insert_select", f"SELECT {N} FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")(
    lambda s, d: dml.insert(nation(s, d), nation(s, d).where("n_regionkey = 1").withColumn("n_nationkey", F.col("n_nationkey") + 100))
)
frame("dml_replace", f"SELECT {N} FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT * FROM {VALUES}")(lambda s, d: dml.replace(nation(s, d), _new(s), KEY))
frame("dml_insert_ignore", f"SELECT {N} FROM nation UNION ALL SELECT * FROM {VALUES} WHERE n_nationkey <> 3")(lambda s, d: dml.insert_ignore(nation(s, d), _new(s), KEY))
frame("dml_upsert", f"SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN n_name || '+CHANGED' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT * FROM {VALUES} WHERE n_nationkey <> 3")(
    lambda s, d: dml.upsert(nation(s, d), _new(s), ["n_nationkey"], {"n_name": F.expr("concat(o.n_name, '+', n.n_name)")})
)
frame("dml_update", "SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN 7 ELSE n_regionkey END AS n_regionkey FROM nation")(lambda s, d: dml.update(nation(s, d), {"n_regionkey": F.lit(7)}, F.expr("n_regionkey = 2")))
frame("dml_update_limit", "SELECT n_nationkey, CASE WHEN n_nationkey IN (SELECT n_nationkey FROM nation ORDER BY n_nationkey DESC LIMIT 4) THEN 'X' ELSE n_name END AS n_name, n_regionkey FROM nation")(
    lambda s, d: dml.update(nation(s, d), {"n_name": F.lit("X")}, order=[F.desc("n_nationkey")], limit=4)
)
frame("dml_delete", f"SELECT {N} FROM nation WHERE NOT (n_regionkey > 2)")(lambda s, d: dml.delete(nation(s, d), F.expr("n_regionkey > 2")))
frame("dml_delete_multi", f"SELECT {N} FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")(
    lambda s, d: dml.delete_matching(n := nation(s, d), r := table(s, d, "region").where("r_name LIKE 'A%'"), n.n_regionkey == r.r_regionkey)
)
frame("dml_truncate", f"SELECT {N} FROM nation WHERE false")(lambda s, d: dml.truncate(nation(s, d)))


def script(key: str, oracle: str | None, *statements: str) -> None:
    """Statements of one session over a copy of nation, t; the last gives the result."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        s = Session(spark)
        s.register("t", nation(spark, folder), primary=["n_nationkey"])
        s.register("region", table(spark, folder, "region"))
        for x in statements[:-1]:
            s.sql(x)
        return s.sql(statements[-1])

    QUERIES[key] = run
    if oracle:
        ORACLE[key] = oracle


ALL = f"SELECT {N} FROM t"
script("sql_dml_statements", f"SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'up' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey >= 2 UNION ALL SELECT 40, 'ins', 1",
       "INSERT INTO t (n_nationkey, n_name, n_regionkey) VALUES (40, 'ins', 1)", "UPDATE t SET n_name = 'up' WHERE n_nationkey = 3", "DELETE FROM t WHERE n_nationkey < 2", ALL)
script("sql_upsert", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 1 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 50, 'n', 10",
       "INSERT INTO t VALUES (1, 'x', 10), (50, 'n', 10) ON DUPLICATE KEY UPDATE n_regionkey = n_regionkey + VALUES(n_regionkey)", ALL)
script("sql_delete_joined", f"SELECT {N} FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')", "DELETE a FROM t a JOIN region r ON a.n_regionkey = r.r_regionkey WHERE r.r_name LIKE 'A%'", ALL)
script("txn_rollback", f"SELECT {N} FROM nation", "BEGIN", "DELETE FROM t", "ROLLBACK", ALL)
script("txn_savepoint", f"SELECT {N} FROM nation WHERE n_nationkey <> 5", "BEGIN", "DELETE FROM t WHERE n_nationkey = 5", "SAVEPOINT a", "TRUNCATE TABLE t", "ROLLBACK TO a", "COMMIT", ALL)
script("ddl_create_insert", "SELECT 1 AS id, 'a' AS name, 18 AS age UNION ALL SELECT 2, 'b', 30", "CREATE TABLE u (id INT AUTO_INCREMENT PRIMARY KEY, name VARCHAR(50) NOT NULL, age INT DEFAULT 18)", "INSERT INTO u (name) VALUES ('a')", "INSERT INTO u (name, age) VALUES ('b', 30)", "SELECT * FROM u")
script("ddl_alter", "SELECT n_nationkey AS k, n_name, 5 AS extra FROM nation", "ALTER TABLE t ADD COLUMN extra INT DEFAULT 5, DROP COLUMN n_regionkey, RENAME COLUMN n_nationkey TO k", "SELECT * FROM t")
INSERTED = f"SELECT {N} FROM nation UNION ALL SELECT 40, 'ins', 1"
script("ddl_like", INSERTED, "CREATE TABLE u LIKE t", "ALTER TABLE u ADD COLUMN c INT", "INSERT INTO t VALUES (40, 'ins', 1)", ALL)
script("ddl_rollback", INSERTED, "BEGIN", "ALTER TABLE t ADD COLUMN c INT", "ROLLBACK", "INSERT INTO t VALUES (40, 'ins', 1)", ALL)
script("ddl_rename", f"SELECT {N} FROM nation", "RENAME TABLE t TO u", f"SELECT {N} FROM u")
script("ddl_view", "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey HAVING COUNT(*) > 1", "CREATE VIEW v AS SELECT n_regionkey, COUNT(*) AS n FROM t GROUP BY n_regionkey", "SELECT * FROM v WHERE n > 1")
script("ddl_index", "SELECT unnest(['PRIMARY', 'by_name']) AS INDEX_NAME, unnest(['n_nationkey', 'n_name']) AS COLUMN_NAME", "CREATE INDEX by_name ON t (n_name)", "SELECT INDEX_NAME, COLUMN_NAME FROM information_schema.STATISTICS")
script("show_variables", "SELECT 'autocommit' AS Variable_name, 'ON' AS Value", "SHOW VARIABLES LIKE 'autocommit'")
script("show_databases", "SELECT unnest(['default', 'information_schema', 'mysql', 'performance_schema', 'sys']) AS \"Database\"", "SHOW DATABASES")
COLUMNS_OF_T = """SELECT * FROM (VALUES ('n_nationkey', 'int', 'NO', 'PRI', CAST(NULL AS VARCHAR), ''), ('n_name', 'text', 'YES', '', NULL, ''), ('n_regionkey', 'int', 'YES', '', NULL, '')) AS v("Field", "Type", "Null", "Key", "Default", "Extra")"""
script("show_columns", COLUMNS_OF_T, "SHOW COLUMNS FROM t")
script("show_describe", COLUMNS_OF_T, "DESC t")
script("show_create_table", """SELECT 't' AS "Table", E'CREATE TABLE `t` (\\n  `n_nationkey` int NOT NULL,\\n  `n_name` text,\\n  `n_regionkey` int,\\n  PRIMARY KEY (`n_nationkey`)\\n) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4' AS "Create Table\"""", "SHOW CREATE TABLE t")
script("show_index", """SELECT 't' AS "Table", '0' AS Non_unique, 'PRIMARY' AS Key_name, '1' AS Seq_in_index, 'n_nationkey' AS Column_name, 'A' AS "Collation", CAST(NULL AS VARCHAR) AS Cardinality, CAST(NULL AS VARCHAR) AS Sub_part,
       CAST(NULL AS VARCHAR) AS Packed, '' AS "Null", 'BTREE' AS Index_type, '' AS "Comment", '' AS Index_comment""", "SHOW INDEX FROM t")
script("show_status", "SELECT unnest(['Com_insert', 'Com_select', 'Threads_connected', 'Threads_running']) AS Variable_name, unnest(['2', '10', '5', '2']) AS Value", "SHOW STATUS")
script("show_engines", None, "SHOW ENGINES")
script("show_charset", """SELECT * FROM (VALUES ('utf8', 'UTF-8 Unicode', 'utf8_general_ci', 3), ('utf8mb4', 'UTF-8 Unicode', 'utf8mb4_0900_ai_ci', 4)) AS v(Charset, Description, "Default collation", Maxlen)""", "SHOW CHARACTER SET WHERE Maxlen > 1")
script("show_collation", None, "SHOW COLLATION LIKE 'utf8mb4%'")
script("sysvar_select", "SELECT 'ON' AS a, 'SERIALIZABLE' AS i, 151 AS m", "SET SESSION TRANSACTION ISOLATION LEVEL SERIALIZABLE", "SELECT @@autocommit AS a, @@session.tx_isolation AS i, @@global.max_connections AS m")
script("info_schema_tables", "SELECT unnest(['region', 't']) AS TABLE_NAME, 'BASE TABLE' AS TABLE_TYPE", "SELECT TABLE_NAME, TABLE_TYPE FROM information_schema.TABLES WHERE TABLE_SCHEMA = 'default'")
script("info_schema_columns", "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS COLUMN_NAME, unnest(['int', 'text', 'int']) AS DATA_TYPE, unnest(['PRI', '', '']) AS COLUMN_KEY", "SELECT COLUMN_NAME, DATA_TYPE, COLUMN_KEY FROM information_schema.COLUMNS WHERE TABLE_NAME = 't'")
script("info_schema_statistics", "SELECT 't' AS TABLE_NAME, 'PRIMARY' AS INDEX_NAME, 'n_nationkey' AS COLUMN_NAME", "SELECT TABLE_NAME, INDEX_NAME, COLUMN_NAME FROM information_schema.STATISTICS")

# front end
sql("sql_logical_ops", "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > 100 && (o_custkey < 50 || o_custkey > 900) && !(o_orderstatus = 'P')", "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > 100 AND (o_custkey < 50 OR o_custkey > 900) AND NOT (o_orderstatus = 'P')")
sql("sql_params", "SELECT COUNT(*) AS n FROM orders WHERE o_custkey > ? AND o_orderstatus IN (?, 'P')", "SELECT COUNT(*) AS n FROM orders WHERE o_custkey > 100 AND o_orderstatus IN ('F', 'P')", [100, "F"])
sql("sql_hints_locks", "SELECT SQL_NO_CACHE o_orderkey FROM orders o USE INDEX (PRIMARY) WHERE o.o_orderkey < 50 /* note */ FOR UPDATE", "SELECT o_orderkey FROM orders WHERE o_orderkey < 50")
sql("sql_loose_group", "SELECT o_custkey, o_custkey + 0 AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey")
sql("sql_binary", "SELECT COUNT(*) AS n FROM orders WHERE BINARY o_orderstatus = 'F'", "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F'")
sql("sql_collate", "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus COLLATE utf8mb4_general_ci = 'f'", "SELECT COUNT(*) AS n FROM orders WHERE lower(o_orderstatus) = 'f'")
sql("sql_convert_using", "SELECT CONVERT(r_name USING utf8mb4) AS name FROM region", "SELECT r_name AS name FROM region")
sql("sql_match", "SELECT COUNT(*) AS n FROM part WHERE MATCH(p_name) AGAINST ('part 1') > 0", None)

# statistics
frame("stats_table", None)(lambda s, d: statistics.table_stats(table(s, d, "orders")))
frame("stats_column", "SELECT 'o_custkey' AS column_name, COUNT(*) AS n_rows, CAST(COUNT(*) - COUNT(o_custkey) AS BIGINT) AS n_null, COUNT(DISTINCT o_custkey) AS ndv, CAST(MIN(o_custkey) AS VARCHAR) AS min_value, CAST(MAX(o_custkey) AS VARCHAR) AS max_value FROM orders")(
    lambda s, d: statistics.column_stats(table(s, d, "orders"), ["o_custkey"], exact=True)
)
frame("stats_index", "SELECT COUNT(DISTINCT (l_returnflag, l_linestatus)) AS cardinality, COUNT(DISTINCT (l_returnflag, l_linestatus)) / COUNT(*) AS selectivity FROM lineitem")(
    lambda s, d: statistics.index_stats(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"])
)
frame("stats_topn", "SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 20")(lambda s, d: statistics.top_n(table(s, d, "lineitem"), "l_partkey", 20))
frame("hist_equi_width", "SELECT LEAST(10, CAST(FLOOR((l_quantity - lo) / ((hi - lo) / 10)) AS INTEGER) + 1) AS bucket, COUNT(*) AS n FROM lineitem, (SELECT MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem) GROUP BY 1")(
    lambda s, d: statistics.equi_width(table(s, d, "lineitem"), "l_quantity", 10)
)
frame("hist_equi_depth", "SELECT bucket, MIN(o_orderpriority) AS lo, MAX(o_orderpriority) AS hi, CAST(SUM(c) AS BIGINT) AS n FROM (SELECT o_orderpriority, c, CAST(CEIL(SUM(c) OVER (ORDER BY o_orderpriority) * 3 / SUM(c) OVER ()) AS INTEGER) AS bucket FROM (SELECT o_orderpriority, COUNT(*) AS c FROM orders GROUP BY 1)) GROUP BY bucket")(
    lambda s, d: statistics.equi_depth(table(s, d, "orders"), "o_orderpriority", 3)
)
frame("hist_frequency", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")(lambda s, d: statistics.frequency(table(s, d, "orders"), "o_orderstatus"))
