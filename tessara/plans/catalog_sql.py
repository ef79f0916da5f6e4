"""Relational queries, most of them in the engine's SQL dialect."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import relational as R
from .registry import dialect, load, query

# --- Projections, filters and predicates -----------------------------------

dialect("scan_select_arith", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + l_tax * 2 AS q FROM lineitem")
dialect("filter_compare", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_returnflag <> 'N' AND 'O' = l_linestatus")
dialect(
    "filter_three_valued",
    "SELECT event_id FROM events WHERE (CASE WHEN value > 50 THEN value END) > 80 OR NOT (CASE WHEN value < 20 THEN TRUE END) OR (CASE WHEN value < 5 THEN FALSE END) = FALSE",
)
dialect(
    "in_list",
    "SELECT p_partkey, p_size IN (1, 7, 15) AS small, p_brand NOT IN ('Brand#2', 'Brand#4') AS other, p_size IN (1, NULL) AS unknown, p_size IN () AS never, p_size NOT IN () AS always FROM part",
    "SELECT p_partkey, p_size IN (1, 7, 15) AS small, p_brand NOT IN ('Brand#2', 'Brand#4') AS other, CASE WHEN p_size = 1 THEN TRUE END AS unknown, FALSE AS never, TRUE AS always FROM part",
)
dialect("between_both_ways", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000.5 AND o_custkey NOT BETWEEN 100 AND 900")
dialect(
    "like_patterns",
    r"SELECT p_partkey, p_name LIKE '%ring' AS a, p_name LIKE 's%' AS b, p_type NOT LIKE '_C%' AS c, p_name LIKE '%\%' AS d, p_type LIKE p_type AS e, p_brand LIKE 'brand%' AS f FROM part",
    r"SELECT p_partkey, p_name LIKE '%ring' AS a, p_name LIKE 's%' AS b, p_type NOT LIKE '_C%' AS c, contains(p_name, '\') AS d, TRUE AS e, p_brand LIKE 'brand%' AS f FROM part",
)
dialect(
    "case_bands",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'low' END AS band, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2.5 END AS mixed FROM orders",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'low' END AS band, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2.5 END::DOUBLE AS mixed FROM orders",
)
dialect("is_null_mix", "SELECT event_id, (CASE WHEN value > 100 THEN value END) IS NULL AS a, (CASE WHEN value > 100 THEN value END) IS NOT NULL AS b, NULL IS NULL AS c, value + NULL IS NULL AS d FROM events")
dialect(
    "null_on_error_arithmetic",
    "SELECT l_orderkey, l_linenumber, l_quantity / (l_linenumber - 1) AS ratio, l_partkey % (l_linenumber - 2) AS rest, l_partkey / l_suppkey AS real_division, l_quantity % 7 AS float_rest, l_orderkey * 9223372036854775807 AS product FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_linenumber - 1, 0) AS ratio, l_partkey % nullif(l_linenumber - 2, 0) AS rest, l_partkey / nullif(l_suppkey, 0) AS real_division, l_quantity % 7 AS float_rest, TRY(l_orderkey * 9223372036854775807) AS product FROM lineitem",
)
dialect(
    "select_no_from",
    "SELECT 10 / 4 AS a, 7 / 2 AS b, 7 % 2 AS c, CAST(1 / 0 AS DOUBLE) AS d, 'it''s' AS e, TRUE AND NULL IS NULL AS f, -5 AS g, +3 AS h, 1.5e2 AS i, 9223372036854775807 + 1 AS j, - -2 AS k",
    "SELECT 2.5::DOUBLE AS a, 3.5::DOUBLE AS b, 1::BIGINT AS c, NULL::DOUBLE AS d, 'it''s' AS e, TRUE AS f, -5::BIGINT AS g, 3::BIGINT AS h, 150.0::DOUBLE AS i, NULL::BIGINT AS j, 2::BIGINT AS k",
)
dialect(
    "soft_casts",
    """SELECT o_orderkey, CAST(o_totalprice AS INT) AS whole, CAST(o_orderkey AS TEXT) AS text, CAST(o_orderpriority AS BIGINT) AS misfit, CAST(o_orderdate AS DATE) AS day,
    CAST(CAST(o_custkey AS VARCHAR) AS DOUBLE) AS back, CAST(o_orderkey > 100 AS STRING) AS flag, CAST('2024-02-30' AS DATE) AS no_day, CAST('yes' AS BOOLEAN) AS yes, CAST(' 42 ' AS INT) AS trimmed FROM orders""",
    """SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS whole, o_orderkey::VARCHAR AS text, NULL::BIGINT AS misfit, o_orderdate::DATE AS day,
    o_custkey::DOUBLE AS back, (o_orderkey > 100)::VARCHAR AS flag, NULL::DATE AS no_day, TRUE AS yes, 42::BIGINT AS trimmed FROM orders""",
)
dialect("date_compare", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) > CAST('1997-06-30' AS DATE) AND CAST(o_orderdate AS DATE) <= CAST('1998-03-01' AS DATE)")
dialect("negate", "SELECT c_custkey, -c_acctbal AS a, -c_custkey AS b, -(c_custkey - 10) * 2 AS c FROM customer")
dialect("star_expansion", "SELECT r.*, n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
dialect("output_names", "SELECT COUNT(*), l_linestatus, SUM(l_quantity) FROM lineitem GROUP BY l_linestatus", 'SELECT count(*) AS "COUNT(*)", l_linestatus, sum(l_quantity) AS "SUM(l_quantity)" FROM lineitem GROUP BY l_linestatus')
dialect(
    "precedence_and_comments",
    """SELECT o_orderkey, -- a line comment
    /* and a block */ NOT o_orderstatus = 'F' AND o_custkey > 10 OR o_custkey % 7 = 3 AS p, o_custkey + 2 * 3 - 4 AS q, (o_orderstatus = 'F') = o_custkey IS NULL AS r FROM orders;""",
    """SELECT o_orderkey, ((NOT (o_orderstatus = 'F')) AND o_custkey > 10) OR o_custkey % 7 = 3 AS p, o_custkey + 2 AS q, (o_orderstatus = 'F') = (o_custkey IS NULL) AS r FROM orders""",
)
dialect("quoted_names", 'SELECT "o_orderkey" AS "Order Key", O_CUSTKEY AS c FROM Orders WHERE "o_orderkey" < 5000')

# --- Joins -------------------------------------------------------------------

dialect("inner_join_multi_key", "SELECT a.l_orderkey AS k, a.l_suppkey AS s, a.l_linenumber AS x, b.l_linenumber AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey")
dialect("left_join_residual", "SELECT c.c_custkey AS c, o.o_orderkey AS o FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 150000 AND c.c_acctbal > 0")
dialect("right_join", "SELECT o.o_orderkey AS o, c.c_custkey AS c FROM orders o RIGHT OUTER JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'")
dialect("cross_join", "SELECT r.r_name AS r, n.n_name AS n FROM region r CROSS JOIN nation n")
dialect("comma_join", "SELECT r.r_name AS r, n.n_name AS n FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey")
dialect("theta_join", "SELECT r.r_name AS r, n.n_name AS n FROM region r JOIN nation n ON r.r_regionkey < n.n_regionkey")
dialect("self_join", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
dialect("mixed_type_key", "SELECT c.c_custkey AS c, n.n_name AS n FROM customer c JOIN nation n ON c.c_nationkey + 0.0 = n.n_nationkey")
dialect(
    "null_keys_never_match",
    "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON (CASE WHEN a.n_nationkey > 5 THEN a.n_regionkey END) = (CASE WHEN b.n_nationkey < 20 THEN b.n_regionkey END)",
)
dialect(
    "join_aggregate",
    """SELECT n.n_name AS nation, COUNT(*) AS n, MIN(o.o_totalprice) AS least, MAX(o.o_totalprice) AS most
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
    WHERE o.o_totalprice > 1000 GROUP BY n.n_name ORDER BY n DESC, nation""",
)

# --- Aggregation ---------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_discount), 8) AS avg_disc, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def agg_group_flags(spark, d):
    return (
        load(spark, d, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 8).alias("avg_disc"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
    )


dialect("global_agg", "SELECT COUNT(*) AS n, COUNT(CASE WHEN l_tax > 0.05 THEN l_tax END) AS some, MIN(l_shipdate) AS first_day, MAX(l_shipdate) AS last_day, SUM(l_quantity) AS q FROM lineitem")
dialect("global_agg_empty", "SELECT COUNT(*) AS n, SUM(l_quantity) AS q, MIN(l_returnflag) AS f, AVG(l_tax) AS t, COUNT(DISTINCT l_partkey) AS p FROM lineitem WHERE l_quantity < 0")
dialect("group_by_expression", "SELECT l_quantity % 5 AS band, COUNT(*) AS n, MAX(l_orderkey) AS most FROM lineitem GROUP BY l_quantity % 5")
dialect("group_by_alias", "SELECT CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, COUNT(*) AS n FROM orders GROUP BY size")
dialect("group_by_ordinal", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1, 2")
dialect(
    "group_alias_beats_column",
    "SELECT o_custkey % 3 AS o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus",
    "SELECT o_custkey % 3 AS o_orderstatus, count(*) AS n FROM orders GROUP BY o_custkey % 3",
)
dialect("group_by_null_key", "SELECT CASE WHEN l_linenumber > 3 THEN l_linenumber END AS k, COUNT(*) AS n FROM lineitem GROUP BY k")
dialect("group_many", "SELECT l_partkey, l_suppkey, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem GROUP BY l_partkey, l_suppkey")
dialect("count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(l_tax) AS n FROM lineitem GROUP BY l_returnflag")
dialect("having", "SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) < 400000")
dialect("having_global", "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 1")
dialect("agg_expression", "SELECT l_linestatus, SUM(l_quantity) / COUNT(l_quantity) AS mean, MAX(l_quantity) - MIN(l_quantity) AS spread, SUM(l_linenumber) % 7 AS rest FROM lineitem GROUP BY l_linestatus",
    "SELECT l_linestatus, sum(l_quantity) / count(l_quantity) AS mean, max(l_quantity) - min(l_quantity) AS spread, (sum(l_linenumber) % 7)::BIGINT AS rest FROM lineitem GROUP BY l_linestatus")
dialect("avg_and_mean", "SELECT o_orderpriority, AVG(o_custkey) AS a, MEAN(o_custkey) AS m FROM orders GROUP BY o_orderpriority")
dialect("min_max_types", "SELECT MIN(o_orderpriority) AS s, MAX(o_totalprice > 1000) AS b, MIN(CAST(o_orderdate AS DATE)) AS d, MAX(o_custkey) AS i, MIN(o_totalprice) AS f FROM orders",
    "SELECT min(o_orderpriority) AS s, bool_or(o_totalprice > 1000) AS b, min(o_orderdate::DATE) AS d, max(o_custkey) AS i, min(o_totalprice) AS f FROM orders")
dialect("sum_whole", "SELECT o_orderstatus, SUM(o_orderkey) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, sum(o_orderkey)::BIGINT AS s FROM orders GROUP BY o_orderstatus")
dialect(
    "sum_overflow_is_null",
    "SELECT o_orderstatus, SUM(9223372036854775807 - o_orderkey) AS s FROM orders GROUP BY o_orderstatus",
    "SELECT o_orderstatus, CASE WHEN count(*) > 1 THEN NULL ELSE min(9223372036854775807 - o_orderkey) END::BIGINT AS s FROM orders GROUP BY o_orderstatus",
)
dialect(
    "sum_distinct_overflow_is_null",
    "SELECT o_orderstatus, SUM(DISTINCT 9223372036854775807 - o_orderkey) AS s, SUM(DISTINCT o_orderkey % 7) AS t FROM orders GROUP BY o_orderstatus",
    "SELECT o_orderstatus, CASE WHEN count(DISTINCT o_orderkey) > 1 THEN NULL ELSE min(9223372036854775807 - o_orderkey) END::BIGINT AS s, sum(DISTINCT o_orderkey % 7)::BIGINT AS t FROM orders GROUP BY o_orderstatus",
)
dialect("distinct_aggregates", "SELECT l_returnflag, SUM(DISTINCT l_linenumber) AS s, AVG(DISTINCT l_quantity) AS a, MIN(DISTINCT l_tax) AS m FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, sum(DISTINCT l_linenumber)::BIGINT AS s, avg(DISTINCT l_quantity) AS a, min(l_tax) AS m FROM lineitem GROUP BY l_returnflag")
dialect("order_by_aggregate", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY COUNT(*) DESC, c_mktsegment")

# --- Order, limits, distinct -------------------------------------------------

dialect("order_nulls_last", "SELECT event_id, CASE WHEN value > 30 THEN value END AS v FROM events ORDER BY v, event_id LIMIT 9000", "SELECT event_id, CASE WHEN value > 30 THEN value END AS v FROM events ORDER BY v ASC NULLS LAST, event_id LIMIT 9000")
dialect("order_nulls_first", "SELECT event_id, CASE WHEN value > 30 THEN value END AS v FROM events ORDER BY v DESC, event_id LIMIT 700", "SELECT event_id, CASE WHEN value > 30 THEN value END AS v FROM events ORDER BY v DESC NULLS FIRST, event_id LIMIT 700")
dialect("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
dialect("limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25 OFFSET 40")
dialect("order_by_ordinal", "SELECT s_nationkey, s_suppkey FROM supplier ORDER BY 1 DESC, 2 LIMIT 30", "SELECT s_nationkey, s_suppkey FROM supplier ORDER BY s_nationkey DESC, s_suppkey LIMIT 30")
dialect("order_by_hidden", "SELECT p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
dialect("order_by_expression", "SELECT o_orderkey, o_totalprice * 2 AS double_price FROM orders ORDER BY o_totalprice % 1000, o_orderkey LIMIT 100")
dialect("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, CASE WHEN l_linenumber > 4 THEN l_linenumber END AS k FROM lineitem")
dialect("distinct_ordered", "SELECT DISTINCT p_type, p_size FROM part ORDER BY p_size DESC, p_type LIMIT 40")


@query("""SELECT o_custkey, o_orderkey, o_totalprice, rank FROM
(SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_k_per_group(spark, d):
    orders = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.top_k_per_group(orders, ["o_custkey"], [("o_totalprice", False), ("o_orderkey", True)], 3)


@query("""WITH a AS (SELECT DISTINCT o_custkey, o_orderstatus AS x FROM orders WHERE o_totalprice > 100000), b AS (SELECT DISTINCT o_custkey, o_orderstatus AS x FROM orders WHERE o_totalprice <= 100000),
u AS (SELECT o_custkey, count(DISTINCT x) AS u FROM orders o, LATERAL (SELECT o.o_orderstatus AS x) GROUP BY o_custkey),
i AS (SELECT o_custkey, count(*) AS i FROM a JOIN b USING (o_custkey, x) GROUP BY o_custkey)
SELECT u.o_custkey, round(coalesce(i, 0) / u, 8) AS overlap FROM u LEFT JOIN i ON u.o_custkey = i.o_custkey""")
def jaccard_overlap(spark, d):
    high = F.when(F.col("o_totalprice") > 100000, F.col("o_orderstatus"))
    low = F.when(F.col("o_totalprice") <= 100000, F.col("o_orderstatus"))
    sets = load(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(high).alias("a"), F.collect_set(low).alias("b"))
    return sets.select("o_custkey", F.round(R.jaccard(F.col("a"), F.col("b")), 8).alias("overlap"))


@query("""WITH a AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT a.o_custkey, sum(least(a.n, b.n))::BIGINT AS n FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.p = b.p GROUP BY a.o_custkey""")
def multiset_intersection(spark, d):
    orders = load(spark, d, "orders")
    return R.multiset_overlap(orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'O'"), ["o_custkey"], "o_orderpriority")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def missing_keys(spark, d):
    spenders = load(spark, d, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return R.missing_keys(load(spark, d, "customer").select("c_custkey"), spenders, ["c_custkey"])


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS shown, o_orderdate::DATE AS day, NULL::DATE AS loose FROM orders")
def date_parse_format(spark, d):
    """ISO dates there and back; a month of one digit is no date."""
    shown = S.cast(F.col("o_orderdate").cast("date"), "date", "string")
    loose = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-1-5"))
    return load(spark, d, "orders").select("o_orderkey", shown.alias("shown"), S.cast(shown, "string", "date").alias("day"), S.cast(loose, "string", "date").alias("loose"))
