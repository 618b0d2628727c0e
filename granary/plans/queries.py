"""The registered queries of the core operators, and for each the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import sql as fn
from granary.operators import dml, joins, paging, rowdiff, schemadiff, statements
from granary.plans.registry import ORACLES, QUERIES, c, money, query
from granary.sources import sinks
from granary.sources.tables import one_row, values

# Scans, projection


@query("SELECT n.n_name, n.n_regionkey FROM nation AS n")
def q_scan_alias(t):
    return t.nation.alias("n").select("n.n_name", "n.n_regionkey")


@query("SELECT * FROM customer")
def q_project_star(t):
    return t.customer


@query("SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA'")
def q_project_table_star(t):
    return t.nation.alias("n").join(t.region.alias("r"), c("n.n_regionkey") == c("r.r_regionkey")).filter("r.r_name <> 'ASIA'").select("n.*")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def q_distinct(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT d.k, d.total FROM (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) d WHERE d.total > 100000")
def q_derived_table(t):
    d = t.orders.groupBy(c("o_custkey").alias("k")).agg(money(F.sum("o_totalprice")).alias("total")).alias("d")
    return d.filter("d.total > 100000").select("d.k", "d.total")


@query("SELECT s_suppkey, s_name, 'X' AS dummy FROM supplier, (SELECT 1)")
def q_one_row_source(t):
    return t.supplier.join(F.broadcast(one_row(t.spark)), F.lit(True)).select("s_suppkey", "s_name", "dummy")


# Predicates


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 10 AND l_quantity <> 20 AND l_quantity < 40 AND l_discount <= 0.05 AND l_tax > 0.01 AND l_returnflag = 'R'")
def q_cmp_ops(t):
    return t.lineitem.filter((c("l_quantity") >= 10) & (c("l_quantity") != 20) & (c("l_quantity") < 40) & (c("l_discount") <= 0.05) & (c("l_tax") > 0.01) & (c("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' AND p_brand NOT LIKE 'Brand#1_'")
def q_like(t):
    return t.part.filter(c("p_name").like("%ring%") & ~c("p_brand").like("Brand#1_")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '#[12]+$') AND NOT regexp_matches(p_name, '^s')")
def q_rlike(t):
    return t.part.filter(c("p_brand").rlike("#[12]+$") & ~c("p_name").rlike("^s")).select("p_partkey", "p_brand")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')")
def q_not(t):
    return t.orders.filter(~(c("o_orderstatus") == "F")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR o_totalprice > 200000 AND o_orderpriority = '1-URGENT'")
def q_and_or(t):
    return t.orders.filter((c("o_orderstatus") == "O") | (c("o_totalprice") > 200000) & (c("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("SELECT c.c_custkey, o.o_orderkey IS NOT NULL AS has_order FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 WHERE o.o_orderkey IS NULL OR o.o_orderstatus IS NOT NULL")
def q_is_null(t):
    j = t.customer.join(t.orders, (c("c_custkey") == c("o_custkey")) & (c("o_totalprice") > 400000), "left")
    return j.filter(c("o_orderkey").isNull() | c("o_orderstatus").isNotNull()).select("c_custkey", c("o_orderkey").isNotNull().alias("has_order"))


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def q_between(t):
    return t.lineitem.filter(c("l_quantity").between(10, 20)).select("l_orderkey", "l_quantity")


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity NOT BETWEEN 5 AND 45")
def q_not_between(t):
    return t.lineitem.filter(~c("l_quantity").between(5, 45)).select("l_orderkey", "l_quantity")


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9, 14)")
def q_in_list(t):
    return t.part.filter(c("p_size").isin(1, 5, 9, 14)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size NOT IN (1, 5, 9, 14)")
def q_not_in_list(t):
    return t.part.filter(~c("p_size").isin(1, 5, 9, 14)).select("p_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def q_in_subquery(t):
    return joins.in_subquery(t.customer.select("c_custkey", "c_name"), ["c_custkey"], t.orders.filter("o_totalprice > 300000").select("o_custkey"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def q_not_in_subquery(t):
    return joins.not_in_subquery(t.customer.select("c_custkey", "c_name"), "c_custkey", t.orders.filter("o_totalprice > 300000").select("o_custkey"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END FROM orders)")
def q_not_in_with_null(t):
    return joins.not_in_subquery(t.customer.select("c_custkey"), "c_custkey", t.orders.select(F.when(c("o_orderkey") % 7 != 0, c("o_custkey"))))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT n FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS n FROM orders WHERE o_totalprice > 300000) WHERE n IS NOT NULL)")
def q_not_in_without_nulls(t):
    rows = t.orders.filter("o_totalprice > 300000").select(F.when(c("o_orderkey") % 7 != 0, c("o_custkey")).alias("n")).filter("n is not null")
    return joins.not_in_subquery(t.customer.select("c_custkey"), "c_custkey", rows)


@query("SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 400000)")
def q_tuple_in(t):
    return joins.in_subquery(t.orders, ["o_custkey", "o_orderstatus"], t.orders.filter("o_totalprice > 400000").select("o_custkey", "o_orderstatus")).select("o_orderkey")


# Expressions


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax - l_quantity / 2, 4) AS v FROM lineitem")
def q_arith(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(c("l_extendedprice") * (1 - c("l_discount")) + c("l_tax") - c("l_quantity") / 2, 4).alias("v"))


@query("SELECT p_partkey, (p_size & 4) + 2 AS a, (p_size | 2) << 1 AS b, p_size >> 1 AS d FROM part")
def q_bit_ops(t):
    return t.part.select("p_partkey", (c("p_size").bitwiseAND(4) + 2).alias("a"), F.shiftleft(c("p_size").bitwiseOR(2), 1).alias("b"), F.shiftright("p_size", 1).alias("d"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band FROM orders")
def q_case_searched(t):
    return t.orders.select("o_orderkey", F.when(c("o_totalprice") > 300000, "high").when(c("o_totalprice") > 100000, "middle").otherwise("low").alias("band"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders")
def q_case_simple(t):
    return t.orders.select("o_orderkey", fn.case(c("o_orderstatus"), [(F.lit("F"), F.lit(1)), (F.lit("O"), F.lit(2))], F.lit(0)).alias("code"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'fine' END AS state FROM supplier")
def q_if_then_else(t):
    return t.supplier.select("s_suppkey", F.when(c("s_acctbal") < 0, "debt").otherwise("fine").alias("state"))


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(o_custkey AS VARCHAR) AS cust, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def q_cast(t):
    return t.orders.select("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("whole"), c("o_custkey").cast("string").alias("cust"), fn.trunc(c("o_orderdate")).cast("string").alias("day"))


@query("SELECT o_orderkey, CAST(CAST(strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') AS DATE) AS VARCHAR) AS day FROM orders")
def q_cast_format(t):
    return t.orders.select("o_orderkey", fn.cast_with_mask(F.date_format("o_orderdate", fn.mask("DD.MM.YYYY")), "DATE", "DD.MM.YYYY").cast("string").alias("day"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)")
def q_scalar_subquery(t):
    mean = t.orders.agg((1.5 * F.avg("o_totalprice")).alias("limit"))
    return t.orders.join(F.broadcast(mean), c("o_totalprice") > c("limit")).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def q_correlated_scalar(t):
    most = t.orders.groupBy(c("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("most"))
    return t.orders.join(most, (c("o_custkey") == c("k")) & (c("o_totalprice") == c("most"))).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_size > 25 AND p_type = 'ECONOMY'")
def q_param(t):
    return t.spark.sql("SELECT p_partkey, p_retailprice FROM {part} WHERE p_size > :size AND p_type = :type", args={"size": 25, "type": "ECONOMY"}, part=t.part)


@query("SELECT c_custkey, upper(substr(c_name, 1, 4)) || '-' || replace(c_mktsegment, 'E', '3') AS tag, strpos(c_name, '#') AS at, length(trim(c_name)) AS n, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg FROM customer")
def q_string_functions(t):
    return t.customer.select("c_custkey", F.concat(F.upper(F.substring("c_name", 1, 4)), F.lit("-"), F.replace("c_mktsegment", F.lit("E"), F.lit("3"))).alias("tag"), F.instr("c_name", "#").cast("long").alias("at"), F.length(F.trim("c_name")).cast("long").alias("n"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("seg"))


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, date_trunc('hour', ts) AS hour, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_date_json_functions(t):
    return t.events.select("event_id", fn.trunc(c("ts")).cast("string").alias("day"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M') AS at, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE CAST(o_custkey AS VARCHAR) END AS BIGINT) AS n FROM orders")
def q_conversions(t):
    text = F.when(c("o_orderkey") % 3 == 0, c("o_orderstatus")).otherwise(c("o_custkey").cast("string"))
    return t.orders.select("o_orderkey", fn.to_char(c("o_orderdate"), "DD.MM.YYYY HH24:MI").alias("at"), fn.to_number(text, "bigint").alias("n"))


# Joins


@query("SELECT r_name, n_name FROM region, nation")
def q_cross_join(t):
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def q_comma_equi_join(t):
    return t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).select("n_name", "r_name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def q_inner_join(t):
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_totalprice < b.o_totalprice AND a.o_orderdate > b.o_orderdate")
def q_theta_join(t):
    a, b = t.orders.alias("a"), t.orders.alias("b")
    return a.join(b, (c("a.o_custkey") == c("b.o_custkey")) & (c("a.o_totalprice") < c("b.o_totalprice")) & (c("a.o_orderdate") > c("b.o_orderdate"))).select(c("a.o_orderkey").alias("a"), c("b.o_orderkey").alias("b"))


_L, _R = "(SELECT * FROM customer WHERE c_custkey % 3 <> 0)", "(SELECT * FROM orders WHERE o_custkey % 2 = 0)"


def _sides(t):
    return t.customer.filter("c_custkey % 3 <> 0"), t.orders.filter("o_custkey % 2 = 0"), c("c_custkey") == c("o_custkey")


@query(f"SELECT c_custkey, o_orderkey FROM {_L} LEFT JOIN {_R} ON c_custkey = o_custkey")
def q_left_outer(t):
    a, b, on = _sides(t)
    return a.join(b, on, "left").select("c_custkey", "o_orderkey")


@query(f"SELECT c_custkey, o_orderkey FROM {_L} RIGHT JOIN {_R} ON c_custkey = o_custkey")
def q_right_outer(t):
    a, b, on = _sides(t)
    return a.join(b, on, "right").select("c_custkey", "o_orderkey")


@query(f"SELECT c_custkey, o_orderkey FROM {_L} FULL JOIN {_R} ON c_custkey = o_custkey")
def q_full_outer(t):
    a, b, on = _sides(t)
    return a.join(b, on, "full").select("c_custkey", "o_orderkey")


@query(f"SELECT c_name, o_totalprice FROM {_L} FULL JOIN {_R} ON c_custkey = o_custkey")
def q_outer_is_full(t):
    return joins.outer_join(*_sides(t)).select("c_name", "o_totalprice")


_N = "(SELECT c_custkey, c_nationkey AS k FROM customer) a NATURAL JOIN (SELECT s_suppkey, s_nationkey AS k FROM supplier) b"


def _natural(t):
    return t.customer.select("c_custkey", c("c_nationkey").alias("k")), t.supplier.select("s_suppkey", c("s_nationkey").alias("k"))


@query(f"SELECT k, count(*) AS n FROM {_N} GROUP BY k")
def q_natural_join(t):
    return joins.natural_join(*_natural(t)).groupBy("k").agg(F.count("*").alias("n"))


@query(f"SELECT c_custkey, s_suppkey FROM {_N} WHERE c_custkey < s_suppkey")
def q_natural_join_on(t):
    return joins.natural_join(*_natural(t), c("c_custkey") < c("s_suppkey")).select("c_custkey", "s_suppkey")


@query("SELECT s_suppkey, r_name FROM supplier CROSS JOIN region")
def q_join_no_on(t):
    return t.supplier.crossJoin(t.region).select("s_suppkey", "r_name")


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND c_nationkey = n_nationkey GROUP BY n_name")
def q_three_way(t):
    j = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey"))
    return j.groupBy("n_name").agg(money(F.sum(c("l_extendedprice") * (1 - c("l_discount")))).alias("revenue"))


@query("SELECT x.c_custkey, x.n_name FROM (customer JOIN nation ON c_nationkey = n_nationkey) x JOIN region ON x.n_regionkey = r_regionkey WHERE r_regionkey < 3")
def q_aliased_join(t):
    x = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).alias("x")
    return x.join(t.region, c("x.n_regionkey") == c("r_regionkey")).filter("r_regionkey < 3").select("x.c_custkey", "x.n_name")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'ORDERS_ONLY' WHEN a.k IS NULL THEN 'CUSTOMERS_ONLY' ELSE 'BOTH' END AS status FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 250000) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) b ON a.k = b.k")
def q_inventory_status(t):
    return joins.status_join(t.orders.filter("o_totalprice > 250000").select(c("o_custkey").alias("k")), t.customer.filter("c_acctbal > 0").select(c("c_custkey").alias("k")), ["k"], ("ORDERS", "CUSTOMERS"))


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) USING (c_custkey)")
def q_lookup_default(t):
    n = t.orders.filter("o_orderstatus = 'P'").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return joins.lookup_with_default(t.customer.select("c_custkey"), n, ["c_custkey"], {"n": F.lit(0)})


# Aggregation


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 4) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
def q_agg_global(t):
    return t.lineitem.agg(F.count("*").alias("n"), money(F.sum("l_quantity")).alias("s"), F.round(F.avg("l_quantity"), 4).alias("a"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def q_group_by(t):
    return t.lineitem.filter("l_shipdate <= DATE '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(money(F.sum("l_quantity")).alias("sum_qty"), money(F.sum(c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax")))).alias("charge"), F.count("*").alias("n"))


@query("SELECT year(o_orderdate) AS y, o_custkey % 10 AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), o_custkey % 10")
def q_group_by_expr(t):
    return t.orders.groupBy(F.year("o_orderdate").cast("bigint").alias("y"), (c("o_custkey") % 10).alias("m")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, round(sum(l_quantity * l_extendedprice), 0) AS s, round(sum(l_discount + l_tax), 2) AS d FROM lineitem GROUP BY l_suppkey")
def q_agg_expr(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum(c("l_quantity") * c("l_extendedprice")), 0).alias("s"), money(F.sum(c("l_discount") + c("l_tax"))).alias("d"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS n, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderpriority")
def q_count_distinct(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n"), F.sum_distinct("o_custkey").alias("s"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 2000000")
def q_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("_s")).filter("_s > 2000000").drop("_s")


@query("SELECT count(*) AS n FROM orders HAVING max(o_totalprice) > 1000")
def q_having_no_group(t):
    return t.orders.agg(F.count("*").alias("n"), F.max("o_totalprice").alias("_m")).filter("_m > 1000").drop("_m")


@query("SELECT c_nationkey, c_mktsegment FROM customer GROUP BY c_nationkey, c_mktsegment")
def q_group_no_agg(t):
    return t.customer.select("c_nationkey", "c_mktsegment").distinct()


@query("SELECT o_custkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS other FROM orders GROUP BY o_custkey")
def q_cond_count(t):
    return t.orders.groupBy("o_custkey").agg(F.count_if(c("o_orderstatus") == "F").alias("f"), F.count_if(c("o_orderstatus") != "F").alias("other"))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_acctbal > 9000 GROUP BY n_regionkey")
def q_listagg(t):
    j = t.nation.join(t.supplier.filter("s_acctbal > 9000"), c("n_nationkey") == c("s_nationkey"))
    return j.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey")
def q_group_collect(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("keys"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, max(o_orderdate) AS at FROM orders GROUP BY o_custkey")
def q_last_per_group(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"), F.max("o_orderdate").alias("at"))


@query("SELECT o_custkey, string_agg(o_orderpriority || '=' || v, ';' ORDER BY o_orderpriority) AS entries FROM (SELECT o_custkey, o_orderpriority, CAST(max(o_orderkey) AS VARCHAR) AS v FROM orders GROUP BY 1, 2) GROUP BY o_custkey")
def q_map_last_wins(t):
    last = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderkey").cast("string").alias("v"))
    m = last.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "v"))).alias("m"))
    return m.select("o_custkey", F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), c("m")[k])), ";").alias("entries"))


# Windows


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
def q_row_number(t):
    return t.orders.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("bigint").alias("rn"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def q_top1_per_group(t):
    return t.orders.withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).filter("rn = 1").select("o_custkey", "o_orderkey")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 2) AS running FROM events")
def q_window_sum(t):
    return t.events.select("event_id", money(F.sum("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("running"))


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id) AS most, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def q_window_whole(t):
    w = Window.partitionBy("user_id")
    return t.events.select("event_id", F.max("value").over(w).alias("most"), F.count("*").over(w).alias("n"))


@query("SELECT n_name, count(*) OVER () AS total FROM (SELECT n_name, count(*) AS k FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name)")
def q_window_empty(t):
    g = t.nation.join(t.customer, c("n_nationkey") == c("c_nationkey")).groupBy("n_name").agg(F.count("*").alias("k"))
    return g.select("n_name", F.count("*").over(Window.partitionBy()).alias("total"))


@query("SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id) AS kinds FROM events")
def q_window_distinct(t):
    return t.events.select("event_id", F.size(F.collect_set("event_type").over(Window.partitionBy("user_id"))).cast("bigint").alias("kinds"))


# Order, limit, sets


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q_order_limit(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 5")
def q_limit_offset(t):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").offset(5).limit(20)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100")
def q_offset_only(t):
    return paging.offset_rows(t.orders.select("o_orderkey"), ["o_orderkey"], 100)




@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier")
def q_union(t):
    return t.customer.filter("c_acctbal > 9000").select(c("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def q_union_all(t):
    return t.customer.select(c("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def q_union_chain(t):
    return t.customer.select(c("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct().union(t.nation.select("n_nationkey"))


@query("(SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) UNION (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def q_union_paren(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select(c("o_orderkey").alias("k")).union(t.lineitem.filter("l_quantity > 49").select("l_orderkey")).distinct()


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def q_exists(t):
    return t.customer.select("c_custkey").join(t.orders.filter("o_totalprice > 300000"), c("c_custkey") == c("o_custkey"), "left_semi")


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier ORDER BY v DESC, k LIMIT 25")
def q_union_trailing_order(t):
    every = t.customer.select(c("c_custkey").alias("k"), c("c_acctbal").alias("v")).union(t.supplier.select("s_suppkey", "s_acctbal"))
    return every.orderBy(F.desc("v"), "k").limit(25)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def q_set_difference(t):
    return t.customer.select("c_custkey").join(t.orders.filter("o_totalprice > 300000"), c("c_custkey") == c("o_custkey"), "left_anti")


# CTE and DML


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), n AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM n JOIN customer ON o_custkey = c_custkey")
def q_cte(t):
    n = t.orders.filter("o_totalprice > 200000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.join(t.customer, c("o_custkey") == c("c_custkey")).select("c_name", "n")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id, event_type FROM r WHERE rn <= 2")
def q_cte_window(t):
    return t.events.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).filter("rn <= 2").select("user_id", "event_id", "event_type")


_S = "s_suppkey, s_name, s_nationkey, s_acctbal"


@query(f"SELECT {_S} FROM supplier UNION ALL SELECT 900001, 'New one', NULL, 0.0 UNION ALL SELECT 900002, 'New two', NULL, 0.0")
def q_insert_values(t):
    rows = values(t.spark, [(900001, "New one"), (900002, "New two")], "k long, n string")
    return dml.insert(t.supplier, rows, ["s_suppkey", "s_name"], {"s_acctbal": F.lit(0.0)})


@query(f"SELECT {_S} FROM supplier UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
def q_insert_select(t):
    return dml.insert(t.supplier, t.customer.filter("c_acctbal > 5000").select(c("c_custkey") + 1000000, "c_name", "c_nationkey", "c_acctbal"))


@query(f"SELECT {_S} FROM supplier UNION ALL (WITH x AS (SELECT c_nationkey AS k, max(c_acctbal) AS m FROM customer GROUP BY 1) SELECT k + 5000000, 'Best of nation', k, m FROM x)")
def q_insert_with_cte(t):
    x = t.customer.groupBy(c("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("m"))
    return dml.insert(t.supplier, x.select(c("k") + 5000000, F.lit("Best of nation"), "k", "m"))


@query(f"SELECT {_S} FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT s_suppkey, s_name || '!', s_nationkey, s_acctbal + 1 FROM supplier WHERE s_suppkey % 4 = 0")
def q_insert_or_replace(t):
    new = t.supplier.filter("s_suppkey % 4 = 0").select("s_suppkey", F.concat("s_name", F.lit("!")).alias("s_name"), "s_nationkey", (c("s_acctbal") + 1).alias("s_acctbal"))
    return dml.insert_or_replace(t.supplier, new, ["s_suppkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 100000 THEN o_totalprice * 0.5 ELSE o_totalprice END AS o_totalprice FROM orders")
def q_update(t):
    d = dml.update(t.orders, (c("o_orderstatus") == "P") & (c("o_totalprice") > 100000), o_orderstatus=F.lit("X"), o_totalprice=c("o_totalprice") * 0.5)
    return d.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT * FROM events WHERE NOT coalesce(value < 5 AND nullif(event_type, 'view') <> 'error', false)")
def q_delete(t):
    return dml.delete(t.events, (c("value") < 5) & (F.nullif("event_type", F.lit("view")) != "error"))


@query("""
SELECT coalesce(t.c_custkey, u.c_custkey) AS c_custkey, CASE WHEN t.c_custkey IS NULL THEN 'new' ELSE t.c_name END AS c_name,
  CASE WHEN t.c_custkey IS NOT NULL AND u.c_custkey IS NOT NULL AND u.total > 1000 THEN round(t.c_acctbal + u.total, 2) WHEN t.c_custkey IS NOT NULL THEN t.c_acctbal ELSE u.total END AS c_acctbal
FROM (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 5 <> 0) t
FULL JOIN (SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) u ON t.c_custkey = u.c_custkey""")
def q_merge(t):
    into = t.customer.filter("c_custkey % 5 <> 0").select("c_custkey", "c_name", "c_acctbal")
    using = t.orders.filter("o_orderkey % 3 = 0").groupBy(c("o_custkey").alias("c_custkey")).agg(money(F.sum("o_totalprice")).alias("total"))
    return dml.merge(into, using, ["c_custkey"], {"c_acctbal": F.round(c("t.c_acctbal") + c("u.total"), 2)}, {"c_custkey": c("u.c_custkey"), "c_name": F.lit("new"), "c_acctbal": c("u.total")}, c("u.total") > 1000)


# Row differ: orders against orders of which some are dropped, some changed and some added

_NEW = """new AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 31 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 62 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
  FROM orders WHERE o_orderkey % 97 <> 0 UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 53 = 0)"""
_DIFF = f"""WITH {_NEW}, d AS (
  SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'INSERT' WHEN n.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op,
    CASE WHEN o.o_orderkey IS NOT NULL AND n.o_orderkey IS NOT NULL THEN concat_ws(',', CASE WHEN o.o_custkey IS DISTINCT FROM n.o_custkey THEN 'o_custkey' END, CASE WHEN o.o_orderstatus IS DISTINCT FROM n.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN o.o_totalprice IS DISTINCT FROM n.o_totalprice THEN 'o_totalprice' END) END AS changed
  FROM orders o FULL JOIN new n ON o.o_orderkey = n.o_orderkey)"""


def _states(t):
    old = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    new = old.filter("o_orderkey % 97 <> 0").withColumns({"o_orderstatus": F.when(c("o_orderkey") % 31 == 0, "Z").otherwise(c("o_orderstatus")), "o_totalprice": F.when(c("o_orderkey") % 62 == 0, c("o_totalprice") + 1).otherwise(c("o_totalprice"))})
    return old, new.union(old.filter("o_orderkey % 53 = 0").withColumn("o_orderkey", c("o_orderkey") + 100000000))


def _diff(t, **how):
    d = rowdiff.diff(*_states(t), ["o_orderkey"], **how)
    return d.select("o_orderkey", "op", F.array_join("changed", ",").alias("changed"))


@query(f"{_DIFF} SELECT * FROM d WHERE op <> 'UPDATE' OR changed <> ''")
def q_rowdiff_all(t):
    return _diff(t)


@query(f"{_DIFF} SELECT o_orderkey FROM d WHERE op = 'INSERT'")
def q_rowdiff_insert(t):
    return _diff(t).filter("op = 'INSERT'").select("o_orderkey")


@query(f"{_DIFF} SELECT o_orderkey FROM d WHERE op = 'DELETE'")
def q_rowdiff_delete(t):
    return _diff(t).filter("op = 'DELETE'").select("o_orderkey")


@query(f"{_DIFF} SELECT o_orderkey, changed FROM d WHERE op = 'UPDATE' AND changed <> ''")
def q_rowdiff_update(t):
    return _diff(t).filter("op = 'UPDATE'").select("o_orderkey", "changed")


@query(f"{_DIFF} SELECT * FROM d WHERE op = 'INSERT' OR op = 'UPDATE' AND changed <> ''")
def q_rowdiff_no_deletes(t):
    return _diff(t, deletes=False)


@query(f"{_DIFF} SELECT op, changed, count(*) AS n FROM d WHERE op <> 'UPDATE' OR changed <> '' GROUP BY op, changed")
def q_rowdiff_changed_cols(t):
    return _diff(t).groupBy("op", "changed").agg(F.count("*").alias("n"))


@query("""
WITH new AS (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 5 = 0 THEN upper(text) ELSE text END AS text FROM conversations WHERE conv_id % 11 <> 0)
SELECT o.conv_id, o.turn, CASE WHEN n.conv_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op
FROM conversations o LEFT JOIN new n ON o.conv_id = n.conv_id AND o.turn = n.turn WHERE n.conv_id IS NULL OR o.text IS DISTINCT FROM n.text""")
def q_rowdiff_composite_key(t):
    new = t.conversations.filter("conv_id % 11 <> 0").withColumn("text", F.when((c("conv_id") + c("turn")) % 5 == 0, F.upper("text")).otherwise(c("text")))
    return rowdiff.diff(t.conversations, new, ["conv_id", "turn"]).select("conv_id", "turn", "op")


@query(f"WITH {_NEW} SELECT * FROM new")
def q_rowdiff_apply(t):
    old, new = _states(t)
    return rowdiff.apply_changes(old, rowdiff.diff(old, new, ["o_orderkey"]), ["o_orderkey"])


@query("""
WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
new AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id)
SELECT n.user_id, CASE WHEN l.user_id IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS op FROM new n LEFT JOIN last l ON n.user_id = l.user_id
WHERE l.user_id IS NULL OR l.event_type IS DISTINCT FROM n.event_type OR l.value IS DISTINCT FROM n.value""")
def q_rowdiff_duplicate_keys(t):
    new = t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max_by("value", "event_id").alias("value"))
    old = t.events.filter("event_id % 2 = 0").select("user_id", "event_type", "value", "event_id")
    return rowdiff.diff(old, new, ["user_id"], last_by=["event_id"]).select("user_id", "op")


@query("""
WITH o AS (SELECT c_custkey, c_acctbal FROM customer), n AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer),
p AS (SELECT s_suppkey, s_acctbal FROM supplier), q AS (SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT 'customer' AS table_name, 'UPDATE' AS op, count(*) AS n FROM o JOIN n USING (c_custkey) WHERE o.c_acctbal <> n.c_acctbal HAVING count(*) > 0
UNION ALL SELECT 'supplier', 'DELETE', count(*) FROM p WHERE s_suppkey NOT IN (SELECT s_suppkey FROM q) HAVING count(*) > 0""")
def q_rowdiff_tables(t):
    a, b = t.customer.select("c_custkey", "c_acctbal"), t.supplier.select("s_suppkey", "s_acctbal")
    new = {"customer": a.withColumn("c_acctbal", F.when(c("c_custkey") % 13 == 0, 0.0).otherwise(c("c_acctbal"))), "supplier": b.filter("s_suppkey % 3 <> 0")}
    d = rowdiff.diff_tables({"customer": a, "supplier": b}, new, {"customer": ["c_custkey"], "supplier": ["s_suppkey"]})
    return d.groupBy("table_name", "op").agg(F.count("*").alias("n"))


@query("""
WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer)
SELECT 'customer' AS table_name, 'UPDATE' AS op, '{"c_custkey":' || c_custkey || '}' AS row_key FROM customer o JOIN n USING (c_custkey) WHERE o.c_acctbal <> n.c_acctbal
UNION ALL SELECT 'supplier', 'INSERT', '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}' FROM supplier WHERE s_suppkey % 3 <> 0""")
def q_rowdiff_fallback(t):
    a, b = t.customer.select("c_custkey", "c_acctbal"), t.supplier.select("s_suppkey", "s_name")
    new = {"customer": a.withColumn("c_acctbal", F.when(c("c_custkey") % 13 == 0, 0.0).otherwise(c("c_acctbal"))), "supplier": b.filter("s_suppkey % 3 <> 0")}
    return rowdiff.diff_tables({"customer": a, "supplier": b}, new, {"customer": ["c_custkey"]}, fall_back=True).drop("changed")


@query(f"WITH {_NEW} SELECT 'old' AS side, CAST(count(*) AS BIGINT) AS n_rows FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders EXCEPT ALL SELECT * FROM new) UNION ALL SELECT 'new', count(*) FROM (SELECT * FROM new EXCEPT ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders)")
def q_row_hash_compare(t):
    return rowdiff.row_hash_compare(*_states(t))


# Schema differ: catalogs that Spark derives from events - users are tables, event types their columns, ranges of values their types

_CAT = """SELECT 'u' || CAST(user_id AS VARCHAR) AS table_name, event_type AS column_name, 'NUMBER(' || CAST(length(CAST(CAST(floor(max(value)) AS BIGINT) AS VARCHAR)) AS VARCHAR) || ')' AS sql_type,
  min(value) < 1 AS nullable, CASE WHEN max(value) > 100 THEN CAST(CAST(floor(min(value)) AS BIGINT) AS VARCHAR) END AS default_text FROM events WHERE {} GROUP BY user_id, event_type"""
_OLD_CAT, _NEW_CAT = _CAT.format("event_id % 3 <> 0 AND user_id % 17 <> 0"), _CAT.format("event_id % 3 <> 1 AND user_id % 19 <> 0")


def _catalogs(t):
    def one(where: str) -> DataFrame:
        size = F.length(F.floor(F.max("value")).cast("bigint").cast("string")).cast("string")
        g = t.events.filter(where).groupBy("user_id", c("event_type").alias("column_name"))
        g = g.agg(F.concat(F.lit("NUMBER("), size, F.lit(",0)")).alias("sql_type"), (F.min("value") < 1).alias("nullable"), F.when(F.max("value") > 100, F.floor(F.min("value")).cast("bigint").cast("string")).alias("default_text"))
        return g.withColumn("table_name", F.concat(F.lit("u"), c("user_id").cast("string"))).drop("user_id")

    return one("event_id % 3 <> 0 AND user_id % 17 <> 0"), one("event_id % 3 <> 1 AND user_id % 19 <> 0")


@query(f"WITH o AS (SELECT DISTINCT upper(table_name) AS k FROM ({_OLD_CAT})), n AS (SELECT DISTINCT upper(table_name) AS k FROM ({_NEW_CAT})) SELECT coalesce(o.k, n.k) AS table_name, CASE WHEN o.k IS NULL THEN 'ADD' ELSE 'DROP' END AS op FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL")
def q_schemadiff_tables(t):
    return schemadiff.diff_tables(*_catalogs(t))


_COLS = f"""WITH o AS (SELECT upper(table_name) AS t, upper(column_name) AS k, * FROM ({_OLD_CAT})), n AS (SELECT upper(table_name) AS t, upper(column_name) AS k, * FROM ({_NEW_CAT})),
d AS (SELECT coalesce(o.t, n.t) AS table_name, coalesce(o.k, n.k) AS column_name, CASE WHEN o.t IS NULL THEN 'ADD' WHEN n.t IS NULL THEN 'DROP' ELSE 'MODIFY' END AS op,
    CASE WHEN o.t IS NOT NULL AND n.t IS NOT NULL THEN concat_ws(', ', CASE WHEN o.sql_type <> n.sql_type THEN 'type: ' || o.sql_type || ' -> ' || n.sql_type END,
      CASE WHEN o.nullable <> n.nullable THEN 'nullable: ' || CAST(o.nullable AS VARCHAR) || ' -> ' || CAST(n.nullable AS VARCHAR) END,
      CASE WHEN o.default_text IS DISTINCT FROM n.default_text THEN 'default: ' || coalesce(o.default_text, 'NULL') || ' -> ' || coalesce(n.default_text, 'NULL') END) END AS change
  FROM o FULL JOIN n ON o.t = n.t AND o.k = n.k),
e AS (SELECT * FROM d WHERE change IS DISTINCT FROM '' AND table_name IN (SELECT t FROM o) AND table_name IN (SELECT t FROM n))"""


@query(f"{_COLS} SELECT table_name, column_name, op, change FROM e")
def q_schemadiff_columns(t):
    return schemadiff.diff_columns(*_catalogs(t))


@query(f"{_COLS} SELECT table_name, count(*) AS n, string_agg(concat_ws(' ', op, column_name, change), '; ' ORDER BY concat_ws(' ', op, column_name, change)) AS differences FROM e GROUP BY table_name")
def q_column_differences(t):
    return schemadiff.column_differences(*_catalogs(t))


@query(f"{_COLS} SELECT op, CASE op WHEN 'ADD' THEN 'ADD COLUMN' WHEN 'DROP' THEN 'DROP COLUMN' ELSE 'MODIFY COLUMN' END AS step, CASE op WHEN 'ADD' THEN 'DROP COLUMN' END AS reverse, count(*) AS n FROM e GROUP BY op")
def q_migration_steps(t):
    return schemadiff.migration_steps(schemadiff.diff_columns(*_catalogs(t)), "COLUMN").groupBy("op", "step", "reverse").agg(F.count("*").alias("n"))


_CON = "SELECT 'U' || CAST(user_id AS VARCHAR) AS table_name, upper(event_type) AS kind, CASE WHEN event_type <> 'view' THEN 'C' || CAST(user_id % 10 AS VARCHAR) END AS name, CAST(CAST(floor(max(value) / 50) AS BIGINT) AS VARCHAR) AS definition FROM events WHERE {} GROUP BY user_id, event_type"


def _constraints(t, where: str) -> DataFrame:
    g = t.events.filter(where).groupBy("user_id", "event_type").agg(F.floor(F.max("value") / 50).cast("bigint").cast("string").alias("definition"))
    return g.select(F.concat(F.lit("U"), "user_id").alias("table_name"), F.upper("event_type").alias("kind"), F.when(c("event_type") != "view", F.concat(F.lit("c"), c("user_id") % 10)).alias("name"), "definition")


@query(f"""WITH o AS (SELECT * FROM ({_CON.format('event_id % 3 <> 0')}) WHERE name IS NOT NULL), n AS (SELECT * FROM ({_CON.format('event_id % 3 <> 1')}) WHERE name IS NOT NULL),
j AS (SELECT coalesce(o.table_name, n.table_name) AS table_name, coalesce(o.kind, n.kind) AS kind, coalesce(o.name, n.name) AS name, o.definition AS a, n.definition AS b FROM o FULL JOIN n USING (table_name, kind, name))
SELECT 'DROP' AS op, table_name, kind, name FROM j WHERE a IS NOT NULL AND a IS DISTINCT FROM b UNION ALL SELECT 'ADD', table_name, kind, name FROM j WHERE b IS NOT NULL AND a IS DISTINCT FROM b""")
def q_schemadiff_constraints(t):
    return schemadiff.diff_constraints(_constraints(t, "event_id % 3 <> 0"), _constraints(t, "event_id % 3 <> 1"))


_PK = "SELECT 'U' || CAST(user_id AS VARCHAR) AS table_name, CASE user_id % 3 WHEN 0 THEN 'PK' || CAST({0} AS VARCHAR) WHEN 1 THEN NULL END AS pk, CAST(CAST(floor(max(value) / 50) AS BIGINT) AS VARCHAR) AS definition FROM events WHERE event_type = 'click' AND {1} GROUP BY user_id"


@query(f"""WITH o AS ({_PK.format('user_id % 2', 'event_id % 3 <> 0')}), n AS ({_PK.format('user_id % 4', 'event_id % 3 <> 1')}),
j AS (SELECT coalesce(o.table_name, n.table_name) AS table_name, o.definition AS a, n.definition AS b, o.pk AS x, n.pk AS y FROM o FULL JOIN n USING (table_name)),
d AS (SELECT * FROM j WHERE a IS DISTINCT FROM b OR x IS DISTINCT FROM y)
SELECT 'DROP' AS op, table_name, 'PRIMARY KEY' AS kind FROM d WHERE a IS NOT NULL UNION ALL SELECT 'ADD', table_name, 'PRIMARY KEY' FROM d WHERE b IS NOT NULL""")
def q_schemadiff_primary_keys(t):
    def keys(where: str, number: Column, system: str) -> DataFrame:
        g = t.events.filter(where).filter("event_type = 'click'").groupBy("user_id").agg(F.floor(F.max("value") / 50).cast("bigint").cast("string").alias("definition"))
        name = F.when(c("user_id") % 3 == 0, F.concat(F.lit("pk"), number)).when(c("user_id") % 3 == 2, F.lit(system))
        return g.select(F.concat(F.lit("u"), "user_id").alias("table_name"), F.lit("PRIMARY KEY").alias("kind"), name.alias("name"), "definition")

    d = schemadiff.diff_constraints(keys("event_id % 3 <> 0", c("user_id") % 2, "SYS_C0011"), keys("event_id % 3 <> 1", c("user_id") % 4, "SYS_C0022"))
    return d.drop("name")


@query("""WITH i AS (SELECT 'T' || CAST(l_suppkey AS VARCHAR) AS table_name, CASE WHEN l_linenumber % 2 = 0 THEN 'I' || CAST(l_linenumber AS VARCHAR) END AS name, 'A,B' || CAST(l_linenumber AS VARCHAR) AS cols, max(l_quantity) > {0} AS u FROM lineitem GROUP BY l_suppkey, l_linenumber),
k AS (SELECT table_name, coalesce(name, CASE WHEN u THEN 'uix_' ELSE 'ix_' END || lower(table_name) || '_' || replace(lower(cols), ',', '_')) AS name, cols, u FROM i),
""".replace("{0}", "49.5") + """i2 AS (SELECT 'T' || CAST(l_suppkey AS VARCHAR) AS table_name, CASE WHEN l_linenumber % 2 = 0 THEN 'I' || CAST(l_linenumber AS VARCHAR) END AS name, 'A,B' || CAST(l_linenumber AS VARCHAR) AS cols, max(l_quantity) > 48.5 AS u FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY l_suppkey, l_linenumber),
k2 AS (SELECT table_name, coalesce(name, CASE WHEN u THEN 'uix_' ELSE 'ix_' END || lower(table_name) || '_' || replace(lower(cols), ',', '_')) AS name, cols, u FROM i2)
SELECT coalesce(k.table_name, k2.table_name) AS table_name, coalesce(k.name, k2.name) AS name, CASE WHEN k.name IS NULL THEN 'ADD' WHEN k2.name IS NULL THEN 'DROP' ELSE 'MODIFY' END AS op,
  CASE WHEN k.name IS NOT NULL AND k2.name IS NOT NULL THEN 'is_unique: ' || CAST(k.u AS VARCHAR) || ' -> ' || CAST(k2.u AS VARCHAR) END AS change
FROM k FULL JOIN k2 ON k.table_name = k2.table_name AND k.name = k2.name WHERE k.name IS NULL OR k2.name IS NULL OR k.u <> k2.u""")
def q_schemadiff_indexes(t):
    def indexes(df: DataFrame, most: float) -> DataFrame:
        n = c("l_linenumber").cast("string")
        g = df.groupBy("l_suppkey", "l_linenumber").agg((F.max("l_quantity") > most).alias("is_unique"))
        return g.select(F.concat(F.lit("t"), c("l_suppkey").cast("string")).alias("table_name"), F.when(c("l_linenumber") % 2 == 0, F.concat(F.lit("i"), n)).alias("name"), F.concat(F.lit("A,B"), n).alias("columns"), "is_unique")

    return schemadiff.diff_indexes(indexes(t.lineitem, 49.5), indexes(t.lineitem.filter("l_suppkey % 5 <> 0"), 48.5))


@query("""WITH o AS (SELECT upper(c_name) AS table_name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS x FROM customer), n AS (SELECT upper(c_name) AS table_name, CASE WHEN c_custkey % 8 <> 0 THEN CASE WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END END AS x FROM customer WHERE c_custkey % 9 <> 0)
SELECT table_name, o.x AS old_comment, n.x AS new_comment FROM o JOIN n USING (table_name) WHERE o.x IS DISTINCT FROM n.x""")
def q_schemadiff_comments(t):
    old = t.customer.select(c("c_name").alias("table_name"), F.when(c("c_custkey") % 4 != 0, c("c_mktsegment")).alias("comment"))
    said = F.when(c("c_custkey") % 7 == 0, F.lower("c_mktsegment")).otherwise(c("c_mktsegment"))
    return schemadiff.diff_comments(old, t.customer.filter("c_custkey % 9 <> 0").select(c("c_name").alias("table_name"), F.when(c("c_custkey") % 8 != 0, said).alias("comment")))


_COM = "SELECT upper(table_name) AS table_name, upper(column_name) AS column_name, default_text AS x FROM ({})"


@query(f"WITH o AS ({_COM.format(_OLD_CAT)}), n AS ({_COM.format(_NEW_CAT)}) SELECT table_name, column_name, o.x AS old_comment, n.x AS new_comment FROM o JOIN n USING (table_name, column_name) WHERE o.x IS DISTINCT FROM n.x")
def q_schemadiff_column_comments(t):
    return schemadiff.diff_column_comments(*(x.withColumnRenamed("default_text", "comment") for x in _catalogs(t)))


@query("SELECT c_custkey, nullif(CASE c_nationkey % 3 WHEN 0 THEN 'USERS' ELSE c_mktsegment END, 'USERS') AS tablespace, nullif(c_nationkey, 10) AS pct_free, nullif(c_custkey % 3, 1) AS ini_trans, nullif(c_acctbal > 0, true) AS logging, nullif(c_acctbal > 5000, false) AS cache FROM customer")
def q_default_options(t):
    space = F.when(c("c_nationkey") % 3 == 0, "USERS").otherwise(c("c_mktsegment"))
    options = t.customer.select("c_custkey", space.alias("tablespace"), c("c_nationkey").alias("pct_free"), (c("c_custkey") % 3).alias("ini_trans"), (c("c_acctbal") > 0).alias("logging"), (c("c_acctbal") > 5000).alias("cache"))
    return schemadiff.strip_default_options(options)


@query(f"""WITH k AS (SELECT table_name, column_name FROM ({_OLD_CAT})), a AS (SELECT DISTINCT table_name, unnest(['aud_user', 'aud_time']) AS column_name FROM k)
SELECT table_name || '_AT' AS table_name, column_name, table_name AS source_table FROM (SELECT * FROM k UNION ALL SELECT * FROM a)
UNION ALL SELECT table_name || '_HT', column_name, table_name FROM k WHERE CAST(substr(table_name, 2) AS BIGINT) % 5 = 0""")
def q_history_tables(t):
    old = _catalogs(t)[0]
    flags = t.events.select(F.concat(F.lit("u"), c("user_id").cast("string")).alias("table_name"), F.when(c("user_id") % 5 == 0, "Y").otherwise("N").alias("flag"))
    return schemadiff.derived_tables(old, flags)


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'TIMESTAMP' WHEN 1 THEN CASE WHEN p_size = 10 THEN 'INTEGER' ELSE 'NUMBER(' || CAST(p_size AS VARCHAR) || ')' END WHEN 2 THEN CASE WHEN p_size = 10 THEN 'INTEGER' ELSE 'NUMBER(' || CAST(p_size AS VARCHAR) || ')' END ELSE 'NUMBER(12,' || CAST(p_size AS VARCHAR) || ')' END AS kind FROM part")
def q_type_normalise(t):
    size = c("p_size").cast("string")
    raw = fn.case(c("p_size") % 4, [(F.lit(0), F.lit("timestamp(6)")), (F.lit(1), F.concat(F.lit("number("), size, F.lit(")"))), (F.lit(2), F.concat(F.lit("Number( "), size, F.lit(" , 0)")))], F.concat(F.lit("NUMBER(12,"), size, F.lit(")")))
    return t.part.select("p_partkey", schemadiff.normal_type(raw).alias("kind"))


@query(f"WITH o AS (SELECT DISTINCT table_name AS k FROM ({_OLD_CAT})), n AS (SELECT DISTINCT table_name AS k FROM ({_NEW_CAT})) SELECT CASE WHEN n.k IS NULL THEN 'OLD_ONLY' WHEN o.k IS NULL THEN 'NEW_ONLY' ELSE 'BOTH' END AS status, count(*) AS n FROM o FULL JOIN n ON o.k = n.k GROUP BY 1")
def q_inventory_counts(t):
    return joins.status_join(*_catalogs(t), ["table_name"], ("OLD", "NEW")).groupBy("status").agg(F.count("*").alias("n"))


# Statement logs: events are statements about the tables of their users

_LOG = """log AS (SELECT event_id AS pos, CASE event_type WHEN 'signup' THEN 'CreateTable' WHEN 'purchase' THEN 'Insert' WHEN 'click' THEN 'Update' WHEN 'view' THEN 'Select' ELSE CASE WHEN event_id % 3 = 0 THEN 'DropTable' ELSE 'AlterTable' END END AS type,
  'u' || CAST(user_id AS VARCHAR) AS table_name, 'file' || CAST(event_id % 16 AS VARCHAR) AS file, value > 2 AS ok FROM events)"""


def _log(t):
    error = F.when(c("event_id") % 3 == 0, "DropTable").otherwise("AlterTable")
    kind = fn.case(c("event_type"), [(F.lit(k), F.lit(v)) for k, v in (("signup", "CreateTable"), ("purchase", "Insert"), ("click", "Update"), ("view", "Select"))], error)
    return t.events.select(c("event_id").alias("pos"), kind.alias("type"), F.concat(F.lit("u"), c("user_id").cast("string")).alias("table_name"), F.concat(F.lit("file"), (c("event_id") % 16).cast("string")).alias("file"), (c("value") > 2).alias("ok"))


@query(f"WITH {_LOG} SELECT pos, type FROM log WHERE type NOT IN ('Set', 'Prompt', 'Select', 'Commit')")
def q_stmt_filter(t):
    return statements.drop_noise(_log(t)).select("pos", "type")


_DROP = "l AS (SELECT *, max(CASE WHEN type = 'DropTable' THEN pos END) OVER (PARTITION BY table_name) AS d FROM log), o AS (SELECT * FROM l WHERE NOT (type IN ('Insert', 'Update', 'Delete', 'AlterTable', 'CreateIndex') AND coalesce(pos < d, false)))"
_DEDUPE = "m AS (SELECT *, max(CASE WHEN type = 'CreateTable' THEN pos END) OVER (PARTITION BY table_name) AS k FROM {}), q AS (SELECT * FROM m WHERE NOT (type = 'DropTable' AND k IS NOT NULL) AND NOT (type = 'CreateTable' AND pos < k))"


@query(f"WITH {_LOG}, {_DROP} SELECT pos, type FROM o")
def q_stmt_drop_optimize(t):
    return statements.drop_optimize(_log(t)).select("pos", "type")


@query(f"WITH {_LOG}, {_DEDUPE.format('log')} SELECT pos, type FROM q")
def q_stmt_dedupe(t):
    return statements.dedupe(_log(t)).select("pos", "type")


@query(f"WITH {_LOG}, {_DROP}, {_DEDUPE.format('o')} SELECT pos, type, table_name FROM q WHERE type <> 'Select'")
def q_stmt_simplify(t):
    return statements.pipeline(_log(t), "filter,drop-optimize,dedupe,sort").select("pos", "type", "table_name")


@query(f"WITH {_LOG} SELECT pos, type FROM log WHERE type NOT IN ('Insert', 'Update')")
def q_stmt_exclude(t):
    return statements.pipeline(_log(t), "exclude:Insert|Update").select("pos", "type")


_PRIO = "CASE type WHEN 'CreateTable' THEN 0 WHEN 'AlterTable' THEN 4 WHEN 'Insert' THEN 7 WHEN 'Update' THEN 8 WHEN 'DropTable' THEN 13 ELSE 99 END"


@query(f"WITH {_LOG} SELECT pos, type, {_PRIO} AS prio, row_number() OVER (ORDER BY {_PRIO}, pos) AS place FROM log")
def q_priority_sort(t):
    return statements.ranked(_log(t)).select("pos", "type", "prio", "place")


_SYNC = "CASE type WHEN 'DropTable' THEN 0 WHEN 'AlterTable' THEN 2 WHEN 'CreateTable' THEN 3 WHEN 'Insert' THEN 8 ELSE 9 END"


@query(f"WITH {_LOG} SELECT pos, type, {_SYNC} AS prio, row_number() OVER (ORDER BY {_SYNC}, pos) AS place FROM log")
def q_sync_order(t):
    return statements.ranked(_log(t), statements.SYNC_PRIORITY, statements.SYNC_OTHER).select("pos", "type", "prio", "place")


@query(f"WITH {_LOG} SELECT type, table_name, row_number() OVER (PARTITION BY table_name ORDER BY {_PRIO}, pos) AS place, pos FROM log")
def q_stmt_sort(t):
    d = _log(t).withColumn("place", F.row_number().over(Window.partitionBy("table_name").orderBy(statements.priority(c("type")), "pos")).cast("bigint"))
    return d.select("type", "table_name", "place", "pos")


@query(f"WITH {_LOG} SELECT file, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_failed, count(*) AS n_total FROM log GROUP BY ROLLUP (file)")
def q_stmt_summary(t):
    return statements.report(_log(t))


@query(f"WITH {_LOG} SELECT table_name, max(pos) AS pos FROM log WHERE type = 'CreateTable' GROUP BY table_name")
def q_stmt_last_create(t):
    return statements.last_per_table(_log(t)).select("table_name", "pos")


@query("SELECT c_custkey, c_mktsegment AS segment, 'r' || CAST(c_custkey AS VARCHAR) AS note FROM customer")
def q_meta_comments(t):
    text = F.concat(F.lit("Text first\n@SEGMENT: old\n@NOTE: \\\n  r"), c("c_custkey").cast("string"), F.lit("\n@SEGMENT: "), c("c_mktsegment"))
    m = t.customer.select("c_custkey", fn.metadata(text).alias("m"))
    return m.select("c_custkey", c("m")["SEGMENT"].alias("segment"), c("m")["NOTE"].alias("note"))


@query(f"""WITH k AS (SELECT DISTINCT table_name, column_name FROM ({_OLD_CAT})), a AS (SELECT DISTINCT table_name, unnest(['aud_user', 'aud_time']) AS column_name FROM k)
SELECT table_name, string_agg(column_name, ',' ORDER BY p, column_name) AS columns FROM (SELECT table_name, column_name, 0 AS p FROM k WHERE column_name <> 'error' UNION ALL SELECT table_name, column_name, 1 FROM a) GROUP BY table_name""")
def q_audit_columns(t):
    old = _catalogs(t)[0].groupBy("table_name").agg(F.array_sort(F.collect_set("column_name")).alias("cols"))
    return old.select("table_name", F.array_join(F.concat(F.array_except("cols", F.array(F.lit("error"))), F.array(F.lit("aud_time"), F.lit("aud_user"))), ",").alias("columns"))


@query(f"SELECT table_name, column_name, row_number() OVER (PARTITION BY table_name ORDER BY column_name) AS ordinal, upper(column_name[1]) || column_name[2:] || ' Of ' || upper(table_name[1]) || table_name[2:] AS title, CASE WHEN nullable THEN 'N' ELSE 'Y' END AS required FROM ({_OLD_CAT})")
def q_meta_defaults(t):
    d = _catalogs(t)[0]
    return d.select("table_name", "column_name", F.row_number().over(Window.partitionBy("table_name").orderBy("column_name")).cast("bigint").alias("ordinal"), fn.title(F.concat("column_name", F.lit("_OF_"), "table_name")).alias("title"), F.when(c("nullable"), "N").otherwise("Y").alias("required"))


@query("SELECT '(' || c_custkey || ', ''' || c_name || ''', ' || c_nationkey || ', ''' || c_mktsegment || ''')' AS line, 'INSERT INTO customer (c_custkey, c_name, c_nationkey, c_mktsegment) VALUES' AS head, true AS small FROM customer")
def q_insert_batches(t):
    b = sinks.insert_batches(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "customer", ["c_custkey"], 100)
    rows = F.split(F.regexp_extract("statement", r"(?s)^[^\n]*\n(.*);$", 1), ",\n")
    return b.select(F.explode(rows).alias("line"), F.regexp_extract("statement", r"^([^\n]*)\n", 1).alias("head"), ((F.col("n_rows") <= 100) & (F.size(rows) == F.col("n_rows"))).alias("small"))


@query("SELECT 'INSERT INTO supplier (s_suppkey, s_name, s_nationkey, s_acctbal) VALUES' || chr(10) || '(' || s_suppkey || ', ''' || s_name || ''', ' || s_nationkey || ', NULL);' AS statement FROM supplier")
def q_insert_literals(t):
    return sinks.insert_batches(t.supplier.withColumn("s_acctbal", F.lit(None).cast("double")), "supplier", ["s_suppkey"], 1).select("statement")


_PLAN_NEW = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 31 = 0 THEN 'it''s' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 97 <> 0"


@query(f"""WITH new AS ({_PLAN_NEW})
SELECT o.o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'DELETE FROM orders WHERE o_orderkey = ' || o.o_orderkey || ';' ELSE 'UPDATE orders SET o_orderstatus = ''it''''s'' WHERE o_orderkey = ' || o.o_orderkey || ';' END AS statement
FROM orders o LEFT JOIN new n ON o.o_orderkey = n.o_orderkey WHERE n.o_orderkey IS NULL OR n.o_orderstatus <> o.o_orderstatus""")
def q_change_statements(t):
    old = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    new = old.filter("o_orderkey % 97 <> 0").withColumn("o_orderstatus", F.when(c("o_orderkey") % 31 == 0, "it's").otherwise(c("o_orderstatus")))
    return sinks.change_statements(rowdiff.diff(old, new, ["o_orderkey"]), "orders", ["o_orderkey"]).select("o_orderkey", "statement")


@query("""SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS json FROM orders""")
def q_json_rows(t):
    return sinks.json_rows(t.orders.select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("nothing")))


@query("SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10")
def q_shipping_priority(t):
    j = t.customer.filter("c_mktsegment = 'BUILDING'").join(t.orders.filter("o_orderdate < DATE '1998-03-15'"), c("c_custkey") == c("o_custkey")).join(t.lineitem, c("l_orderkey") == c("o_orderkey"))
    g = j.groupBy("o_orderkey", "o_orderdate").agg(money(F.sum(c("l_extendedprice") * (1 - c("l_discount")))).alias("revenue"))
    return g.orderBy(F.desc("revenue"), "o_orderkey").limit(10).select("o_orderkey", "revenue", "o_orderdate")


_INV = """SELECT '{k}' AS kind, CASE WHEN n.k IS NULL THEN 'OLD_ONLY' WHEN o.k IS NULL THEN 'NEW_ONLY' ELSE 'BOTH' END AS status, count(*) AS n FROM (SELECT DISTINCT {c} AS k FROM ({o})) o FULL JOIN (SELECT DISTINCT {c} AS k FROM ({n})) n ON o.k = n.k GROUP BY ALL"""


@query(
    " UNION ALL ".join(
        _INV.format(k=k, c=key, o=o, n=n)
        for k, key, o, n in (
            ("TABLE", "table_name", _OLD_CAT, _NEW_CAT),
            ("COLUMN", "table_name || '.' || column_name", _OLD_CAT, _NEW_CAT),
            ("CONSTRAINT", "table_name || '.' || kind || '.' || coalesce(name, '')", _CON.format("event_id % 3 <> 0"), _CON.format("event_id % 3 <> 1")),
            ("INDEX", "l_suppkey || '.' || l_linenumber", "SELECT * FROM lineitem", "SELECT * FROM lineitem WHERE l_suppkey % 5 <> 0"),
        )
    )
)
def q_inventory_all(t):
    tables = [d.select(c("table_name").alias("k")) for d in _catalogs(t)]
    columns = [d.select(F.concat_ws(".", "table_name", "column_name").alias("k")) for d in _catalogs(t)]
    constraints = [_constraints(t, f"event_id % 3 <> {i}").select(F.concat_ws(".", "table_name", "kind", F.coalesce("name", F.lit(""))).alias("k")) for i in (0, 1)]
    indexes = [d.select(F.concat_ws(".", "l_suppkey", "l_linenumber").alias("k")) for d in (t.lineitem, t.lineitem.filter("l_suppkey % 5 <> 0"))]
    parts = (("TABLE", tables), ("COLUMN", columns), ("CONSTRAINT", constraints), ("INDEX", indexes))
    return reduce(DataFrame.unionByName, (joins.status_join(*two, ["k"], ("OLD", "NEW")).groupBy("status").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "status", "n") for kind, two in parts))


from granary.plans import large  # noqa: E402, F401  registers its queries
