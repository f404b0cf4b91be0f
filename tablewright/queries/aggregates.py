"""Aggregation queries (A1-A20) over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tablewright.functions.tsql import temporal_as_text
from tablewright.operators import aggregates as A
from tablewright.registry import query
from tablewright.sources.tables import Tables

TS = "%Y-%m-%d %H:%M:%S.%f"


@query("group_count", sql="""
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, user_id,
       CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS k_bucket, value >= 50 AS high, count(*) AS n
FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY
GROUP BY ALL
""")
def group_count(spark, d):
    e = Tables(spark, d).events
    last = e.agg(F.max("ts")).scalar()                     # scalar subquery
    recent = e.where(F.col("ts") >= last - F.expr("INTERVAL 7 DAYS"))
    g = recent.groupBy(F.to_date("ts").alias("day"), "event_type", "user_id",
                       F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("int").alias("k_bucket"),
                       (F.col("value") >= 50).alias("high")).agg(F.count(F.lit(1)).alias("n"))
    return temporal_as_text(g.orderBy(F.col("n").desc()))


@query("global_agg", sql="""
SELECT count(*) AS n_lines, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
       CAST(sum(l_linenumber) AS BIGINT) AS sum_lines
FROM lineitem
""")
def global_agg(spark, d):
    li = Tables(spark, d).lineitem
    return li.agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
                  F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.sum("l_linenumber").alias("sum_lines"))


@query("count_distinct", sql="""
SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_customers, count(*) AS n_orders FROM orders
GROUP BY o_orderpriority HAVING count(DISTINCT o_custkey) > 100
""")
def count_distinct(spark, d):
    o = Tables(spark, d).orders
    g = o.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n_customers"),
                                         F.count(F.lit(1)).alias("n_orders"))
    return g.where(F.col("n_customers") > 100)


@query("having", sql="""
SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S.%f') AS last_order
FROM orders GROUP BY o_custkey
HAVING sum(o_totalprice) > 3000000 AND count(*) >= 10 AND max(o_orderdate) >= TIMESTAMP '2000-01-01'
""")
def having(spark, d):
    o = Tables(spark, d).orders
    g = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("_t"),
                                   F.max("o_orderdate").alias("last_order"))
    g = g.where((F.col("_t") > 3000000) & (F.col("n") >= 10) &
                (F.col("last_order") >= F.lit("2000-01-01").cast("timestamp_ntz")))
    return temporal_as_text(g.select("o_custkey", "n", F.round("_t", 2).alias("total"), "last_order"))


@query("ordered_string_agg", sql="""
SELECT o_custkey, string_agg(o_orderpriority, ', ' ORDER BY o_orderpriority DESC) AS priorities
FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY o_custkey
""")
def ordered_string_agg(spark, d):
    # distinct first: each customer's list is bounded by the number of priorities
    o = Tables(spark, d).orders.select("o_custkey", "o_orderpriority").distinct()
    return o.groupBy("o_custkey").agg(A.ordered_list("o_orderpriority", ["o_orderpriority"], ", ", [True]).alias("priorities"))


@query("conditional_sum", sql="""
SELECT l_linestatus,
       round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS returned_value,
       round(sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END), 2) AS kept_value,
       CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS discounted_lines
FROM lineitem GROUP BY l_linestatus
""")
def conditional_sum(spark, d):
    li = Tables(spark, d).lineitem
    return li.groupBy("l_linestatus").agg(
        F.round(A.conditional_sum(F.col("l_returnflag") == "R", "l_extendedprice"), 2).alias("returned_value"),
        F.round(A.conditional_sum(F.col("l_returnflag") != "R", "l_extendedprice"), 2).alias("kept_value"),
        A.conditional_sum(F.col("l_discount") > 0.05, F.lit(1)).cast("bigint").alias("discounted_lines"))


EVENT_TYPES = ["view", "click", "signup", "purchase", "error"]


@query("pivot_max", sql="""
SELECT user_id,
  max(CASE WHEN event_type = 'view' THEN value END) AS "view",
  max(CASE WHEN event_type = 'click' THEN value END) AS "click",
  max(CASE WHEN event_type = 'signup' THEN value END) AS "signup",
  max(CASE WHEN event_type = 'purchase' THEN value END) AS "purchase",
  max(CASE WHEN event_type = 'error' THEN value END) AS "error"
FROM events GROUP BY user_id
""")
def pivot_max(spark, d):
    return A.pivot_max(Tables(spark, d).events, ["user_id"], "event_type", EVENT_TYPES, "value")


@query("unpivot", sql="""
SELECT s_suppkey, 'acctbal' AS name, s_acctbal AS value FROM supplier
UNION ALL SELECT s_suppkey, 'nationkey', CAST(s_nationkey AS DOUBLE) FROM supplier
""")
def unpivot(spark, d):
    s = Tables(spark, d).supplier.select("s_suppkey", F.col("s_acctbal").alias("acctbal"),
                                         F.col("s_nationkey").cast("double").alias("nationkey"))
    return A.unpivot(s, ["s_suppkey"], ["acctbal", "nationkey"], "name", "value")


@query("two_level_agg", sql="""
WITH t1 AS (SELECT p_type, p_size, p_brand || '(' || CAST(count(*) AS VARCHAR) || ')' AS label, count(*) AS occurs
            FROM part GROUP BY p_type, p_size, p_brand)
SELECT p_type, p_size, CAST(sum(occurs) AS BIGINT) AS occurs,
       string_agg(label, ', ' ORDER BY occurs DESC, label) AS examples
FROM t1 GROUP BY p_type, p_size HAVING sum(occurs) > 3
""")
def two_level_agg(spark, d):
    return A.two_level_list(Tables(spark, d).part, ["p_type", "p_size"], "p_brand", more_than=3)


@query("case_over_aggs", sql="""
SELECT o_custkey,
  CASE WHEN count(*) = 2 AND min(o_orderstatus) = 'F' THEN '( two orders, one final )'
       WHEN count(*) = 2 THEN '( two orders, none final )'
       WHEN count(*) = 1 AND min(o_orderstatus) = 'O' THEN '( one open order )'
       WHEN count(*) = 1 THEN '( one order )' END AS order_class,
  CASE WHEN count(*) = 1 THEN CAST(min(o_orderkey) AS VARCHAR)
       ELSE format('( {:d} orders )', count(*)) END AS key_text
FROM orders GROUP BY o_custkey
""")
def case_over_aggs(spark, d):
    o = Tables(spark, d).orders
    n, st = F.count(F.lit(1)), F.min("o_orderstatus")
    cls = (F.when((n == 2) & (st == "F"), "( two orders, one final )")
           .when(n == 2, "( two orders, none final )")
           .when((n == 1) & (st == "O"), "( one open order )")
           .when(n == 1, "( one order )"))
    key_text = F.when(n == 1, F.min("o_orderkey").cast("string")).otherwise(F.format_string("( %d orders )", n))
    return o.groupBy("o_custkey").agg(cls.alias("order_class"), key_text.alias("key_text"))


@query("any_flag", sql="""
SELECT p_partkey, CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 0 THEN 'never returned' ELSE 'returned' END AS flag
FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey
""")
def any_flag(spark, d):
    t = Tables(spark, d)
    j = t.lineitem.select("l_partkey", "l_returnflag")
    g = j.groupBy(F.col("l_partkey").alias("p_partkey")).agg(A.any_flag(F.col("l_returnflag") == "R").alias("_f"))
    g = g.join(t.part.select("p_partkey"), "p_partkey", "left_semi")
    return g.select("p_partkey", F.when(F.col("_f") == 0, "never returned").otherwise("returned").alias("flag"))


@query("singleton_groups", sql="""
SELECT o_custkey, year(o_orderdate) AS yr, max(o_orderkey) AS o_orderkey FROM orders
GROUP BY o_custkey, year(o_orderdate) HAVING count(*) = 1
""")
def singleton_groups(spark, d):
    o = Tables(spark, d).orders.select("o_custkey", F.year("o_orderdate").cast("bigint").alias("yr"), "o_orderkey")
    return A.singleton_groups(o, ["o_custkey", "yr"], "o_orderkey")


@query("duplicate_rows", sql="""
SELECT o.o_orderkey, o.o_custkey, strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate FROM orders o
JOIN (SELECT o_custkey, o_orderdate FROM orders GROUP BY ALL HAVING count(*) > 1) x USING (o_custkey, o_orderdate)
""")
def duplicate_rows(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return temporal_as_text(A.duplicate_rows(o, ["o_custkey", "o_orderdate"]))


@query("cardinality_factor", sql="""
SELECT 'l_returnflag' AS column_name, CAST(count(*) // (count(DISTINCT l_returnflag) + max(CASE WHEN l_returnflag IS NULL THEN 1 ELSE 0 END)) AS BIGINT) AS factor FROM lineitem
UNION ALL SELECT 'l_quantity', CAST(count(*) // (count(DISTINCT l_quantity) + max(CASE WHEN l_quantity IS NULL THEN 1 ELSE 0 END)) AS BIGINT) FROM lineitem
UNION ALL SELECT 'l_suppkey', CAST(count(*) // (count(DISTINCT l_suppkey) + max(CASE WHEN l_suppkey IS NULL THEN 1 ELSE 0 END)) AS BIGINT) FROM lineitem
UNION ALL SELECT 'l_orderkey', CAST(count(*) // (count(DISTINCT l_orderkey) + max(CASE WHEN l_orderkey IS NULL THEN 1 ELSE 0 END)) AS BIGINT) FROM lineitem
""")
def cardinality_factor(spark, d):
    li = Tables(spark, d).lineitem
    return A.cardinality_factor(li, ["l_returnflag", "l_quantity", "l_suppkey", "l_orderkey"])


@query("minmax_many", sql="""
SELECT strftime(least((SELECT min(o_orderdate) FROM orders), (SELECT min(l_shipdate) FROM lineitem)), '%Y-%m-%d') AS min_value,
       strftime(greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)), '%Y-%m-%d') AS max_value
""")
def minmax_many(spark, d):
    t = Tables(spark, d)
    o = t.orders.agg(F.struct(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))).scalar()
    li = t.lineitem.agg(F.struct(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))).scalar()
    return spark.range(1).select(F.date_format(F.least(o["lo"], li["lo"]), "yyyy-MM-dd").alias("min_value"),
                                 F.date_format(F.greatest(o["hi"], li["hi"]), "yyyy-MM-dd").alias("max_value"))


@query("share_of_total", sql="""
WITH g AS (SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)
SELECT n_name, round(revenue, 2) AS revenue, round(revenue * 100.0 / (SELECT sum(revenue) FROM g), 1) AS pct FROM g
ORDER BY revenue DESC LIMIT 10
""")
def share_of_total(spark, d):
    t = Tables(spark, d)
    j = (t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
         .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")))
    s = A.share_of_total(j, ["n_name"], F.col("l_extendedprice") * (1 - F.col("l_discount")), "revenue")
    return s.orderBy(F.col("revenue").desc()).limit(10).select("n_name", F.round("revenue", 2).alias("revenue"), "pct")


@query("group_subtotals", sql="""
WITH g AS (SELECT n_name, c_custkey, sum(c_acctbal) AS acctbal, grouping(n_name, c_custkey) AS g
           FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_name, c_custkey), (n_name), ()))
SELECT row_number() OVER (ORDER BY n_name NULLS LAST, c_custkey NULLS FIRST) AS place, CASE g WHEN 0 THEN 'detail' WHEN 1 THEN 'group' ELSE 'total' END AS level,
       n_name, CAST(c_custkey AS VARCHAR) AS c_custkey, round(acctbal, 2) AS acctbal
FROM g
""")
def group_subtotals(spark, d):
    t = Tables(spark, d)
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    g = A.group_subtotals(j, ["n_name"], ["c_custkey"], "c_acctbal", "acctbal")
    return g.select("place", "level", "n_name", F.col("c_custkey").cast("string").alias("c_custkey"), F.round("acctbal", 2).alias("acctbal"))


@query("top_with_other", sql="""
WITH g AS (SELECT s_name AS slice, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name),
     t AS (SELECT sum(v) AS total FROM g),
     f AS (SELECT CASE WHEN v > total * 0.01 THEN slice ELSE '(other)' END AS slice, sum(v) AS v FROM g, t GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY v DESC, slice) AS VARCHAR) AS rank, slice, round(v / 1000.0, 1) AS size FROM f
""")
def top_with_other(spark, d):
    t = Tables(spark, d)
    j = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("slice"), "l_extendedprice")
    return A.top_with_other(j, "slice", "l_extendedprice", 0.01, scale=1 / 1000.0)


def _top_sql(metric: str, item: str, value: str, rel: str) -> str:
    return f"(SELECT '{metric}' AS metric, CAST({item} AS VARCHAR) AS item, CAST({value} AS DOUBLE) AS value FROM {rel} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)"


def _total_sql(metric: str, value: str, rel: str) -> str:
    return f"SELECT '{metric}' AS metric, '' AS item, CAST({value} AS DOUBLE) AS value FROM {rel}"


REVENUE = "l_extendedprice * (1 - l_discount)"


@query("stats_long", sql="SELECT metric, item, round(value, 2) AS value FROM (" + " UNION ALL ".join([
    _total_sql("customers", "count(*)", "customer"), _total_sql("customers in debt", "count(*) FILTER (c_acctbal < 0)", "customer"),
    _top_sql("nation with the most customers", "c_nationkey", "count(*)", "customer"), _top_sql("segment with the highest balance", "c_mktsegment", "sum(c_acctbal)", "customer"),
    _total_sql("orders", "count(*)", "orders"), _total_sql("orders over 400000", "count(*) FILTER (o_totalprice > 400000)", "orders"),
    _top_sql("largest order", "o_orderkey", "sum(o_totalprice)", "orders"), _top_sql("customer with the most orders", "o_custkey", "count(*)", "orders"),
    _top_sql("customer with the most spent", "o_custkey", "sum(o_totalprice)", "orders"),
    _total_sql("order lines", "count(*)", "lineitem"), _total_sql("revenue", f"sum({REVENUE})", "lineitem"),
    _top_sql("supplier with the most revenue", "l_suppkey", f"sum({REVENUE})", "lineitem"), _top_sql("part sold most", "l_partkey", "sum(l_quantity)", "lineitem"),
    _total_sql("events", "count(*)", "events"), _top_sql("busiest day", "strftime(CAST(ts AS DATE), '%Y-%m-%d')", "count(*)", "events"),
    _total_sql("thousand letters of text", "round(sum(length(text)) / 1000.0, 0)", "documents"),
    _top_sql("language with the most text", "lang", "sum(length(text))", "documents"), _top_sql("source with the most documents", "source", "count(*)", "documents"),
]) + ")")
def stats_long(spark, d):
    """18 metrics of five tables, each table read once."""
    t = Tables(spark, d)
    n, revenue = F.count(F.lit(1)), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    letters = F.sum(F.length("text"))
    parts = [
        A.stats_of(t.customer, {"customers": n, "customers in debt": F.count(F.when(F.col("c_acctbal") < 0, 1))},
                   {"nation with the most customers": (F.col("c_nationkey"), n), "segment with the highest balance": (F.col("c_mktsegment"), F.sum("c_acctbal"))}),
        A.stats_of(t.orders, {"orders": n, "orders over 400000": F.count(F.when(F.col("o_totalprice") > 400000, 1))},
                   {"largest order": (F.col("o_orderkey"), F.sum("o_totalprice")), "customer with the most orders": (F.col("o_custkey"), n),
                    "customer with the most spent": (F.col("o_custkey"), F.sum("o_totalprice"))}),
        A.stats_of(t.lineitem, {"order lines": n, "revenue": F.sum(revenue)},
                   {"supplier with the most revenue": (F.col("l_suppkey"), F.sum(revenue)), "part sold most": (F.col("l_partkey"), F.sum("l_quantity"))}),
        A.stats_of(t.events, {"events": n}, {"busiest day": (F.date_format(F.to_date("ts"), "yyyy-MM-dd"), n)}),
        A.stats_of(t.documents, {"thousand letters of text": F.round(letters / 1000.0, 0)},
                   {"language with the most text": (F.col("lang"), letters), "source with the most documents": (F.col("source"), n)})]
    return reduce(lambda a, b: a.unionByName(b), parts).select("metric", "item", F.round("value", 2).alias("value"))
