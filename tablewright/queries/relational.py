"""Relational core over the test tables: scans, predicates, joins, set ops, windows, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.tsql import temporal_as_text
from tablewright.operators import filters as P
from tablewright.operators import joins as J
from tablewright.operators import windows as W
from tablewright.operators.numbering import number_rows
from tablewright.registry import query
from tablewright.sources.tables import Tables, scan, tagged_file_scan, tagged_union
from tablewright.sources.generators import letter_code, spine_for

TS = "%Y-%m-%d %H:%M:%S.%f"

# ---------------------------------------------------------------- C14 latest row


@query("latest_row_row_number", sql=f"""
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '{TS}') AS o_orderdate, o_orderpriority
FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def latest_row_row_number(spark, d):
    o = Tables(spark, d).orders
    return temporal_as_text(W.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]))


@query("latest_row_max_join", sql=f"""
SELECT o.o_custkey, o.o_orderkey, strftime(o.o_orderdate, '{TS}') AS o_orderdate
FROM orders o JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY o_custkey) x
  ON o.o_custkey = x.o_custkey AND o.o_orderdate = x.m
""")
def latest_row_max_join(spark, d):
    o = Tables(spark, d).orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return temporal_as_text(W.latest(o, ["o_custkey"], ["o_orderdate"], ties=True))


# ---------------------------------------------------------------- S: scans, sources


@query("scan_filter_project", sql=f"""
SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '{TS}') AS o_orderdate
FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1998-01-01'
""")
def scan_filter_project(spark, d):
    df = scan(spark, Tables(spark, d).path("orders"),
              where=(F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")),
              columns=["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"],
              order=[F.col("o_orderdate").desc(), "o_orderkey"])
    return temporal_as_text(df)


EVENT_LABELS = [("view", "Page view", 1), ("click", "Click", 2), ("signup", "Sign-up", 3),
                ("purchase", "Purchase", 4), ("error", "Error", 5)]


@query("inline_values", sql="""
SELECT v.label, v.sort_key, count(*) AS n
FROM events e JOIN (VALUES ('view','Page view',1),('click','Click',2),('signup','Sign-up',3),
                           ('purchase','Purchase',4),('error','Error',5)) v(event_type, label, sort_key)
  ON e.event_type = v.event_type
GROUP BY v.label, v.sort_key
""")
def inline_values(spark, d):
    labels = J.values_df(spark, EVENT_LABELS, "event_type string, label string, sort_key int")
    return (Tables(spark, d).events.join(labels, "event_type")
            .groupBy("label", "sort_key").agg(F.count(F.lit(1)).alias("n")))


@query("tagged_union_scan", sql="""
SELECT 'customer' AS source, c_custkey AS id, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer
UNION ALL
SELECT 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
""")
def tagged_union_scan(spark, d):
    t = Tables(spark, d)
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                          F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"))
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                          F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return tagged_union({"customer": c, "supplier": s}).select("source", "id", "name", "nationkey", "acctbal")


@query("event_log_scan", sql=f"""
SELECT event_id, strftime(ts, '{TS}') AS ts, user_id,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'events.parquet' AS source_file
FROM events WHERE event_type = 'error'
""")
def event_log_scan(spark, d):
    df = tagged_file_scan(spark, [f"{d.rstrip('/')}/events*.parquet"])
    df = df.where(F.col("event_type") == "error").select(
        "event_id", "ts", "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"), "source_file")
    return temporal_as_text(df)


@query("number_spine", sql="""
SELECT s.n AS p_size, count(p.p_partkey) AS n_parts
FROM range((SELECT min(p_size) FROM part), (SELECT max(p_size) FROM part) + 1) s(n)
LEFT JOIN part p ON p.p_size = s.n
GROUP BY s.n
""")
def number_spine(spark, d):
    part = Tables(spark, d).part
    spine = spine_for(part, "p_size", "p_size")
    counts = part.groupBy("p_size").agg(F.count(F.lit(1)).alias("n_parts"))
    return (spine.join(counts, "p_size", "left")
            .select(F.col("p_size").cast("bigint").alias("p_size"),
                    F.coalesce("n_parts", F.lit(0)).alias("n_parts")))


@query("letter_codes", sql="""
SELECT n_nationkey, n_name, chr(65 + n_nationkey // 26) || chr(65 + n_nationkey % 26) AS code FROM nation
""")
def letter_codes(spark, d):
    n = Tables(spark, d).nation
    return n.select("n_nationkey", "n_name", letter_code("n_nationkey").alias("code"))


# ---------------------------------------------------------------- P: predicates


@query("case_ladder", sql="""
SELECT o_orderkey,
       CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'partial' END AS status_label,
       CASE WHEN o_totalprice >= 300000 THEN 'REBUILD' WHEN o_totalprice >= 100000 THEN 'REORGANIZE' ELSE 'NONE' END AS action
FROM orders
""")
def case_ladder(spark, d):
    o = Tables(spark, d).orders
    return o.select(
        "o_orderkey",
        P.simple_case("o_orderstatus", {"F": "final", "O": "open"}, "partial").alias("status_label"),
        P.case_ladder([(F.col("o_totalprice") >= 300000, "REBUILD"),
                       (F.col("o_totalprice") >= 100000, "REORGANIZE")], "NONE").alias("action"))


LIKE_SOUGHT = "ent."


@query("like_escaped", sql="""
SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'ent.')
""")
def like_escaped(spark, d):
    docs = Tables(spark, d).documents
    return docs.where(P.contains_text("text", LIKE_SOUGHT)).select("doc_id", "lang")


@query("exclusion_lists", sql="""
SELECT p_partkey, p_brand, p_type FROM part
WHERE p_type NOT LIKE '%PROMO%' AND p_type NOT LIKE 'SMALL%' AND p_brand NOT IN ('Brand#11', 'Brand#22', 'Brand#3')
""")
def exclusion_lists(spark, d):
    p = Tables(spark, d).part.select("p_partkey", "p_brand", "p_type")
    p = P.exclude(p, "p_type", not_like=["%PROMO%", "SMALL%"])
    return P.exclude(p, "p_brand", not_in=["Brand#11", "Brand#22", "Brand#3"])


def _event_objects(events):
    """Objects = (user, event type) with first/last time; a type's parent is the user's signup object."""
    o = events.groupBy("user_id", "event_type").agg(F.min("ts").alias("create_date"), F.max("ts").alias("modify_date"))
    return o.select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("object_id"),
        F.when(F.col("event_type") != "signup",
               F.concat(F.col("user_id").cast("string"), F.lit(":signup"))).alias("parent_id"),
        F.concat(F.col("event_type"), F.lit("#"), F.col("user_id").cast("string")).alias("name"),
        "create_date", "modify_date")


@query("recent_changes", sql=f"""
WITH o AS (
  SELECT concat_ws(':', CAST(user_id AS VARCHAR), event_type) AS object_id,
         CASE WHEN event_type <> 'signup' THEN CAST(user_id AS VARCHAR) || ':signup' END AS parent_id,
         event_type || '#' || CAST(user_id AS VARCHAR) AS name,
         min(ts) AS create_date, max(ts) AS modify_date
  FROM events GROUP BY user_id, event_type)
SELECT coalesce(p.name, o.name) AS parent, o.name,
       strftime(o.modify_date, '{TS}') AS modify_date,
       CASE WHEN o.create_date = o.modify_date THEN 'new' ELSE 'changed' END AS new,
       CASE WHEN p.name IS NULL THEN 0 ELSE 1 END AS is_child
FROM o LEFT JOIN o p ON o.parent_id = p.object_id
WHERE o.modify_date > (SELECT max(modify_date) FROM o) - INTERVAL 600 MINUTE
""")
def recent_changes(spark, d):
    objs = _event_objects(Tables(spark, d).events)
    out = P.recent_changes(objs, "object_id", "parent_id", "name", "create_date", "modify_date", 600)
    return temporal_as_text(out.orderBy("parent", "is_child", "name"))


@query("interval_overlap", sql=f"""
WITH s AS (SELECT user_id, min(ts) AS s_start, max(ts) AS s_end FROM events
           GROUP BY user_id, date_trunc('day', ts))
SELECT user_id, strftime(s_start, '{TS}') AS s_start, strftime(s_end, '{TS}') AS s_end FROM s
WHERE s_end > TIMESTAMP '2024-01-10 06:00:00' - INTERVAL 4 HOUR
  AND s_start < TIMESTAMP '2024-01-10 06:00:00' - INTERVAL 4 HOUR + INTERVAL 5 HOUR
""")
def interval_overlap(spark, d):
    e = Tables(spark, d).events
    sessions = e.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(
        F.min("ts").alias("s_start"), F.max("ts").alias("s_end"))
    test_start = F.lit("2024-01-10 06:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 4 HOURS")  # UTC offset 4
    test_end = test_start + F.expr("INTERVAL 5 HOURS")
    out = sessions.where(P.overlaps("s_start", "s_end", test_start, test_end))
    return temporal_as_text(out.select("user_id", "s_start", "s_end"))


@query("null_safe_diff", sql="""
WITH a AS (SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS pr, o_totalprice FROM orders),
     b AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
                  nullif(o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN '1-URGENT' ELSE '5-LOW' END) AS pr,
                  o_totalprice FROM orders)
SELECT a.o_orderkey FROM a JOIN b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.pr IS DISTINCT FROM b.pr
   OR a.o_totalprice IS DISTINCT FROM b.o_totalprice
""")
def null_safe_diff(spark, d):
    o = Tables(spark, d).orders
    a = o.select("o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("pr"), "o_totalprice")
    b = o.select("o_orderkey",
                 F.when(F.col("o_orderpriority") == "2-HIGH", "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
                 F.nullif("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "1-URGENT").otherwise("5-LOW")).alias("pr"),
                 "o_totalprice")
    j = a.alias("a").join(b.alias("b"), "o_orderkey")
    return j.where(P.any_differs([("a.o_orderstatus", "b.o_orderstatus"), ("a.pr", "b.pr"),
                                  ("a.o_totalprice", "b.o_totalprice")])).select("o_orderkey")


@query("chain_participants", sql="""
WITH r AS (
  SELECT e.event_id, e.user_id, e.event_type, e.value,
         CASE WHEN e.event_type = 'error' AND p.user_id <> e.user_id THEN p.event_id ELSE 0 END AS blocked_by
  FROM events e LEFT JOIN events p ON p.event_id = e.event_id - 1),
l AS (SELECT user_id AS uid, count(*) AS locks FROM events WHERE event_type = 'purchase' AND value > 45 GROUP BY user_id)
SELECT r.event_id, r.user_id, r.blocked_by, l.locks FROM r LEFT JOIN l ON r.user_id = l.uid
WHERE r.blocked_by <> 0
   OR r.event_id IN (SELECT blocked_by FROM r WHERE blocked_by <> 0)
   OR (l.locks IS NOT NULL AND (l.locks > 1 OR (l.locks = 1 AND (r.event_type <> 'view' OR r.value > 10))))
""")
def chain_participants(spark, d):
    e = Tables(spark, d).events
    prev = e.select(F.col("event_id").alias("p_id"), F.col("user_id").alias("p_user"))
    rows = (e.join(prev, F.col("p_id") == F.col("event_id") - 1, "left")
             .select("event_id", "user_id", "event_type", "value",
                     F.when((F.col("event_type") == "error") & (F.col("p_user") != F.col("user_id")), F.col("p_id"))
                      .otherwise(F.lit(0)).alias("blocked_by")))
    detail = e.where((F.col("event_type") == "purchase") & (F.col("value") > 45)).select(F.col("user_id").alias("uid"))
    out = P.chain_participants(rows, "event_id", "blocked_by", detail, "uid", "user_id",
                               extra=(F.col("event_type") != "view") | (F.col("value") > 10))
    return out.select("event_id", "user_id", "blocked_by", "locks")


@query("length_class", sql="""
SELECT doc_id, CASE WHEN n_chars BETWEEN 0 AND 99 THEN 'tiny' WHEN n_chars BETWEEN 100 AND 999 THEN 'short'
                    WHEN n_chars BETWEEN 1000 AND 9999 THEN 'medium' ELSE 'long' END AS length_class
FROM documents
""")
def length_class(spark, d):
    docs = Tables(spark, d).documents
    return docs.select("doc_id", P.length_class("n_chars", [(0, 99, "tiny"), (100, 999, "short"),
                                                           (1000, 9999, "medium")], "long").alias("length_class"))


@query("property_lookup", sql="""
SELECT s_suppkey, CAST(s_acctbal AS VARCHAR) AS value FROM supplier
""")
def property_lookup(spark, d):
    s = Tables(spark, d).supplier
    return P.property_lookup(s, ["s_suppkey"], "S_ACCTBAL")


@query("regex_clean", sql="""
SELECT page_id, CASE WHEN regexp_matches(url, '^https://') THEN regexp_replace(url, '[?#].*$', '') ELSE url END AS clean_url
FROM pages
""")
def regex_clean(spark, d):
    p = Tables(spark, d).pages
    return p.select("page_id", P.regex_clean("url", r"[?#].*$", guard=r"^https://").alias("clean_url"))


@query("distinct_project", sql="SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_project(spark, d):
    return Tables(spark, d).orders.select("o_orderstatus", "o_orderpriority").distinct()


# ---------------------------------------------------------------- J: joins


@query("join_inner", sql="""
SELECT o.o_orderkey, c.c_name, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""")
def join_inner(spark, d):
    t = Tables(spark, d)
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("join_multikey", sql="""
SELECT l.l_orderkey, l.l_linenumber, s.s_name, n.n_name
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_nationkey = s.s_nationkey
""")
def join_multikey(spark, d):
    t = Tables(spark, d)
    lo = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ls = lo.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    out = ls.join(t.customer, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return out.select("l_orderkey", "l_linenumber", "s_name", "n_name")


@query("join_left_chain", sql="""
SELECT c.c_custkey, coalesce(n.n_name, r.r_name, 'unknown') AS place, r.r_name
FROM customer c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey <> 2
LEFT JOIN region r ON r.r_regionkey = c.c_nationkey % 5
""")
def join_left_chain(spark, d):
    t = Tables(spark, d)
    n = t.nation.where(F.col("n_regionkey") != 2)
    j = (t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
         .join(t.region, F.col("r_regionkey") == F.col("c_nationkey") % 5, "left"))
    return j.select("c_custkey", F.coalesce("n_name", "r_name", F.lit("unknown")).alias("place"), "r_name")


def _left_join_tables(t):
    """Nations, their suppliers, and customers tied to a supplier number (four per nation number)."""
    a = t.nation.select("n_nationkey")
    b = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    c = t.customer.select("c_custkey", (F.col("c_nationkey") * 4).cast("bigint").alias("s_suppkey"))
    return a, b, c


def _ids_as_text(df):
    """Outer-joined ids may be NULL: shown as text so both engines render them alike."""
    return df.select("n_nationkey", F.col("s_suppkey").cast("string").alias("s_suppkey"), F.col("c_custkey").cast("string").alias("c_custkey"))


LJ_SQL = "SELECT n_nationkey, CAST(s_suppkey AS VARCHAR) AS s_suppkey, CAST(c_custkey AS VARCHAR) AS c_custkey FROM nation "


@query("left_join_semantics_1", sql=LJ_SQL + """
LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON s_suppkey = c_nationkey * 4""")
def left_join_semantics_1(spark, d):
    a, b, c = _left_join_tables(Tables(spark, d))
    return _ids_as_text(a.join(b, "n_nationkey", "left").join(c, "s_suppkey", "left"))


@query("left_join_semantics_2", sql=LJ_SQL + """
LEFT JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON s_suppkey = c_nationkey * 4""")
def left_join_semantics_2(spark, d):
    a, b, c = _left_join_tables(Tables(spark, d))
    # inner join on the left-joined side's key collapses the outer join to inner
    return _ids_as_text(a.join(b, "n_nationkey", "left").join(c, "s_suppkey", "inner"))


@query("left_join_semantics_3", sql=LJ_SQL + """
LEFT JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON n_nationkey = c_nationkey * 4""")
def left_join_semantics_3(spark, d):
    a, b, c = _left_join_tables(Tables(spark, d))
    # a nation has many suppliers and many customers: all pairs of them
    return _ids_as_text(J.spread_join(a.join(b, "n_nationkey", "left"), c.withColumnRenamed("s_suppkey", "c_number"), "n_nationkey", "c_number"))


@query("left_join_semantics_4", sql=LJ_SQL + """
LEFT JOIN (supplier JOIN customer ON s_suppkey = c_nationkey * 4) ON s_nationkey = n_nationkey""")
def left_join_semantics_4(spark, d):
    a, b, c = _left_join_tables(Tables(spark, d))
    inner = b.join(c, "s_suppkey")
    return _ids_as_text(a.join(inner, "n_nationkey", "left"))


@query("join_full_outer", sql="""
WITH l AS (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'),
     r AS (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey,
       CASE WHEN l.o_orderkey IS NULL THEN 'only in right' WHEN r.o_orderkey IS NULL THEN 'only in left'
            ELSE 'in both' END AS status,
       coalesce(l.o_totalprice, r.o_totalprice) AS o_totalprice
FROM l FULL OUTER JOIN r ON l.o_orderkey = r.o_orderkey
""")
def join_full_outer(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_totalprice", "o_orderpriority")
    left = o.where(F.col("o_orderpriority") != "1-URGENT").drop("o_orderpriority")
    right = o.where(F.col("o_orderpriority") != "5-LOW").drop("o_orderpriority")
    j = J.full_outer_status(left, right, ["o_orderkey"])
    return j.select("o_orderkey", "status", F.coalesce("l_o_totalprice", "r_o_totalprice").alias("o_totalprice"))


@query("join_left_anti", sql="""
SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def join_left_anti(spark, d):
    t = Tables(spark, d)
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("join_left_semi", sql="""
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
""")
def join_left_semi(spark, d):
    t = Tables(spark, d)
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("join_cross", sql="""
SELECT r.r_name, n.n_name, CASE WHEN n.n_regionkey = r.r_regionkey THEN 1 ELSE 0 END AS home
FROM region r CROSS JOIN nation n
""")
def join_cross(spark, d):
    t = Tables(spark, d)
    # J8 is the cross join itself; it pairs the 5 regions with the 25 nations — sizes the
    # schema fixes at every scale (125 rows), so it is the one Cartesian product kept
    return (F.broadcast(t.region).crossJoin(t.nation)
            .select("r_name", "n_name", (F.col("n_regionkey") == F.col("r_regionkey")).cast("int").alias("home")))


@query("join_self_theta", sql="""
SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
""")
def join_self_theta(spark, d):
    n = Tables(spark, d).nation
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))) \
        .select(F.col("a.n_nationkey").alias("a_key"), F.col("b.n_nationkey").alias("b_key"))


@query("join_range", sql="""
WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders
           QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT a.o_custkey, a.o_orderkey AS first_key, b.o_orderkey AS second_key,
       date_diff('day', a.o_orderdate, b.o_orderdate) AS days
FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND date_diff('day', a.o_orderdate, b.o_orderdate) > 5
""")
def join_range(spark, d):
    """Pairs more than 5 days apart among sampled rows: each customer's last order of a year, so
    a customer has at most as many rows as there are years, however many orders it has."""
    o = Tables(spark, d).orders
    s = (o.groupBy("o_custkey", F.year("o_orderdate").alias("year"))
          .agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("last")).select("o_custkey", "last.*"))
    a, b = s.alias("a"), s.alias("b")
    days = F.datediff(F.col("b.o_orderdate"), F.col("a.o_orderdate"))
    j = a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (days > 5))
    return j.select(F.col("a.o_custkey").alias("o_custkey"), F.col("a.o_orderkey").alias("first_key"),
                    F.col("b.o_orderkey").alias("second_key"), days.cast("bigint").alias("days"))


@query("join_or_condition", sql="""
SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n
  ON (s.s_nationkey = n.n_nationkey AND s.s_acctbal >= 5000)
  OR (s.s_nationkey = n.n_regionkey AND s.s_acctbal < 5000)
""")
def join_or_condition(spark, d):
    t = Tables(spark, d)
    s, n = t.supplier, t.nation
    out = J.or_join(s, n, [
        (s["s_nationkey"] == n["n_nationkey"], s["s_acctbal"] >= 5000),
        (s["s_nationkey"] == n["n_regionkey"], s["s_acctbal"] < 5000)])
    return out.select("s_suppkey", "n_name")


@query("join_or_overlap", sql="""
SELECT s_suppkey, n_name FROM supplier, nation
WHERE CASE WHEN s_nationkey = n_nationkey THEN s_acctbal < 5000 OR (s_nationkey = n_regionkey AND s_acctbal > 0)
           ELSE s_nationkey = n_regionkey AND s_acctbal > 0 END
""")
def join_or_overlap(spark, d):
    """Branches that both fit some pairs (a nation with the number of its region): each pair comes once."""
    t = Tables(spark, d)
    s, n = t.supplier, t.nation
    out = J.or_join(s, n, [
        (s["s_nationkey"] == n["n_nationkey"], s["s_acctbal"] < 5000),
        (s["s_nationkey"] == n["n_regionkey"], s["s_acctbal"] > 0)])
    return out.select("s_suppkey", "n_name")


@query("join_text_contains", sql="""
WITH toks AS (SELECT DISTINCT doc_id, t AS tok FROM (
    SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^0-9a-z_\\p{L}]+')) AS t FROM documents) WHERE t <> ''),
     words AS (SELECT DISTINCT t AS word FROM (
    SELECT unnest(regexp_split_to_array(lower(text), '[^0-9a-z_\\p{L}]+')) AS t FROM benchmark) WHERE t <> '')
SELECT toks.doc_id, words.word FROM toks JOIN words ON toks.tok = words.word
""")
def join_text_contains(spark, d):
    t = Tables(spark, d)
    words = (t.benchmark.select(F.explode(F.split(F.lower("text"), r"[^0-9a-z_\p{L}]+")).alias("word"))
             .where(F.col("word") != "").distinct())
    return J.token_join(t.documents, "doc_id", "text", words, "word").select("doc_id", "word")


@query("join_like_or", sql="""
SELECT doc_id, item_id FROM documents d, benchmark b
WHERE contains(lower(d.text), lower(left(b.text, 40)))
   OR (d.lang = 'en' AND contains(lower(d.text), lower(left(b.text, 6))))
   OR (d.source = 'src7' AND contains(lower(d.text), lower(left(b.text, 3))))
""")
def join_like_or(spark, d):
    """Benchmark items and the documents that contain their first 40 letters, or 6 if they are English, or 3 in one source."""
    t = Tables(spark, d)
    words = t.benchmark.select("item_id", *[F.left("text", F.lit(n)).alias(f"p{n}") for n in (40, 6, 3)])
    return J.like_or_join(t.documents.select("doc_id", "text", "lang", "source"), "doc_id", "text", words, "item_id",
                          [("p40", F.lit(True)), ("p6", F.col("lang") == "en"), ("p3", F.col("source") == "src7")])


RULES = [("R", None, "returned"), (None, "O", "open"), ("A", "F", "accepted, final"), (None, None, "any")]


@query("join_wildcard_lookup", sql="""
WITH rules(r_l_returnflag, r_l_linestatus, rule) AS (
  VALUES ('R', NULL, 'returned'), (NULL, 'O', 'open'), ('A', 'F', 'accepted, final'), (NULL, NULL, 'any'))
SELECT r.rule, count(*) AS n FROM lineitem l JOIN rules r
  ON l.l_returnflag = coalesce(r.r_l_returnflag, l.l_returnflag) AND l.l_linestatus = coalesce(r.r_l_linestatus, l.l_linestatus)
GROUP BY r.rule
""")
def join_wildcard_lookup(spark, d):
    rules = spark.createDataFrame(RULES, "r_l_returnflag string, r_l_linestatus string, rule string")
    li = Tables(spark, d).lineitem.select("l_returnflag", "l_linestatus")
    return J.wildcard_lookup(li, rules, ["l_returnflag", "l_linestatus"]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("join_mixed_types", sql="""
WITH k AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS nkey_text FROM customer)
SELECT n.n_nationkey, n.n_name FROM nation n JOIN k ON n.n_nationkey = TRY_CAST(k.nkey_text AS INTEGER)
""")
def join_mixed_types(spark, d):
    t = Tables(spark, d)
    k = t.customer.select(F.col("c_nationkey").cast("string").alias("nkey_text")).distinct()
    return J.cast_join(t.nation, "n_nationkey", k, "nkey_text", "inner").select("n_nationkey", "n_name")


@query("lateral_apply", sql="""
SELECT page_id, pos::BIGINT AS pos, part FROM (
  SELECT page_id, unnest(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')) AS part,
         unnest(range(1, len(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')) + 1)) AS pos FROM pages)
""")
def lateral_apply(spark, d):
    p = Tables(spark, d).pages.select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("u"))
    return p.select("page_id", F.posexplode(F.split("u", "/")).alias("pos", "part")) \
        .select("page_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "part")


@query("typed_self_joins", sql="""
SELECT user_id, v AS "view", c AS "click", p AS "purchase", v + c + p AS total FROM (
  SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type = 'click') AS c,
         count(*) FILTER (WHERE event_type = 'purchase') AS p
  FROM events GROUP BY user_id)
""")
def typed_self_joins(spark, d):
    out = J.typed_counts(Tables(spark, d).events, "user_id", "event_type", ["view", "click", "purchase"])
    return out.select("user_id", *[F.col(c).cast("bigint").alias(c) for c in ["view", "click", "purchase", "total"]])


@query("correlated_scalar", sql="""
SELECT c.c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders,
       round((SELECT sum(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey), 2) AS total
FROM customer c
""")
def correlated_scalar(spark, d):
    t = Tables(spark, d)
    agg = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"),
                                           F.round(F.sum("o_totalprice"), 2).alias("total"))
    j = t.customer.join(agg, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "total")


# ---------------------------------------------------------------- U: set operations


@query("union_distinct", sql="SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    t = Tables(spark, d)
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).union(
        t.supplier.select("s_nationkey")).distinct()


@query("union_all", sql="""
SELECT nationkey, count(*) AS n FROM (SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
GROUP BY nationkey
""")
def union_all(spark, d):
    t = Tables(spark, d)
    u = t.customer.select(F.col("c_nationkey").alias("nationkey")).unionByName(
        t.supplier.select(F.col("s_nationkey").alias("nationkey")))
    return u.groupBy("nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("except_distinct", sql="""
SELECT c_nationkey AS nationkey, c_mktsegment FROM customer
EXCEPT SELECT s_nationkey, 'BUILDING' FROM supplier WHERE s_acctbal > 0
""")
def except_distinct(spark, d):
    t = Tables(spark, d)
    sup = t.supplier.where(F.col("s_acctbal") > 0).select(F.col("s_nationkey").alias("nationkey"),
                                                         F.lit("BUILDING").alias("c_mktsegment"))
    return t.customer.select(F.col("c_nationkey").alias("nationkey"), "c_mktsegment").subtract(sup)


# ---------------------------------------------------------------- W: windows


@query("row_number_part", sql="""
SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
FROM orders
""")
def row_number_part(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_totalprice")
    out = W.number_within(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], "rn")
    return out.select("o_orderkey", "o_custkey", F.col("rn").cast("int").alias("rn"))


@query("rank_part", sql="""
SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity * (1 - l_discount) DESC) AS rnk
FROM lineitem
""")
def rank_part(spark, d):
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("score"))
    out = W.rank_within(li, ["l_orderkey"], ["score"], "rnk")
    return out.select("l_orderkey", "l_linenumber", F.col("rnk").cast("int").alias("rnk"))


@query("row_number_global", sql="""
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_id FROM orders
""")
def row_number_global(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_totalprice")
    return number_rows(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], "row_id").select("o_orderkey", "row_id")


@query("running_min_exclusive", sql="""
SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS min_before
FROM orders
""")
def running_min_exclusive(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return W.running_min_before(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select(
        "o_orderkey", "min_before")


@query("ordinal_in_split", sql="""
SELECT page_id, array_to_string(parts[1:len(parts) - 1], '/') AS parent_path, len(parts) AS n_parts
FROM (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS parts FROM pages)
""")
def ordinal_in_split(spark, d):
    p = Tables(spark, d).pages.select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("u"))
    return p.select("page_id", W.drop_last_parts("u", "/", 1).alias("parent_path"),
                    F.size(F.split("u", "/")).cast("bigint").alias("n_parts"))


@query("prefix_labels", sql="""
SELECT n_name, upper(left(n_name, 1)) || CAST(row_number() OVER (PARTITION BY upper(left(n_name, 1)) ORDER BY n_name) AS VARCHAR) AS label
FROM nation
""")
def prefix_labels(spark, d):
    return W.prefix_labels(Tables(spark, d).nation.select("n_name"), "n_name")


# ---------------------------------------------------------------- T: sort / top-k


@query("order_multi", sql=f"""
SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '{TS}') AS o_orderdate,
       row_number() OVER (ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS sort_pos
FROM orders
""")
def order_multi(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_orderpriority", "o_orderdate")
    out = number_rows(o, [F.col("o_orderpriority"), F.col("o_orderdate").desc(), F.col("o_orderkey")], "sort_pos")
    return temporal_as_text(out.orderBy("sort_pos"))


@query("top_n", sql="""
SELECT o_custkey, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY o_custkey
ORDER BY spend DESC, o_custkey LIMIT 10
""")
def top_n(spark, d):
    o = Tables(spark, d).orders
    return (o.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spend"))
            .orderBy(F.col("spend").desc(), "o_custkey").limit(10))


@query("top_1_group", sql="""
SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority LIMIT 1
""")
def top_1_group(spark, d):
    g = Tables(spark, d).orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("n").desc(), "o_orderpriority").limit(1)


@query("topk_then_agg", sql="""
WITH k AS (SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 400)
SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM k GROUP BY l_orderkey
ORDER BY total DESC, l_orderkey LIMIT 10
""")
def topk_then_agg(spark, d):
    li = Tables(spark, d).lineitem
    k = li.orderBy("l_extendedprice", "l_orderkey", "l_linenumber").limit(400)
    g = k.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return g.orderBy(F.col("total").desc(), "l_orderkey").limit(10)
