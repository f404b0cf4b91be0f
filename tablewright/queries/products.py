"""Composite products: star schema (C1-C6), templates (C7), compare (C8-C11), sinks and profile (S8-S16),
fingerprints (C13), matching sets (C15-C17), ballots (C18-C19) and fractions (C33)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tablewright.functions.tsql import temporal_as_text
from tablewright.plans import ballots as B
from tablewright.plans import compare as C
from tablewright.plans import fingerprint as FP
from tablewright.plans import fractions as FR
from tablewright.plans import sets as ST
from tablewright.plans import star as S
from tablewright.plans.templates import template_merge
from tablewright.registry import query
from tablewright.sources import sinks as K
from tablewright.sources.generators import date_spine as _date_spine
from tablewright.sources.profile import column_profile
from tablewright.sources.tables import Tables

TS = "%Y-%m-%d %H:%M:%S.%f"
PREFIX = "L"


def lineitem_star(spark, d):
    return S.build_star(Tables(spark, d).lineitem, PREFIX)


def _factor_sql(table, col):
    return (f"SELECT '{table}' AS t, '{col}' AS c, count(*) // (count(DISTINCT {col}) + "
            f"max(CASE WHEN {col} IS NULL THEN 1 ELSE 0 END)) AS factor FROM {table}")


@query("star_classify", sql=f"""
WITH cols AS (SELECT table_name, column_name, data_type FROM information_schema.columns
              WHERE table_name IN ('lineitem', 'orders')),
f AS ({_factor_sql('lineitem', 'l_returnflag')} UNION ALL {_factor_sql('lineitem', 'l_linestatus')}
      UNION ALL {_factor_sql('orders', 'o_orderstatus')} UNION ALL {_factor_sql('orders', 'o_orderpriority')})
SELECT cols.table_name, cols.column_name,
       CASE cols.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
                           WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(cols.data_type) END AS data_type,
       CASE WHEN cols.data_type IN ('TIMESTAMP', 'DATE') THEN 'datetime'
            WHEN cols.data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'SMALLINT', 'BOOLEAN') THEN 'measure'
            WHEN f.factor > 3 THEN 'dimension' ELSE 'measure' END AS action
FROM cols LEFT JOIN f ON f.t = cols.table_name AND f.c = cols.column_name
""")
def star_classify(spark, d):
    t = Tables(spark, d)
    frames = [S.classification_frame(spark, name, S.classify(t.read(name))) for name in ("lineitem", "orders")]
    return reduce(lambda a, b: a.unionByName(b), frames)


@query("star_date_dim", sql="""
WITH b AS (SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem),
d AS (SELECT CAST(g.generate_series AS DATE) AS dv FROM b, generate_series(b.lo, b.hi, INTERVAL 1 DAY) g
      UNION SELECT DATE '9999-12-31')
SELECT strftime(dv, '%Y-%m-%d') AS Date_Value, dayname(dv) AS Day_of_Week_Name, monthname(dv) AS Month_Name FROM d
""")
def star_date_dim(spark, d):
    return temporal_as_text(lineitem_star(spark, d).date_dim)


@query("star_dim", sql="""
SELECT 'L_l_returnflag_Dim' AS dimension, row_number() OVER (ORDER BY v) AS dim_id, v AS value
FROM (SELECT DISTINCT coalesce(l_returnflag, '') AS v FROM lineitem)
UNION ALL
SELECT 'L_l_linestatus_Dim', row_number() OVER (ORDER BY v), v FROM (SELECT DISTINCT coalesce(l_linestatus, '') AS v FROM lineitem)
""")
def star_dim(spark, d):
    star = lineitem_star(spark, d)
    parts = [df.select(F.lit(f"{PREFIX}_{name}_Dim").alias("dimension"), F.col(f"{PREFIX}_{name}_Dim_ID").alias("dim_id"),
                       F.col(name).alias("value")) for name, df in star.dims.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


STAGING_ORDER = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
                 "l_returnflag, l_linestatus, l_shipdate")
DIMS_SQL = """
rf AS (SELECT row_number() OVER (ORDER BY v) AS id, v FROM (SELECT DISTINCT coalesce(l_returnflag, '') AS v FROM lineitem)),
ls AS (SELECT row_number() OVER (ORDER BY v) AS id, v FROM (SELECT DISTINCT coalesce(l_linestatus, '') AS v FROM lineitem))
"""


@query("star_fact", sql=f"""
WITH {DIMS_SQL}
SELECT row_number() OVER (ORDER BY {STAGING_ORDER}) AS L_Fact_ID,
       l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       rf.id AS L_l_returnflag_Dim_ID, ls.id AS L_l_linestatus_Dim_ID,
       strftime(coalesce(CAST(l_shipdate AS DATE), DATE '9999-12-31'), '%Y-%m-%d') AS L_l_shipdate,
       strftime(l_shipdate, '{TS}') AS l_shipdate
FROM lineitem l JOIN rf ON coalesce(l.l_returnflag, '') = rf.v JOIN ls ON coalesce(l.l_linestatus, '') = ls.v
""")
def star_fact(spark, d):
    """The fact with its ids, 1..n in the order of the staging columns."""
    star = S.build_star(Tables(spark, d).lineitem, PREFIX, fact_order=STAGING_ORDER.split(", "))
    return temporal_as_text(star.fact)


@query("star_fact_ordered", sql=f"""
SELECT row_number() OVER (ORDER BY {STAGING_ORDER}) AS L_Fact_ID, l_orderkey, l_linenumber FROM lineitem
""")
def star_fact_ordered(spark, d):
    """Fact ids in an order that the caller asks for."""
    star = S.build_star(Tables(spark, d).lineitem, PREFIX, fact_order=STAGING_ORDER.split(", "))
    return star.fact.select("L_Fact_ID", "l_orderkey", "l_linenumber")


@query("star_view", sql=f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       coalesce(l_returnflag, '') AS l_returnflag, coalesce(l_linestatus, '') AS l_linestatus,
       strftime(coalesce(CAST(l_shipdate AS DATE), DATE '9999-12-31'), '%Y-%m-%d') AS L_l_shipdate,
       strftime(l_shipdate, '{TS}') AS l_shipdate
FROM lineitem
""")
def star_view(spark, d):
    return temporal_as_text(lineitem_star(spark, d).view)


@query("fk_check", sql=f"""
WITH {DIMS_SQL},
b AS (SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem)
SELECT 'L_l_returnflag_Dim_ID' AS fact_column, 'L_l_returnflag_Dim' AS dimension,
       (SELECT count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM rf WHERE rf.v = coalesce(l.l_returnflag, ''))) AS violations
UNION ALL
SELECT 'L_l_linestatus_Dim_ID', 'L_l_linestatus_Dim',
       (SELECT count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM ls WHERE ls.v = coalesce(l.l_linestatus, '')))
UNION ALL
SELECT 'ship_day', 'L_Date_Dim', (SELECT count(*) FROM lineitem, b WHERE CAST(l_shipdate AS DATE) NOT BETWEEN lo AND hi)
""")
def fk_check(spark, d):
    """All keys of the fact, that of a DATE column among them."""
    staging = Tables(spark, d).lineitem.withColumn("ship_day", F.to_date("l_shipdate"))
    return S.build_star(staging, PREFIX).violations


# ---------------------------------------------------------------- C8-C11 snapshot compare


SPARK_TYPES = {
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
               ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
}


def _snapshot_sql(name: str, rel: str, cols: list[tuple[str, str]]) -> str:
    parts = [f"SELECT '{name}' AS Item, '' AS Parent, 'TABLE' AS Property_Type, "
             f"'columns={len(cols)};rows=' || CAST(count(*) AS VARCHAR) AS Properties FROM {rel}"]
    for c, t in cols:
        parts.append(f"SELECT '{c}', '{name}', 'COLUMN', 'type={t};nulls=' || CAST(count(*) - count({c}) AS VARCHAR) || "
                     f"';distinct=' || CAST(count(DISTINCT {c}) AS VARCHAR) FROM {rel}")
    return " UNION ALL ".join(parts)


_SRC_ORDERS = "(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')"
_TGT_ORDERS = "(SELECT * EXCLUDE (o_orderpriority) FROM orders)"


@query("snapshot_compare", sql=f"""
WITH src0 AS ({_snapshot_sql('orders', _SRC_ORDERS, SPARK_TYPES['orders'])}
              UNION ALL {_snapshot_sql('customer', 'customer', SPARK_TYPES['customer'])}),
tgt0 AS ({_snapshot_sql('orders', _TGT_ORDERS, SPARK_TYPES['orders'][:5])}
         UNION ALL {_snapshot_sql('supplier', 'supplier', SPARK_TYPES['supplier'])}),
src1 AS (SELECT Parent || Item AS Item, Parent, Property_Type, Properties FROM src0),
tgt1 AS (SELECT Parent || Item AS Item, Parent, Property_Type, Properties FROM tgt0),
src AS (SELECT * FROM src1 WHERE Parent = '' OR Parent IN (SELECT Item FROM tgt1 WHERE Property_Type = 'TABLE')),
tgt AS (SELECT * FROM tgt1 WHERE Parent = '' OR Parent IN (SELECT Item FROM src WHERE Property_Type = 'TABLE'))
SELECT 'only in source' AS Result, Item, Property_Type, Properties AS Source_Properties, '' AS Target_Properties
FROM src ANTI JOIN tgt USING (Item, Property_Type)
UNION ALL SELECT 'only in target', Item, Property_Type, '', Properties FROM tgt ANTI JOIN src USING (Item, Property_Type)
UNION ALL SELECT 'different Properties', Item, Property_Type, src.Properties, tgt.Properties
FROM src JOIN tgt USING (Item, Property_Type) WHERE src.Properties <> tgt.Properties
""")
def snapshot_compare(spark, d):
    t = Tables(spark, d)
    src = C.profile_snapshot(t.orders.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")), "orders") \
        .unionByName(C.profile_snapshot(t.customer, "customer"))
    tgt = C.profile_snapshot(t.orders.drop("o_orderpriority"), "orders").unionByName(C.profile_snapshot(t.supplier, "supplier"))
    return C.compare(src, tgt)


@query("prune_orphans", sql=f"""
WITH src0 AS ({_snapshot_sql('customer', 'customer', SPARK_TYPES['customer'])}
              UNION ALL {_snapshot_sql('orders', 'orders', SPARK_TYPES['orders'])}),
tgt0 AS ({_snapshot_sql('supplier', 'supplier', SPARK_TYPES['supplier'])}
         UNION ALL {_snapshot_sql('orders', 'orders', SPARK_TYPES['orders'])}),
src AS (SELECT * FROM src0 WHERE Parent = '' OR Parent IN (SELECT Item FROM tgt0 WHERE Property_Type = 'TABLE')),
tgt AS (SELECT * FROM tgt0 WHERE Parent = '' OR Parent IN (SELECT Item FROM src WHERE Property_Type = 'TABLE'))
SELECT 'source' AS side, Item, Parent FROM src UNION ALL SELECT 'target', Item, Parent FROM tgt
""")
def prune_orphans(spark, d):
    t = Tables(spark, d)
    src = C.profile_snapshot(t.customer, "customer").unionByName(C.profile_snapshot(t.orders, "orders"))
    tgt = C.profile_snapshot(t.supplier, "supplier").unionByName(C.profile_snapshot(t.orders, "orders"))
    s, g = C.prune_orphans(src, tgt)
    return s.select(F.lit("source").alias("side"), "Item", "Parent").unionByName(
        g.select(F.lit("target").alias("side"), "Item", "Parent"))


@query("compare_values", sql="""
WITH this AS (SELECT n_name AS Item, 'nation' AS ItemType, n_name || ' in region ' || CAST(n_regionkey AS VARCHAR) AS Value FROM nation),
other AS (SELECT n_name AS Item, 'nation' AS ItemType,
                 CASE WHEN n_regionkey = 0 THEN n_name || ' in region ' || CAST(n_regionkey AS VARCHAR) || '!'
                      WHEN n_regionkey = 1 THEN lower(n_name) || ' in region ' || CAST(n_regionkey AS VARCHAR)
                      ELSE n_name || ' in region ' || CAST(n_regionkey AS VARCHAR) END AS Value
          FROM nation WHERE n_name <> 'CANADA'
          UNION ALL SELECT r_name, 'region', r_name FROM region)
SELECT CASE WHEN t.Item IS NULL THEN 'only in here' WHEN s.Item IS NULL THEN 'only in other'
            WHEN length(rtrim(s.Value)) <> length(rtrim(t.Value)) THEN 'different lengths'
            WHEN s.Value <> t.Value THEN 'different values' ELSE 'match' END AS Result,
       coalesce(s.Item, t.Item) AS Item, coalesce(s.ItemType, t.ItemType) AS ItemType,
       coalesce(s.Value, '') AS ThisValue, coalesce(t.Value, '') AS OtherValue
FROM this s FULL OUTER JOIN other t ON s.Item = t.Item
WHERE s.Value IS DISTINCT FROM t.Value
""")
def compare_values(spark, d):
    t = Tables(spark, d)
    base = F.concat(F.col("n_name"), F.lit(" in region "), F.col("n_regionkey").cast("string"))
    this = t.nation.select(F.col("n_name").alias("Item"), F.lit("nation").alias("ItemType"), base.alias("Value"))
    other_val = (F.when(F.col("n_regionkey") == 0, F.concat(base, F.lit("!")))
                 .when(F.col("n_regionkey") == 1,
                       F.concat(F.lower("n_name"), F.lit(" in region "), F.col("n_regionkey").cast("string")))
                 .otherwise(base))
    other = t.nation.where(F.col("n_name") != "CANADA").select(
        F.col("n_name").alias("Item"), F.lit("nation").alias("ItemType"), other_val.alias("Value")).unionByName(
        t.region.select(F.col("r_name").alias("Item"), F.lit("region").alias("ItemType"), F.col("r_name").alias("Value")))
    return C.compare_values(this, other)


@query("profile_snapshot", sql=f"""
{_snapshot_sql('customer', 'customer', SPARK_TYPES['customer'])}
""")
def profile_snapshot(spark, d):
    return C.profile_snapshot(Tables(spark, d).customer, "customer")


# ---------------------------------------------------------------- S9-S16 sinks and profile


def _lit_sql(c):
    return f"'''' || replace({c}, '''', '''''') || ''''"


@query("snapshot_script_sink", sql=f"""
WITH v AS (SELECT row_number() OVER (ORDER BY c_custkey) AS rn,
                  '(' || CAST(c_custkey AS VARCHAR) || ', ' || {_lit_sql('c_name')} || ', ' || {_lit_sql('c_mktsegment')} || ')' AS vals
           FROM customer)
SELECT 20 AS section, rn AS row_num,
       CASE WHEN rn % 1000 = 1 THEN '/*' || CAST(rn // 1000 AS VARCHAR) || '*/ insert customer_snapshot values ' || vals
            ELSE ',' || vals END AS line
FROM v
UNION ALL SELECT 10, 1, 'drop table if exists customer_snapshot;'
UNION ALL SELECT 10, 2, 'create table customer_snapshot (c_custkey bigint, c_name varchar, c_mktsegment varchar);'
""")
def snapshot_script_sink(spark, d):
    c = Tables(spark, d).customer.select("c_custkey", "c_name", "c_mktsegment")
    out = K.insert_script(c, "customer_snapshot", ["c_custkey"], 1000, header=[
        "drop table if exists customer_snapshot;",
        "create table customer_snapshot (c_custkey bigint, c_name varchar, c_mktsegment varchar);"])
    return out.select(F.col("section").cast("int").alias("section"), F.col("row_num").cast("bigint").alias("row_num"), "line")


@query("row_literals", sql=f"""
SELECT s_suppkey, '(' || CAST(s_suppkey AS VARCHAR) || ', ' || {_lit_sql('s_name')} || ', ' || CAST(s_nationkey AS VARCHAR)
       || ', ' || CAST(s_acctbal AS VARCHAR) || ')' AS literal
FROM supplier
""")
def row_literals(spark, d):
    s = Tables(spark, d).supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return s.select("s_suppkey", K.row_literals(s).alias("literal"))


@query("json_out", sql="""
SELECT r_regionkey, to_json({'r_regionkey': r_regionkey, 'r_name': r_name}) AS json FROM region
""")
def json_out(spark, d):
    r = Tables(spark, d).region
    return r.select("r_regionkey", K.json_rows(r).alias("json"))


def _xml_text(c: str) -> str:
    return f"replace(replace(replace(CAST({c} AS VARCHAR), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("xml_out", sql=f"""
SELECT r_regionkey, '<region>' || chr(10) || '    <r_regionkey>' || {_xml_text('r_regionkey')} || '</r_regionkey>' || chr(10)
       || '    <r_name>' || {_xml_text('r_name')} || '</r_name>' || chr(10) || '</region>' AS xml
FROM region
""")
def xml_out(spark, d):
    r = Tables(spark, d).region
    return r.select("r_regionkey", K.xml_rows(r, "region").alias("xml"))


@query("table_sink", sql="SELECT * FROM nation")
def table_sink(spark, d):
    n = Tables(spark, d).nation
    import uuid
    return K.table_sink(n, K.shared_path(spark, f"table_sink/{uuid.uuid4().hex}"))


@query("incremental_new", sql="""
WITH items AS (SELECT strftime(o_orderdate, '%Y%m%d') || '_' || CAST(o_orderkey AS VARCHAR) AS name, o_orderdate FROM orders)
SELECT name FROM items
WHERE CAST(split_part(name, '_', 1) AS BIGINT) >
      coalesce((SELECT max(CAST(split_part(name, '_', 1) AS BIGINT)) FROM items WHERE o_orderdate < TIMESTAMP '2001-01-01'), 0)
""")
def incremental_new(spark, d):
    # items are numbered by order date; the ledger of completed items is everything ordered before 2001
    items = Tables(spark, d).orders.select(
        F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.col("o_orderkey").cast("string")).alias("name"),
        "o_orderdate")
    out = K.incremental_new(items, "name", items, "name",
                            done=F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
    return out.select("name")


def _profile_sql(table: str) -> str:
    parts = []
    for i, (c, t) in enumerate(SPARK_TYPES[table]):
        num = t in ("bigint", "int", "double")
        if num:
            mn, mx, tn, tx = f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)", "NULL", "NULL"
        elif t == "timestamp_ntz":
            mn, mx = "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"
            tn, tx = f"strftime(min({c}), '{TS}')", f"strftime(max({c}), '{TS}')"
        else:
            mn, mx, tn, tx = "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", f"min({c})", f"max({c})"
        parts.append(f"SELECT '{c}' AS column_name, {i + 1} AS ordinal, '{t}' AS data_type, true AS nullable, "
                     f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, "
                     f"{mn} AS min_num, {mx} AS max_num, {tn} AS min_text, {tx} AS max_text FROM {table}")
    return " UNION ALL ".join(parts)


@query("column_profile", sql=_profile_sql("orders"))
def column_profile_q(spark, d):
    return column_profile(Tables(spark, d).orders)


@query("template_merge", sql="""
SELECT n_regionkey, CAST((k - 1) // 3 + 1 AS INTEGER) AS chunk,
       string_agg('Nation ' || n_name || ' (#' || n_nationkey || ') is in region ' || n_regionkey || '. ', ' | ' ORDER BY k) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) GROUP BY ALL
""")
def template_merge_q(spark, d):
    n = Tables(spark, d).nation
    return template_merge(n, "Nation [N_NAME] (#[n_nationkey]) is in region [n_regionkey]. ", ["n_nationkey"], " | ",
                          group=["n_regionkey"], chunk=3)


@query("template_merge_all", sql="""
SELECT CAST((k - 1) // 100 + 1 AS INTEGER) AS chunk, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY k) AS text
FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) GROUP BY chunk
""")
def template_merge_all(spark, d):
    """One text of a whole table, in rows of 100 orders each."""
    o = Tables(spark, d).orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return template_merge(o, "[o_orderkey]:[o_orderstatus]", [F.col("o_totalprice").desc(), F.col("o_orderkey")], ",", chunk=100)


# ---------------------------------------------------------------- C13 fingerprints



def _fp_sql(table: str, cols: list[str], rel: str | None = None, ordered: bool = True) -> str:
    text = "concat_ws('|', " + ", ".join(f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), 'N')" for c in cols) + ")"
    omd5 = "md5(coalesce(string_agg(h, '' ORDER BY h), ''))" if ordered else "CAST(NULL AS VARCHAR)"
    return f"""SELECT '{table}' AS table_name, count(*) AS row_count,
  CAST(coalesce(sum(CAST(('0x' || substring(h, 1, 15)) AS BIGINT)), 0) AS VARCHAR) || ':' ||
  CAST(coalesce(sum(CAST(('0x' || substring(h, 16, 15)) AS BIGINT)), 0) AS VARCHAR) AS hash_sum,
  {omd5} AS ordered_md5
FROM (SELECT md5({text}) AS h FROM {rel or table})"""


@query("table_fingerprint", sql=" UNION ALL ".join([
    _fp_sql("region", ["r_regionkey", "r_name"]), _fp_sql("nation", ["n_nationkey", "n_name", "n_regionkey"]),
    _fp_sql("supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], ordered=False)]))
def table_fingerprint(spark, d):
    t = Tables(spark, d)
    # the one-string ordered form only for the fixed-size reference tables; supplier grows with scale
    parts = [FP.fingerprint(t.read(n), n, ordered=(n != "supplier")) for n in ("region", "nation", "supplier")]
    parts = [p if "ordered_md5" in p.columns else p.withColumn("ordered_md5", F.lit(None).cast("string")) for p in parts]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("fingerprint_expected", sql=f"""
SELECT table_name, '(' || chr(39) || table_name || chr(39) || ', ' || chr(39) || hash_sum || chr(39) || ', ' || row_count || '),' AS line FROM (
{_fp_sql("orders", ["o_custkey", "o_orderstatus", "o_orderpriority"], ordered=False)}
UNION ALL {_fp_sql("supplier", ["s_name", "s_nationkey"], ordered=False)})
""")
def fingerprint_expected(spark, d):
    """Fingerprints without ids, prices and dates, as the expected rows for next time."""
    t = Tables(spark, d)
    return FP.expected_rows(FP.fingerprint(t.orders, "orders", exclude=["o_orderkey", "o_totalprice", "o_orderdate"])
                            .unionByName(FP.fingerprint(t.supplier, "supplier", exclude=["s_suppkey", "s_acctbal"])))


@query("fingerprint_validate", sql=f"""
WITH e AS ({_fp_sql("region", ["r_regionkey", "r_name"])} UNION ALL {_fp_sql("nation", ["n_nationkey", "n_name", "n_regionkey"])}
           UNION ALL {_fp_sql("supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])}),
a AS ({_fp_sql("region", ["r_regionkey", "r_name"])}
      UNION ALL {_fp_sql("nation", ["n_nationkey", "n_name", "n_regionkey"], "(SELECT * FROM nation WHERE n_regionkey <> 0)")})
SELECT coalesce(e.table_name, a.table_name) AS table_name, CAST(e.row_count AS VARCHAR) AS expected_rows,
       CAST(a.row_count AS VARCHAR) AS actual_rows,
       CASE WHEN e.hash_sum IS NULL THEN 'missing expected' WHEN a.hash_sum IS NULL THEN 'missing table'
            WHEN e.hash_sum <> a.hash_sum THEN 'hash differs' ELSE 'count differs' END AS problem
FROM e FULL OUTER JOIN a ON e.table_name = a.table_name
WHERE e.hash_sum IS DISTINCT FROM a.hash_sum OR e.row_count IS DISTINCT FROM a.row_count
""")
def fingerprint_validate(spark, d):
    t = Tables(spark, d)
    expected = reduce(lambda a, b: a.unionByName(b), [FP.fingerprint(t.read(n), n) for n in ("region", "nation", "supplier")])
    actual = FP.fingerprint(t.region, "region").unionByName(
        FP.fingerprint(t.nation.where(F.col("n_regionkey") != 0), "nation"))   # one region's nations removed
    out = FP.validate(expected, actual)
    return out.select("table_name", F.col("expected_rows").cast("string").alias("expected_rows"),
                      F.col("actual_rows").cast("string").alias("actual_rows"), "problem")


# ---------------------------------------------------------------- C15-C17 matching sets (customer → order priorities)

_SET_SQL = """
WITH p AS (SELECT DISTINCT o_custkey AS owner, o_orderpriority AS element FROM orders),
s AS (SELECT owner, string_agg(element, ',' ORDER BY element) AS set_text, count(*) AS set_size FROM p GROUP BY owner),
c AS (SELECT set_text, min(owner) AS leader, count(*) AS class_size FROM s GROUP BY set_text),
m AS (SELECT s.owner, c.leader, s.set_size, c.class_size FROM s JOIN c USING (set_text))
"""


@query("sets_duplicate", sql=_SET_SQL + "SELECT owner, leader, set_size, class_size FROM m WHERE class_size > 1")
def sets_duplicate(spark, d):
    return ST.duplicate_sets(Tables(spark, d).orders, "o_custkey", "o_orderpriority")


@query("sets_equal_pairs", sql=_SET_SQL + "SELECT leader, owner, set_size FROM m WHERE owner <> leader")
def sets_equal_pairs(spark, d):
    return ST.equal_pairs(Tables(spark, d).orders, "o_custkey", "o_orderpriority")


@query("sets_subset_pairs", sql=_SET_SQL + """,
l AS (SELECT DISTINCT leader, set_size FROM m),
le AS (SELECT l.leader, l.set_size, p.element FROM l JOIN p ON p.owner = l.leader),
x AS (SELECT a.leader AS a, a.set_size AS a_size, b.leader AS b, b.set_size AS b_size, count(*) AS match_count
      FROM le a JOIN le b ON a.element = b.element AND a.leader <> b.leader GROUP BY ALL)
SELECT least(a, b) AS "left", greatest(a, b) AS "right", match_count,
       CASE WHEN a < b THEN 'Left subset of right' ELSE 'Right subset of left' END AS relation
FROM x WHERE match_count = a_size AND b_size > a_size
UNION ALL SELECT leader, owner, CAST(set_size AS BIGINT), 'Match' FROM m WHERE owner > leader
""")
def sets_subset_pairs(spark, d):
    return ST.subset_pairs(Tables(spark, d).orders, "o_custkey", "o_orderpriority")


# ---------------------------------------------------------------- C18-C19 ranked ballots (users rank event types)


def _votes(spark, d):
    """Each user ranks the event types by how often they used them (ties: type name)."""
    from pyspark.sql import Window
    e = Tables(spark, d).events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.col("n").desc(), "event_type")   # ≤ 5 rows per user
    return e.select("user_id", "event_type", F.row_number().over(w).alias("rank"))


@query("ballot_profiles", sql="""
WITH v AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rank
           FROM events GROUP BY user_id, event_type),
l AS (SELECT user_id, string_agg(event_type, ',' ORDER BY rank) AS ranking FROM v GROUP BY user_id),
r AS (SELECT ranking, count(*) AS votes FROM l GROUP BY ranking),
n AS (SELECT row_number() OVER (ORDER BY votes DESC, ranking) AS ranking_id, ranking, votes FROM r)
SELECT ranking_id, ranking, unnest(string_split(ranking, ',')) AS candidate,
       CAST(generate_subscripts(string_split(ranking, ','), 1) AS INTEGER) AS rank, votes
FROM n
""")
def ballot_profiles(spark, d):
    return B.ballot_profiles(_votes(spark, d), "user_id", "event_type", "rank")


@query("instant_runoff", sql="""
WITH RECURSIVE
v AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rnk
      FROM events GROUP BY user_id, event_type),
l AS (SELECT user_id, list(event_type ORDER BY rnk) AS ranking FROM v GROUP BY user_id),
p AS (SELECT ranking, count(*) AS votes FROM l GROUP BY ranking),
pe AS (SELECT ranking, votes, unnest(ranking) AS cand, generate_subscripts(ranking, 1) AS pos FROM p),
tot AS (SELECT sum(votes) AS t FROM p),
r(rnd, elim) AS (
  SELECT 1, []::VARCHAR[]
  UNION ALL
  SELECT r.rnd + 1, list_append(r.elim, s.bottom)
  FROM r, LATERAL (
      SELECT arg_min(cand, (votes, cand)) AS bottom, max(votes) AS top, count(*) AS ncand FROM (
        SELECT cand, sum(votes) AS votes FROM (
          SELECT ranking, votes, cand, row_number() OVER (PARTITION BY ranking ORDER BY pos) AS k
          FROM pe WHERE NOT list_contains(r.elim, cand)) WHERE k = 1 GROUP BY cand)) s
  WHERE s.top * 2 <= (SELECT t FROM tot) AND s.ncand > 1
)
SELECT CAST(r.rnd AS INTEGER) AS round, x.cand AS candidate, CAST(x.votes AS BIGINT) AS votes,
       CAST(round(x.votes * 100.0 / (SELECT t FROM tot)) AS DOUBLE) AS pct
FROM r, LATERAL (
  SELECT cand, sum(votes) AS votes FROM (
    SELECT ranking, votes, cand, row_number() OVER (PARTITION BY ranking ORDER BY pos) AS k
    FROM pe WHERE NOT list_contains(r.elim, cand)) WHERE k = 1 GROUP BY cand) x
""")
def instant_runoff(spark, d):
    return B.instant_runoff(B.ballot_profiles(_votes(spark, d), "user_id", "event_type", "rank"))


# ---------------------------------------------------------------- C33 best fractions


def _frac_sql(max_den: int, loop: bool) -> str:
    top = max_den - 1 if loop else max_den
    best = ("least(coalesce(min(diff) OVER w, 'infinity'::DOUBLE), abs(frac - 1))" if loop else "min(diff) OVER w")
    digits = "round(abs(log10(nullif(diff, 0))), 1)" if loop else "round(-log10(nullif(diff, 0)), 1)"
    keep = "" if loop else "AND n <> 0"
    return f"""
WITH v AS (SELECT DISTINCT x AS value FROM (SELECT l_discount AS x FROM lineitem UNION ALL SELECT l_tax FROM lineitem)),
f AS (SELECT value, CAST(trunc(value) AS BIGINT) AS ip, value - CAST(trunc(value) AS BIGINT) AS frac FROM v),
r AS (SELECT value, ip, frac, t.d AS d, CAST(round(t.d * frac) AS BIGINT) AS n FROM f, range(1, {top + 1}) t(d)),
r2 AS (SELECT *, abs(frac - n / d) AS diff FROM r),
r3 AS (SELECT *, {best} AS best FROM r2 WINDOW w AS (PARTITION BY value ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT value, ip AS Integer_Part, n AS Numerator, d AS Denominator, {digits} AS Significant_Digits,
       printf('%d + %d/%d', ip, n, d) AS Formula
FROM r3 WHERE diff < best {keep}
"""


def _frac_values(spark, d):
    li = Tables(spark, d).lineitem
    return li.select(F.col("l_discount").alias("x")).unionByName(li.select(F.col("l_tax").alias("x")))


@query("best_fractions", sql=_frac_sql(10000, False))
def best_fractions(spark, d):
    return FR.best_fractions(_frac_values(spark, d), "x", 10000)


@query("best_fractions_loop", sql=_frac_sql(100, True))
def best_fractions_loop(spark, d):
    return FR.best_fractions(_frac_values(spark, d), "x", 100, loop_form=True)


# ---------------------------------------------------------------- S8 date spine, S13 view sink



@query("date_spine", sql="""
WITH b AS (SELECT least((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem)) AS lo,
                  greatest((SELECT max(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)) AS hi)
SELECT strftime(CAST(g.generate_series AS DATE), '%Y-%m-%d') AS date_value FROM b, generate_series(b.lo, b.hi, INTERVAL 1 DAY) g
UNION SELECT '9999-12-31'
""")
def date_spine(spark, d):
    t = Tables(spark, d)
    o = t.orders.agg(F.struct(F.min(F.to_date("o_orderdate")).alias("lo"), F.max(F.to_date("o_orderdate")).alias("hi"))).scalar()
    li = t.lineitem.agg(F.struct(F.min(F.to_date("l_shipdate")).alias("lo"), F.max(F.to_date("l_shipdate")).alias("hi"))).scalar()
    bounds = spark.range(1).select(F.least(o["lo"], li["lo"]).alias("lo"), F.greatest(o["hi"], li["hi"]).alias("hi"))
    days = _date_spine(bounds, "lo", "hi", "date_value")
    default = spark.range(1).select(F.lit(S.DEFAULT_DATE).cast("date").alias("date_value"))
    return temporal_as_text(days.unionByName(default).distinct())


@query("view_sink", sql="""
SELECT coalesce(l_returnflag, '') AS l_returnflag, coalesce(l_linestatus, '') AS l_linestatus, count(*) AS n,
       round(sum(l_extendedprice), 2) AS revenue
FROM lineitem GROUP BY ALL
""")
def view_sink(spark, d):
    # the rebuilt star view published as a temporary view and queried with SQL
    lineitem_star(spark, d).view.createOrReplaceTempView("vw_L")
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue "
                     "FROM vw_L GROUP BY l_returnflag, l_linestatus")
