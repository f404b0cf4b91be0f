"""Graph queries (C24-C28) over graphs derived from the tables.

The referral graph: when a user's purchase directly follows another user's
click, the clicking user (pk / red) is referenced by the purchasing user
(fk / ring).  Its size grows with ``events``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.plans import graph as G
from tablewright.registry import query
from tablewright.sources.tables import Tables

FOCAL = "U1"
EDGES_SQL = """
e AS (SELECT 'U' || CAST(p.user_id AS VARCHAR) AS pk, 'U' || CAST(x.user_id AS VARCHAR) AS fk,
             max(CASE WHEN x.value < 10 THEN 1 ELSE 0 END) AS nullable
      FROM events x JOIN events p ON p.event_id = x.event_id - 1
      WHERE x.event_type = 'purchase' AND p.event_type = 'click' AND p.user_id <> x.user_id GROUP BY ALL)
"""
TRANSITIONS_SQL = """
t AS (SELECT 'U' || CAST(p.user_id AS VARCHAR) AS red, 'U' || CAST(x.user_id AS VARCHAR) AS ring,
             CASE WHEN x.event_type = 'click' THEN 1 ELSE 0 END AS is_call,
             CASE WHEN p.event_type = 'signup' THEN 1 ELSE 0 END AS is_job,
             CASE WHEN x.event_type = 'purchase' THEN 1 ELSE 0 END AS is_update
      FROM events x JOIN events p ON p.event_id = x.event_id - 1 WHERE p.user_id <> x.user_id)
"""


def _pairs(events):
    prev = events.select(F.col("event_id").alias("p_id"), F.col("user_id").alias("p_user"), F.col("event_type").alias("p_type"))
    j = events.join(prev, F.col("p_id") == F.col("event_id") - 1).where(F.col("p_user") != F.col("user_id"))
    return j.withColumn("red", F.concat(F.lit("U"), F.col("p_user").cast("string"))) \
            .withColumn("ring", F.concat(F.lit("U"), F.col("user_id").cast("string")))


def referral_edges(events):
    j = _pairs(events).where((F.col("event_type") == "purchase") & (F.col("p_type") == "click"))
    return j.groupBy(F.col("red").alias("pk"), F.col("ring").alias("fk")).agg(
        F.max((F.col("value") < 10).cast("int")).alias("nullable"))


def transitions(events):
    j = _pairs(events)
    return j.select("red", "ring", (F.col("event_type") == "click").cast("int").alias("is_call"),
                    (F.col("p_type") == "signup").cast("int").alias("is_job"),
                    (F.col("event_type") == "purchase").cast("int").alias("is_update"))


@query("graph_neighborhood", sql=f"""
WITH {EDGES_SQL},
ends AS (SELECT pk, fk, nullable, 'pk' AS side, pk AS node, fk AS other FROM e
         UNION ALL SELECT pk, fk, nullable, 'fk', fk, pk FROM e),
near AS (SELECT *, CASE side WHEN 'pk' THEN 5 ELSE 2 END AS gen FROM ends WHERE node = '{FOCAL}'),
rules(gen, seed, side, tier) AS (VALUES (6, 5, 'pk', 1), (1, 2, 'fk', 1), (3, 2, 'pk', 2), (4, 5, 'fk', 2)),
far AS (SELECT DISTINCT r.tier, r.gen, x.pk, x.fk, x.nullable
        FROM rules r JOIN near s ON s.gen = r.seed JOIN ends x ON x.side = r.side AND x.node = s.other),
size AS (SELECT tier, gen, count(*) AS n FROM far GROUP BY ALL),
total AS (SELECT n0, n0 + coalesce((SELECT sum(n) FROM size WHERE tier = 1 AND n <= 10), 0) AS n1
          FROM (SELECT count(*) AS n0 FROM near)),
tried AS (SELECT size.*, n <= 10 AS kept FROM size, total WHERE n0 < 20 AND (tier = 1 OR n1 < 25)),
rel AS (SELECT pk, fk, nullable, gen FROM near
        UNION ALL SELECT pk, fk, nullable, gen FROM far JOIN tried USING (tier, gen) WHERE kept),
nodes AS (SELECT pk AS node FROM rel UNION SELECT fk FROM rel),
g(gen, label) AS (VALUES (1, 'GRANDPARENT'), (2, 'PARENT'), (3, 'SIBLING'), (4, 'SPOUSE'), (5, 'CHILD'), (6, 'GRANDCHILD'))
SELECT 1 AS section, 'graph RL' AS line
UNION ALL SELECT 2, fk || CASE WHEN nullable = 1 THEN '-.->' ELSE '-->' END || pk FROM e
  WHERE pk IN (SELECT node FROM nodes) AND fk IN (SELECT node FROM nodes)
UNION ALL SELECT 3, '%% ' || CAST(count(*) AS VARCHAR) || ' ' || g.label || ' relationships' FROM rel JOIN g USING (gen) GROUP BY g.label
UNION ALL SELECT 4, '%% ' || CAST(count(*) AS VARCHAR) || ' total initial relationships' FROM rel
UNION ALL SELECT 5, '%% ' || CAST(n AS VARCHAR) || ' ' || g.label || ' relationships left out' FROM tried JOIN g USING (gen) WHERE NOT kept
""")
def graph_neighborhood(spark, d):
    edges = referral_edges(Tables(spark, d).events)
    return G.neighborhood(edges, FOCAL)[1]


@query("caller_closure", sql=f"""
WITH RECURSIVE {EDGES_SQL},
d AS (SELECT DISTINCT pk AS red, fk AS ring FROM e),
walk(round, entered, seen) AS (
  SELECT 0, ['{FOCAL}'], ['{FOCAL}']
  UNION ALL
  SELECT round + 1, fresh, list_concat(seen, fresh)
  FROM (SELECT w.round, w.seen, list(DISTINCT d.ring) AS fresh FROM walk w JOIN d ON list_contains(w.entered, d.red) AND NOT list_contains(w.seen, d.ring)
        GROUP BY w.round, w.seen))
SELECT d.red, d.ring, CAST(n.round AS INTEGER) AS round FROM (SELECT round, unnest(entered) AS node FROM walk) n JOIN d ON d.red = n.node
""")
def caller_closure(spark, d):
    edges = referral_edges(Tables(spark, d).events).select(F.col("pk").alias("red"), F.col("fk").alias("ring"))
    return G.callers(edges, FOCAL).select("red", "ring", F.col("round").cast("int").alias("round"))


COMMON = ["U0"]


@query("edge_classify", sql=f"""
WITH {TRANSITIONS_SQL}
SELECT red, ring, is_call, is_job, max(is_update) AS is_update,
       CASE WHEN is_call = 1 THEN 'call' WHEN max(is_update) = 1 THEN 'write' ELSE 'read' END AS kind
FROM t WHERE red <> 'U0' GROUP BY red, ring, is_call, is_job
""")
def edge_classify(spark, d):
    return G.classify_edges(transitions(Tables(spark, d).events), exclude=COMMON)


@query("edge_lines", sql=f"""
WITH {TRANSITIONS_SQL},
c AS (SELECT red, ring, is_call, is_job, max(is_update) AS is_update FROM t WHERE red <> 'U0' GROUP BY ALL),
n AS (SELECT name, upper(left(name, 1)) || count(*) OVER (PARTITION BY upper(left(name, 1)) ORDER BY name) AS code
      FROM (SELECT unnest([red, ring]) AS name FROM c) GROUP BY name),
parts AS (SELECT unnest(list_filter([
            CASE WHEN is_call = 1 THEN [2, 1] END, CASE WHEN is_call + is_update = 0 THEN [3, 0] END, CASE WHEN is_update = 1 THEN [4, 1] END], lambda x: x IS NOT NULL)) AS style,
          [(a.code || printf(if(is_call = 1, '([%s])', '[%s]'), red)), (b.code || printf(if(is_job = 1, '[\\%s/]', '([%s])'), ring))] AS ends
          FROM c JOIN n a ON a.name = red JOIN n b ON b.name = ring)
SELECT DISTINCT style[1] AS section,
       ends[style[2] + 1] || [' -->|call| ', ' -.-> ', ' ==> '][style[1] - 1] || ends[2 - style[2]] AS line FROM parts
UNION ALL SELECT 1, 'graph LR'
""")
def edge_lines(spark, d):
    return G.edge_lines(G.classify_edges(transitions(Tables(spark, d).events), exclude=COMMON))


FKS = [
    {"child": "lineitem", "child_cols": ["l_orderkey"], "parent": "orders", "parent_cols": ["o_orderkey"], "nullable": False},
    {"child": "lineitem", "child_cols": ["l_partkey"], "parent": "part", "parent_cols": ["p_partkey"], "nullable": True},
    {"child": "lineitem", "child_cols": ["l_suppkey"], "parent": "supplier", "parent_cols": ["s_suppkey"], "nullable": False},
    {"child": "orders", "child_cols": ["o_custkey"], "parent": "customer", "parent_cols": ["c_custkey"], "nullable": False},
    {"child": "supplier", "child_cols": ["s_nationkey"], "parent": "nation", "parent_cols": ["n_nationkey"], "nullable": False},
    {"child": "customer", "child_cols": ["c_nationkey"], "parent": "nation", "parent_cols": ["n_nationkey"], "nullable": False},
    {"child": "nation", "child_cols": ["n_regionkey"], "parent": "region", "parent_cols": ["r_regionkey"], "nullable": False},
]
UNIQUE = {"part": ["p_name"], "supplier": ["s_name", "s_nationkey"], "nation": ["n_name", "n_regionkey"],
          "region": ["r_name"], "customer": ["c_name"]}


@query("denormalize", sql="""
SELECT l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus,
       strftime(l.l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS l_shipdate, l.l_orderkey, p.p_name, s.s_name, n.n_name, r.r_name
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def denormalize(spark, d):
    from tablewright.functions.tsql import temporal_as_text
    t = Tables(spark, d)
    tables = {n: t.read(n) for n in ("lineitem", "orders", "part", "supplier", "customer", "nation", "region")}
    return temporal_as_text(G.denormalize(tables, FKS, "lineitem", UNIQUE))


#: Orders and customers with natural keys that hold foreign keys: nation and region are reached twice.
UNIQUE_ROLES = {**UNIQUE, "orders": ["o_orderkey", "o_custkey"], "customer": ["c_name", "c_nationkey"]}


@query("denormalize_roles", sql="""
WITH place AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
       strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS l_shipdate, o_orderkey, p_name, s_name, c_name,
       sp.n_name, cp.n_name AS c_nationkey_n_name, sp.r_name, cp.r_name AS n_regionkey_r_name
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
JOIN customer ON c_custkey = o_custkey JOIN place cp ON cp.n_nationkey = c_nationkey
JOIN supplier ON s_suppkey = l_suppkey JOIN place sp ON sp.n_nationkey = s_nationkey
LEFT JOIN part ON p_partkey = l_partkey
""")
def denormalize_roles(spark, d):
    """Customer and supplier nation in one view: the same parent in two roles."""
    from tablewright.functions.tsql import temporal_as_text
    t = Tables(spark, d)
    tables = {n: t.read(n) for n in ("lineitem", "orders", "part", "supplier", "customer", "nation", "region")}
    return temporal_as_text(G.denormalize(tables, FKS, "lineitem", UNIQUE_ROLES))
