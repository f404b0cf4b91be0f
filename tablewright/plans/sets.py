"""Matching sets (C15-C17): owners whose element sets are equal, or contain one another.

Scale design
* Each owner's set gets an order-free signature — (size and sums of three 32-bit
  pieces of element hashes) — computed by partial aggregation, so an owner holding a
  third of all rows is reduced map-side and never collected into one task.
* Owners with the same signature form a class; the class leader is its
  smallest owner.  Membership is then *verified exactly*: every member's
  elements are joined to the leader's elements on (class, element) and the
  matches must equal the set size.  Members failing the check (a hash
  collision) form classes among themselves in the same way, until none fails.
* Equal sets are reported as (leader, member) rows — one row per member, a
  star instead of every pair inside a class.
* Subset relations are computed between classes only: a class waits at its
  rarest element for the larger classes that hold it.  Where an element is hot,
  both sides are cut into parts of at most ``per_list`` classes, and every part
  of the waiting ones meets every part of the holding ones: an element that all
  owners hold makes many small tasks.  A 256-bit bitmap of the elements drops
  most candidates that cannot contain the set; the rest are verified by
  counting shared elements.  No cap is put on candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.session import cut_lineage

WORDS = 4


def _sums(e: Column) -> list[Column]:
    """Sums of unsigned 32-bit pieces of two hashes: exact (no overflow) below 2^31 elements per owner."""
    lo32, x = F.lit(0xFFFFFFFF), F.xxhash64(e)
    return [F.sum(x.bitwiseAND(lo32)), F.sum(F.shiftrightunsigned(x, 32)), F.sum(F.hash(e).cast("bigint").bitwiseAND(lo32))]


def _pairs(df: DataFrame, owner: str, element: str) -> DataFrame:
    return df.select(F.col(owner).alias("owner"), F.col(element).alias("element")).distinct()


def set_classes(df: DataFrame, owner: str, element: str, signature: Callable[[Column], list[Column]] = _sums) -> tuple[DataFrame, DataFrame]:
    """Return (membership, elements).

    membership: owner, leader, set_size, class_size — one row per owner.
    elements:   leader, element — the elements of each class (from its leader).
    All steps are partial aggregates and equi-joins (no window over a class).
    ``signature`` gives aggregates over the element's text; equal sets must agree in them.
    """
    pairs = cut_lineage(_pairs(df, owner, element))
    parts = signature(F.col("element").cast("string"))
    keys = ["set_size", *[f"h{i}" for i in range(len(parts))]]
    open_ = pairs.groupBy("owner").agg(F.count(F.lit(1)).alias("set_size"), *[p.alias(f"h{i}") for i, p in enumerate(parts)])
    done = None
    while True:
        open_ = cut_lineage(open_)
        leaders = open_.groupBy(*keys).agg(F.min("owner").alias("leader"))
        cand = open_.join(leaders, keys)
        # exact check against the leader: shared elements must equal the set size
        lead_el = pairs.join(leaders.select(F.col("leader").alias("owner")), "owner").select(
            F.col("owner").alias("_l_leader"), F.col("element").alias("_l_el"))
        shared = (pairs.join(cand.select("owner", "leader"), "owner")
                       .join(lead_el, (F.col("leader") == F.col("_l_leader")) & (F.col("element") == F.col("_l_el")))
                       .groupBy("owner").agg(F.count(F.lit(1)).alias("shared")))
        checked = cut_lineage(cand.join(shared, "owner", "left").withColumn("same", F.coalesce("shared", F.lit(0)) == F.col("set_size")))
        right = checked.where("same").select("owner", "set_size", "leader")
        done = right if done is None else done.unionByName(right)
        open_ = checked.where("not same").select("owner", *keys)
        if open_.isEmpty():                                # each round settles every leader at least
            break
    sizes = done.groupBy("leader").agg(F.count(F.lit(1)).alias("class_size"))
    # both results are read several times downstream: materialise them once
    membership = cut_lineage(done.join(sizes, "leader").select("owner", "leader", "set_size", "class_size"))
    elements = cut_lineage(pairs.join(membership.where(F.col("owner") == F.col("leader")).select("owner"), "owner")
                           .select(F.col("owner").alias("leader"), "element"))
    return membership, elements


def duplicate_sets(df: DataFrame, owner: str, element: str) -> DataFrame:
    """Owners whose set is shared with at least one other owner."""
    membership, _ = set_classes(df, owner, element)
    return membership.where(F.col("class_size") > 1)


def equal_pairs(df: DataFrame, owner: str, element: str) -> DataFrame:
    """(leader, owner) for every owner whose set equals its class leader's set."""
    membership, _ = set_classes(df, owner, element)
    return membership.where(F.col("owner") != F.col("leader")).select("leader", "owner", "set_size")


def _bitmap(hashed: str) -> list[Column]:
    """Aggregates: ``WORDS`` words of 64 bits, one bit for each element's hash."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftright({hashed}, 8), 64) as int))")
    return [F.bit_or(F.when(F.pmod(F.col(hashed), F.lit(WORDS)) == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}") for w in range(WORDS)]


def subset_candidates(membership: DataFrame, elements: DataFrame, per_list: int = 1000) -> DataFrame:
    """(a, a_size, b, b_size): pairs of classes, b larger, where b holds a's rarest element and a's bitmap lies in b's."""
    sizes = membership.where(F.col("owner") == F.col("leader")).select("leader", "set_size")
    maps = elements.select("leader", F.xxhash64(F.col("element").cast("string")).alias("_tw_h")).groupBy("leader").agg(*_bitmap("_tw_h"))
    classes = cut_lineage(sizes.join(maps, "leader"))
    freq = elements.groupBy("element").agg(F.count(F.lit(1)).alias("df"))
    rarest = cut_lineage(elements.join(freq, "element").groupBy("leader").agg(F.min(F.struct("df", "element")).alias("r"))
                         .select("leader", "r.*"))
    # parts of the classes that wait at an element, and of those that hold it
    cuts = rarest.groupBy("element").agg(F.ceil(F.count(F.lit(1)) / per_list).cast("int").alias("na"), F.ceil(F.first("df") / per_list).cast("int").alias("nb"))

    def part(of: str, n: str) -> Column:
        return F.pmod(F.xxhash64(of), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    words = [f"w{w}" for w in range(WORDS)]
    a = (rarest.select("leader", "element").join(classes, "leader").join(cuts, "element")
         .select("element", F.col("leader").alias("a"), F.col("set_size").alias("a_size"), *[F.col(w).alias(f"a_{w}") for w in words],
                 part("leader", "na").alias("pa"), every("nb").alias("pb")))
    b = (elements.join(cuts, "element").join(classes, "leader")
         .select("element", F.col("leader").alias("b"), F.col("set_size").alias("b_size"), *words, part("leader", "nb").alias("pb"), every("na").alias("pa")))
    inside = F.lit(True)
    for w in words:
        inside = inside & (F.col(f"a_{w}").bitwiseAND(F.col(w)) == F.col(f"a_{w}"))
    return a.join(b, ["element", "pa", "pb"]).where((F.col("b_size") > F.col("a_size")) & inside).select("a", "a_size", "b", "b_size")


def subset_pairs(df: DataFrame, owner: str, element: str, per_list: int = 1000) -> DataFrame:
    """C17: pairs of classes where one set is a proper subset of the other, and
    ``Match`` rows (leader, member) for the owners with equal sets.

    Output: left (smaller id), right, match_count, relation.
    """
    membership, elements = set_classes(df, owner, element)
    cand = subset_candidates(membership, elements, per_list)
    a_el = elements.select(F.col("leader").alias("a"), "element")
    b_el = elements.select(F.col("leader").alias("_b"), F.col("element").alias("b_element"))
    shared = (cand.join(a_el, "a")
                  .join(b_el, (F.col("b") == F.col("_b")) & (F.col("element") == F.col("b_element")))
                  .groupBy("a", "a_size", "b", "b_size").agg(F.count(F.lit(1)).alias("match_count")))
    sub = shared.where(F.col("match_count") == F.col("a_size"))
    left = F.least("a", "b")
    match = membership.where(F.col("owner") != F.col("leader")).select(
        F.col("leader").alias("left"), F.col("owner").alias("right"), F.col("set_size").cast("bigint").alias("match_count"),
        F.lit("Match").alias("relation"))
    return sub.select(left.alias("left"), F.greatest("a", "b").alias("right"), "match_count",
                      F.when(F.col("a") == left, "Left subset of right").otherwise("Right subset of left").alias("relation")
                      ).unionByName(match)
