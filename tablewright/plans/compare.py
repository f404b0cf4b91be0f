"""Snapshot comparison.

A snapshot is rows (Item, Parent, Property_Type, Properties).  Comparing two
snapshots is one full outer join on (Item, Property_Type) after pruning
children whose parent is missing on the other side — all equi-joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.tsql import blank_len
from tablewright.session import cut_lineage
from tablewright.sources.profile import column_profile

SNAPSHOT_COLS = ["Item", "Parent", "Property_Type", "Properties"]


def profile_snapshot(df: DataFrame, table: str) -> DataFrame:
    """C11: a table's snapshot computed from its data.

    One row for the table (``columns=…;rows=…``) and one per column, parent =
    the table, with type, null count and distinct count as ``key=value`` text.
    """
    prof = column_profile(df, with_rows=True)
    props = F.concat_ws(";", F.concat(F.lit("type="), "data_type"), F.concat(F.lit("nulls="), F.col("null_count").cast("string")),
                        F.concat(F.lit("distinct="), F.col("distinct_count").cast("string")))
    table_props = F.concat(F.lit(f"columns={len(df.columns)};rows="), F.col("rows").cast("string"))
    # the table row rides along with the first column's row: one aggregate for both
    rows = F.array(F.struct(F.col("column_name").alias("Item"), F.lit(table).alias("Parent"),
                            F.lit("COLUMN").alias("Property_Type"), props.alias("Properties")))
    rows = F.when(F.col("ordinal") == 1, F.array_insert(
        rows, 1, F.struct(F.lit(table).alias("Item"), F.lit("").alias("Parent"), F.lit("TABLE").alias("Property_Type"),
                          table_props.alias("Properties")))).otherwise(rows)
    return prof.select(F.inline(rows))


def full_names(snap: DataFrame) -> DataFrame:
    """Item = Parent + Item (the item is stored without its parent)."""
    return snap.withColumn("Item", F.concat(F.coalesce(F.col("Parent"), F.lit("")), F.col("Item")))


def prune_orphans(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop children whose parent is missing on the other side.

    Source first against the full target, then target against the pruned
    source; one pass (not cascading).  An item that is its own parent does
    not count as a parent.
    """
    def parents(df):
        return (df.where(F.col("Item") != F.col("Parent")).select(F.col("Item").alias("_tw_parent")).distinct())

    def prune(df, other):
        # one pass: a row stays unless it is a child whose parent the other side lacks
        is_child = F.coalesce(F.col("Parent"), F.lit("")) > ""
        j = df.join(parents(other), F.col("Parent") == F.col("_tw_parent"), "left")
        return j.where(~is_child | F.col("_tw_parent").isNotNull()).drop("_tw_parent")

    source = prune(source, target)
    target = prune(target, source)
    return source, target


def compare(source: DataFrame, target: DataFrame, keys=("Item", "Property_Type"), value="Properties",
            with_parent: bool = True) -> DataFrame:
    """Rows that differ between two snapshots, labelled
    ``only in target`` / ``only in source`` / ``different Properties``."""
    keys = list(keys)
    # snapshots are small (one row per catalogued item) and each side is read
    # several times below: materialise them once instead of re-deriving them
    source, target = cut_lineage(source), cut_lineage(target)
    if with_parent:
        source, target = full_names(source), full_names(target)
        source, target = prune_orphans(source, target)
    s = source.select(*[F.col(k).alias(f"s_{k}") for k in keys], F.col(value).alias("s_v"), F.lit(True).alias("_s"))
    t = target.select(*[F.col(k).alias(f"t_{k}") for k in keys], F.col(value).alias("t_v"), F.lit(True).alias("_t"))
    j = s.join(t, reduce(lambda a, b: a & b, [F.col(f"s_{k}") == F.col(f"t_{k}") for k in keys]), "full_outer")
    result = (F.when(F.col("_s").isNull(), "only in target").when(F.col("_t").isNull(), "only in source")
              .when(F.col("s_v") != F.col("t_v"), "different Properties").otherwise("match"))
    differs = reduce(lambda a, b: a | b,
                     [F.coalesce(F.col(f"s_{k}"), F.lit("")) != F.coalesce(F.col(f"t_{k}"), F.lit("")) for k in keys] +
                     [F.coalesce(F.col("s_v"), F.lit("")) != F.coalesce(F.col("t_v"), F.lit(""))])
    return j.where(differs).select(
        result.alias("Result"), *[F.coalesce(F.col(f"s_{k}"), F.col(f"t_{k}")).alias(k) for k in keys],
        F.coalesce(F.col("s_v"), F.lit("")).alias("Source_Properties"),
        F.coalesce(F.col("t_v"), F.lit("")).alias("Target_Properties"))


def compare_values(this: DataFrame, other: DataFrame, key: str = "Item", kind: str = "ItemType",
                   value: str = "Value", values_only: bool = False) -> DataFrame:
    """Snapshots keyed by item only: one-sided rows, then different lengths
    (trailing blanks ignored) before different values.

    ``only in here`` marks items of ``this`` missing from ``other`` (the
    recipe this follows has the two one-sided labels the other way round;
    it never shows them because its filter drops one-sided rows).

    ``values_only=True`` keeps the dialect's ``WHERE s.Value <> t.Value``,
    which drops one-sided rows (NULL comparison); the default keeps them.
    """
    s = this.select(F.col(key).alias("s_k"), F.col(kind).alias("s_t"), F.col(value).alias("s_v"))
    t = other.select(F.col(key).alias("t_k"), F.col(kind).alias("t_t"), F.col(value).alias("t_v"))
    j = s.join(t, F.col("s_k") == F.col("t_k"), "full_outer")
    result = (F.when(F.col("t_k").isNull(), "only in here").when(F.col("s_k").isNull(), "only in other")
              .when(blank_len("s_v") != blank_len("t_v"), "different lengths")
              .when(F.col("s_v") != F.col("t_v"), "different values").otherwise("match"))
    cond = (F.col("s_v") != F.col("t_v")) if values_only else ~F.col("s_v").eqNullSafe(F.col("t_v"))
    return j.where(cond).select(result.alias("Result"), F.coalesce("s_k", "t_k").alias(key),
                                F.coalesce("s_t", "t_t").alias(kind),
                                F.coalesce("s_v", F.lit("")).alias("ThisValue"),
                                F.coalesce("t_v", F.lit("")).alias("OtherValue"))
