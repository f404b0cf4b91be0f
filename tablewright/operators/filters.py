"""Projections, filters and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.tsql import col


def case_ladder(branches: list[tuple[Column, str]], default: str | None = None) -> Column:
    """Searched CASE — first true branch wins."""
    expr = None
    for cond, label in branches:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def simple_case(c, mapping: dict, default: str | None = None) -> Column:
    """Simple CASE c WHEN k THEN v …"""
    return case_ladder([(col(c) == F.lit(k), v) for k, v in mapping.items()], default)


def contains_text(c, sought: str, case_insensitive: bool = True) -> Column:
    """LIKE '%' + escaped(sought) + '%' — the sought text is literal, wildcards included."""
    if case_insensitive:
        return F.contains(F.lower(col(c)), F.lit(sought.lower()))
    return F.contains(col(c), F.lit(sought))


def exclude(df: DataFrame, c: str, not_like: list[str] = (), not_in: list = ()) -> DataFrame:
    """NOT LIKE any pattern AND NOT IN a list."""
    cond = F.lit(True)
    for p in not_like:
        cond = cond & ~col(c).like(p)
    if not_in:
        cond = cond & ~col(c).isin(list(not_in))
    return df.where(cond)


def recent_changes(objects: DataFrame, id_col: str, parent_col: str, name_col: str,
                   created: str, modified: str, minutes: int, as_of: Column | None = None) -> DataFrame:
    """Objects modified within ``minutes`` before ``as_of`` (default: latest modification).

    Flags ``new`` when created = modified, resolves the parent's name through a
    self left join (own name when no parent) and orders parents before children.
    """
    if as_of is None:
        as_of = objects.agg(F.max(modified)).scalar()       # scalar subquery, evaluated once
    p = objects.select(F.col(id_col).alias("_p_id"), F.col(name_col).alias("_p_name"))
    out = (objects.where(F.col(modified) > as_of - F.make_interval(mins=F.lit(minutes)))
            .join(p, F.col(parent_col) == F.col("_p_id"), "left"))
    return out.select(
        F.coalesce(F.col("_p_name"), F.col(name_col)).alias("parent"),
        F.col(name_col).alias("name"),
        F.col(modified).alias("modify_date"),
        F.when(F.col(created) == F.col(modified), "new").otherwise("changed").alias("new"),
        F.when(F.col("_p_name").isNull(), 0).otherwise(1).alias("is_child"),
    )


def overlaps(start: str, end: str, win_start: Column, win_end: Column) -> Column:
    """P5: interval [start, end) overlaps the window: end > win_start AND start < win_end."""
    return (col(end) > win_start) & (col(start) < win_end)


def any_differs(pairs: list[tuple[str, str]]) -> Column:
    """True when any column pair differs, treating NULL = NULL as equal."""
    return reduce(lambda a, b: a | b, [~col(x).eqNullSafe(col(y)) for x, y in pairs])


def chain_participants(rows: DataFrame, id_col: str, ref_col: str, detail: DataFrame,
                       detail_key: str, row_key: str, extra: Column) -> DataFrame:
    """Rows that point at another row, rows pointed at, or rows whose detail count qualifies.

    ``ref_col`` holds the id (``id_col``) of the row pointed at, 0 for none.
    ``detail`` rows are counted per ``detail_key`` (a map-side partial
    aggregate) and joined to ``row_key``; "is pointed at" joins the distinct
    referenced ids, so no per-row subquery is evaluated.
    """
    counts = detail.groupBy(F.col(detail_key).alias("_tw_dkey")).agg(F.count(F.lit(1)).alias("locks"))
    referenced = (rows.where(col(ref_col) != 0).select(F.col(ref_col).alias("_tw_ref")).distinct()
                  .withColumn("_tw_is_ref", F.lit(True)))
    j = (rows.join(counts, F.col(row_key) == F.col("_tw_dkey"), "left").drop("_tw_dkey")
             .join(referenced, F.col(id_col) == F.col("_tw_ref"), "left"))
    keep = ((col(ref_col) != 0) | F.col("_tw_is_ref").isNotNull() |
            (F.col("locks").isNotNull() & ((F.col("locks") > 1) | ((F.col("locks") == 1) & extra))))
    return j.where(keep).drop("_tw_ref", "_tw_is_ref")


def length_class(c, buckets: list[tuple[int, int, str]], default: str) -> Column:
    """BETWEEN lo AND hi → label (first match)."""
    return case_ladder([(col(c).between(lo, hi), lab) for lo, hi, lab in buckets], default)


def property_lookup(df: DataFrame, key_cols: list[str], name: Column | str) -> DataFrame:
    """Value of the column whose name is given as data (case-insensitive), as text.

    Builds a map column-name → value per row and looks the lower-cased name up.
    """
    value_cols = [c for c in df.columns if c not in key_cols]
    m = F.create_map(*[x for c in value_cols for x in (F.lit(c.lower()), F.col(c).cast("string"))])
    nm = F.lower(F.lit(name) if isinstance(name, str) else name)
    return df.select(*key_cols, F.element_at(m, nm).alias("value"))


def regex_clean(c, pattern: str, guard: str | None = None) -> Column:
    """P10: remove regex matches, only where the guard pattern matches the text."""
    cleaned = F.regexp_replace(col(c), pattern, "")
    if guard is None:
        return cleaned
    return F.when(col(c).rlike(guard), cleaned).otherwise(col(c))
