"""Aggregation operators.

Every grouped aggregate here is an algebraic aggregate (count, sum, min, max,
max over a struct) so Spark computes it partially on the map side before the
shuffle — a hot key arrives at its reducer as one partial row per input
partition, not as its raw rows.  Ordered string lists (A5) are built only
over groups whose size is bounded by the caller (distinct labels, column
lists), never over raw fact rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.tsql import col
from tablewright.operators.numbering import number_rows, number_within
from tablewright.session import cut_lineage
from tablewright.sources.profile import rows_per_value


def ordered_list(value, order: list, sep: str = ", ", desc: list[bool] | None = None) -> Column:
    """A5: STRING_AGG(value, sep) WITHIN GROUP (ORDER BY order…) as an aggregate Column."""
    desc = desc or [False] * len(order)
    keys = ", ".join(f"{o if isinstance(o, str) else o._jc.toString()}{' DESC' if d else ''}" for o, d in zip(order, desc))
    v = value if isinstance(value, str) else value._jc.toString()
    sep_sql = sep.replace("'", "''")
    return F.expr(f"listagg({v}, '{sep_sql}') WITHIN GROUP (ORDER BY {keys})")


def chunked_list(df: DataFrame, group: list[str], order: list, value: str, sep: str, chunk: int = 1000, name: str = "text",
                 num_partitions: int | None = None) -> DataFrame:
    """A5 for groups of any size: ``group``, ``chunk`` (from 1) and the ``sep``-joined values of its rows.

    Values are numbered inside their group by the segmented scan and every
    ``chunk`` of them are one row, so a group with a third of all rows is many
    small groups.  The pieces in order, joined by ``sep``, are the whole list.
    ``order`` must be total; NULL values take a number but no place in the text.
    With ``num_partitions`` rows are sorted and joined in so many tasks; without, Spark decides.
    """
    n = number_within(df, group, order, "_tw_at", num_partitions) if group else number_rows(df, order, "_tw_at", num_partitions=num_partitions)
    placed = n.withColumn("chunk", F.expr(f"cast((_tw_at - 1) div {chunk} + 1 as int)"))
    if num_partitions:
        placed = placed.repartition(num_partitions, *group, "chunk")
    return placed.groupBy(*group, "chunk").agg(ordered_list(value, ["_tw_at"], sep).alias(name))


def two_level_list(df: DataFrame, outer: list[str], inner: str, more_than: int = 0, cut: int | None = None) -> DataFrame:
    """Rows of ``outer`` counted, with their ``inner`` values as ``value(count)``, most frequent first; groups of
    more than ``more_than`` rows; the list is cut to ``cut`` letters only if asked for."""
    t1 = df.groupBy(*outer, inner).agg(F.count(F.lit(1)).alias("occurs")).withColumn(
        "_tw_label", F.concat(F.col(inner), F.lit("("), F.col("occurs").cast("string"), F.lit(")")))
    examples = ordered_list("_tw_label", ["occurs", "_tw_label"], ", ", [True, False])
    g = t1.groupBy(*outer).agg(F.sum("occurs").alias("occurs"), (F.left(examples, F.lit(cut)) if cut else examples).alias("examples"))
    return g.where(F.col("occurs") > more_than)


def conditional_sum(cond: Column, value) -> Column:
    """SUM(IIF(cond, value, 0))."""
    return F.sum(F.when(cond, col(value)).otherwise(F.lit(0)))


def pivot_max(df: DataFrame, keys: list[str], pivot_col: str, values: list, value_col: str) -> DataFrame:
    """MAX(IIF(pivot = v, value, …)) per v — values listed explicitly (no discovery pass)."""
    return df.groupBy(*keys).pivot(pivot_col, values).agg(F.max(value_col))


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """Columns → (name, value) rows."""
    return df.unpivot(ids, values, name, value)


def any_flag(cond: Column) -> Column:
    """MAX(cond * 1) — 1 when any row of the group satisfies ``cond``."""
    return F.max(cond.cast("int"))


def singleton_groups(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Groups with exactly one row, recovering that row's id via MAX."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tw_n"), F.max(id_col).alias(id_col))
              .where(F.col("_tw_n") == 1).drop("_tw_n"))


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Detail rows whose key repeats — partial count per key, then a semi-join back."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tw_n")).where(F.col("_tw_n") > 1).drop("_tw_n")
    return df.join(dup, keys, "left_semi")


def cardinality_factor(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, rows per distinct value (NULL counts as one value), integer division; from one count of all values."""
    return rows_per_value(df, columns)


def minmax_many(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min / max over several columns, then over all of them."""
    return df.agg(F.least(*[F.min(c) for c in columns]).alias("min_value"),
                  F.greatest(*[F.max(c) for c in columns]).alias("max_value"))


def share_of_total(df: DataFrame, keys: list[str], value, name: str = "value", digits: int = 1) -> DataFrame:
    """Per-group value and its percentage of the grand total.

    The grouped result is materialised once (the scan, joins and aggregation
    behind it run once) and the grand total is a scalar subquery over it, so
    no global window and no join are needed.
    """
    g = cut_lineage(df.groupBy(*keys).agg(F.sum(col(value)).alias(name)))
    total = g.agg(F.sum(name)).scalar()
    return g.withColumn("pct", F.round(F.col(name) * 100.0 / total, digits))


def group_subtotals(df: DataFrame, keys: list[str], detail: list[str], value, name: str = "value") -> DataFrame:
    """Per-group sum headers, the detail rows below each, and a grand total at the end.

    One aggregate over GROUPING SETS ((keys, detail), (keys), ()); ``level`` is
    ``group``, ``detail`` or ``total`` and ``place`` the row's number in report
    order (groups by key, header first).  Rows of equal ``detail`` are one row.
    """
    g = df.groupingSets([[*keys, *detail], keys, []], *keys, *detail).agg(F.sum(col(value)).alias(name), F.grouping_id().alias("_tw_id"))
    level = F.when(F.col("_tw_id") == 0, "detail").when(F.col("_tw_id") == (1 << len(detail)) - 1, "group").otherwise("total")
    g = g.withColumn("level", level)
    order = [(F.col("level") == "total"), *[F.col(k) for k in keys], (F.col("level") == "detail"), *[F.col(d) for d in detail]]
    return number_rows(g, order, "place").select("place", "level", *keys, *detail, name)


def top_with_other(df: DataFrame, key: str, value, min_share: float = 0.01,
                   other: str = "(other)", digits: int = 1, scale: float = 1.0) -> DataFrame:
    """Slices at or below ``min_share`` of the total fold into one ``(other)`` slice; rank by size.

    Ranks come from the distributed numbering: with negative values, or a
    share of 0, any number of slices may exceed the threshold.
    """
    g = cut_lineage(df.groupBy(key).agg(F.sum(col(value)).alias("_tw_v")))   # aggregated once
    j = g.withColumn("_tw_t", g.agg(F.sum("_tw_v")).scalar())      # grand total as a scalar subquery
    big = F.col("_tw_v") > F.col("_tw_t") * min_share
    folded = (j.withColumn(key, F.when(big, F.col(key)).otherwise(F.lit(other)))
                .groupBy(key).agg(F.sum("_tw_v").alias("_tw_v")))
    ranked = number_rows(folded, [F.col("_tw_v").desc(), F.col(key)], "_tw_rank")
    return ranked.select(F.col("_tw_rank").cast("string").alias("rank"), key,
                         F.round(F.col("_tw_v") * scale, digits).alias("size"))


def stats_of(df: DataFrame, totals: dict[str, Column], holders: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(metric, item, value) rows of one table, from one aggregate over grouping sets.

    ``totals``: metric → aggregate over all rows (item '').  ``holders``: metric →
    (item, aggregate per item): the item with the greatest value, ties to the
    smallest item.  One pass, however many metrics: an empty grouping set gives the
    totals, one for each kind of item its values, of which a second aggregate,
    a row a metric, takes the best.
    """
    items = {f"_tw_i{k}": item.cast("string") for k, (item, _) in enumerate(holders.values())}
    aggs = [v.cast("double").alias(f"_tw_t{k}") for k, v in enumerate(totals.values())]
    aggs += [v.cast("double").alias(f"_tw_h{k}") for k, (_, v) in enumerate(holders.values())]
    g = df.withColumns(items).groupingSets([[], *[[i] for i in items]], *items).agg(*aggs, F.grouping_id().cast("bigint").alias("_tw_id"))
    everything = (1 << len(items)) - 1

    def row(id_: int, metric: str, item: Column, value: str) -> Column:
        return F.struct(F.lit(id_).cast("bigint").alias("id"), F.lit(metric).alias("metric"), item.alias("item"), F.col(value).alias("value"))

    rows = [row(everything, m, F.lit(""), f"_tw_t{k}") for k, m in enumerate(totals)]
    rows += [row(everything - (1 << (len(items) - 1 - k)), m, F.col(f"_tw_i{k}"), f"_tw_h{k}") for k, m in enumerate(holders)]
    long = g.select("_tw_id", F.inline(F.array(*rows))).where(F.col("_tw_id") == F.col("id"))
    best = F.min_by(F.struct("item", "value"), F.struct((-F.col("value")).alias("v"), "item"))
    return long.groupBy("metric").agg(best.alias("b")).select("metric", "b.item", "b.value")
