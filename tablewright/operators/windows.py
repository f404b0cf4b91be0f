"""Window-style operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.tsql import col
from tablewright.operators import numbering


def _order(cols, desc=False) -> list[Column]:
    out = []
    for c in cols:
        c = col(c)
        out.append(c.desc() if desc else c)
    return out


def latest(df: DataFrame, keys: list[str], order: list[str], ties: bool = False) -> DataFrame:
    """C14: latest row per key.

    ``ties=False`` (ROW_NUMBER = 1): one row per key, the greatest ``order``
    tuple (include a unique column in ``order`` for a total order).  Done as
    an aggregate ``max(struct(order…, row…))`` so a hot key is reduced
    map-side before the shuffle instead of being sorted in one window task.

    ``ties=True`` (MAX join): every row whose order value equals the key's
    maximum.  The max is a partial aggregate; the join back is keyed on
    (keys, order) so a hot key's rows spread over the order values.
    """
    if not ties:
        payload = [c for c in df.columns if c not in keys]
        best = F.max(F.struct(*[col(o).alias(f"_tw_o{i}") for i, o in enumerate(order)],
                              *[F.col(c) for c in payload])).alias("_tw_best")
        out = df.groupBy(*keys).agg(best)
        return out.select(*keys, *[F.col(f"_tw_best.{c}").alias(c) for c in payload]).select(*df.columns)
    maxes = df.groupBy(*keys).agg(*[F.max(o).alias(o) for o in order])
    return df.join(maxes, on=keys + order, how="left_semi")


def number_within(df: DataFrame, partition: list[str], order: list, name: str = "rn",
                  desc: bool = False) -> DataFrame:
    """ROW_NUMBER() OVER (PARTITION BY … ORDER BY …), safe for hot groups (see numbering)."""
    return numbering.number_within(df, partition, _order(order, desc), name)


def rank_within(df: DataFrame, partition: list[str], order: list[str], name: str = "rnk",
                desc: bool = True) -> DataFrame:
    """RANK() — ties share a rank, the next rank skips; safe for hot groups."""
    return numbering.rank_within(df, partition, order, name, desc)


def running_min_before(df: DataFrame, partition: list[str], order: list, value: str, name: str = "min_before") -> DataFrame:
    """MIN(value) over all earlier rows of the partition (exclusive running frame), by the same scan."""
    return numbering.running_min_within(df, partition, _order(order), value, name)


def drop_last_parts(c, sep: str, keep_all_but: int) -> Column:
    """Split a path on ``sep``, keep all but the last N parts, join again."""
    parts = F.split(col(c), _regex_quote(sep))
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - keep_all_but, F.lit(0))), sep)


def part_ordinal(c, sep: str) -> Column:
    """Parts of a split path with their 1-based ordinal (use with ``inline``)."""
    parts = F.split(col(c), _regex_quote(sep))
    return F.transform(parts, lambda x, i: F.struct((i + 1).alias("ordinal"), x.alias("part")))


def prefix_labels(df: DataFrame, name: str, label: str = "label", order: list | None = None) -> DataFrame:
    """label = upper first letter + number of the name within its letter (hot letters are split)."""
    d = df.withColumn("_tw_first", F.upper(F.substring(F.col(name), 1, 1)))
    d = numbering.number_within(d, ["_tw_first"], _order(order) if order else [F.col(name)], "_tw_n")
    return d.withColumn(label, F.concat("_tw_first", F.col("_tw_n").cast("string"))).drop("_tw_first", "_tw_n")


def _regex_quote(s: str) -> str:
    import re
    return re.escape(s)
