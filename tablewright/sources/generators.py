"""Generated relations: number spines, date spines, letter codes.

Spines come from ``spark.range`` (distributed over partitions) or from
``sequence`` exploded per row — never from recursion.  The bounds are
computed by one global aggregate that returns a single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.tsql import col


def spine(spark: SparkSession, lo: int, hi: int, name: str = "n", num_partitions: int | None = None) -> DataFrame:
    """Integers lo..hi inclusive, spread over partitions."""
    return spark.range(lo, hi + 1, 1, num_partitions).withColumnRenamed("id", name)


def spine_for(df: DataFrame, c: str, name: str = "n") -> DataFrame:
    """Integers from min(c) to max(c) of ``df`` (one-row bounds aggregate, then a distributed range)."""
    b = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
    if b is None or b["lo"] is None:
        return df.sparkSession.range(0).withColumnRenamed("id", name)
    return spine(df.sparkSession, int(b["lo"]), int(b["hi"]), name)


def letter_code(n) -> Column:
    """Ordinal 0..675 → two letters AA..ZZ; another ordinal is an error."""
    n = col(n)
    code = F.concat(F.char(F.lit(65) + F.floor(n / 26)), F.char(F.lit(65) + n % 26))
    return F.when((n < 0) | (n > 675), F.raise_error(F.concat(F.lit("no two-letter code for "), n.cast("string")))).otherwise(code)


def date_spine(bounds: DataFrame, lo: str = "lo", hi: str = "hi", name: str = "date_value") -> DataFrame:
    """Every date between the bounds row's ``lo`` and ``hi`` (dates), one row each.

    ``bounds`` is a one-row frame; the day sequence is split into yearly
    chunks first so the explode is spread over many rows and tasks.
    """
    years = bounds.select(F.explode(F.sequence(F.trunc(F.col(lo), "year"), F.trunc(F.col(hi), "year"),
                                               F.expr("INTERVAL 1 YEAR"))).alias("y"), lo, hi)
    years = years.repartition("y")
    days = years.select(
        F.explode(F.sequence(F.greatest(F.col("y"), F.col(lo)),
                             F.least(F.date_add(F.add_months(F.col("y"), 12), -1), F.col(hi)))).alias(name))
    return days
