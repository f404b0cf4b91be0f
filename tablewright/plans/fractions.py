"""Best rational approximations.

For each distinct value: its integer part and fraction; a denominator d with
the nearest numerator round(d * frac) is kept when its error is strictly below
that of every smaller denominator.

Such fractions are convergents of the continued fraction of frac, or
intermediates between two of them from the middle on: any other fraction has,
on its side of frac, a nearer one with a smaller denominator on the way through
the Stern-Brocot tree.  So the walk goes from convergent to convergent, some
twenty steps for denominators up to 10,000, and only what it passes is
compared, with the same numerators and errors that a table of all denominators
would hold.  All of it is array work in the value's row: no rows per
denominator, no window, no shuffle but the distinct values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _steps(top: int) -> int:
    """Convergents up to ``top``: their denominators grow at least like the Fibonacci numbers."""
    return int(math.log(max(top, 2), (1 + 5 ** 0.5) / 2)) + 3


def candidate_denominators(x: Column, top: int) -> Column:
    """Ascending denominators up to ``top`` that can be best for ``x`` in [0, 1): 1, convergents, and intermediates
    from just before the middle of each step (a superset does no harm)."""
    start = F.struct(F.lit(1.0).alias("e0"), x.alias("e1"), F.lit(0).cast("bigint").alias("q0"), F.lit(1).cast("bigint").alias("q1"),
                     F.array(F.lit(1).cast("bigint")).alias("found"))

    def step(s: Column, _: Column) -> Column:
        live = (s["e1"] > 0) & (s["q1"] <= top)
        a = F.when(live, F.greatest(F.least(F.floor(s["e0"] / s["e1"]), F.lit(top + 1).cast("bigint")), F.lit(1).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
        low = F.greatest(F.floor(a / 2) - 1, F.lit(1).cast("bigint"))
        high = F.least(a + 1, F.floor((F.lit(top) - s["q0"]) / s["q1"]))
        passed = F.when(live & (high >= low), F.transform(F.sequence(low, F.greatest(high, low)), lambda k: s["q0"] + k * s["q1"])) \
            .otherwise(F.array().cast("array<bigint>"))
        return F.struct(F.when(live, s["e1"]).otherwise(s["e0"]).alias("e0"), F.when(live, F.abs(s["e0"] - a * s["e1"])).otherwise(0.0).alias("e1"),
                        F.when(live, s["q1"]).otherwise(s["q0"]).alias("q0"),
                        F.when(live, s["q0"] + a * s["q1"]).otherwise(s["q1"]).alias("q1"), F.concat(s["found"], passed).alias("found"))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(_steps(top))), start, step, lambda s: s["found"])
    return F.array_sort(F.array_distinct(walked))


def best_fractions(df: DataFrame, col: str, max_den: int = 10000, loop_form: bool = False) -> DataFrame:
    """Value, Integer_Part, Numerator, Denominator, Significant_Digits, Formula.

    ``loop_form=False`` (the table function): denominators 1..max_den, d = 1
    never qualifies (no earlier row), numerator 0 rows dropped.
    ``loop_form=True``: denominators 1..max_den-1, the first comparison is
    against the fraction 1, numerator 0 rows kept.
    """
    vals = df.select(F.col(col).cast("double").alias("value")).where(F.col("value").isNotNull()).distinct()
    vals = vals.select("value", F.col("value").cast("bigint").alias("Integer_Part"))
    vals = vals.withColumn("_tw_frac", F.col("value") - F.col("Integer_Part"))
    frac, top = F.col("_tw_frac"), max_den - 1 if loop_form else max_den

    def fraction(d: Column) -> Column:
        n = F.round(d * frac, 0).cast("bigint")
        return F.struct(d.alias("d"), n.alias("n"), F.abs(frac - n / d).alias("diff"))

    def better(s: Column, f: Column) -> Column:
        first = F.lit(False) if loop_form else s["best"].isNull()
        keep = ~first & (f["diff"] < s["best"])
        return F.struct(F.least(s["best"], f["diff"]).alias("best"), F.when(keep, F.concat(s["kept"], F.array(f))).otherwise(s["kept"]).alias("kept"))

    none = F.array().cast("array<struct<d:bigint,n:bigint,diff:double>>")
    start = F.struct((F.abs(frac - 1) if loop_form else F.lit(None).cast("double")).alias("best"), none.alias("kept"))
    fractions = F.transform(candidate_denominators(F.abs(frac), top), fraction)
    rows = vals.select("value", "Integer_Part", F.inline(F.aggregate(fractions, start, better, lambda s: s["kept"])))
    if not loop_form:
        rows = rows.where(F.col("n") != 0)
    exact = F.nullif(F.col("diff"), F.lit(0.0))
    digits = F.round(F.abs(F.log10(exact)) if loop_form else -F.log10(exact), 1)
    return rows.select("value", "Integer_Part", F.col("n").alias("Numerator"), F.col("d").alias("Denominator"), digits.alias("Significant_Digits"),
                       F.format_string("%d + %d/%d", "Integer_Part", "n", "d").alias("Formula"))
