"""Table fingerprints and validation.

Row text = the non-excluded columns as text, each with its length, joined by
``|`` (NULL has a mark of its own).  Two fingerprints per table:
* ``hash_sum`` — order-free: the sum of each row's MD5 read as two 60-bit
  numbers, plus the row count.  Partial sums aggregate map-side, so it
  scales to any table size and any partitioning.
* ``ordered_md5`` — MD5 of all row MD5s concatenated in sorted order, the
  classic "hash of the canonical content"; only for small (reference)
  tables, since it builds one string per table: more than ``ORDERED_ROWS`` rows
  are an error.  An empty table gives MD5('').
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.aggregates import ordered_list


#: Most rows of a table that has an ordered fingerprint (32 letters a row are in one string).
ORDERED_ROWS = 100_000


def row_text(df: DataFrame, exclude: list[str] = ()) -> Column:
    cols = [c for c in df.columns if c not in set(exclude)]
    text = lambda c: F.col(f"`{c}`").cast("string")
    # each value with its length, NULL with a mark of its own: no two different rows read the same
    return F.concat_ws("|", *[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("N")) for c in cols])


def row_md5(df: DataFrame, exclude: list[str] = ()) -> Column:
    return F.md5(row_text(df, exclude))


def fingerprint(df: DataFrame, table: str, exclude: list[str] = (), ordered: bool = False) -> DataFrame:
    """One row: table_name, row_count, hash_sum (text), and ordered_md5 when ``ordered``."""
    h = df.select(row_md5(df, exclude).alias("_tw_h"))
    part = lambda a, b: F.conv(F.substring("_tw_h", a, b), 16, 10).cast("decimal(38,0)")
    aggs = [F.count(F.lit(1)).alias("row_count"),
            F.concat_ws(":", F.coalesce(F.sum(part(1, 15)), F.lit(0)).cast("string"),
                        F.coalesce(F.sum(part(16, 15)), F.lit(0)).cast("string")).alias("hash_sum")]
    if ordered:
        some = h.limit(ORDERED_ROWS + 1).withColumn("_tw_n", F.lit(1))               # no more than that reaches one task
        text = some.agg(F.sum("_tw_n").alias("n"), ordered_list("_tw_h", ["_tw_h"], "").alias("t"))
        refused = F.raise_error(F.lit(f"{table}: an ordered fingerprint is for tables of at most {ORDERED_ROWS} rows"))
        ordered_md5 = text.select(F.when(F.col("n") > ORDERED_ROWS, refused).otherwise(F.md5(F.coalesce("t", F.lit(""))))).scalar()
        return h.agg(*aggs).select(F.lit(table).alias("table_name"), "*", ordered_md5.alias("ordered_md5"))
    return h.agg(*aggs).select(F.lit(table).alias("table_name"), "*")


def expected_rows(actual: DataFrame) -> DataFrame:
    """The fingerprints as rows of text to keep as the expected values of the next validation."""
    quoted = F.concat(F.lit("'"), F.replace("table_name", F.lit("'"), F.lit("''")), F.lit("'"))
    return actual.select("table_name", F.concat(F.lit("("), quoted, F.lit(", '"), "hash_sum", F.lit("', "), F.col("row_count").cast("string"), F.lit("),")).alias("line"))


def validate(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Tables whose fingerprint or row count differs (or that exist on one side only)."""
    e = expected.select("table_name", F.col("hash_sum").alias("expected_hash"), F.col("row_count").alias("expected_rows"))
    a = actual.select("table_name", F.col("hash_sum").alias("actual_hash"), F.col("row_count").alias("actual_rows"))
    j = e.join(a, "table_name", "full_outer")
    bad = ~F.col("expected_hash").eqNullSafe(F.col("actual_hash")) | ~F.col("expected_rows").eqNullSafe(F.col("actual_rows"))
    return j.where(bad).select("table_name", "expected_rows", "actual_rows",
                               F.when(F.col("expected_hash").isNull(), "missing expected")
                                .when(F.col("actual_hash").isNull(), "missing table")
                                .when(F.col("expected_hash") != F.col("actual_hash"), "hash differs")
                                .otherwise("count differs").alias("problem"))
