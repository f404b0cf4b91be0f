"""Column profile computed from the data (S16), and the counts of values that it shares with A14 and C1.

One scan turns each row into (column, value) pairs, which are counted per
value — partial counts before the shuffle, so a frequent value costs one row
per task — and then per column.  Distinct counts are exact at every size, with
no row expanded once per distinct aggregate and no second scan: null counts,
minima and maxima are those of the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def as_text(f: T.StructField) -> Column:
    """The value as text, equal for equal values only (both zeros are one value)."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0)).cast("string")
    if isinstance(f.dataType, T.BinaryType):
        return F.hex(c)
    if isinstance(f.dataType, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(f.dataType, T.TimestampNTZType):
        return F.date_format(c, _MICROS)
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(c.isNotNull(), F.to_json(F.struct(c)))
    return c.cast("string")


_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def column_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(i, rows, nulls, distinct, lo, hi, lo_text, hi_text) of each column i that has rows: one scan, one exchange of values.

    ``lo`` and ``hi`` are numbers as double, the texts are those of text and temporal columns.
    """
    fields = [df.schema[c] for c in columns] if columns else df.schema.fields
    pairs = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        number = c.cast("double") if isinstance(f.dataType, NUMERIC) else F.lit(None).cast("double")
        shown = F.lit(None).cast("string")
        if isinstance(f.dataType, TEMPORAL):
            shown = F.date_format(c, "yyyy-MM-dd" if isinstance(f.dataType, T.DateType) else _MICROS)
        elif isinstance(f.dataType, T.StringType):
            shown = c
        pairs.append(F.struct(F.lit(i).alias("i"), as_text(f).alias("v"), number.alias("num"), shown.alias("shown")))
    values = (df.select(F.inline(F.array(*pairs))).groupBy("i", "v")
              .agg(F.count(F.lit(1)).alias("n"), F.max("num").alias("num"), F.max("shown").alias("shown")))
    return values.groupBy("i").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("v").alias("distinct"),
        F.min("num").alias("lo"), F.max("num").alias("hi"), F.min("shown").alias("lo_text"), F.max("shown").alias("hi_text"))


def column_profile(df: DataFrame, with_rows: bool = False) -> DataFrame:
    """Per column: name, ordinal, type, nullable, null count, distinct count,
    numeric min/max (double) and text min/max (strings, ISO dates);
    ``with_rows`` adds the table's row count to every row."""
    fields = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    listed = df.sparkSession.createDataFrame(fields, "_tw_i int, column_name string, data_type string, nullable boolean")
    counts = column_counts(df)
    j = listed.join(F.broadcast(counts), F.col("_tw_i") == F.col("i"), "left")           # a row a column on both sides
    none = F.lit(0).cast("bigint")
    return j.select("column_name", (F.col("_tw_i") + 1).alias("ordinal"), "data_type", "nullable", F.coalesce("nulls", none).alias("null_count"),
                    F.coalesce("distinct", none).alias("distinct_count"), F.col("lo").alias("min_num"), F.col("hi").alias("max_num"),
                    F.col("lo_text").alias("min_text"), F.col("hi_text").alias("max_text"), *([F.coalesce("rows", none).alias("rows")] if with_rows else []))


def rows_per_value(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, factor): rows per distinct value, NULL as one value, integer division; 0 for a table without rows."""
    names = F.array(*[F.lit(c) for c in columns])
    counts = column_counts(df, columns).select(
        F.element_at(names, F.col("i") + 1).alias("column_name"),
        F.expr("rows div (distinct + if(nulls > 0, 1, 0))").cast("bigint").alias("factor"))
    listed = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return listed.join(F.broadcast(counts), "column_name", "left").select("column_name", F.coalesce("factor", F.lit(0).cast("bigint")).alias("factor"))
