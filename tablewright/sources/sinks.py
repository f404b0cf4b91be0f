"""Sinks and serialisers.

Everything is a Column expression per row; line numbering for scripts uses
the distributed :func:`number_rows`; writes go through the DataFrame writer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.tsql import sql_text_literal
from tablewright.operators.numbering import number_rows
from tablewright.session import checkpoint_dir

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def literal_of(field: T.StructField) -> Column:
    """One value as a SQL literal chosen by type class.

    numbers and booleans bare, binary as 0x-hex, dates / timestamps quoted
    ISO text, everything else quoted text with quotes doubled; NULL → NULL.
    """
    c = F.col(f"`{field.name}`")
    dt = field.dataType
    if isinstance(dt, NUMERIC):
        v = c.cast("string")
    elif isinstance(dt, T.BooleanType):
        v = c.cast("int").cast("string")
    elif isinstance(dt, T.BinaryType):
        v = F.concat(F.lit("0x"), F.hex(c))
    elif isinstance(dt, T.DateType):
        v = F.concat(F.lit("'"), F.date_format(c, "yyyy-MM-dd"), F.lit("'"))
    elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        v = F.concat(F.lit("'"), F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("'"))
    else:
        return sql_text_literal(c)
    return F.coalesce(v, F.lit("NULL"))


def row_literals(df: DataFrame) -> Column:
    """``(v1, v2, …)`` for the whole row."""
    parts = []
    for i, f in enumerate(df.schema.fields):
        if i:
            parts.append(F.lit(", "))
        parts.append(literal_of(f))
    return F.concat(F.lit("("), *parts, F.lit(")"))


def insert_script(df: DataFrame, table: str, order: list, batch: int = 1000,
                  header: list[str] | None = None, footer: list[str] | None = None) -> DataFrame:
    """Rows → ``,(…)`` lines; every ``batch``-th line (1, batch+1, …) starts a new
    ``insert <table> values`` statement instead of the comma.  Header and footer
    lines get their own sections; the result is (section, row_num, line).
    """
    lines = number_rows(df.select(*order, row_literals(df).alias("_tw_vals")), [F.col(c) for c in order], "row_num")
    starts = (F.col("row_num") % batch) == 1 if batch > 1 else F.lit(True)
    line = F.when(starts, F.concat(F.lit("/*"), F.floor(F.col("row_num") / batch).cast("string"),
                                   F.lit(f"*/ insert {table} values "), F.col("_tw_vals"))) \
            .otherwise(F.concat(F.lit(","), F.col("_tw_vals")))
    body = lines.select(F.lit(20).alias("section"), "row_num", line.alias("line"))
    spark = df.sparkSession
    extra = [(10, i + 1, h) for i, h in enumerate(header or [])] + [(30, i + 1, f) for i, f in enumerate(footer or [])]
    if extra:
        body = body.unionByName(spark.createDataFrame(extra, "section int, row_num bigint, line string"))
    return body


def write_script(lines: DataFrame, path: str) -> None:
    """Write script lines in (section, row_num) order as text files (sorted, then written)."""
    lines.orderBy("section", "row_num").select("line").write.mode("overwrite").text(path)


def json_rows(df: DataFrame) -> Column:
    """The row as a JSON object."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def xml_rows(df: DataFrame, row_tag: str = "row") -> Column:
    """The row as an XML element."""
    return F.to_xml(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"rowTag": row_tag})


def table_sink(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> DataFrame:
    """Write a table as Parquet and return the written table."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A folder below the session's shared checkpoint folder (for job-owned scratch tables)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}"


def incremental_new(items: DataFrame, name_col: str, ledger: DataFrame, ledger_name: str,
                    done: Column | None = None, sep: str = "_") -> DataFrame:
    """Items numbered above the highest completed number (none completed → 0).

    The number is the integer before the first ``sep`` of the name.
    """
    def number(c):
        return F.split_part(F.col(c), F.lit(sep), F.lit(1)).try_cast("bigint")
    led = ledger if done is None else ledger.where(done)
    hwm = led.agg(F.coalesce(F.max(number(ledger_name)), F.lit(0))).scalar()   # scalar subquery
    return items.where(number(name_col) > hwm)
