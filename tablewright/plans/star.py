"""Star schema from a flat staging table.

``build_star(staging, prefix)`` classifies every staging column, then builds
lazily: a role-playing date dimension, one dimension per low-cardinality
text column, the fact table (surrogate keys by joining back on the
null-replaced value) and a view that rebuilds the staging shape.

Scale notes
* Classification needs one number per column (rows per distinct value): one
  scan counts all (column, value) pairs, exactly.
* Dimension keys 1..n in value order use the segmented scan of
  :mod:`tablewright.operators.numbering`, never a global window.  The fact id is
  a partition offset plus the row's place, without a sort, unless an order is asked for.
* Fact → dimension joins are plain equi-joins: AQE broadcasts a dimension
  when its measured size is under the threshold and otherwise sort-merge
  joins (with skew splitting for hot values).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.numbering import number_rows, number_within
from tablewright.session import cut_lineage
from tablewright.sources.generators import date_spine
from tablewright.sources.profile import rows_per_value

# The default date for missing dates and the dimension rule threshold.
DEFAULT_DATE = "9999-12-31"
DIMENSION_FACTOR = 3          # rows per distinct value above this → dimension

MEASURE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType,
                 T.DoubleType, T.BooleanType, T.DayTimeIntervalType, T.TimeType)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
RARE_TYPES = (T.BinaryType, T.MapType, T.ArrayType, T.StructType, T.VariantType, T.NullType)


@dataclass
class StagingColumn:
    name: str
    data_type: T.DataType
    action: str                 # datetime | measure | dimension | skip
    null_replacement: object    # '' | 0 | DEFAULT_DATE | None

    @property
    def is_datetime(self) -> bool:
        return isinstance(self.data_type, (T.TimestampType, T.TimestampNTZType))

    @property
    def is_date(self) -> bool:
        return isinstance(self.data_type, T.DateType)


class Star:
    """The star built from a staging table; every part is built on first use.

    Reading ``dims`` does not number the fact, the view joins the fact rows
    (the fact id is not needed there), and the fact id is assigned only when
    ``fact`` itself is read.
    """

    def __init__(self, staging: DataFrame, prefix: str, columns: list[StagingColumn], fact_order: list[str] | None):
        self.staging = staging
        self.prefix = prefix
        self.columns = columns
        self.fact_order = fact_order
        self.fact_columns = _fact_plan(columns, prefix)

    @cached_property
    def date_dim(self) -> DataFrame:
        return date_dimension(self.staging, self.columns)

    @cached_property
    def dims(self) -> dict[str, DataFrame]:
        """C3 for every dimension column.

        Text dimensions (the usual case) are built together: one scan of the
        staging table explodes (dimension, value) pairs, which are
        de-duplicated map-side, numbered within each dimension in one
        numbering pass, and materialised once; each dimension is a filter
        of that table.  Other dimension types are built one by one.
        """
        dcols = [c for c in self.columns if c.action == "dimension"]
        text = [c for c in dcols if isinstance(c.data_type, T.StringType)]
        out = {c.name: dimension(self.staging, c, self.prefix) for c in dcols if c not in text}
        if text:
            pairs = self.staging.select(F.explode(F.array(*[
                F.struct(F.lit(c.name).alias("_tw_dim"), _replaced(c).alias("_tw_val")) for c in text])).alias("_tw_p"))
            pairs = pairs.select("_tw_p._tw_dim", "_tw_p._tw_val").distinct()
            numbered = cut_lineage(number_within(pairs, ["_tw_dim"], [F.col("_tw_val")], "_tw_id"))
            for c in text:
                out[c.name] = numbered.where(F.col("_tw_dim") == c.name).select(
                    F.col("_tw_id").alias(f"{self.prefix}_{c.name}_Dim_ID"), F.col("_tw_val").alias(c.name))
        return {c.name: out[c.name] for c in dcols}

    @cached_property
    def fact_rows(self) -> DataFrame:
        """C4 without the fact id: surrogate keys by joining back on the null-replaced value."""
        by_name = {c.name: c for c in self.columns}
        fact = self.staging
        for name, d in self.dims.items():
            key = f"_tw_k_{name}"
            fact = (fact.withColumn(key, _replaced(by_name[name]))
                        .join(d.withColumnRenamed(name, key), key, "left").drop(key))
        out = []
        for fact_col, action, src in self.fact_columns:
            if action == "straight":
                out.append(F.col(src).alias(fact_col))
            elif action == "join":
                out.append(F.col(fact_col))
            else:
                out.append(_as_date(src).alias(fact_col))
        return fact.select(*out)

    @cached_property
    def fact(self) -> DataFrame:
        """C4: fact rows numbered 1..n: in ``fact_order`` if one is given, else by their place, without a sort."""
        order_cols = [F.col(src_to_fact(self.fact_columns, o)) for o in self.fact_order or []]
        fact = number_rows(self.fact_rows, order_cols, f"{self.prefix}_Fact_ID")
        return fact.select(f"{self.prefix}_Fact_ID", *[p[0] for p in self.fact_columns])

    @cached_property
    def view(self) -> DataFrame:
        """The staging shape rebuilt from the fact rows and the dimensions."""
        view = self.fact_rows
        for fact_col, action, src in self.fact_columns:
            if action == "join":
                view = view.join(self.dims[src], fact_col, "inner")
            elif action in ("date", "datepart"):
                dd = self.date_dim.select(F.col("Date_Value").alias(f"_tw_d_{fact_col}"))
                view = view.join(dd, F.col(fact_col) == F.col(f"_tw_d_{fact_col}"), "inner").drop(f"_tw_d_{fact_col}")
        return view.select(*[F.col(src).alias(src) if action == "join" else F.col(fact_col)
                             for fact_col, action, src in self.fact_columns])

    @cached_property
    def violations(self) -> DataFrame:
        """Foreign keys fact → dimension (join and date columns, not datepart): orphan counts.

        The fact is built once: a left join per key, then one sum of the rows that found no partner.
        """
        fact, counts = self.fact_rows, []
        for i, (fact_col, action, src) in enumerate(self.fact_columns):
            if action == "join":
                keys = self.dims[src].select(F.col(fact_col).alias(f"_tw_k{i}"))
            elif action == "date":
                keys = self.date_dim.select(F.col("Date_Value").alias(f"_tw_k{i}"))
            else:
                continue
            fact = fact.join(keys, F.col(fact_col) == F.col(f"_tw_k{i}"), "left")
            counts.append(F.struct(F.lit(fact_col).alias("fact_column"), F.lit(f"{self.prefix}_{src if action == 'join' else 'Date'}_Dim").alias("dimension"),
                                   F.coalesce(F.sum(F.col(f"_tw_k{i}").isNull().cast("bigint")), F.lit(0).cast("bigint")).alias("violations")))
        if counts:
            return fact.agg(F.array(*counts).alias("checks")).select(F.inline("checks"))
        return self.staging.sparkSession.createDataFrame([], "fact_column string, dimension string, violations bigint")


def _type_action(dt: T.DataType) -> str:
    if isinstance(dt, DATE_TYPES):
        return "datetime"
    if isinstance(dt, MEASURE_TYPES):
        return "measure"
    if isinstance(dt, RARE_TYPES):
        return "skip"
    if isinstance(dt, T.CharType):
        return "dimension"       # fixed-width text
    return ""                    # decided by the data


def _null_replacement(dt: T.DataType):
    if isinstance(dt, (T.StringType, T.CharType, T.VarcharType)):
        return ""
    if isinstance(dt, DATE_TYPES):
        return DEFAULT_DATE
    if isinstance(dt, RARE_TYPES):
        return None
    return 0


def cardinality_factors(staging: DataFrame, columns: list[str]) -> dict[str, int]:
    """Rows per distinct value (NULL is one value), integer division, per column: exact, from one count of all values."""
    if not columns:
        return {}
    return {r["column_name"]: r["factor"] for r in rows_per_value(staging, columns).collect()}      # one row per column


def classify(staging: DataFrame, overrides: dict[str, str] | None = None) -> list[StagingColumn]:
    """Action per staging column.

    By type: date/timestamp → datetime (overrides any action except skip),
    numbers/booleans → measure, binary/nested → skip, fixed-width char →
    dimension; other text by the data: more than 3 rows per distinct value →
    dimension, else measure (kept in the fact).
    """
    overrides = {k.lower(): v for k, v in (overrides or {}).items()}
    cols = []
    for f in staging.schema.fields:
        action = overrides.get(f.name.lower(), "") or _type_action(f.dataType)
        cols.append(StagingColumn(f.name, f.dataType, action, _null_replacement(f.dataType)))
    pending = [c.name for c in cols if c.action == ""]
    factors = cardinality_factors(staging, pending)
    for c in cols:
        if c.action == "":
            c.action = "dimension" if factors[c.name] > DIMENSION_FACTOR else "measure"
        if isinstance(c.data_type, DATE_TYPES) and c.action != "skip":
            c.action = "datetime"
    return [c for c in cols if c.action != "skip"]


def _replaced(c: StagingColumn) -> Column:
    col = F.col(c.name)
    if c.null_replacement is None:
        return col
    return F.coalesce(col, F.lit(c.null_replacement).cast(c.data_type))


def _as_date(name: str) -> Column:
    return F.coalesce(F.to_date(F.col(name)), F.lit(DEFAULT_DATE).cast("date"))


def date_dimension(staging: DataFrame, columns: list[StagingColumn]) -> DataFrame:
    """Every date between the global min and max of all date columns, plus the
    default date, with weekday and month names."""
    dcols = [c.name for c in columns if c.action == "datetime"]
    default = staging.sparkSession.range(1).select(F.lit(DEFAULT_DATE).cast("date").alias("Date_Value"))
    if dcols:
        mins = [F.min(F.to_date(F.col(c))) for c in dcols]
        maxs = [F.max(F.to_date(F.col(c))) for c in dcols]
        bounds = staging.agg((F.least(*mins) if len(mins) > 1 else mins[0]).alias("lo"),
                             (F.greatest(*maxs) if len(maxs) > 1 else maxs[0]).alias("hi"))
        days = date_spine(bounds.where(F.col("lo").isNotNull()), "lo", "hi", "Date_Value")
        dates = days.unionByName(default).distinct()
    else:
        dates = default
    return dates.select("Date_Value", F.date_format("Date_Value", "EEEE").alias("Day_of_Week_Name"),
                        F.date_format("Date_Value", "MMMM").alias("Month_Name"))


def dimension(staging: DataFrame, c: StagingColumn, prefix: str) -> DataFrame:
    """Distinct null-replaced values keyed 1..n in value order."""
    values = staging.select(_replaced(c).alias(c.name)).distinct()
    return number_rows(values, [F.col(c.name)], f"{prefix}_{c.name}_Dim_ID").select(f"{prefix}_{c.name}_Dim_ID", c.name)


def _fact_plan(cols: list[StagingColumn], prefix: str) -> list[tuple[str, str, str]]:
    """(fact column, action, staging column) in staging order; a datetime column
    yields a date part followed by the original value."""
    plan: list[tuple[str, str, str]] = []
    for c in cols:
        if c.is_datetime:
            plan.append((f"{prefix}_{c.name}", "datepart", c.name))
        if c.action == "dimension":
            plan.append((f"{prefix}_{c.name}_Dim_ID", "join", c.name))
        elif c.is_date:
            plan.append((c.name, "date", c.name))
        else:
            plan.append((c.name, "straight", c.name))
    return plan


def build_star(staging: DataFrame, prefix: str, overrides: dict[str, str] | None = None,
               fact_order: list[str] | None = None) -> Star:
    """Classify the staging columns; the star's parts are built when read."""
    return Star(staging, prefix, classify(staging, overrides), fact_order)


def src_to_fact(plan, staging_col: str) -> str:
    """Fact column that carries a staging column (the last plan entry for it)."""
    names = [p[0] for p in plan if p[2] == staging_col]
    return names[-1]


def classification_frame(spark, table: str, cols: list[StagingColumn]) -> DataFrame:
    """The classification as a small DataFrame (one row per kept column)."""
    rows = [(table, c.name, c.data_type.simpleString(), c.action) for c in cols]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, action string")
