"""Parquet table access for the driver's test tables (and any folder of the same layout)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy handle: ``Tables(spark, dir).orders`` is ``spark.read.parquet(dir/orders.parquet)``.

    Reads are lazy; Catalyst prunes columns and pushes filters into each scan.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.read(name)
        raise AttributeError(name)

    def register_views(self, names=TABLE_NAMES) -> None:
        for n in names:
            self.read(n).createOrReplaceTempView(n)


def scan(spark: SparkSession, path: str, where: Column | str | None = None,
         columns: list | None = None, order: list | None = None) -> DataFrame:
    """Scan → filter → project → order.  Filter and projection reach the Parquet scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    if columns:
        df = df.select(*columns)
    if order:
        df = df.orderBy(*order)
    return df


def tagged_union(sources: dict[str, DataFrame], tag_col: str = "source") -> DataFrame:
    """S3: run one projection over many sources, tag each row with its source, union by name."""
    parts = [df.withColumn(tag_col, F.lit(tag)) for tag, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def tagged_file_scan(spark: SparkSession, paths: list[str], tag_col: str = "source_file") -> DataFrame:
    """One multi-path (or glob) read; each row tagged with the file it came from."""
    return spark.read.parquet(*paths).withColumn(tag_col, F.col("_metadata.file_name"))
