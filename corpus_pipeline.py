"""Corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, best-fit packing.

Every stage works on all rows its predecessor kept.  The filtering stages
return the columns of ``documents``; the last returns the packed pieces.

Defined results: the dedup stages decide on rows, by a row key, so exactly one
row of each group stays, also if rows or ids repeat.  A null doc_id is judged
like any other; in the dedup stages a row with one stays only if its group has
no id.  Columns besides doc_id and text are carried along unread, whatever
their names.  Texts of any length are read whole.  Empty tables pass through
all stages.  A stage's own tables are removed when the next one has its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm import exact_dedup, ngram_join, packing, quality
from tablewright.llm.common import table
from tablewright.session import cut_lineage, scratch


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a long key of every row, under a name that no column has.

    A row read from files is named by its file and its place there, so all
    reads agree and nothing is written.  The files' numbers are broadcast: a
    row for each file, which the driver lists to plan the read anyway.  Other
    rows are written with a number.
    """
    name = "_row"
    while any(c.startswith(name) for c in docs.columns):
        name = "_" + name
    try:
        place = docs.metadataColumn("_metadata")
        named = docs.select("*", place["file_path"].alias(name + "_file"), place["row_index"].alias(name))
    except AnalysisException:
        return cut_lineage(docs.withColumn(name, F.monotonically_increasing_id())), name
    paths = named.select(F.col(name + "_file").alias(name + "_path")).distinct()
    files = paths.withColumn(name + "_no", F.row_number().over(Window.orderBy(name + "_path")).cast("long"))
    keyed = named.join(F.broadcast(cut_lineage(files)), F.col(name + "_file") == F.col(name + "_path"))
    return keyed.select(*[F.col(f"`{c}`") for c in docs.columns], (F.shiftleft(name + "_no", 40) + F.col(name)).alias(name)), name


def _one_of_each(docs: DataFrame, groups: Callable[[DataFrame], DataFrame], best: Callable[[Column], Column]) -> DataFrame:
    """One row of ``docs`` of each group: the ``best`` by doc_id, null last, then row key.

    ``groups`` gives (doc_id, group) for rows of doc_id and text; it sees the
    row key as doc_id.  Its tables are removed once the keys of the rows that
    stay are written.
    """
    rows, key = _keyed(docs)
    with scratch(docs.sparkSession) as keep:
        grouped = groups(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "group")
        ids = rows.select(F.col(key).alias("row"), "doc_id")
        kept = keep(grouped.join(ids, grouped["_key"] == ids["row"]).groupBy("group")
                    .agg(best(F.struct("doc_id", "row")).alias("best")).select(F.col("best.row").alias("_kept")))
    # one way at every size: the rows are shuffled once, never looked up in a table that grows with them
    return rows.join(kept.hint("merge"), rows[key] == kept["_kept"], "left_semi").drop(key)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    with scratch(spark):
        model = quality.fit(docs, labels)
    return docs.where(quality.keeps(docs, model))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of largest id of each group of equal texts."""
    return _one_of_each(docs, lambda rows: exact_dedup.exact_dedup(rows).select("doc_id", F.col("keep_id").alias("group")), F.max)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each group of near duplicates."""
    def smallest(row: Column) -> Column:
        return F.min(F.struct(row["doc_id"].isNull().alias("no_id"), row["doc_id"].alias("doc_id"), row["row"].alias("row")))

    return _one_of_each(docs, lambda rows: ngram_join.ngram_join(rows).select("doc_id", F.col("component_id").alias("group")), smallest)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that are left."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality_stage), ("exact_dedup", exact_dedup_stage),
          ("ngram_jaccard_join", ngram_stage), ("best_fit_packing", packing_stage)]

#: No stage but exact dedup can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
