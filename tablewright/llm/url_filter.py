"""URL filter: blocked Bloom filter of listed canonical URLs, then an exact hash join.

A list holds canonical entries (tier, verdict, host, path).  An entry fits its
host and all subdomains, on paths that start with the entry's path.  Of the
entries that fit a URL those of the smallest tier count, and of these the
longest wins (ties: the smaller text, then ``allow``).  Tier 0 holds the named
rules, later tiers hold plain listed URLs.

Every URL has one key per (host suffix, path prefix) that could be an entry;
prefix lengths are those that occur in the list (distinct lengths, at most
``max_lengths`` of them go to the driver).  Keys are tested against the Bloom
filter in the task that reads the row, so that only possible hits are
shuffled.  The exact join removes the false positives.  The filter's size is
bounded; beyond the bound only its false-positive rate grows.

Defined results: a null url, or one without ``://``, has empty host and path
and fits no entry.  Repeated page rows each get their own row.  Rows of the
list with a null or empty host, or a null path, fit nothing.  An empty list
gives every URL the default verdict.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import BlockedBloom
from tablewright.session import cut_lineage

#: Words in the labels of a host that put the host on the block list (a parameter of the query).
BLOCKED_WORDS = ("ads", "adult", "bet", "bets", "casino", "pills", "porn", "spam", "xxx")


def _after(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))


def split_url(rows: DataFrame) -> DataFrame:
    """Adds host and path to a frame with a ``url`` column: the contract's canonical form."""
    return (rows.withColumn("_rest", _after(F.col("url")))
            .withColumn("host", F.coalesce(F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")))
            .withColumn("path", F.coalesce(F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1), F.lit("")))
            .drop("_rest"))


def rule_rows(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A literal list of (verdict, host, path) as entries of tier 0."""
    return spark.createDataFrame([(0, *r) for r in rules], "tier int, verdict string, host string, path string")


def listed_hosts(pages: DataFrame, words: tuple[str, ...] = BLOCKED_WORDS) -> DataFrame:
    """Block entries of tier 1 (host, empty path, which fits every path) for the hosts of ``pages`` with one of ``words`` in their labels."""
    hosts = split_url(pages.select("url")).select("host").distinct()
    hit = F.arrays_overlap(F.split("host", r"[.\-_]"), F.array(*[F.lit(w) for w in words]))
    return hosts.where(hit).select(F.lit(1).alias("tier"), F.lit("block").alias("verdict"), "host", F.lit("").alias("path"))


def filter_urls(pages: DataFrame, listed: DataFrame, default: str = "allow", max_lengths: int = 1024,
                max_bytes: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    ``listed`` has tier, verdict, host, path.  ``rule`` is host and path of the
    winning entry if that is of tier 0, else null.
    """
    spark = pages.sparkSession
    entries = cut_lineage(listed.select("tier", "verdict", F.lower("host").alias("host"), "path").where("host <> '' and path is not null")
                          .groupBy("host", "path").agg(F.min(F.struct("tier", "verdict")).alias("e"))
                          .select("host", "path", "e.tier", "e.verdict")
                          .withColumn("key", F.xxhash64("host", "path")))
    n = entries.count()
    lengths = [r[0] for r in entries.select(F.length("path").alias("n")).distinct().orderBy("n").limit(max_lengths + 1).collect()]
    if len(lengths) > max_lengths:
        raise ValueError(f"the list has paths of more than {max_lengths} different lengths")
    bloom = spark.sparkContext.broadcast(BlockedBloom.build(entries, "key", n, max_bytes))

    rows = split_url(pages.select(F.col("page_id").cast("long").alias("page_id"), "url")).drop("url")
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")))
    prefixes = F.filter(F.array(*[F.lit(k) for k in lengths]).cast("array<int>"), lambda k: k <= F.length("path"))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(
        prefixes, lambda k: F.struct(h.alias("host"), F.substring(F.col("path"), F.lit(1), k).alias("path")))))

    @F.pandas_udf("boolean")
    def possible(key: pd.Series) -> pd.Series:
        return pd.Series(bloom.value.has(key.to_numpy(np.int64).view(np.uint64)))

    possible_rows = (rows.select("host", "path", F.explode(pairs).alias("hit"))
                     .select("host", "path", F.col("hit.host").alias("h"), F.col("hit.path").alias("p"))
                     .where(possible(F.xxhash64("h", "p"))).distinct())
    e = entries.select(F.col("host").alias("eh"), F.col("path").alias("ep"), "tier", "verdict")
    best = (possible_rows.join(e, (F.col("h") == F.col("eh")) & (F.col("p") == F.col("ep")))
            .groupBy("host", "path")
            .agg(F.min(F.struct("tier", (-F.length("eh") - F.length("ep")).alias("n"), F.concat("eh", "ep").alias("rule"), "verdict")).alias("b"))
            .select(F.col("host").alias("bh"), F.col("path").alias("bp"), F.when(F.col("b.tier") == 0, F.col("b.rule")).alias("rule"), F.col("b.verdict").alias("verdict")))
    return (rows.join(best, (F.col("host") == F.col("bh")) & (F.col("path") == F.col("bp")), "left")
            .select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))
