"""Balanced label propagation of documents over shards, in DataFrame operations only.

Documents of equal text are linked.  The law held is ``bytes``: the shards'
sizes are near equal, and as few links as possible are cut.

1. Every document starts in a shard by hash.  A *unit* is the part of one
   group that lies in one shard, so a group has at most ``shards`` units
   however many rows it has.
2. Rounds: a unit prefers the shard that holds most of its group's bytes.
   The units that want to move into a shard are taken group by group, as far
   as the shard's quota goes (an even share of all bytes, less what it
   holds).  A group larger than a quota stays split.  The rounds end when
   nothing moves, or after ``rounds``; units beyond an even share of bytes
   are then dissolved and fill up like unlinked documents.
3. Unlinked documents fill the shards up: first those above the mean size,
   then the others, each laid along a line of running bytes and cut where the
   shards' remaining quotas end, so a boundary misses its place by less than
   one small document.

Running sums are taken in buckets: a window within one bucket of about
``bucket_rows`` rows, and one over the bucket totals.

Defined results: null text has size 1 and counts as the empty text; equal
doc_ids are separate rows; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import cut_lineage


def _running(rows: DataFrame, keys: list[str], order: list[str], value: str, buckets: int, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the earlier rows of the same keys.

    The order is a hash of ``order`` in ``buckets`` ranges, then ``order``, which
    names a row; only bucket totals (at most ``buckets`` per key) meet in one window.
    """
    b = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = b.withColumn("_in", F.sum(value).over(inner) - F.col(value))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (b.groupBy(*keys, "_b").agg(F.sum(value).alias("_t"))
              .withColumn("_start", F.sum("_t").over(w) - F.col("_t")).drop("_t"))
    return (within.join(starts, [*keys, "_b"]).withColumn(out, F.col("_start") + F.col("_in")).drop("_b", "_in", "_start"))


def _at(quotas: list[float], total: float, position: Column) -> Column:
    """Shard whose stretch of the line holds ``position``: stretches follow each other, as long as the quotas."""
    scale, end, shard = total / max(sum(quotas), 1e-9), 0.0, F.lit(0)
    for quota in quotas[:-1]:
        end += quota
        shard = shard + (position >= F.lit(end * scale)).cast("int")
    return shard


def _loads(rows: DataFrame, size: str, shards: int) -> list[float]:
    got = {r["shard"]: r["b"] for r in rows.where("shard is not null").groupBy("shard").agg(F.sum(size).alias("b")).collect()}
    return [float(got.get(k, 0)) for k in range(shards)]


def _fill(rows: DataFrame, loads: list[float], mean: float, buckets: int) -> DataFrame:
    """Gives every row a shard along the line of the remaining quotas."""
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return rows
    quotas = [max(0.0, mean - x) for x in loads]
    laid = _running(rows, [], ["doc_id", "crc", "row"], "size", buckets, "_at")
    return laid.withColumn("shard", _at(quotas, total, F.col("_at") + F.col("size") / 2).cast("int")).drop("_at")


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Propagation goes on until nothing moves: a unit moves once, to the shard
    that holds most of its group, so there is an end.  ``rounds`` ends it earlier.
    """
    text = F.coalesce("text", F.lit(""))
    base = cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.sha2(text, 256)).alias("grp"),
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("init"), F.monotonically_increasing_id().alias("row")))
    rows, total = base.agg(F.count(F.lit(1)), F.sum("size")).first()
    mean, buckets = (total or 0) / shards, max(64, math.isqrt(rows))

    units = base.groupBy("grp", "init").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    linked = units.groupBy("grp").agg(F.sum("n").alias("rows")).where("rows > 1").select("grp")
    units = cut_lineage(units.join(linked, "grp").select("grp", "init", F.col("init").alias("shard"), "bytes"))
    for _ in itertools.count() if rounds is None else range(rounds):
        quotas = F.array(*[F.lit(mean - x) for x in _loads(units, "bytes", shards)])
        held = units.groupBy("grp", "shard").agg(F.sum("bytes").alias("w"))
        best = held.groupBy("grp").agg(F.max(F.struct("w", (-F.col("shard")).alias("s"))).alias("b")).select("grp", (-F.col("b.s")).alias("want"))
        movers = units.join(best, "grp").where("shard <> want")
        running = _running(movers, ["want"], ["grp", "init"], "bytes", buckets, "before")
        moved = cut_lineage(running.where(F.col("before") + F.col("bytes") <= F.element_at(quotas, F.col("want") + 1))
                            .select("grp", "init", "want"))
        if moved.isEmpty():
            break
        units = cut_lineage(units.join(moved, ["grp", "init"], "left")
                            .select("grp", "init", F.coalesce("want", "shard").alias("shard"), "bytes"))
    # what still exceeds an even share goes to the filling rows
    over = _running(units, ["shard"], ["grp", "init"], "bytes", buckets, "before")
    settled = over.where(F.col("before") + F.col("bytes") <= mean).select("grp", "init", "shard")

    rows_ = cut_lineage(base.join(settled, ["grp", "init"], "left").select("doc_id", "size", "crc", "row", "shard"))
    done, free = rows_.where("shard is not null"), rows_.where("shard is null")
    limit = total / rows if rows else 0
    loads = _loads(done, "size", shards)
    large = cut_lineage(_fill(free.where(F.col("size") > limit), loads, mean, buckets))
    loads = [a + b for a, b in zip(loads, _loads(large, "size", shards), strict=True)]
    small = _fill(free.where(F.col("size") <= limit), loads, mean, buckets)
    placed = cut_lineage(done.unionByName(large).unionByName(small).withColumn("one", F.lit(1).cast("long")))
    return (_running(placed, ["shard"], ["doc_id", "crc", "row"], "one", buckets, "slot")
            .select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                    "slot", F.lit(None).cast("int").alias("grown_shard")))
