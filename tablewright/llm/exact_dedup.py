"""Exact dedup over a cuckoo-filter index of text digests.

``CuckooIndex`` keeps 16-bit fingerprints in four-slot buckets.  Beside each
fingerprint the slot stores the whole 256-bit digest (the bucketed content):
a fingerprint hit counts only if that content is equal, so there are no false
positives; an overflowing insertion doubles the table and refills it from the
stored keys; a live digest can be deleted again.

``exact_dedup`` runs the index twice.  In the map stage each task folds its
own rows into an index and emits one row per digest it has seen (a group with
a third of all rows shrinks to one row per task).  Those rows are shuffled by
digest and folded again.  The index of a map task is emptied when it holds
``flush_at`` digests, so memory is bounded; the reduce side is partitioned so
that a task holds about ``per_part`` digests.

Defined results: null text equals the empty text.  Rows with a null doc_id
take part; they are kept only if no row of the group has an id.  Rows that
repeat both doc_id and text each count and share their flag.  Only doc_id and
text are read, so extra columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import parts_for, texts


class CuckooIndex:
    SLOTS, MAX_KICKS = 4, 200

    def __init__(self, buckets: int = 256):
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.fps = [0] * (buckets * self.SLOTS)
        self.keys: list = [None] * (buckets * self.SLOTS)
        self.values: list = [None] * (buckets * self.SLOTS)
        self.live = 0

    def _place(self, key: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(key[-2:], "little") or 1
        first = int.from_bytes(key[-10:-2], "little") & self.mask
        return fp, first, self._other(first, fp)

    def _other(self, bucket: int, fp: int) -> int:
        return bucket ^ ((fp * 0x5BD1E995) & self.mask)

    def find(self, key: bytes) -> int:
        """Slot of a live key, or -1.  A fingerprint hit is verified against the stored key."""
        fp, a, b = self._place(key)
        for bucket in (a, b):
            at = bucket * self.SLOTS
            for slot in range(at, at + self.SLOTS):
                if self.fps[slot] == fp and self.keys[slot] == key:
                    return slot
        return -1

    def insert(self, key: bytes, value) -> None:
        """Add a key that is not live."""
        if self._put(key, value):
            return
        held = [(k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None] + [self._left]
        buckets = (self.mask + 1) * 2
        while True:                                 # overflow: a larger table, refilled from the stored keys
            self._empty(buckets)
            if all(self._put(k, v) for k, v in held):
                return
            buckets *= 2

    def _put(self, key: bytes, value) -> bool:
        fp, a, b = self._place(key)
        bucket = a
        for kick in range(self.MAX_KICKS):
            for x in ((a, b) if not kick else (bucket,)):
                at = x * self.SLOTS
                for slot in range(at, at + self.SLOTS):
                    if not self.fps[slot]:
                        self.fps[slot], self.keys[slot], self.values[slot] = fp, key, value
                        self.live += 1
                        return True
            slot = bucket * self.SLOTS + (kick + fp) % self.SLOTS
            (fp, key, value), (self.fps[slot], self.keys[slot], self.values[slot]) = \
                (self.fps[slot], self.keys[slot], self.values[slot]), (fp, key, value)
            bucket = self._other(bucket, fp)
        self._left = (key, value)
        return False

    def delete(self, key: bytes) -> bool:
        """Remove a live key; False if it is not there (a foreign key with the same fingerprint stays)."""
        slot = self.find(key)
        if slot < 0:
            return False
        self.fps[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


def _rows(index: CuckooIndex) -> pd.DataFrame:
    items = list(index.items())
    return pd.DataFrame({"digest": [k for k, _ in items], "keep_id": pd.array([v[0] for _, v in items], "Int64"),
                         "n": pd.array([v[1] for _, v in items], "Int64")})


def _fold(flush_at: int | None):
    def fold(batches):
        index = CuckooIndex()
        for x in batches:
            for key, doc, n in zip(x["digest"], x["keep_id"].astype("Int64"), x["n"], strict=True):
                key, doc = bytes(key), None if doc is pd.NA else int(doc)
                slot = index.find(key)
                if slot < 0:
                    index.insert(key, (doc, int(n)))
                    if flush_at and index.live >= flush_at:
                        yield _rows(index)
                        index = CuckooIndex()
                else:
                    old, count = index.values[slot]
                    best = old if doc is None else doc if old is None else max(old, doc)
                    index.values[slot] = (best, count + int(n))
        if index.live:
            yield _rows(index)
    return fold


_SCHEMA = "digest binary, keep_id long, n long"


def digest_groups(docs: DataFrame, flush_at: int = 200_000, per_part: int = 200_000) -> DataFrame:
    """(digest, keep_id, n): one row per different text, through the cuckoo index."""
    spark = docs.sparkSession
    rows = texts(docs).select(F.unhex(F.sha2("text", 256)).alias("digest"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    parts = parts_for(docs.count(), per_part, spark)
    return (rows.mapInPandas(_fold(flush_at), _SCHEMA)
            .repartition(parts, "digest").mapInPandas(_fold(None), _SCHEMA))


def exact_dedup(docs: DataFrame, flush_at: int = 200_000, per_part: int = 200_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Only groups of two rows or more are joined back; a group with a third of
    the rows is a skewed key of an equi-join of narrow rows, which AQE splits.
    """
    rows = texts(docs).select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    groups = (digest_groups(docs, flush_at, per_part).where("n > 1")
              .select(F.lower(F.hex("digest")).alias("sha"), "keep_id", "n"))
    joined = rows.join(groups, rows["text_sha256"] == groups["sha"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


# ---------------------------------------------------------------- the index as a table

def live_index(docs: DataFrame, shards: int = 64) -> DataFrame:
    """Index table (shard, digest, keep_id, live) of the live texts, to be written and updated by later batches.

    ``live`` is the number of rows that hold the text.
    """
    return digest_groups(docs).select(F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), "digest", "keep_id", F.col("n").alias("live"))


def update_index(index: DataFrame, inserts: DataFrame, deletes: DataFrame, shards: int = 64) -> DataFrame:
    """Index table after deleting the rows of ``deletes`` and inserting those of ``inserts``.

    A text leaves the index when its last row goes; deletions of texts that are
    not there are ignored.  A text that is already live keeps its ``keep_id``,
    which names the row that stayed first, also if that row is deleted while
    others live.  ``shards`` must be the number the index was made with and is
    chosen so that one shard fits a task.
    """
    def change(rows: DataFrame, op: int) -> DataFrame:
        one = texts(rows).select(F.unhex(F.sha2("text", 256)).alias("digest"), F.col("doc_id").alias("keep_id"))
        return (one.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("live"))
                .select(F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), "digest", "keep_id", "live", F.lit(op).alias("op")))

    def apply(key, live: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
        held = CuckooIndex()
        for k, doc, n in zip(live["digest"], live["keep_id"], live["live"], strict=True):
            held.insert(bytes(k), (None if pd.isna(doc) else int(doc), int(n)))
        for k, doc, n, op in changes.sort_values("op")[["digest", "keep_id", "live", "op"]].itertuples(index=False):
            k = bytes(k)
            slot = held.find(k)
            if op and slot < 0:
                held.insert(k, (None if pd.isna(doc) else int(doc), int(n)))
            elif slot >= 0:
                first, rows = held.values[slot]
                left = rows + int(n) if op else rows - int(n)
                if left > 0:
                    held.values[slot] = (first, left)
                else:
                    held.delete(k)
        items = list(held.items())
        return pd.DataFrame({"shard": pd.array([key[0]] * len(items), "Int32"), "digest": [k for k, _ in items],
                             "keep_id": pd.array([v[0] for _, v in items], "Int64"), "live": pd.array([v[1] for _, v in items], "Int64")})

    changes = change(deletes, 0).unionByName(change(inserts, 1))
    return (index.select("shard", "digest", "keep_id", "live").groupBy("shard").cogroup(changes.groupBy("shard"))
            .applyInPandas(apply, "shard int, digest binary, keep_id long, live long"))
