"""Best-fit packing with certified bounds.

Documents are tokenised and cut in the map stage; only (doc_id, piece,
start, length, crc) of each piece goes on, a few dozen bytes, so no task
holds texts or ids of others.

1. Pieces of full length are sequences by themselves.  The others are dealt
   evenly over partitions of about ``per_part`` pieces, whatever their source.
2. Each partition is packed by best-fit decreasing, and its bin count is
   compared with a lower bound from dual feasible functions (the family
   f_a that rounds lengths above ``size - a`` up to ``size``, drops those
   below ``a`` and keeps the rest, over all ``a``; and the family u_k that
   rounds to multiples of 1/k).
3. A partition at its bound is certified: its sequences are final, but for the
   emptiest one, since the bounds of parts may add up to one sequence a part
   more than the bound of the whole.  Of a partition with a gap the full
   sequences are final; the documents of the others are exchanged: mixed, dealt
   out over fewer partitions together with those emptiest ones, and packed
   again.  A partition's new packing is taken only if it has fewer bins than its
   documents came in.  Rounds go on until nothing is open, the total reaches the
   bound of the whole, or a round gains nothing.

Tables of pieces are written to the shared folder between rounds.  Nothing is
dropped: whatever the rounds do, every piece is in exactly one sequence.

Defined results: null text packs as the empty text (one id).  Repeated rows
are packed each.  A null doc_id is packed like any other.  An empty table
gives no rows.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import tokens
from tablewright.llm.common import in_slices, texts
from tablewright.session import cut_lineage

SIZE = 1024


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of every length, and the number of bins.

    Open bins are kept by remaining room; a bit set of the rooms that occur
    finds the tightest one in a step.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms, used = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, used = size, used, used + 1
        bins[i], offset[i] = b, size - room
        rest = room - n
        if rest:
            by_room[rest].append(b)
            rooms |= 1 << rest
    return bins, offset, used


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Bins that any packing needs: the best of two families of dual feasible functions.

    ``counts[n]`` is the number of pieces of length n, for n up to ``size``.
    """
    n = np.arange(size + 1)
    total = int(counts.sum())
    best = -(-int(counts @ n) // size)
    cum, cum_len = np.cumsum(counts), np.cumsum(counts * n)
    for a in range(0, size // 2 + 1):                          # f_a
        large = total - int(cum[size - a])
        middle = int(cum_len[size - a]) - (int(cum_len[a - 1]) if a else 0)
        best = max(best, large + -(-middle // size))
    for k in range(1, 101):                                    # u_k: exact multiples of 1/(k+1) keep their value
        up = (k + 1) * n
        value = np.where(up % size == 0, n * k, (up // size) * size)
        best = max(best, -(-int(counts @ value) // (k * size)))
    return best


def pieces(docs: DataFrame, size: int = SIZE, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; one map pass over whole texts."""
    def tokenize(batches):
        for x in batches:
            out = []
            for doc, text in zip(x["doc_id"].astype("Int64"), x["text"], strict=True):
                ids = tokens.document_ids(text, tokenizer)
                for k, (start, n) in enumerate(tokens.cut(len(ids), size)):
                    out.append((doc, k, start, n, zlib.crc32(ids[start:start + n].tobytes())))
            p = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield p.astype({"doc_id": "Int64", "piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return texts(docs).mapInArrow(in_slices(tokenize, schema=schema), schema)


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"


def _pack_round(pool: DataFrame, parts: int, round_: int, size: int) -> DataFrame:
    """Deals the pieces of ``pool`` over ``parts`` groups, packs each, keeps the old bins where the new ones are not fewer."""
    def pack(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        n = x["length"].to_numpy(np.int64)
        bins, offset, used = best_fit_decreasing(n, size)
        if round_ == 0 or used < x["sequence_id"].nunique():
            x["sequence_id"] = bins + (np.int64(round_) << 56) + (np.int64(key[0]) << 32)
            x["offset"] = offset
            x["fill"] = np.bincount(bins, weights=n, minlength=used).astype(np.int64)[bins]
        x["bound"] = lower_bound(np.bincount(n, minlength=size + 1), size)
        return x[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill", "part", "bound"]]

    # whole old bins stay together, and a first round deals single pieces, by row: equal ones do not meet
    key = F.xxhash64(F.monotonically_increasing_id()) if round_ == 0 else F.xxhash64("sequence_id", F.lit(round_))
    dealt = pool.withColumn("part", F.pmod(key, F.lit(parts)).cast("int"))
    return cut_lineage(dealt.groupBy("part").applyInPandas(pack, _PACKED + ", part int, bound long"))


def pack_documents(docs: DataFrame, size: int = SIZE, tokenizer: str = "byte_bpe_50k", per_part: int = 200_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of ``docs``."""
    cut = cut_lineage(pieces(docs, size, tokenizer))
    names = cut.columns
    full = cut.where(F.col("length") == size).select(
        *names, (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool = cut.where(F.col("length") < size)
    hist = np.zeros(size + 1, np.int64)
    for r in pool.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():      # at most ``size`` rows
        hist[r["length"]] = r["n"]
    return full.unionByName(pack_pieces(pool, hist, size, per_part))


def pack_pieces(pool: DataFrame, hist: np.ndarray, size: int, per_part: int) -> DataFrame:
    """The pieces of ``pool``, all shorter than ``size`` (``hist`` has their lengths' counts), with sequence_id and offset."""
    spark, names = pool.sparkSession, pool.columns
    columns = [*names, "sequence_id", "offset"]
    open_ = pool.select(*names, *[F.lit(None).cast("long").alias(c) for c in ("sequence_id", "offset", "fill")])
    goal, came, settled = lower_bound(hist, size), None, []
    parts, round_ = max(1, -(-int(hist.sum()) // per_part)), 0
    while True:
        packed = _pack_round(open_, parts, round_, size)
        bins = packed.groupBy("part", "sequence_id").agg(F.first("fill").alias("fill"), F.first("bound").alias("bound"))
        state = bins.groupBy("part").agg(F.count(F.lit(1)).alias("bins"), F.first("bound").alias("bound"), F.count(F.when(F.col("fill") == size, 1)).alias("full"),
                                         F.min(F.struct("fill", "sequence_id")).alias("emptiest")).collect()      # a row a partition
        total = sum(r["bins"] for r in state)
        certified = {r["part"]: r["emptiest"] for r in state if r["bins"] == r["bound"]}
        left = sum((certified[r["part"]]["fill"] < size) if r["part"] in certified else r["bins"] - r["full"] for r in state)
        if total <= goal or left < 2 or (came is not None and total >= came):
            return reduce(lambda a, b: a.unionByName(b), [*settled, packed.select(*columns)])
        kept = spark.createDataFrame([(p, e["sequence_id"]) for p, e in certified.items()], "certified int, emptiest long")
        seen = packed.join(F.broadcast(kept), F.col("part") == F.col("certified"), "left")
        final = (F.col("fill") == size) | (F.col("certified").isNotNull() & (F.col("sequence_id") != F.col("emptiest")))
        settled.append(seen.where(final).select(*columns))
        open_ = seen.where(~final).select(*columns, "fill")
        goal, came, round_ = goal - (total - left), left, round_ + 1
        parts = max(1, min(parts - 1, -(-open_.count() // per_part)))
