"""Packed token ids as binary rows: id matrices, cumulative segment lengths and position resets.

Each task tokenises its own documents in windows of about ``window_tokens``
ids, cuts documents longer than a sequence into pieces without loss, and
packs the window by best-fit decreasing; a segment tree over the remaining
capacities finds the tightest sequence with room.  Nothing is shuffled and no
task holds more than one window, so a hot source or a very long text does not
matter; each window has at most its own last sequences unfilled.

A row is one sequence: ``ids`` is a row of the id matrix (little-endian,
16 bits if the vocabulary allows, padded to the full length), ``cu_seqlens``
the cumulative segment lengths from 0, ``resets`` the places where position
ids start at 0 again, and doc_ids, pieces and starts say what each segment
is.  ``position_ids`` and ``segments`` read a row back.

Defined results: null text is the empty text, one end id long.  Null doc_ids
and repeated rows are packed like others.  An empty table writes no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tablewright.llm import tokens
from tablewright.llm.common import texts

SIZE = 1024
PAD_ID = 50256


class CapacityTree:
    """Segment tree over capacities 0..size: each node counts the open sequences below it."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, sequence) of the smallest capacity of at least ``need``; it leaves the tree."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):     # up to a right sibling that has one
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:                                      # down to its smallest
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return capacity, self.open[capacity].pop()


def pack_window(lengths: list[int], size: int) -> list[list[int]]:
    """Members of each sequence, by best-fit decreasing."""
    tree, out = CapacityTree(size), []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[i])
        room, b = found if found else (size, len(out))
        if not found:
            out.append([])
        out[b].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], b)
    return out


_SCHEMA = ("sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, "
           "doc_ids array<long>, pieces array<int>, starts array<long>")


def packed_rows(docs: DataFrame, size: int = SIZE, tokenizer: str = "byte_bpe_50k", pad_id: int = PAD_ID,
                end_id: int = tokens.END_ID, window_tokens: int = 4_000_000, dtype: str = "<u2") -> DataFrame:
    """One row per packed sequence; see the module's text."""

    def sequences(held: list, first: int) -> pd.DataFrame:
        rows = []
        for members in pack_window([len(h[3]) for h in held], size):
            cu = np.concatenate(([0], np.cumsum([len(held[i][3]) for i in members])))
            ids = np.full(size, pad_id, dtype)
            ids[:cu[-1]] = np.concatenate([held[i][3] for i in members])
            rows.append((first + len(rows), int(cu[-1]), ids.tobytes(), cu.astype(np.int32), cu[:-1].astype(np.int32),
                         [held[i][0] for i in members], [held[i][1] for i in members], [held[i][2] for i in members]))
        return pd.DataFrame(rows, columns=["sequence_id", "n_tokens", "ids", "cu_seqlens", "resets", "doc_ids", "pieces", "starts"])

    def pack(batches):
        done, held, n = TaskContext.get().partitionId() << 32, [], 0
        for x in batches:
            for doc, text in zip(x["doc_id"].astype("Int64"), x["text"], strict=True):
                doc = None if doc is pd.NA else int(doc)
                ids = tokens.document_ids(text, tokenizer, end_id).astype(dtype)
                for k, (start, m) in enumerate(tokens.cut(len(ids), size)):
                    held.append((doc, k, start, ids[start:start + m]))
                    n += m
                    if n >= window_tokens:
                        out = sequences(held, done)
                        done, held, n = done + len(out), [], 0
                        yield out
        if held:
            yield sequences(held, done)

    return texts(docs).mapInPandas(pack, _SCHEMA)


def write_token_binary(docs: DataFrame, path: str, **options) -> None:
    """Writes the packed rows as Parquet under ``path``."""
    packed_rows(docs, **options).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def position_ids(n_tokens: int, resets: np.ndarray) -> np.ndarray:
    """Position of every token in its segment, from the resets of a row."""
    start = np.zeros(n_tokens, np.int64)
    start[resets] = resets
    return np.arange(n_tokens) - np.maximum.accumulate(start)


def segments(rows: DataFrame, dtype: str = "<u2") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every segment, read from packed rows.

    Segments end where position ids restart; ``cu_seqlens`` must agree.
    """
    def read(batches):
        for x in batches:
            out = []
            for r in x.itertuples(index=False):
                position = position_ids(r.n_tokens, np.asarray(r.resets))
                begin = np.flatnonzero(position == 0)
                if not np.array_equal(np.append(begin, r.n_tokens), np.asarray(r.cu_seqlens)):
                    raise ValueError(f"segment lengths and position resets of sequence {r.sequence_id} differ")
                ids = np.frombuffer(r.ids, dtype).astype("<u4")
                for doc, piece, start, a, b in zip(r.doc_ids, r.pieces, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
                    out.append((doc, piece, start, b - a, zlib.crc32(ids[a:b].tobytes()), r.sequence_id, a))
            p = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
            yield p.astype({"doc_id": "Int64", "piece": "int32", **{c: "int64" for c in p.columns[2:]}})

    return rows.mapInPandas(read, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
