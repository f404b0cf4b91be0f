"""Shared helpers of the llm operators: column selection, sizing, graph components, Bloom filter, text hashing."""

from __future__ import annotations

import functools
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tablewright.session import cut_lineage, scratch

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a given table; files are read by Spark only, so any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of a documents table; null text counts as empty, other columns are dropped."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def in_slices(f, rows: int = 512, schema: str | None = None):
    """A function over small pandas frames, for ``mapInArrow``: a worker turns few texts at a time into Python strings.

    ``schema`` types the results; without it the types are those of the frames.
    """
    typed = to_arrow_schema(StructType.fromDDL(schema)) if schema else None

    def run(batches):
        import pyarrow as pa
        small = (b.slice(a, rows).to_pandas(integer_object_nulls=True) for b in batches for a in range(0, b.num_rows, rows))
        for out in f(small):
            yield pa.RecordBatch.from_pandas(out, schema=typed, preserve_index=False)
    return run


def parts_for(rows: int, per_part: int, spark: SparkSession) -> int:
    """Partitions that hold ``per_part`` rows each, at least the session's parallelism."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // per_part))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the smallest node reachable.

    Contraction: every node takes the smallest id among itself and its
    neighbours, edges are rewritten to those ids, and the rounds go on until
    no edge joins two ids.  Each round is one combinable aggregate and three
    equi-joins (skewed keys are split by AQE), and its tables are written to
    the shared folder and removed at the end.  Null ends and self loops are
    allowed.
    """
    with scratch(edges.sparkSession) as keep:
        edges = cut_lineage(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).dropna().distinct())
        labels = cut_lineage(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
                             .select("node", F.col("node").alias("component")))
        while True:
            open_ = edges.where("u <> v")
            if open_.isEmpty():
                return keep(labels)
            both = open_.select("u", "v").union(open_.select(F.col("v"), F.col("u")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("old"), F.least("u", "m").alias("new"))
            low = cut_lineage(low)
            labels = cut_lineage(labels.join(low, labels["component"] == low["old"], "left")
                                 .select("node", F.coalesce("new", "component").alias("component")))
            a, b = low.alias("a"), low.alias("b")
            edges = cut_lineage(open_.join(a, F.col("u") == F.col("a.old")).join(b, F.col("v") == F.col("b.old"))
                                .select(F.col("a.new").alias("u"), F.col("b.new").alias("v")).where("u <> v").distinct())


# ---------------------------------------------------------------- hashing

def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on a uint64 array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


@functools.cache
def _powers(n_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < 2**n_bits, and a random word for each byte value."""
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    n = 1 << n_bits
    up, down = np.ones(n, U64), np.ones(n, U64)
    with np.errstate(over="ignore"):
        for k in range(n_bits):
            h = 1 << k
            up[h:2 * h] = up[:h] * U64(pow(base, h, 1 << 64))
            down[h:2 * h] = down[:h] * U64(pow(inverse, h, 1 << 64))
    return up, down, mix64(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))


_FACTORS = [int(mix64(np.array([i + 1], U64) * U64(0x9E3779B97F4A7C15))[0]) >> 8 | 1 for i in range(8)]

#: ASCII blanks \x20 \x09-\x0D separate words; A-Z are lowered, nothing else is changed.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BLOCK_BITS = 18


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hash of every word of a UTF-8 text, in order, in numpy over the bytes.

    A word's hash is a polynomial over its bytes, taken as a difference of
    prefix sums; texts beyond 256 KiB go in blocks cut at a blank (a longer
    word is hashed with a larger table).
    """
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    out, at, step = [], 0, 1 << _BLOCK_BITS
    while at < len(b):
        end = min(len(b), at + step)
        bits = min(_BLOCK_BITS, max(17, int(end - at).bit_length()))
        if end < len(b):
            gap = np.flatnonzero(_SPACE[b[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:
                nxt = np.flatnonzero(_SPACE[b[end:]])
                end = end + int(nxt[0]) if len(nxt) else len(b)
                bits = int(end - at).bit_length()
        out.append(_block_hashes(b[at:end], bits))
        at = end
    return np.concatenate(out) if out else np.zeros(0, U64)


def _block_hashes(b: np.ndarray, bits: int) -> np.ndarray:
    up, down, byte = _powers(bits)
    inside = np.concatenate(([False], ~_SPACE[b], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(byte[b] * up[:len(b)], dtype=U64)))
        return mix64((total[end] - total[start]) * down[start] + (end - start).astype(U64))


def shingle_set(raw: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words make one shingle, none an empty set."""
    w = word_hashes(raw)
    if not len(w):
        return w
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, U64)
    with np.errstate(over="ignore"):
        for i in range(k):                                 # word hashes are mixed: a sum with odd factors keeps their order
            h += w[i:n + i] * U64(_FACTORS[i % 8] + 16 * (i // 8))
        h = mix64(h)
    return np.unique(h)


# ---------------------------------------------------------------- blocked Bloom filter

class BlockedBloom:
    """Bloom filter in blocks of 512 bits (eight 64-bit words): all probes of a key fall into one block."""

    def __init__(self, words: np.ndarray, probes: int = 6):
        self.words, self.probes = words, probes

    @staticmethod
    def blocks_for(keys: int, max_bytes: int = 64 << 20, bits_per_key: int = 16) -> int:
        """Number of blocks, bounded by ``max_bytes`` however many keys there are."""
        return max(1, min(max_bytes // 64, -(-keys * bits_per_key // 512)))

    @staticmethod
    def places(h: np.ndarray, blocks: int, probes: int = 6):
        """Word index and bit mask of every probe of uint64 hashes."""
        with np.errstate(over="ignore"):
            block, g = h % U64(blocks), mix64(h ^ U64(0xD6E8FEB86659FD93))
        for k in range(probes):
            bit = (g >> U64(9 * k)) & U64(511)
            yield block * U64(8) + (bit >> U64(6)), U64(1) << (bit & U64(63))

    def has(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for at, mask in self.places(h, len(self.words) // 8, self.probes):
            ok &= (self.words[at] & mask) != 0
        return ok

    @classmethod
    def build(cls, keys: DataFrame, column: str, n_keys: int, max_bytes: int = 64 << 20, probes: int = 6) -> "BlockedBloom":
        """Filter over a long column: words are OR-ed by Spark; only the bounded bit array reaches the driver."""
        import pandas as pd
        blocks = cls.blocks_for(n_keys, max_bytes)

        def words(batches):
            for x in batches:
                h = x[column].to_numpy(np.int64).view(U64)
                for at, mask in cls.places(h, blocks, probes):
                    yield pd.DataFrame({"at": at.astype(np.int64), "mask": mask.view(np.int64)})

        rows = (keys.select(column).dropna().mapInPandas(words, "at long, mask long")
                .groupBy("at").agg(F.expr("bit_or(mask)").alias("mask")).toPandas())
        out = np.zeros(blocks * 8, U64)
        out[rows["at"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(U64)
        return cls(out, probes)


# ---------------------------------------------------------------- tokenizer files

def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on this machine (every executor has the package)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def quiet_threads() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
