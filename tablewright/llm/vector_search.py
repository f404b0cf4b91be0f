"""Approximate nearest neighbours: one HNSW graph per shard, results merged.

Nearness is the largest inner product.  A shard holds vectors of like norms,
within a factor of two of each other, scaled by a power of two near them.  They
get one more component, sqrt(R^2 - |x|^2) for the shard's largest norm R, which
makes the largest inner product the smallest Euclidean distance; the graph is
built on these.  So neither a few long vectors nor a wide range of norms hides
the differences of the others, and nothing overflows.

Equal vectors are one node of a graph, which carries their ``k + 1`` smallest
ids; no result needs more of them.  Both the nodes and the queries are
grouped in parts of about ``group_part`` rows first, so a vector with a third
of the rows is no task's work.  Equal queries of a part are searched once.

Nodes of a band of norms are dealt to its shards by a hash of their smallest
id, about ``per_shard`` each, so neither a cluster nor a hot source makes a
large shard.  A shard's
graph is flat arrays: ids, vectors, and per level a (nodes x degree) array of
neighbour positions, -1 where there is none.  It is built in growing batches:
the batch's nodes search the graph of the earlier ones in step (vectorised
beam search), see each other by a block of inner products, keep neighbours by
the usual diversity rule, and link back.

Queries are every row whose id is divisible by ``every``.  Blocks of about
``block`` different queries meet each shard: a task loads the graph once and the
block's queries stream to it.  The ``k + 1`` nearest nodes of a pair (query,
shard) are expanded to their ids, of which the first ``k + 1`` are merged per
query; a query for which the graph gives fewer nodes than that, though the shard
has them, is compared with the whole shard.  Scores are inner products of the
original vectors in double precision.

Defined results: null, empty or zero vectors, and those with null or
non-finite components, take no part.  Vectors of another length than the most
frequent one (ties: the longer) take no part either.  Rows that repeat an id
are one row, that with the smallest vector.  Null ids take no part.  With
fewer than ``k`` candidates in all, all found are returned.  Ties go to the
smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import cut_lineage


def _exponent(x: np.ndarray, axis=None) -> np.ndarray:
    """Power of two just above the largest component."""
    return np.frexp(np.abs(x).max(axis=axis, initial=0.0))[1]


def _directions(x: np.ndarray) -> np.ndarray:
    """Rows at unit length, whatever their size."""
    x = np.ldexp(x, -_exponent(x, 1)[:, None])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class FlatHnsw:
    """A graph over up to a few ten thousand vectors, as flat neighbour arrays per level."""

    def __init__(self, degree: int = 16, ef: int = 96, seed: int = 11):
        self.m, self.ef, self.seed = degree, ef, seed
        self.links: list[np.ndarray] = []                  # level 0 holds 2 * degree neighbours per node
        self.rows: list[np.ndarray] = []                   # nodes of each level, ascending
        self.slot: list[np.ndarray] = []                   # node -> row of its level, -1 if it is not there

    # ---- building

    def build(self, vectors: np.ndarray) -> "FlatHnsw":
        x = np.asarray(vectors, np.float64)
        x = np.ldexp(x, -_exponent(x))                     # the largest component is between 1/2 and 1: squares stay finite
        square = (x * x).sum(axis=1)
        top = square.max(initial=0.0)
        self.x = np.concatenate((x, np.sqrt(np.maximum(top - square, 0.0))[:, None]), axis=1).astype(np.float32)
        n = len(x)
        order = np.random.default_rng(self.seed)
        level = np.minimum((-np.log(1.0 - order.random(n)) / np.log(self.m)).astype(int), 6)
        if n:
            level[0] = level.max()                         # the entry point
        for k in range(int(level.max(initial=0)) + 1):
            rows = np.flatnonzero(level >= k)
            slot = np.full(n, -1, np.int64)
            slot[rows] = np.arange(len(rows))
            self.rows.append(rows)
            self.slot.append(slot)
            self.links.append(np.full((len(rows), self.m * (2 if k == 0 else 1)), -1, np.int32))
        done = 1
        while done < n:
            batch = np.arange(done, min(n, done + max(1, min(512, done))))
            self._insert(batch, level[batch], done)
            done = int(batch[-1]) + 1
        return self

    def _insert(self, batch: np.ndarray, level: np.ndarray, known: int) -> None:
        q = self.x[batch]
        entry = np.zeros(len(batch), np.int64)
        for k in range(len(self.rows) - 1, -1, -1):
            at = level >= k
            if not at.all():
                entry[~at] = self._beam(q[~at], entry[~at][:, None], k, 1)[0][:, 0]
            if not at.any():
                continue
            ids, dist = self._beam(q[at], entry[at][:, None], k, self.ef)
            entry[at] = ids[:, 0]
            own = batch[at]
            width = min(len(own) - 1, 2 * self.m)
            if width > 0:                                  # the batch's nodes see each other
                d = self._block_distance(q[at], q[at])
                np.fill_diagonal(d, np.inf)
                near = np.argpartition(d, width - 1, axis=1)[:, :width]
                ids = np.concatenate((ids, own[near]), axis=1)
                dist = np.concatenate((dist, np.take_along_axis(d, near, axis=1)), axis=1)
            kept = self._diverse(own, ids, dist, self.links[k].shape[1] if k else self.m + self.m // 2)
            self.links[k][self.slot[k][own], :kept.shape[1]] = kept
            self._link_back(own, kept, k)

    @staticmethod
    def _block_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)).astype(np.float32)

    def _diverse(self, own: np.ndarray, ids: np.ndarray, dist: np.ndarray, m: int) -> np.ndarray:
        """Up to ``m`` neighbours of each node: nearest first, none that is nearer to a kept one; then filled with the nearest."""
        order = np.argsort(dist, axis=1, kind="stable")[:, :3 * m]
        ids, dist = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
        ok = np.isfinite(dist) & (ids >= 0)
        v = self.x[np.maximum(ids, 0)]
        among = ((v * v).sum(axis=2)[:, :, None] + (v * v).sum(axis=2)[:, None, :] - 2.0 * np.einsum("qid,qjd->qij", v, v))
        kept = np.zeros(ids.shape, bool)
        count = np.zeros(len(ids), np.int64)
        for j in range(ids.shape[1]):
            nearer = (kept & (among[:, j, :] < dist[:, j, None])).any(axis=1)
            take = ok[:, j] & ~nearer & (count < m)
            kept[:, j] = take
            count += take
        rank = np.where(kept, 0, np.where(ok, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        best = np.argsort(rank, axis=1)[:, :m]
        out = np.take_along_axis(ids, best, axis=1).astype(np.int32)
        out[~np.take_along_axis(ok, best, axis=1)] = -1
        return out

    def _link_back(self, own: np.ndarray, kept: np.ndarray, k: int) -> None:
        links, slot = self.links[k], self.slot[k]
        src, dst = np.repeat(own, kept.shape[1]), kept.ravel().astype(np.int64)
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        for a in range(0, len(nodes), 512):
            node, f, c = nodes[a:a + 512], first[a:a + 512], count[a:a + 512]
            width = int(c.max())
            new = np.full((len(node), width), -1, np.int64)
            fill = np.arange(width)[None, :] < c[:, None]
            new[fill] = src[np.concatenate([np.arange(i, i + j) for i, j in zip(f, c, strict=True)])]
            old = links[slot[node]].astype(np.int64)
            new[(new[:, :, None] == old[:, None, :]).any(axis=2)] = -1
            ids = np.concatenate((old, new), axis=1)
            d = ((self.x[np.maximum(ids, 0)] - self.x[node][:, None, :]) ** 2).sum(axis=2)
            d[ids < 0] = np.inf
            links[slot[node]] = self._diverse(node, ids, d, links.shape[1])

    # ---- searching

    def _beam(self, q: np.ndarray, entry: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step: (ids, squared distances), nearest first, -1 where fewer were found."""
        links, slot, n = self.links[k], self.slot[k], len(q)
        ids = np.full((n, ef), -1, np.int64)
        dist = np.full((n, ef), np.inf, np.float32)
        opened = np.ones((n, ef), bool)
        w = entry.shape[1]
        ids[:, :w], opened[:, :w] = entry, False
        dist[:, :w] = ((self.x[entry] - q[:, None, :]) ** 2).sum(axis=2)
        seen = np.zeros((n, len(self.rows[k])), bool)
        np.put_along_axis(seen, slot[entry], True, axis=1)
        live = np.arange(n)
        per_step = 1 if ef == 1 else 4
        while len(live):
            d = np.where(opened[live], np.inf, dist[live])
            pick = np.argsort(d, axis=1, kind="stable")[:, :per_step]
            fine = np.isfinite(np.take_along_axis(d, pick, axis=1))
            live, pick, fine = live[fine[:, 0]], pick[fine[:, 0]], fine[fine[:, 0]]
            if not len(live):
                break
            mark = opened[live]
            np.put_along_axis(mark, pick, True, axis=1)
            opened[live] = mark
            node = np.take_along_axis(ids[live], pick, axis=1)
            near = links[slot[np.maximum(node, 0)]].astype(np.int64)
            near[~fine] = -1
            near = near.reshape(len(live), -1)
            at = slot[np.maximum(near, 0)]
            known = np.take_along_axis(seen[live], at, axis=1) | (near < 0)
            flat = np.where(known, -1, near)
            order = np.argsort(flat, axis=1, kind="stable")          # one node may come from several
            flat = np.take_along_axis(flat, order, axis=1)
            flat[:, 1:][flat[:, 1:] == flat[:, :-1]] = -1
            row, col = np.nonzero(flat >= 0)
            new = flat[row, col]
            seen[live[row], slot[new]] = True
            diff = self.x[new] - q[live[row]]
            dn = np.full(flat.shape, np.inf, np.float32)
            dn[row, col] = np.einsum("ij,ij->i", diff, diff)
            all_ids = np.concatenate((ids[live], flat), axis=1)
            all_d = np.concatenate((dist[live], dn), axis=1)
            all_o = np.concatenate((opened[live], np.zeros(flat.shape, bool)), axis=1)
            best = np.argpartition(all_d, ef - 1, axis=1)[:, :ef] if all_d.shape[1] > ef else np.argsort(all_d, axis=1)
            ids[live], dist[live] = np.take_along_axis(all_ids, best, axis=1), np.take_along_axis(all_d, best, axis=1)
            opened[live] = np.take_along_axis(all_o, best, axis=1) | ~np.isfinite(dist[live])
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
        ids[~np.isfinite(dist)] = -1
        return ids, dist

    def search(self, queries: np.ndarray, ef: int, block: int = 256) -> np.ndarray:
        """(queries x ef) node positions by largest inner product, -1 where fewer were found."""
        out = []
        for a in range(0, len(queries), block):
            q = np.asarray(queries[a:a + block], np.float32)
            q = np.concatenate((q, np.zeros((len(q), 1), np.float32)), axis=1)
            entry = np.zeros(len(q), np.int64)
            for k in range(len(self.rows) - 1, 0, -1):
                entry = self._beam(q, entry[:, None], k, 1)[0][:, 0]
            out.append(self._beam(q, entry[:, None], 0, ef)[0])
        return np.concatenate(out) if out else np.zeros((0, ef), np.int64)

    # ---- stored form

    def arrays(self) -> dict:
        return {"vectors": self.x.tobytes(), "width": self.x.shape[1],
                "links": [a.tobytes() for a in self.links], "levels": [a.astype(np.int32).tobytes() for a in self.rows]}

    @classmethod
    def from_arrays(cls, vectors: bytes, width: int, links, levels) -> "FlatHnsw":
        g = cls()
        g.x = np.frombuffer(vectors, np.float32).reshape(-1, width)
        for link, level in zip(links, levels, strict=True):
            rows = np.frombuffer(level, np.int32).astype(np.int64)
            slot = np.full(len(g.x), -1, np.int64)
            slot[rows] = np.arange(len(rows))
            g.rows.append(rows)
            g.slot.append(slot)
            g.links.append(np.frombuffer(link, np.int32).reshape(len(rows), -1))
        return g


def clean_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part; v is array<double>."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))      # no -0.0: equal vectors have equal bits
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = (rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & good)
            .groupBy("vec_id").agg(F.min("v").alias("v")))
    return rows


def _parted(rows: DataFrame, n: int, group_part: int) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 + n // group_part)).cast("int"))


def distinct_vectors(vectors: DataFrame, n: int, keep: int, group_part: int = 512) -> DataFrame:
    """(vec_id, v, ids) of each different vector: its smallest id, and its ``keep`` smallest, ascending."""
    def smallest(ids: Column) -> Column:
        return F.slice(F.sort_array(ids), 1, keep)

    return (_parted(vectors, n, group_part).groupBy("v", "part").agg(smallest(F.collect_list("vec_id")).alias("ids"))
            .groupBy("v").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"))
            .select(F.col("ids")[0].alias("vec_id"), "v", "ids"))


def distinct_queries(queries: DataFrame, n: int, group_part: int = 512) -> DataFrame:
    """(vec_id, v, ids) of the equal queries of each part: their smallest id and all of them."""
    return (_parted(queries, n, group_part).groupBy("v", "part").agg(F.collect_list("vec_id").alias("ids"))
            .select(F.array_min("ids").alias("vec_id"), "v", "ids"))


_INDEX = "shard int, ids binary, copies binary, originals binary, vectors binary, width int, links array<binary>, levels array<binary>"


def _band(v: Column) -> Column:
    """Whole logarithm of the norm to base two; of the largest component where squares would leave a double's range."""
    square = F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x)
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.when(square.between(1e-280, 1e280), F.floor(F.log2(square) / 2)).otherwise(F.floor(F.log2(top))).cast("int")


def sharded(nodes: DataFrame, per_shard: int, least: int = 1) -> tuple[DataFrame, int]:
    """``nodes`` (with their band) with their shard, and the number of shards: each band of norms (there are at most some 2100) has its own.

    ``least`` shards share the rows if there are enough of them to give each a graph of some size.
    """
    counts = sorted((r["band"], r["count"]) for r in nodes.groupBy("band").count().collect())
    per_shard = min(per_shard, max(1024, -(-sum(n for _, n in counts) // least)))
    first, rows = 0, []
    for band, n in counts:
        rows.append((band, first, -(-n // per_shard)))
        first += rows[-1][2]
    plan = nodes.sparkSession.createDataFrame(rows, "of int, first int, parts int")
    placed = nodes.join(F.broadcast(plan), F.col("band") == F.col("of"))
    shard = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    return placed.select("vec_id", "v", "ids", shard.alias("shard")), first


def build_index(nodes: DataFrame, degree: int = 16, ef_build: int = 64) -> DataFrame:
    """One row per shard of the different vectors (vec_id, v, ids, shard): its graph as flat arrays, the ids of every
    node and their numbers, and the original vectors in double precision."""
    def build(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("vec_id")
        v = np.array(x["v"].tolist(), np.float64)
        g = FlatHnsw(degree, ef_build).build(v)
        return pd.DataFrame([{"shard": key[0], "ids": np.concatenate(x["ids"].tolist()).astype(np.int64).tobytes(),
                              "copies": x["ids"].map(len).to_numpy(np.int64).tobytes(), "originals": v.tobytes(), **g.arrays()}])

    return nodes.groupBy("shard").applyInPandas(build, _INDEX)


def nearest_nodes(graph: FlatHnsw, originals: np.ndarray, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs found in a shard: at least min(k, nodes) of every query."""
    at = graph.search(_directions(queries), max(ef, k))
    row, col = np.nonzero(at >= 0)
    node = at[row, col]
    short = np.flatnonzero((at >= 0).sum(axis=1) < min(k, len(originals)))
    if len(short):                                         # the graph did not reach enough: compare with all
        enough = ~np.isin(row, short)
        with np.errstate(over="ignore", invalid="ignore"):
            best = np.argsort(-(queries[short] @ originals.T), axis=1, kind="stable")[:, :k]
        row = np.concatenate((row[enough], np.repeat(short, best.shape[1])))
        node = np.concatenate((node[enough], best.ravel()))
    return row, node


def _searched(k: int, ef: int):
    """Streams (shard, block) runs: the graph's row first, then its queries."""
    def run(batches):
        import pyarrow as pa
        graph, where = None, None
        for b in batches:
            keys = list(zip(b.column("shard").to_pylist(), b.column("block").to_pylist(), b.column("kind").to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at] and end - at < 1024:
                    end += 1
                part = b.slice(at, end - at)
                if keys[at][2] == 0:
                    g = part.slice(0, 1).to_pylist()[0]
                    ids, copies = np.frombuffer(g["ids"], np.int64), np.frombuffer(g["copies"], np.int64)
                    graph = (FlatHnsw.from_arrays(g["vectors"], g["width"], g["links"], g["levels"]), ids, copies, np.cumsum(copies) - copies,
                             np.frombuffer(g["originals"]).reshape(len(copies), -1))
                    where = keys[at][:2]
                elif where == keys[at][:2]:
                    q = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    yield pa.RecordBatch.from_pandas(_hits(*graph, part.column("vec_id").to_numpy(), q, k, ef), preserve_index=False)
                at = end
    return run


def _hits(graph: FlatHnsw, ids, copies, start, originals, qid, qv, k: int, ef: int) -> pd.DataFrame:
    """The first ``k`` ids of the shard for each query."""
    row, node = nearest_nodes(graph, originals, qv, k, ef)
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.einsum("ij,ij->i", qv[row], originals[node])
    hit = pd.DataFrame({"row": row, "node": node, "vec_id": ids[start[node]], "score": score})
    order = {"by": ["row", "score", "vec_id"], "ascending": [True, False, True]}
    hit = hit.sort_values(**order).groupby("row").head(k)
    n = copies[hit["node"]]                                # the nodes' ids instead of the nodes
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    hit = hit.loc[hit.index.repeat(n)].reset_index(drop=True)
    hit["vec_id"] = ids[start[hit["node"]] + place]
    hit = hit.sort_values(**order).groupby("row").head(k)
    return hit.assign(query_id=qid[hit["row"]])[["query_id", "vec_id", "score"]].reset_index(drop=True)


def search_index(index: DataFrame, queries: DataFrame, shards: int, n_blocks: int, k: int = 20, ef: int = 96) -> DataFrame:
    """(query_id, vec_id, score): the first ``k`` ids of every shard for every query (vec_id, v), by score, then id."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    graphs = index.withColumn("block", blocks).withColumn("kind", F.lit(0))
    asked = (queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int").alias("block"), F.lit(1).alias("kind"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(1, shards) - 1)))))
    both = graphs.unionByName(asked, allowMissingColumns=True).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")
    return both.mapInArrow(_searched(k, ef), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, per_shard: int = 8192, block: int = 16384,
            id_col: str = "vec_id", vector_col: str = "embedding", group_part: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found."""
    rows = cut_lineage(clean_vectors(vectors, id_col, vector_col))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width, n = (sizes[0]["n"], sizes[0]["count"]) if sizes else (1, 0)
    rows = rows.where(F.size("v") == width)
    nodes = cut_lineage(distinct_vectors(rows, n, k + 1, group_part).withColumn("band", _band(F.col("v"))))
    queries = cut_lineage(distinct_queries(rows.where(F.col("vec_id") % every == 0), n, group_part))
    placed, shards = sharded(nodes, per_shard, nodes.sparkSession.sparkContext.defaultParallelism)
    index = cut_lineage(build_index(placed))
    n_blocks = max(1, -(-queries.count() // block))
    found = search_index(index, queries, shards, n_blocks, k + 1)       # one more, since a query may find itself
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = (found.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k + 1).groupBy("query_id")
            .agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("best")))
    each = (best.join(queries.select(F.col("vec_id").alias("first"), "ids"), F.col("query_id") == F.col("first"))
            .select(F.explode("ids").alias("query_id"), "best"))
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (each.select("query_id", F.posexplode(others).alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")))
