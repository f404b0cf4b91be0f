"""N-gram Jaccard join by T-occurrence search.

Documents are sets of word shingles; two link when their Jaccard similarity
reaches ``numer / denom``.  A pair of sets with n and m shingles must then
share at least T = ceil(numer * (n + m) / (numer + denom)) of them.

The work goes in four map passes over the texts and narrow shuffles between:

1. Every text becomes (doc_id, class, size).  A class is a set: texts with
   equal sets have one class (a 64-bit hash of the set and its size), so
   copies are never expanded into pairs.
2. Long inverted lists: shingles are counted exactly in the lower
   ``count_share`` of the hash space.  The (at most ``max_long``) most
   frequent ones with ``long_list`` or more occurrences are the long lists.
   They only shape the order below; any choice of them gives the same links.
3. Short lists: a fixed order takes shingles by hash, those of long lists
   last.  Two linked sets share one of the first n - ceil(n * numer/denom) + 1
   shingles of each, so only these enter inverted lists, which Spark groups.
   - Lists up to ``pair_list`` classes are merged: occurrences are summed per
     pair of classes, and a pair stays only if its count, plus what may follow
     its last common shingle, can still reach T.
   - Longer lists, and long lists that do occur in a prefix, chain their
     classes to the first one.  Nothing is dropped and no pairs are made.
4. Connected candidates are the search groups.  Their whole sets are dealt
   into blocks by size; pairs of blocks whose sizes can match meet in a task.
   There DivideSkip runs each set as a query against the block's inverted
   lists: its longest lists are set aside, the short ones are heap-merged,
   classes with T - L occurrences are kept, and those are probed in the long
   lists by binary search.  Classes that reach T are linked.  Classes that
   the query is already connected with are taken out of the lists, so a task emits at most one link per
   class (a spanning forest), however dense a group is.

Components of the links, by contraction (``connected_components``), give each
document the smallest doc_id it reaches.

Memory of a task is bounded by two blocks of about ``block_shingles`` and
``block_sets``, or by one larger set.  Nothing but the long-list hashes
(``max_long``) and a Bloom filter of bounded size reaches the driver.

Defined results: null text counts as empty; a document without words has size
0 and its own doc_id.  Repeated rows are in one class.  A null doc_id counts
only if its component has no other.  Columns besides doc_id and text are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import U64, BlockedBloom, connected_components, in_slices, mix64, shingle_set, texts
from tablewright.session import cut_lineage, scratch

NUMER, DENOM, WORDS = 80, 100, 5
_ALL = (1 << 64) - 1
#: Shingles and entries that a worker holds before it sends them: a flush makes some five copies of them.
_HELD_SHINGLES, _HELD_ENTRIES = 200_000, 100_000
#: Stands for a null doc_id where one document of a class is chosen.
_NO_ID = -(1 << 62)


def required_overlap(n: int, m: int, numer: int = NUMER, denom: int = DENOM) -> int:
    """Least intersection of sets of n and m with denom * inter >= numer * union."""
    return -(-numer * (n + m) // (numer + denom))


def prefix_length(n: int, numer: int = NUMER, denom: int = DENOM) -> int:
    return n - -(-numer * n // denom) + 1


def class_of(shingles: np.ndarray) -> int:
    """63-bit id of a set: the sum of its (mixed) hashes, mixed with the size."""
    if not len(shingles):
        return 0
    x = (int(shingles.sum(dtype=U64)) + len(shingles) * 0x9E3779B97F4A7C15) & _ALL
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return (x ^ (x >> 31)) >> 1


# ---------------------------------------------------------------- DivideSkip

class InvertedBlock:
    """Inverted lists of a block of sets: for each shingle the ascending positions of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        owner = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
        every = np.concatenate(sets) if sets else np.zeros(0, U64)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.keys, self.first = np.unique(every[order], return_index=True)
        self.end = np.append(self.first[1:], len(owner))
        self.sizes = np.array([len(s) for s in sets], np.int64)

    def lists(self, query: np.ndarray) -> list[np.ndarray]:
        """The query's lists that are not empty, shortest first."""
        if not len(self.keys):
            return []
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        found = [self.owner[a:b] for a, b in zip(self.first[at].tolist(), self.end[at].tolist(), strict=True)]
        return sorted(found, key=len)

    def search(self, query: np.ndarray, known: np.ndarray | None = None, numer: int = NUMER, denom: int = DENOM):
        """Positions of the sets that link with ``query``, but for those marked in ``known``."""
        n = len(query)
        lists = self.lists(query)
        need = -(-numer * n // denom)                     # T for the smallest set that can match
        if len(lists) < need:
            return
        long_ = lists[len(lists) - (need - 1):] if need > 1 else []
        short = lists[:len(lists) - len(long_)]
        if known is not None:
            short = [x[~known[x]] for x in short]
        for at, run in groupby(heapq.merge(*[x.tolist() for x in short if len(x)])):
            m = int(self.sizes[at])
            t = required_overlap(n, m, numer, denom)
            if min(n, m) < t:
                continue
            count = sum(1 for _ in run)
            left = len(long_)
            if count + left < t:
                continue
            for x in reversed(long_):                     # binary search, until T is reached or out of reach
                if count >= t or count + left < t:
                    break
                left -= 1
                k = int(x.searchsorted(at))
                count += k < len(x) and int(x[k]) == at
            if count >= t:
                yield at


def block_links(ids: np.ndarray, sets: list[np.ndarray], blocks: np.ndarray, same: bool,
                numer: int = NUMER, denom: int = DENOM) -> list[tuple[int, int]]:
    """Spanning links among sets of one block (``same``) or between the first and the second block."""
    left = np.flatnonzero(blocks == blocks.min())
    right = left if same else np.flatnonzero(blocks == blocks.max())
    index = InvertedBlock([sets[i] for i in right])
    root, out = np.arange(len(ids)), []                   # component of every set so far
    for i in left.tolist():
        for at in index.search(sets[i], root[right] == root[i], numer, denom):
            j = int(right[at])
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


# ---------------------------------------------------------------- passes over the texts

def document_classes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, class, n_shingles) of every row; class 0 is the empty set."""
    def classes(batches):
        for x in batches:
            sets = [shingle_set(t.encode("utf-8", "surrogatepass"), words) for t in x["text"]]
            yield pd.DataFrame({"doc_id": x["doc_id"].astype("Int64"), "class": [class_of(s) for s in sets],
                                "n_shingles": [len(s) for s in sets]}).astype({"class": "int64", "n_shingles": "int64"})

    return texts(docs).mapInArrow(in_slices(classes), "doc_id long, class long, n_shingles long")


def _once(x: pd.DataFrame, words: int, seen: set):
    """(class, set) of the texts of a batch, each class once per task as far as ``seen`` remembers."""
    for t in x["text"]:
        s = shingle_set(t.encode("utf-8", "surrogatepass"), words)
        if len(s):
            c = class_of(s)
            if c not in seen:
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(c)
                yield c, s


def long_lists(docs: DataFrame, shingles: int, words: int, long_list: int, max_long: int, count_share: float) -> np.ndarray:
    """Sorted hashes of the most frequent shingles in the lower part of the hash space, by exact counts.

    Each task sends its shingles as packed runs, one per slice of the hash
    space (about two million counted shingles each), with repeats within the
    task counted once per class.
    """
    top = U64(int(count_share * 2.0**64))
    slices = max(64, int(shingles * count_share) // 2_000_000)
    width = U64(int(top) // slices + 1)

    def send(batches):
        seen: set = set()
        held, n = [], 0

        def flush():
            every = np.sort(np.concatenate(held))
            cut = np.searchsorted(every, np.arange(1, slices, dtype=U64) * width)
            parts = np.split(every, cut)
            return pd.DataFrame({"slice": np.arange(slices, dtype=np.int32), "hashes": [p.tobytes() for p in parts]})

        for x in batches:
            for _, s in _once(x, words, seen):
                s = s[:np.searchsorted(s, top)]
                if len(s):
                    held.append(s)
                    n += len(s)
                if n > _HELD_SHINGLES:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def count(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        keys, counts = np.unique(np.concatenate([np.frombuffer(b, U64) for b in x["hashes"]]), return_counts=True)
        many = counts >= long_list
        return pd.DataFrame({"hash": keys[many].view(np.int64), "n": counts[many].astype(np.int64)})

    rows = (texts(docs).mapInArrow(in_slices(send), "slice int, hashes binary").groupBy("slice").applyInPandas(count, "hash long, n long")
            .orderBy(F.desc("n"), "hash").limit(max_long).select("hash").toPandas())
    return np.sort(rows["hash"].to_numpy(np.int64).view(U64))


_ENTRY = np.dtype([("hash", "<u8"), ("class", "<u8"), ("n", "<u4"), ("at", "<u4")])


def prefix_entries(docs: DataFrame, frequent, shingles: int, words: int, numer: int, denom: int) -> DataFrame:
    """(slice, entries): packed entries of the short lists per slice of the hash space, and slice -1 for long lists."""
    slices = max(64, shingles // 5_000_000)

    def send(batches):
        rare = frequent.value
        seen: set = set()
        held, n = [], 0

        def flush():
            e = np.concatenate(held)
            slot = (mix64(e["hash"]) % U64(slices)).astype(np.int32)
            if len(rare):
                at = np.minimum(np.searchsorted(rare, e["hash"]), len(rare) - 1)
                slot[rare[at] == e["hash"]] = -1
            order = np.argsort(slot, kind="stable")
            e, slot = e[order], slot[order]
            k, first = np.unique(slot, return_index=True)
            return pd.DataFrame({"slice": k.astype(np.int32), "entries": [p.tobytes() for p in np.split(e, first[1:])]})

        for x in batches:
            for c, s in _once(x, words, seen):
                p = prefix_length(len(s), numer, denom)
                if len(rare):
                    at = np.minimum(np.searchsorted(rare, s), len(rare) - 1)
                    is_long = rare[at] == s
                    s_ordered = np.concatenate((s[~is_long], s[is_long])) if is_long.any() else s
                else:
                    s_ordered = s
                e = np.empty(p, _ENTRY)
                e["hash"], e["class"], e["n"], e["at"] = s_ordered[:p], c, len(s), np.arange(1, p + 1)
                held.append(e)
                n += p
                if n > _HELD_ENTRIES:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return texts(docs).mapInArrow(in_slices(send), "slice int, entries binary")


_PAIR = "u long, v long, nu long, nv long, au long, av long"


def _list_pairs(pair_list: int, numer: int, denom: int):
    """Occurrences of pairs in the short lists of a slice; longer lists give (first class, class) with nu = -1."""
    def merge(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        e = np.concatenate([np.frombuffer(b, _ENTRY) for b in x["entries"]])
        e = np.unique(e[np.lexsort((e["class"], e["n"], e["hash"]))])
        e = e[np.lexsort((e["class"], e["n"], e["hash"]))]
        start = np.flatnonzero(np.concatenate(([True], e["hash"][1:] != e["hash"][:-1])))
        size = np.diff(np.append(start, len(e)))
        out = []
        for width in range(2, pair_list + 1):             # lists of one length at once
            s = start[size == width]
            if not len(s):
                continue
            block = e[s[:, None] + np.arange(width)]
            i, j = np.triu_indices(width, 1)
            a, b = block[:, i].ravel(), block[:, j].ravel()
            t = -(-numer * (a["n"].astype(np.int64) + b["n"]) // (numer + denom))
            out.append(np.stack([y[a["n"] >= t] for y in (a["class"], b["class"], a["n"], b["n"], a["at"], b["at"])]).astype(np.int64))
        for s, k in zip(start[size > pair_list].tolist(), size[size > pair_list].tolist(), strict=True):
            c = e["class"][s:s + k].astype(np.int64)
            out.append(np.stack([np.full(k - 1, c[0]), c[1:], *[np.full(k - 1, -1)] * 4]))
        got = np.concatenate(out, axis=1) if out else np.zeros((6, 0), np.int64)
        swap = got[0] > got[1]
        got[:, swap] = got[[1, 0, 3, 2, 5, 4]][:, swap]
        return pd.DataFrame(dict(zip(("u", "v", "nu", "nv", "au", "av"), got, strict=True)))
    return merge


def candidate_edges(entries: DataFrame, pair_list: int, numer: int, denom: int) -> DataFrame:
    """(u, v): pairs of classes that may link, and chains of the longer lists."""
    rows = entries.where("slice >= 0").groupBy("slice").applyInPandas(_list_pairs(pair_list, numer, denom), _PAIR)
    # the pairs' count, sizes and last common places; a pair of a chain needs no count
    pairs = rows.groupBy("u", "v").agg(F.count(F.lit(1)).alias("c"), F.max("nu").alias("nu"), F.max("nv").alias("nv"),
                                       F.max("au").alias("au"), F.max("av").alias("av"), F.min("nu").alias("chain"))

    def prefix(n: str):
        return F.col(n) - F.ceil(F.lit(numer) * F.col(n) / F.lit(denom)) + 1

    need = F.ceil(F.lit(numer) * (F.col("nu") + F.col("nv")) / F.lit(numer + denom))
    after = F.least(F.col("nu") - F.col("au"), F.col("nv") - F.col("av"))          # beyond the last common shingle
    beyond = F.greatest(F.col("nu") - prefix("nu"), F.col("nv") - prefix("nv"))    # beyond the shorter prefix
    short = pairs.where((F.col("chain") < 0) | (F.col("c") + F.least(after, beyond) >= need)).select("u", "v")

    def unpack(batches):
        for x in batches:
            for b in x["entries"]:
                e = np.frombuffer(b, _ENTRY)
                yield pd.DataFrame({"hash": e["hash"].astype(np.int64), "v": e["class"].astype(np.int64)})

    long_ = entries.where("slice < 0").select("entries").mapInPandas(unpack, "hash long, v long")
    first = long_.groupBy("hash").agg(F.min("v").alias("u"))                       # at most max_long rows
    chains = long_.join(F.broadcast(first), "hash").where("u < v").select("u", "v").distinct()
    return short.unionByName(chains)


def class_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, n_wanted: int, words: int) -> DataFrame:
    """(class, set) of the wanted classes, from one document of each.

    A bounded Bloom filter of those documents' ids keeps other texts from
    being shingled, and an exact join drops what it let through.
    """
    chosen = cut_lineage(classes.join(wanted.select(F.col("class").alias("w")), F.col("class") == F.col("w"), "left_semi")
                         .groupBy("class").agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("doc_id")))
    bloom = docs.sparkSession.sparkContext.broadcast(
        BlockedBloom.build(chosen.select(F.xxhash64("doc_id").alias("k")), "k", n_wanted))

    def send(batches):
        seen: set = set()
        for x in batches:
            got = list(_once(x[bloom.value.has(x["k"].to_numpy(np.int64).view(U64))], words, seen))
            for k in range(0, len(got), 256):
                yield pd.DataFrame({"class": pd.array([c for c, _ in got[k:k + 256]], "int64"), "set": [s.tobytes() for _, s in got[k:k + 256]]})

    keyed = texts(docs).select(F.xxhash64(F.coalesce("doc_id", F.lit(_NO_ID))).alias("k"), "text")
    rows = keyed.mapInArrow(in_slices(send), "class long, set binary")
    return rows.join(wanted.select("class"), "class", "left_semi").groupBy("class").agg(F.first("set").alias("set"))


# ---------------------------------------------------------------- the join

def ngram_join(docs: DataFrame, words: int = WORDS, numer: int = NUMER, denom: int = DENOM, long_list: int = 32,
               max_long: int = 1 << 20, count_share: float = 0.35, pair_list: int = 32,
               block_shingles: int = 150_000, block_sets: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    spark = docs.sparkSession
    classes = cut_lineage(document_classes(docs, words))
    shingles = classes.agg(F.sum("n_shingles")).first()[0] or 0
    with scratch(spark) as keep:                          # of the steps below only the links' components are left
        frequent = spark.sparkContext.broadcast(long_lists(docs, shingles, words, long_list, max_long, count_share))
        with scratch(spark) as keep_groups:
            entries = cut_lineage(prefix_entries(docs, frequent, shingles, words, numer, denom))
            groups = keep_groups(connected_components(candidate_edges(entries, pair_list, numer, denom)))
        links = cut_lineage(group_links(docs, classes, groups, words, numer, denom, block_shingles, block_sets))
        linked = keep(connected_components(links))
    named = (classes.where("class <> 0").join(linked, classes["class"] == linked["node"], "left")
             .select("doc_id", "class", "n_shingles", F.coalesce("component", "class").alias("root")))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return (named.join(smallest, "root").select("doc_id", "n_shingles", "component_id")
            .unionByName(classes.where("class = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))


def group_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, words: int, numer: int, denom: int,
                block_shingles: int, block_sets: int) -> DataFrame:
    """(u, v): spanning links of the search groups (node, component), by DivideSkip over pairs of blocks."""
    sizes = classes.groupBy("class").agg(F.first("n_shingles").alias("n"))
    members = groups.join(sizes, groups["node"] == sizes["class"]).select("class", "component", "n")
    members = cut_lineage(members)
    total = members.groupBy("component").agg(F.greatest(F.sum("n"), F.count(F.lit(1)) * F.lit(block_shingles // block_sets)).alias("total"))
    # small groups share a block; a large group is cut into blocks by a size class, so that blocks of unlike sizes never meet
    all_ = members.agg(F.sum("n"), F.count(F.lit(1))).first()
    bins = max(1, int(all_[0] or 0) // block_shingles)
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(denom / numer)))).cast("int")
    m = members.join(total, "component").withColumn("level", level)
    small = m.where(F.col("total") <= block_shingles).select(
        "class", "n", F.pmod(F.xxhash64("component"), F.lit(bins)).alias("area"), F.lit(0).alias("level"), F.lit(0).alias("part"))
    weight = m.where(F.col("total") > block_shingles).groupBy("component", "level").agg(
        F.greatest(F.sum("n"), F.count(F.lit(1)) * F.lit(block_shingles // block_sets)).alias("w"))
    cut = weight.select("component", "level", F.ceil(F.col("w") / block_shingles).cast("int").alias("parts"))
    large = (m.where(F.col("total") > block_shingles).join(cut, ["component", "level"])
             .select("class", "n", (-F.col("component") - 1).alias("area"), "level",
                     F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part")))
    placed = small.unionByName(large)
    # a block meets itself, the other blocks of its size class, and those of the next class (a ratio below numer / denom cannot match)
    blocks = placed.select("area", "level", "part").distinct()
    a, b = blocks.alias("a"), blocks.alias("b")
    near = (F.col("a.area") == F.col("b.area")) & (
        ((F.col("a.level") == F.col("b.level")) & (F.col("a.part") <= F.col("b.part"))) | (F.col("a.level") + 1 == F.col("b.level")))
    meets = a.join(b, near).select(
        "a.area", F.xxhash64("a.area", "a.level", "a.part", "b.level", "b.part").alias("meeting"), F.col("a.level").alias("al"),
        F.col("a.part").alias("ap"), F.col("b.level").alias("bl"), F.col("b.part").alias("bp"))
    both = (meets.select("area", "meeting", F.col("al").alias("level"), F.col("ap").alias("part"), F.lit(0).alias("side"), ((F.col("al") == F.col("bl")) & (F.col("ap") == F.col("bp"))).alias("same"))
            .unionByName(meets.where("al <> bl or ap <> bp").select("area", "meeting", F.col("bl").alias("level"), F.col("bp").alias("part"), F.lit(1).alias("side"), F.lit(False).alias("same"))))
    sets = class_sets(docs, classes, members, int(all_[1]), words)
    rows = placed.join(sets, "class").join(both, ["area", "level", "part"]).select("meeting", "side", "same", "class", "set")

    def search(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("class")
        found = block_links(x["class"].to_numpy(np.int64), [np.frombuffer(s, U64) for s in x["set"]], x["side"].to_numpy(), bool(x["same"].iloc[0]), numer, denom)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return rows.groupBy("meeting").applyInPandas(search, "u long, v long")
