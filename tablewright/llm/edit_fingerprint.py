"""Document fingerprints by randomised edit embedding, bit-sampled banding and verification.

A walk reads a text one character at a time: at step j it writes the character
it stands on and moves on if the random bit of (j, character) says so.  All
texts share the bits, so two texts that agree up to a place write the same
symbols there, and after an insertion or deletion two walks soon meet again:
edit distance becomes Hamming distance of what the walks write.

- The bits repeat after ``PERIOD`` steps.  So the steps spent on two characters
  depend on the step of arrival and the characters' classes alone: one table
  look-up, done in numpy for all texts of a batch and all walks at once.
- A fingerprint is ``SAMPLES`` positions of each of ``WALKS`` walks, one byte
  each.  A sample is the position of smallest random weight below the length
  of what the walk wrote, with the symbol found there.  Two texts take the same
  position with probability shorter / longer, so the likeness, the share of
  equal bytes, estimates equal symbols per written length, whatever the lengths.
- Most near documents share one of the 8-byte bands of their fingerprints.  Each
  band's bucket is checked against its smallest class by the whole fingerprint;
  what fails goes on to buckets of a band twice as wide.  A bucket costs its
  size, never its pairs, and nothing is capped.
- Then all other pairs are searched, exactly: fingerprints are packed into
  blocks and every two blocks meet in a task.  Fingerprints that differ in at
  most d places, cut into d // (e + 1) + 1 parts, differ in at most e places of
  one part, so they agree on the part's other bytes; only pairs of different
  groups that agree there are compared.  Memory is two blocks; the number of
  meetings is quadratic in the blocks.

Defined results: a null text counts as empty, an empty text's fingerprint is
all zeros.  Equal texts have equal fingerprints.  "Next" is by doc_id (nulls
first), then text hash, then row; after the last comes the first, and a single
document is its own next one.  Very long texts are walked whole, block by
block, with a mark at every ``_MARK`` characters from which samples are read.  Repeated rows and null ids are rows like others.  An
empty table gives no rows.  Other columns are dropped.
"""

from __future__ import annotations

import functools
import hashlib
import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tablewright.llm.common import U64, connected_components, mix64, texts
from tablewright.session import cut_lineage

WALKS, SAMPLES, PERIOD, SEED = 2, 64, 256, 20
BYTES = WALKS * SAMPLES
BAND = 8
#: Fingerprints of a block: at least, at most; pairs compared at once; places in which a part may differ.
_LEAST_BLOCK, _MOST_BLOCK, _PAIRS, _SPARE = 1 << 12, 1 << 15, 1 << 16, 1
#: UTF-8 bytes and rows of texts walked together, characters (even) between two marks of a walk, cells of a block.
_BYTES, _ROWS, _MARK, _CELLS = 8 << 20, 4096, 32, 1 << 18
#: Characters fall into 32 classes for their bits; class 32 fills up texts of odd length and takes no step.
_CLASSES, _NONE = 32, 32
_SHIFT = 5 + 6 + 1                                         # a state is step << _SHIFT: room for two classes and a walk


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps spent on a class by (step, class, walk); the same for two classes in a row, flat and shifted; positions of falling weight of every sample."""
    r = np.random.Generator(np.random.PCG64(SEED))
    moves = r.integers(0, 2, (PERIOD, _CLASSES, WALKS), dtype=np.uint8).astype(bool)
    moves[-1] |= ~moves.any(0)
    one = np.zeros((PERIOD, _CLASSES + 1, WALKS), np.int32)
    after = np.zeros((_CLASSES, WALKS), np.int32)
    for _ in range(2):                                     # the second round knows what follows the period's end
        for p in range(PERIOD - 1, -1, -1):
            after = one[p, :_CLASSES] = np.where(moves[p], 1, after + 1)
    first = one[:, :_CLASSES]
    p, c, w = np.ogrid[:PERIOD, :_CLASSES, :WALKS]
    two = np.zeros((PERIOD, _CLASSES, 64, WALKS), np.int32)
    for second in range(_CLASSES + 1):
        two[:, :, second] = first + one[(p + first) % PERIOD, second, w]
    falls = []
    for _ in range(BYTES):                                 # records of an endless row of uniform weights: the next is geometric
        at, weight, row = 0, r.random(), [0]
        while at < 1 << 40:
            at += int(min(r.geometric(max(weight, 1e-18)), 1 << 41))
            weight *= r.random()
            row.append(at)
        falls.append(row)
    width = max(map(len, falls))
    return one, (two << _SHIFT).reshape(-1), np.array([row + [1 << 62] * (width - len(row)) for row in falls], np.int64)


def _classes(points: np.ndarray) -> np.ndarray:
    return ((points ^ (points >> 8) * 157) % _CLASSES).astype(np.uint8)


def _walk(pairs: np.ndarray, offset: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step of every (text, walk) at the text's end, and at every mark, flat, with the place of each mark.

    Texts are slices of ``pairs`` of characters, falling in length; a block
    holds some pairs of the texts that have not ended.
    """
    _, stay, _ = _tables()
    n, longest, mask, every = len(lengths), int(lengths[0]), (PERIOD << _SHIFT) - 1, _MARK // 2
    state = np.zeros((n, WALKS), np.int64)
    marks, places, at, filled = [], [], 0, 0
    walk, take, both, add = np.arange(WALKS, dtype=np.int32), stay.take, np.bitwise_and, np.add
    while at < longest:
        open_ = int(np.searchsorted(-lengths, -at, "left"))
        size = min(max(every, _CELLS // open_ // every * every), 1 << 14, -(-(longest - at) // every) * every)
        index = pairs.take(offset[:open_] + (at + np.arange(size))[:, None], mode="clip")[:, :, None] + walk
        active = np.searchsorted(-lengths, -(at + np.arange(size)), "left").tolist()
        k, d = np.empty((open_, WALKS), np.int64), np.empty((open_, WALKS), np.int32)
        last = -1
        for i, (a, row) in enumerate(zip(active, index)):
            if a != last:
                if not a:
                    break
                s, ka, da, last = state[:a], k[:a], d[:a], a
            if i % every == 0:
                marks.append(s.ravel().copy())
                places.append(filled)
                filled += a * WALKS
            both(s, mask, ka)
            add(ka, row[:a], ka)
            take(ka, None, da, "clip")
            add(s, da, s)
        at += size
    return state >> _SHIFT, np.concatenate(marks) >> _SHIFT, np.array(places, np.int64)


def _fingerprints(group: list[str]) -> np.ndarray:
    """Fingerprints of texts of falling length, none empty."""
    stay, _, falls = _tables()
    lengths = np.array([len(t) for t in group], np.int64)
    even = lengths + lengths % 2
    offset = np.cumsum(even) - even
    points = np.frombuffer("".join(t if len(t) % 2 == 0 else t + " " for t in group).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = _classes(points)
    classes[(offset + lengths)[lengths % 2 == 1]] = _NONE
    pairs = (classes[0::2].astype(np.int32) * 64 + classes[1::2]) * WALKS
    written, marks, places = _walk(pairs, offset // 2, even // 2)
    out = np.zeros((len(group), BYTES), np.uint8)
    for first in range(0, len(group), 1024):               # samples of some texts at a time
        own = slice(first, first + 1024)
        doc, n = np.arange(len(group))[own], lengths[own]
        at = np.stack([falls[c][np.searchsorted(falls[c], written[own, c // SAMPLES] - 1, "right") - 1] for c in range(BYTES)], 1)
        walk = np.arange(BYTES) // SAMPLES
        flat = doc[:, None] * WALKS + walk
        low, high = np.zeros(at.shape, np.int64), np.broadcast_to((-(-n // _MARK))[:, None], at.shape).copy()
        for _ in range(int(n[0] // _MARK + 1).bit_length()):           # the last mark at or before the sampled step
            middle = (low + high) >> 1
            inside = middle < high
            ahead = inside & (marks[places[np.where(inside, middle, 0)] + flat] <= at)
            low, high = np.where(ahead, middle, low), np.where(ahead | ~inside, high, middle)
        step, i = marks[places[low] + flat], low * _MARK
        found = offset[own][:, None] + i
        end = np.broadcast_to((offset[own] + n)[:, None], at.shape)
        step, found, end, goal, which = (x.ravel().copy() for x in (step, found, end, at, np.broadcast_to(walk, at.shape)))
        todo = np.arange(len(step))
        while len(todo):                                   # from the mark on, character by character
            here = found[todo]
            nxt = step[todo] + stay[step[todo] % PERIOD, classes[here], which[todo]]
            ok = (nxt <= goal[todo]) & (here + 1 < end[todo])
            todo = todo[ok]
            step[todo], found[todo] = nxt[ok], here[ok] + 1
        with np.errstate(over="ignore"):
            mixed = mix64(goal.astype(U64) * U64(0x9E3779B97F4A7C15) + points[found].astype(U64) + U64(1))
        out[own] = (mixed & U64(255)).astype(np.uint8).reshape(at.shape)
    return out


def fingerprints(given: list[str]) -> np.ndarray:
    """Fingerprints, one row of ``BYTES`` bytes for each text; equal texts are walked once."""
    place = {t: i for i, t in enumerate(dict.fromkeys(given))}
    order = sorted((t for t in place if t), key=len, reverse=True)
    out = np.zeros((len(place), BYTES), np.uint8)
    if order:
        out[[place[t] for t in order]] = _fingerprints(order)
    return out[[place[t] for t in given]]


def in_text_slices(f, schema: str):
    """Like ``in_slices``, but of at most ``_ROWS`` rows and, but for single texts, ``_BYTES`` bytes."""
    typed = to_arrow_schema(StructType.fromDDL(schema))

    def frames(batches):
        for b in batches:
            ends, at = np.cumsum(_utf8_sizes(b.column("text"))), 0
            while at < b.num_rows:
                base = ends[at - 1] if at else 0
                to = min(at + _ROWS, max(at + 1, int(np.searchsorted(ends, base + _BYTES, "right"))))
                yield b.slice(at, to - at).to_pandas(integer_object_nulls=True)
                at = to

    def run(batches):
        import pyarrow as pa
        for out in f(frames(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=typed, preserve_index=False)
    return run


def _utf8_sizes(column) -> np.ndarray:
    import pyarrow.compute as pc
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, 0 to 1."""
    return (a == b).mean(axis=-1)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many characters from the start of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


# ---------------------------------------------------------------- Spark

def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint binary) of every text, without a shuffle."""
    def run(frames):
        for x in frames:
            found = fingerprints(x["text"].tolist())
            yield x.assign(n_chars=x["text"].str.len(), fingerprint=[f.tobytes() for f in found])[["doc_id", "n_chars", "fingerprint"]]

    schema = "doc_id long, n_chars long, fingerprint binary"
    return texts(docs).mapInArrow(in_text_slices(run, schema), schema)


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_PART = f"kind int, part int, text string, {_ROW}"


def _rows(ids, mine: list[str], following: list[str], own: np.ndarray, theirs: np.ndarray):
    """Columns of ``_ROW`` for documents whose next ones are given."""
    import pandas as pd
    made = [edited(a, b) for a, b in zip(mine, following)]
    changed = fingerprints(made)
    return pd.DataFrame({"doc_id": pd.Series(list(ids), dtype=object), "n_chars": [len(t) for t in mine],
                         "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in made],
                         "fingerprint": [f.tobytes() for f in own], "edited_fingerprint": [f.tobytes() for f in changed],
                         "near_edited": likeness(own, changed), "near_next": likeness(own, theirs)})


def _sorted_part(frames):
    """Rows of one sorted partition; its first (kind 1) and last row (kind 2) come out with their texts, for the neighbouring partitions."""
    import pandas as pd

    def end(kind, row):
        doc, text, part, print_ = row
        return pd.DataFrame({"kind": [kind], "part": [part], "text": [text], "doc_id": pd.Series([doc], dtype=object), "n_chars": [len(text)],
                             "edited_sha256": [None], "fingerprint": [print_.tobytes()], "edited_fingerprint": [None], "near_edited": [None],
                             "near_next": [None]})

    last = None
    for x in frames:
        found = fingerprints(x["text"].tolist())
        here = list(zip(x["doc_id"], x["text"], x["part"], found))
        if last is None:
            yield end(1, here[0])[_NAMES]
        else:
            here.insert(0, last)
        last = here[-1]
        if len(here) > 1:
            ids, words, parts, prints = zip(*here)
            prints = np.array(prints)
            yield _rows(ids[:-1], list(words[:-1]), list(words[1:]), prints[:-1], prints[1:]).assign(kind=0, part=parts[0], text=None)[_NAMES]
    if last is not None:
        yield end(2, last)[_NAMES]


_NAMES = [c.split()[0] for c in _PART.split(", ")]


def _across(frames):
    """Last rows of partitions with the first row of the next one."""
    for x in frames:
        own, theirs = (np.array([np.frombuffer(b, np.uint8) for b in x[c]]) for c in ("fingerprint", "their_print"))
        yield _rows(x["doc_id"], x["text"].tolist(), x["their_text"].tolist(), own, theirs)


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and the likenesses; fingerprints are binary.

    Documents are range-partitioned by doc_id and sorted, so a text is shuffled
    once; only the first and last row of a partition go on to another one.
    """
    order = ["doc_id", F.xxhash64("text"), "_row"]
    ranged = (texts(docs).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
              .select("doc_id", "text", F.spark_partition_id().alias("part")))
    made = cut_lineage(ranged.mapInArrow(in_text_slices(_sorted_part, _PART), _PART))
    heads = made.where("kind = 1").select(F.col("part").alias("their_part"), F.col("text").alias("their_text"), F.col("fingerprint").alias("their_print"))
    parts = made.where("kind = 1").select("part")          # one row a partition: the window is bounded by their number
    steps = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("their_part"))
    tails = made.where("kind = 2").select("part", "doc_id", "text", "fingerprint").join(steps, "part").join(heads, "their_part")
    closing = tails.mapInArrow(in_text_slices(_across, _ROW), _ROW)
    return made.where("kind = 0").select(*closing.columns).unionByName(closing)


def near_classes(prints: DataFrame, least: float = 0.6) -> DataFrame:
    """(fingerprint, class_id, near_id) of rows (doc_id, fingerprint): equal fingerprints are a class, near classes a group.

    ``class_id`` and ``near_id`` are smallest ids; ``least`` is the likeness
    that verifies a candidate pair.  Null ids belong to the class of their
    fingerprint; a class without any id forms no links.
    """
    classes = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")))
    named = classes.where("node is not null")
    keys = F.transform(F.sequence(F.lit(0), F.lit(BYTES // BAND - 1)), lambda b: F.struct(b.alias("band"), _band_key(b, BAND).alias("key")))
    keyed, links, width = named.select("node", F.explode(keys).alias("k")).select("node", "k.*"), None, BAND
    while True:
        heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        pairs = cut_lineage(keyed.join(heads, "key").where("node <> head").select("node", "head", "band"))
        checked = cut_lineage(_checked(pairs.select("node", "head").distinct(), named, least))
        near = checked.where("near").select(F.col("node").alias("u"), F.col("head").alias("v"))
        links = near if links is None else links.unionByName(near)
        failed = checked.where("not near").select("node", "head")
        width *= 2
        if width >= BYTES or failed.isEmpty():             # the widest band is the whole fingerprint, which no two classes share
            break
        left = pairs.join(failed, ["node", "head"]).select("node", "band")
        keyed = left.join(named, "node").select("node", "band", _band_key(F.col("band"), width).alias("key"))
    linked = connected_components(links.distinct()).withColumnRenamed("component", "root")
    rooted = named.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    joined = connected_components(other_links(rooted, least)).withColumnRenamed("node", "root")            # groups that have near members
    groups = rooted.join(joined, "root", "left").select("node", F.coalesce("component", "root").alias("near_id")).distinct()  # classes may share a node
    return (classes.join(groups, "node", "left")
            .select("fingerprint", F.col("node").alias("class_id"), F.coalesce("near_id", "node").alias("near_id")))


def other_links(classes: DataFrame, least: float) -> DataFrame:
    """(u, v): roots of near rows of (root, fingerprint) with different roots, enough to link all groups with near members."""
    n = classes.count()
    blocks = max(1, -(-n // min(_MOST_BLOCK, max(_LEAST_BLOCK, n // 8))))

    def pack(key: tuple, x):
        import pandas as pd
        return pd.DataFrame({"block": [key[0]], "roots": [x["root"].to_numpy(np.int64).tobytes()], "prints": [b"".join(x["fingerprint"])]})

    def search(batches):
        import pyarrow as pa
        for b in batches:
            for i in range(b.num_rows):
                x = {n: b.column(n)[i].as_py() for n in b.schema.names}
                same = x["block"] == x["their_block"]
                roots, prints = (np.frombuffer(x[c] if same else x[c] + x["their_" + c], t) for c, t in (("roots", np.int64), ("prints", np.uint8)))
                found = block_links(roots, prints.reshape(-1, BYTES), 0 if same else len(x["roots"]) // 8, least)
                u, v = (roots[np.array([p[k] for p in found], np.int64)] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    packed = (classes.select("root", "fingerprint", F.pmod(F.xxhash64("fingerprint"), F.lit(blocks)).alias("block"))
              .groupBy("block").applyInPandas(pack, "block long, roots binary, prints binary"))
    one = cut_lineage(packed).repartition(blocks)          # about a block a partition: partitions meet in tasks, nothing is copied to disk
    other = one.select(*[F.col(c).alias("their_" + c) for c in one.columns])
    meets = one.join(other.hint("shuffle_replicate_nl"), F.col("block") <= F.col("their_block"))
    return cut_lineage(meets.mapInArrow(search, "u long, v long"))


def _agreements(differ: int, spare: int) -> list[tuple[int, ...]]:
    """Sets of places: fingerprints that differ in at most ``differ`` places agree on all of one set."""
    parts = np.array_split(np.arange(BYTES), differ // (spare + 1) + 1)
    return [c for p in parts for c in combinations(p.tolist(), max(0, len(p) - spare))]


def block_links(roots: np.ndarray, prints: np.ndarray, split: int, least: float) -> list[tuple[int, int]]:
    """Spanning links of near rows with different roots: rows before ``split`` meet those behind it; with 0, all meet all."""
    need, same = math.ceil(least * BYTES), not split
    left, right = (np.arange(len(roots)),) * 2 if same else (np.arange(split), np.arange(split, len(roots)))
    columns = np.ascontiguousarray(prints.T)
    names, root = np.unique(roots, return_inverse=True)
    low = U64((1 << len(names).bit_length()) - 1)
    root, out = root.astype(U64), []
    for places in _agreements(BYTES - need, _SPARE):
        key = np.zeros(len(roots), U64)
        for p in places:
            key = key * U64(0x9E3779B97F4A7C15) + columns[p]
        key = mix64(key) & ~low                            # the rows of a key are in the order of their roots
        whole = key | root
        order = np.argsort(whole[right])
        rows = whole[right][order]
        mine = np.argsort(whole[left])                     # sought in order, which is faster
        first, end = np.searchsorted(rows, key[left][mine]), np.searchsorted(rows, key[left][mine] | low, "right")
        own, own_end = (np.searchsorted(rows, whole[left][mine], side) for side in ("left", "right"))
        n = end - first - (own_end - own)
        some = np.flatnonzero(n)
        until = np.cumsum(n[some])
        for at in range(0, int(until[-1]) if len(some) else 0, _PAIRS):
            k = np.arange(at, min(at + _PAIRS, int(until[-1])))
            i = np.searchsorted(until, k, "right")
            a = some[i]
            j = first[a] + k - (until[i] - n[a])
            j += np.where(j >= own[a], own_end[a] - own[a], 0)             # past the rows of the own root
            u, v = left[mine[a]], right[order[j]]
            ok = root[u] != root[v]
            u, v = (u[ok & (u < v)], v[ok & (u < v)]) if same else (u[ok], v[ok])
            near = np.count_nonzero(prints[u] == prints[v], axis=1) >= need
            for x, y in zip(u[near].tolist(), v[near].tolist()):
                if root[x] != root[y]:
                    root[root == root[x]] = root[y]
                    out.append((x, y))
    return out


def _band_key(band: Column, width: int) -> Column:
    """Hash of ``width`` bytes from the band's start, going round the fingerprint's end."""
    return F.xxhash64(band, F.substring(F.concat("fingerprint", "fingerprint"), band * BAND + 1, F.lit(width)))


def _checked(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(node, head, near) of candidate pairs, by their whole fingerprints."""
    heads = classes.select(F.col("node").alias("head"), F.col("fingerprint").alias("their_print"))
    return (pairs.join(classes, "node").join(heads, "head").select("node", "head", "fingerprint", "their_print")
            .mapInArrow(_verify(least), "node long, head long, near boolean"))


def _verify(least: float):
    def run(batches):
        import pyarrow as pa
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(n).to_pylist()), np.uint8).reshape(-1, BYTES) for n in ("fingerprint", "their_print"))
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("head"), pa.array(likeness(a, c) >= least)], ["node", "head", "near"])
    return run


def fingerprint_report(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """:func:`edited_neighbours` with the near group of every document."""
    rows = edited_neighbours(docs)
    return rows.join(near_classes(rows.select("doc_id", "fingerprint"), least), "fingerprint")
