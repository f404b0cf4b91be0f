"""Join shapes (J1-J17) expressed so Catalyst keeps them equi-joins.

No explicit broadcast hints on data-dependent sides: with AQE the planner
broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and falls back to sort-merge join
otherwise.  ``F.broadcast`` is used only for literal lists, whose rows stand
in the program.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tablewright.session import cut_lineage


def values_df(spark, rows: list[tuple], schema: str) -> DataFrame:
    """An inline literal relation (fixed size → safe to broadcast)."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def full_outer_status(left: DataFrame, right: DataFrame, keys: list[str],
                      left_tag: str = "only in left", right_tag: str = "only in right",
                      both_tag: str = "in both") -> DataFrame:
    """FULL OUTER JOIN with a status CASE and merged (ISNULL) keys."""
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], F.lit(True).alias("_l"))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.lit(True).alias("_r"))
    cond = reduce(lambda a, b: a & b, [F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys])
    j = l.join(r, cond, "full_outer")
    status = (F.when(F.col("_l").isNull(), right_tag)
              .when(F.col("_r").isNull(), left_tag).otherwise(both_tag))
    merged = [F.coalesce(F.col(f"l_{k}"), F.col(f"r_{k}")).alias(k) for k in keys]
    rest = [F.col(f"l_{c}") for c in left.columns if c not in keys] + \
           [F.col(f"r_{c}") for c in right.columns if c not in keys]
    return j.select(*merged, status.alias("status"), *rest)


def or_join(left: DataFrame, right: DataFrame, branches: list[tuple[Column, Column]]) -> DataFrame:
    """Inner join ``ON (eq1 AND p1) OR (eq2 AND p2)`` as a union of equi joins (no nested loop).

    Each branch is (equi-join condition, residual predicate).  A branch
    leaves out the pairs of the branches before it, so a pair that fits
    several comes once.
    """
    parts, earlier = [], F.lit(False)
    for eq, pred in branches:
        parts.append(left.join(right, eq & pred & ~earlier, "inner"))
        earlier = earlier | F.coalesce(eq & pred, F.lit(False))
    return reduce(lambda a, b: a.unionByName(b), parts)


def spread_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, pairs: int = 1 << 20) -> DataFrame:
    """Inner equi join of keys that are frequent on both sides: every row of ``left`` with every row of ``right`` of its key.

    A key with more than ``pairs`` pairs is dealt into parts: a row of ``right``
    is in one of them, a row of ``left`` in all.  (key, part) is shuffled, so
    neither a task nor what a row of ``left`` meets there grows with the pairs
    of a key.  Column names must differ.
    """
    of_left = left.groupBy(F.col(left_key).alias("_tw_k")).agg(F.count(F.lit(1)).alias("_tw_l"))
    of_right = right.groupBy(F.col(right_key).alias("_tw_k")).agg(F.count(F.lit(1)).alias("_tw_r"))
    parts = F.least(F.col("_tw_r"), F.ceil(F.col("_tw_l").cast("double") * F.col("_tw_r") / pairs)).cast("int")
    keys = cut_lineage(of_left.join(of_right, "_tw_k").select("_tw_k", parts.alias("_tw_parts")))
    copies = left.join(keys, F.col(left_key) == F.col("_tw_k")).select(*left.columns, F.explode(F.sequence(F.lit(0), F.col("_tw_parts") - 1)).alias("_tw_part"))
    dealt = (right.withColumn("_tw_row", F.monotonically_increasing_id()).join(keys, F.col(right_key) == F.col("_tw_k"))
             .select(*right.columns, F.pmod(F.xxhash64("_tw_row"), F.col("_tw_parts")).cast("int").alias("_tw_to")))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))        # a given number: tasks are not merged by the size of what they read
    a, b = copies.repartition(n, left_key, "_tw_part"), dealt.repartition(n, right_key, "_tw_to")
    return a.join(b.hint("merge"), (F.col(left_key) == F.col(right_key)) & (F.col("_tw_part") == F.col("_tw_to"))).select(*left.columns, *right.columns)


def token_join(texts: DataFrame, id_col: str, text_col: str, words: DataFrame, word_col: str,
               token_pattern: str = r"[^0-9A-Za-z_\p{L}]+") -> DataFrame:
    """Which words occur as whole tokens in each text.

    The LIKE-theta join becomes: tokenise and de-duplicate each text in its
    row → explode → equi join on the lower-cased token.
    """
    toks = (texts.select(F.col(id_col), F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), token_pattern))).alias("_tw_tok"))
                 .where(F.col("_tw_tok") != ""))
    w = words.select(F.col(word_col), F.lower(F.col(word_col)).alias("_tw_tok"))
    return toks.join(w, "_tw_tok").drop("_tw_tok")


#: Letters of texts whose grams are found together, and bits of the filter of the grams that patterns have.
_LETTERS, _FILTER = 1 << 20, 1 << 20
#: Up to so many letters a gram's key is the gram itself; longer ones are hashed.
_EXACT = 3


def _keys(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of each ``n`` code points in a row."""
    count = max(0, len(points) - n + 1)
    keys = np.zeros(count, np.uint64)
    for j in range(n):
        step = points[j:j + count].astype(np.uint64) + np.uint64(1)
        keys = (keys << np.uint64(21)) | step if n <= _EXACT else keys * np.uint64(0x9E3779B97F4A7C15) + step
    return keys if n <= _EXACT else (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _places(keys: np.ndarray) -> np.ndarray:
    return ((keys ^ (keys >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(7)) % np.uint64(_FILTER)


def _grams(df: DataFrame, id_col: str, text_col: str, lengths: list[int], wanted: bytes | None = None) -> DataFrame:
    """(``id_col``, _tw_n, _tw_g): the keys of the different grams of each text, without a shuffle; with ``wanted``, a bitmap of places, only those in it."""
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("_tw_n", IntegerType()), StructField("_tw_g", LongType())])
    typed = to_arrow_schema(schema)

    def found(ids, given: list[str]):
        import pyarrow as pa
        points = np.frombuffer("".join(given).encode("utf-32-le", "surrogatepass"), np.uint32)
        text = np.repeat(np.arange(len(given)), [len(x) for x in given])
        for n in lengths:
            keys = _keys(points, n)
            whole = text[:len(keys)] == text[n - 1:]
            if wanted is not None:
                bits = np.unpackbits(np.frombuffer(wanted, np.uint8))
                whole &= bits[_places(keys).astype(np.int64)] == 1
            at = np.flatnonzero(whole)
            at = at[np.lexsort((keys[at], text[at]))]
            k, t = keys[at], text[at]
            first = np.ones(len(at), bool)
            first[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
            columns = [ids.take(pa.array(t[first])), pa.array(np.full(int(first.sum()), n, np.int32)), pa.array(k[first].view(np.int64))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, typed)], schema=typed)

    def run(batches):
        import pyarrow.compute as pc
        for b in batches:
            ends, at = np.cumsum(pc.utf8_length(b.column(text_col)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while at < b.num_rows:                         # some texts at a time, at least one
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _LETTERS, "right")))
                yield from found(b.column(id_col).slice(at, to - at), b.column(text_col).slice(at, to - at).to_pylist())
                at = to

    return df.select(*dict.fromkeys([id_col, text_col])).mapInArrow(run, schema)


def contains_join(texts: DataFrame, id_col: str, text_col: str, patterns: DataFrame, pattern_col: str, q: int = 4) -> DataFrame:
    """(``id_col``, pattern columns) wherever a text contains a pattern as a substring, whatever its case.

    ``text LIKE '%' || pattern || '%'`` without a nested loop.  Patterns of at
    least ``q`` letters meet texts on their rarest q-gram: the grams of the
    patterns that occur in texts are counted, each pattern waits in the
    inverted list of its rarest one, and ``contains`` decides on the candidates.
    A pattern with a gram that no text has is out at once.  A shorter pattern
    is itself a gram of its length; the empty one is in every text.  Grams are
    found in one pass over the texts; a bitmap of fixed size keeps those that
    no pattern has from leaving it.  NULL contains nothing and is in nothing.
    ``id_col`` names a text.
    """
    t = texts.select(id_col, F.lower(F.col(text_col)).alias("_tw_t")).where(F.col("_tw_t").isNotNull())
    p = patterns.select(F.lower(F.col(pattern_col)).alias("_tw_p")).where(F.col("_tw_p").isNotNull()).distinct()
    length = F.least(F.length("_tw_p"), F.lit(q))
    lengths = sorted(r[0] for r in p.select(length.alias("n")).distinct().collect())                                 # at most q + 1 rows
    sizes = [n for n in lengths if n] or [q]
    sought = cut_lineage(_grams(p, "_tw_p", "_tw_p", sizes).where(F.col("_tw_n") == length))
    wanted = np.zeros(_FILTER, np.uint8)

    def places(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_places(b.column(0).to_numpy().view(np.uint64)).astype(np.int64)))], ["at"])

    for r in sought.select("_tw_g").mapInArrow(places, "at long").distinct().collect():                              # at most _FILTER numbers
        wanted[r["at"]] = 1
    lists = cut_lineage(_grams(t, id_col, "_tw_t", sizes, np.packbits(wanted).tobytes()).join(sought.select("_tw_n", "_tw_g").distinct(), ["_tw_n", "_tw_g"], "left_semi"))
    times = lists.groupBy("_tw_n", "_tw_g").agg(F.count(F.lit(1)).alias("_tw_c"))
    rarest = (sought.join(times, ["_tw_n", "_tw_g"]).groupBy("_tw_p", "_tw_n")
              .agg(F.min(F.struct("_tw_c", "_tw_g")).alias("r"), F.count(F.lit(1)).alias("_tw_there")))
    whole = sought.groupBy("_tw_p").agg(F.count(F.lit(1)).alias("_tw_all"))
    rarest = rarest.join(whole, "_tw_p").where("_tw_there = _tw_all").select("_tw_p", "_tw_n", F.col("r._tw_g").alias("_tw_g"))
    candidates = lists.join(rarest, ["_tw_n", "_tw_g"]).select(id_col, "_tw_p", "_tw_n")                             # whole texts are never a side to broadcast
    sure = (F.col("_tw_n") < q) & (F.col("_tw_n") <= _EXACT)
    parts = [candidates.where(sure).select(id_col, "_tw_p")]
    if any(n >= q or n > _EXACT for n in lengths):
        parts.append(candidates.where(~sure).join(t.hint("merge"), id_col).where(F.contains("_tw_t", "_tw_p")).select(id_col, "_tw_p"))
    if 0 in lengths:
        parts.append(t.select(id_col, F.lit("").alias("_tw_p")))
    found = reduce(lambda a, b: a.unionByName(b), parts)
    return found.join(patterns.withColumn("_tw_p", F.lower(F.col(pattern_col))), "_tw_p").drop("_tw_p")


def like_or_join(texts: DataFrame, id_col: str, text_col: str, words: DataFrame, key: str,
                 branches: list[tuple[str, Column]]) -> DataFrame:
    """(``id_col``, ``key``) where ``text LIKE '%' || pattern || '%'`` for some branch: a pattern column of
    ``words`` and a predicate on the texts.  A pair that fits several branches comes once."""
    parts = [contains_join(texts.where(when), id_col, text_col, words.select(key, pattern), pattern).select(id_col, key) for pattern, when in branches]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def wildcard_lookup(df: DataFrame, rules: DataFrame, match_cols: list[str], rule_prefix: str = "r_") -> DataFrame:
    """Rule rows where NULL means "any value": ``c = ISNULL(rule.c, c)``.

    Rules are split by which of their columns are NULL.  The rules of one such
    pattern fix the same columns, so they are one equi join on those; Spark
    chooses its strategy by size.  There are at most 2**columns patterns, and
    only those that occur are joined.  Rules without any fixed column fit every
    row (an equi join on a constant).  As with ``=``, a NULL in the data fits
    nothing: ``c = c`` is NULL there, too.
    """
    open_ = [F.col(f"{rule_prefix}{c}").isNull() for c in match_cols]
    shapes = rules.select(F.array(*open_).alias("open")).distinct().collect()
    whole = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in match_cols]))
    parts = []
    for (shape,) in shapes:
        own = rules.where(reduce(lambda a, b: a & b, [o if is_open else ~o for o, is_open in zip(open_, shape)]))
        fixed = [F.col(c) == F.col(f"{rule_prefix}{c}") for c, is_open in zip(match_cols, shape) if not is_open]
        if fixed:
            parts.append(whole.join(own, reduce(lambda a, b: a & b, fixed)))
        else:
            parts.append(whole.withColumn("_tw_all", F.lit(1)).join(own.withColumn("_tw_any", F.lit(1)), F.col("_tw_all") == F.col("_tw_any"))
                         .drop("_tw_all", "_tw_any"))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else whole.join(rules, F.lit(False))


def cast_join(big: DataFrame, big_key: str, small: DataFrame, small_key: str, how: str = "inner") -> DataFrame:
    """Join keys of different types — cast the *small* side to the big side's key type
    (``try_cast`` so bad values become non-matching NULLs), so the big scan keeps pushdown."""
    t = dict(big.dtypes)[big_key]
    s = small.withColumn("_tw_key", F.expr(f"try_cast({small_key} as {t})"))
    return big.join(s, big[big_key] == s["_tw_key"], how).drop("_tw_key")


def typed_counts(df: DataFrame, key: str, type_col: str, types: list, value: str | None = None) -> DataFrame:
    """The three LEFT JOINs of one table by type code as one conditional aggregate.

    Missing types become 0 (ISNULL(…, 0)); adds the row total.
    """
    aggs = []
    for t in types:
        v = F.col(value) if value else F.lit(1)
        aggs.append(F.coalesce(F.sum(F.when(F.col(type_col) == t, v)), F.lit(0)).alias(f"{t}"))
    out = df.groupBy(key).agg(*aggs)
    return out.withColumn("total", reduce(lambda a, b: a + b, [F.col(f"{t}") for t in types]))
