"""Consecutive numbering without a global window or a task for a group: whole frames, and groups by a segmented scan.

``ROW_NUMBER() OVER (ORDER BY k)`` with no PARTITION BY sends every row to a
single task.  Instead:

1. range-partition on the order keys and sort inside each partition
   (the sort is distributed; partition p holds keys below partition p+1);
2. tag rows with ``monotonically_increasing_id`` — partition id in the high
   bits, position within the partition in the low bits;
3. count rows per partition — one row per partition, a bounded table — turn
   the counts into start offsets, and join them back by partition id
   (broadcast is safe: at most ``num_partitions`` rows).

The counts and the numbers must come from exactly the same partitions.  Two
reads of one range exchange are not guaranteed to agree: Spark reuses the
exchange only when both branches plan it identically (column pruning in the
count branch can prevent that), and a range partitioner re-sampled over
input whose row order is not fixed (anything after a shuffle) may choose
other bounds.  So by default the partitioned, sorted, tagged rows are
written once to the reliable checkpoint folder (which also survives
executor loss) and both branches read that.  ``materialize=False`` skips
the write; use it only for inputs read straight from files.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from tablewright.session import cut_lineage

_LOW_BITS = 33


def number_rows(df: DataFrame, order: list, name: str = "row_id", start: int = 1,
                num_partitions: int | None = None, materialize: bool = True) -> DataFrame:
    """Add ``name`` = start, start+1, … following ``order`` (a total order: include a unique key).

    Without ``num_partitions`` the range partition count is left to AQE (its
    initial partition number, coalesced to the advisory partition size), so
    partitions stay a sensible size at any input size; coalescing only merges
    adjacent ranges, so the order across partitions is kept.  An empty
    ``order`` numbers rows by their place: no exchange and no sort, one write.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    if order_cols:
        df = df.repartitionByRange(num_partitions, *order_cols) if num_partitions else df.repartitionByRange(*order_cols)
        df = df.sortWithinPartitions(*order_cols)
    tagged = df.withColumn("_tw_mid", F.monotonically_increasing_id())
    if materialize:
        tagged = cut_lineage(tagged)
    tagged = (tagged.withColumn("_tw_pid", F.shiftright("_tw_mid", _LOW_BITS))
                    .withColumn("_tw_pos", F.col("_tw_mid") - F.shiftleft(F.col("_tw_pid"), _LOW_BITS)))
    counts = tagged.groupBy("_tw_pid").agg(F.count(F.lit(1)).alias("_tw_n"))
    # bounded by the partition count: a global window over it is a few rows
    offsets = counts.select(
        "_tw_pid",
        (F.sum("_tw_n").over(Window.orderBy("_tw_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_tw_off"))
    out = (tagged.join(F.broadcast(offsets), "_tw_pid")
                 .withColumn(name, F.coalesce(F.col("_tw_off"), F.lit(0)) + F.col("_tw_pos") + F.lit(start)))
    return out.drop("_tw_mid", "_tw_pid", "_tw_pos", "_tw_off")


# ---------------------------------------------------------------- segmented scan

def _differs(column) -> np.ndarray:
    """Whether each row after the first differs from the one before; NULL equals NULL, NaN equals NaN."""
    import pyarrow as pa
    import pyarrow.compute as pc
    a, b = column[1:], column[:-1]
    if pa.types.is_nested(column.type):
        x = column.to_pylist()
        return np.array([p != q for p, q in zip(x[1:], x)], bool)
    out = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(column.type):
        out &= ~pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False)
    return out | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))


def _same(a, b) -> bool:
    return a == b or (isinstance(a, float) and isinstance(b, float) and a != a and b != b)


def _all_same(a, b) -> bool:
    return all(_same(x, y) for x, y in zip(a, b))


class _Scan:
    """Numbers, ranks and running minima of the groups of one sorted partition, batch by batch."""

    def __init__(self, keys: list[str], ties: list[str], value: str | None):
        self.keys, self.ties, self.value = keys, ties, value
        self.last, self.seen = None, 0                     # last row's keys and ties; rows so far
        self.start = self.run = 0                          # where the group and the run of ties began
        self.group_first = self.run_first = True           # whether they are the partition's first
        self.least = None

    def _changes(self, batch, columns: list[str], place: int) -> np.ndarray:
        out = np.zeros(batch.num_rows, bool)
        for c in columns:
            out[1:] |= _differs(batch.column(c))
        out[0] = self.last is not None and not _all_same(self.last[place], [batch.column(c)[0].as_py() for c in columns])
        return out

    def add(self, batch):
        import pyarrow as pa
        n = batch.num_rows
        at = self.seen + np.arange(n)
        new = self._changes(batch, self.keys, 0)
        tied = new | self._changes(batch, self.ties, 1)
        start = np.maximum.accumulate(np.where(new, at, self.start))
        run = np.maximum.accumulate(np.where(tied, at, self.run))
        first = self.group_first & ~np.logical_or.accumulate(new)
        run_first = self.run_first & ~np.logical_or.accumulate(tied)
        lows = self._minima(batch.column(self.value), new) if self.value else pa.nulls(n, pa.int32())
        out = [pa.array(at), pa.array(at - start + 1), pa.array(first), pa.array(run - start + 1), pa.array(run_first), lows]
        self.last = tuple([batch.column(c)[n - 1].as_py() for c in columns] for columns in (self.keys, self.ties))
        self.seen, self.start, self.run = self.seen + n, int(start[-1]), int(run[-1])
        self.group_first, self.run_first = bool(first[-1]), bool(run_first[-1])
        return out

    def _minima(self, column, new: np.ndarray):
        """Least value of the earlier rows of the group, for any type that sorts: on places in the sorted values."""
        import pyarrow as pa
        import pyarrow.compute as pc
        both = pa.concat_arrays([column, pa.array([self.least], column.type)])
        order = pc.array_sort_indices(both)                # NULLs last
        places = np.empty(len(both), np.int64)
        places[order.to_numpy()] = np.arange(len(both))
        none = len(both)                                   # NULL values never are a minimum
        places[pc.is_null(both).to_numpy(zero_copy_only=False)] = none
        carried, own = places[-1], places[:-1]
        group = np.cumsum(new)
        shifted = -group * (none + 1)                      # later groups lie lower, so their minima forget the earlier ones
        inclusive = np.minimum.accumulate(np.concatenate(([carried], own + shifted)))[1:] - shifted
        before = np.concatenate(([carried], inclusive[:-1]))
        before[new] = none
        last = inclusive[-1]
        self.least = both[int(order[int(last)].as_py())].as_py() if last < none else None
        picked = pa.array(np.where(before < none, before, 0))
        return pc.if_else(pa.array(before < none), pc.take(both, pc.take(order, picked)), pa.scalar(None, column.type))


def _scanned(df: DataFrame, partition: list[str], order: list[Column], ties: list[str], value: str | None, num_partitions: int | None) -> DataFrame:
    """``df`` range-partitioned and sorted by (partition, order), written once with the scan of each partition."""
    order_cols = [F.col(p) for p in partition] + order
    ranged = df.repartitionByRange(num_partitions, *order_cols) if num_partitions else df.repartitionByRange(*order_cols)
    placed = ranged.sortWithinPartitions(*order_cols).withColumn("_tw_s_pid", F.spark_partition_id())
    low = df.schema[value].dataType if value else IntegerType()
    schema = StructType([*placed.schema.fields, StructField("_tw_s_pos", LongType()), StructField("_tw_s_n", LongType()), StructField("_tw_s_first", BooleanType()),
                         StructField("_tw_s_r", LongType()), StructField("_tw_s_run", BooleanType()), StructField("_tw_s_m", low)])
    typed = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa
        scan = _Scan(partition, ties, value)
        for b in batches:
            if b.num_rows:
                columns = [*b.columns, *scan.add(b)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, typed)], schema=typed)

    return cut_lineage(placed.mapInArrow(run, schema))


def _carried(scanned: DataFrame, partition: list[str], ties: list[str], value: str | None) -> DataFrame:
    """(pid, count, rank, low) that the first group of each partition inherits: a row a partition.

    A partition says what its ends are: its row 0 and its row of the largest
    place, which are picked without a sort; one pass over them in order finds
    what goes over each boundary.
    """
    ends = F.struct(*partition, *[F.col(t).alias(f"_tw_tie{i}") for i, t in enumerate(ties)])
    heads = scanned.where("_tw_s_pos = 0").select("_tw_s_pid", ends.alias("head"))
    last = scanned.groupBy("_tw_s_pid").agg(F.max("_tw_s_pos").alias("_tw_s_pos"))       # a row a partition
    tails = scanned.join(F.broadcast(last), ["_tw_s_pid", "_tw_s_pos"]).select(
        "_tw_s_pid", F.struct(ends.alias("key"), "_tw_s_n", "_tw_s_r", "_tw_s_first", "_tw_s_run", "_tw_s_m", *([value] if value else [])).alias("tail"))
    fields = heads.join(F.broadcast(tails), "_tw_s_pid")
    k, out, before = len(partition), [], None
    for r in sorted(fields.collect(), key=lambda r: r["_tw_s_pid"]):
        count, rank, low, tail = 0, None, None, r["tail"]
        if before is not None and _all_same(before[0][:k], r["head"][:k]):
            count, low = before[1], before[3]
            rank = before[2] if _all_same(before[0][k:], r["head"][k:]) else None
        out.append((r["_tw_s_pid"], count, rank, low))
        own = [v for v in (tail["_tw_s_m"], tail[value]) if v is not None] if value else []
        whole = [low] if tail["_tw_s_first"] and low is not None else []
        total = tail["_tw_s_n"] + (count if tail["_tw_s_first"] else 0)
        last_rank = rank if tail["_tw_s_run"] and rank is not None else tail["_tw_s_r"] + (count if tail["_tw_s_first"] else 0)
        before = (tail["key"], total, last_rank, min(own + whole, default=None))
    low_type = scanned.schema["_tw_s_m"].dataType.simpleString()
    return scanned.sparkSession.createDataFrame(out, f"_tw_s_p int, _tw_s_count long, _tw_s_rank long, _tw_s_low {low_type}")


def _scan(df: DataFrame, partition: list[str], order: list[Column], ties: list[str] | None = None, value: str | None = None,
          num_partitions: int | None = None) -> DataFrame:
    """Rows with number, rank and running minimum inside their partition, and what the partition's first group inherits.

    One range exchange and one write; the rest is a look-up of the row's
    partition in a table of one row a partition (a bounded broadcast).  A group
    however hot is spread over partitions, and no row meets its group again.
    """
    scanned = _scanned(df, partition, order, ties or [], value, num_partitions)
    carried = _carried(scanned, partition, ties or [], value)
    return scanned.join(F.broadcast(carried), F.col("_tw_s_pid") == F.col("_tw_s_p"))


_OWN = ("_tw_s_pid", "_tw_s_pos", "_tw_s_n", "_tw_s_first", "_tw_s_r", "_tw_s_run", "_tw_s_m", "_tw_s_p", "_tw_s_count", "_tw_s_rank", "_tw_s_low")


def _inherited() -> Column:
    return F.when(F.col("_tw_s_first"), F.col("_tw_s_count")).otherwise(F.lit(0))


def number_within(df: DataFrame, partition: list[str], order: list, name: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """ROW_NUMBER() OVER (PARTITION BY partition ORDER BY order) without a per-group task.

    A segmented scan: rows are range-partitioned and sorted by (partition,
    order), numbered inside the sorted partition, and only the group that
    crosses a boundary inherits a count.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = _scan(df, partition, order_cols, num_partitions=num_partitions)
    return rows.withColumn(name, F.col("_tw_s_n") + _inherited()).drop(*_OWN)


def rank_within(df: DataFrame, partition: list[str], order: list[str], name: str = "rnk",
                desc: bool = True, num_partitions: int | None = None) -> DataFrame:
    """RANK() OVER (PARTITION BY partition ORDER BY order): ties share the first number of
    their run; by the scan of :func:`number_within`, which also carries a run over a boundary."""
    rows = _scan(df, partition, [F.col(c).desc() if desc else F.col(c) for c in order], order, num_partitions=num_partitions)
    inherited = F.when(F.col("_tw_s_run"), F.col("_tw_s_rank"))
    return rows.withColumn(name, F.coalesce(inherited, F.col("_tw_s_r") + _inherited())).drop(*_OWN)


def running_min_within(df: DataFrame, partition: list[str], order: list, value: str, name: str = "min_before",
                       num_partitions: int | None = None) -> DataFrame:
    """MIN(value) over all earlier rows of the partition, by the same scan; NULL where there are none."""
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = _scan(df, partition, order_cols, value=value, num_partitions=num_partitions)
    return rows.withColumn(name, F.least("_tw_s_m", F.when(F.col("_tw_s_first"), F.col("_tw_s_low")))).drop(*_OWN)
