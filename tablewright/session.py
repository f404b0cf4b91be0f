"""Spark session defaults and lineage helpers.

Everything here is plain Spark configuration: AQE re-plans joins and
partition counts at runtime, broadcast joins are chosen by Spark only when
the measured side is under ``spark.sql.autoBroadcastJoinThreshold`` (the
size check, with sort-merge join as the fallback), and skewed join
partitions are split by AQE.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "tablewright",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return a session with the library's defaults (only keys not already set)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be configured (shared storage); only a
    local-mode session (tests, benches) gets a folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative operators")
        configured = tempfile.mkdtemp(prefix="tablewright-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    The result no longer depends on the plan that produced it (a retried or
    lost task re-reads the files instead of recomputing upstream stages), and
    a columnar table writes and reads back faster than an RDD checkpoint.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    open_ = _scratches()
    if open_:
        open_[-1].append(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


#: Rows of a partition whose sorts and joins are to fit a task's memory at any size of the input.
PART_ROWS = 1 << 19


def parts_of(df: DataFrame, rows: int) -> int:
    """Partitions of at most about ``PART_ROWS`` rows, at least the session's parallelism; AQE never merges a number asked for."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS))


_LOCAL = threading.local()


def _scratches() -> list[list[str]]:
    """Paths that the open scratches of this thread will remove, innermost last."""
    if not hasattr(_LOCAL, "open"):
        _LOCAL.open = []
    return _LOCAL.open


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that :func:`cut_lineage` writes inside are removed at the end.

    Gives a function that writes a DataFrame as a table of the enclosing
    scratch, or one that stays: what leaves the block must go through it.

        with scratch(spark) as keep:
            steps = cut_lineage(...)
            result = keep(steps.join(...))
    """
    made: list[str] = []
    open_ = _scratches()
    open_.append(made)

    def keep(df: DataFrame) -> DataFrame:
        at = open_.index(made)
        inner = open_[at:]
        del open_[at:]
        try:
            return cut_lineage(df)
        finally:
            open_.extend(inner)

    try:
        yield keep
    finally:
        open_.remove(made)
        for path in made:
            remove_table(spark, path)


def remove_table(spark: SparkSession, path: str) -> None:
    """Removes a folder in whatever store its path names."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[SparkSession]:
    """What is defined and run inside removes its shuffle files as it ends; otherwise they stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield spark
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
