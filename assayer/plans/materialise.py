"""Cutting lineage into shared storage, and broadcasts behind a size check."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` wins; a temporary folder is made only where the
    session names none (local tests), because executors of a cluster could not
    see it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="assayer-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and go on from the files."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df`` of up to ``rows`` rows in no more partitions than have about ``each`` of them.

    A table of few rows over many partitions leaves some small files a partition in each later exchange and checkpoint; a large one keeps its partitions.
    """
    return df.coalesce(max(1, -(-rows // each)))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a materialised table for broadcast if it has at most ``max_rows`` rows.

    Larger tables come back unmarked, so the join that uses them shuffles
    (and adaptive execution splits its skewed partitions). The count stops
    at ``max_rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Bytes of an Arrow batch, about; a batch is a row at least.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, not by rows alone, where the session does not say otherwise: 10,000 long texts would be a large batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with underscores behind it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def join_counted(left: DataFrame, right: DataFrame, key: str, size: str, how: str = "inner", small: int = 200_000, hot_share: int = 50_000) -> DataFrame:
    """``left`` joined to ``right``, which has one materialised row per key and the number of left rows of that key as ``size``.

    Up to ``small`` rows of ``right`` are broadcast whole. Beyond that, a key is hot if more than the
    ``hot_share``-th part of all counted rows (1,000 at least) have it: there are fewer than ``hot_share`` such keys whatever the input, so
    they are broadcast, and their left rows stay where they are. The other rows are shuffled, and no key of
    theirs is large. ``how``: inner or left; rows of no counted key are never hot.
    """
    if right.limit(small + 1).count() <= small:
        return left.join(F.broadcast(right), key, how)
    total = right.agg(F.sum(size)).collect()[0][0]
    bound = max(1000, total // hot_share)
    hot = right.filter(F.col(size) > bound)
    if hot.isEmpty():
        return left.join(right, key, how)
    near = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return near.unionByName(rest.join(right.filter(F.col(size) <= bound), key, how))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
