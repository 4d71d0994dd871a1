"""Measures over runs that arrive in pieces: counts of each micro-batch are merged into a table, once each, however often a batch is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer.functions import measures as m
from assayer.plans import broadcast_if_small

COUNTS = ["n", "tp", "tn", "fp", "fn", "open", "missing"]
SCHEMA = "grp string, " + ", ".join(f"{c} long" for c in COUNTS) + ", squares double, batch long"


def batch_counts(run: DataFrame, truth: DataFrame) -> DataFrame:
    """grp, counts and the sum of squared errors of the answers (id, value) in ``run`` against ``truth`` (id, grp, y); ids that are not in it count as missing.

    A value over 0.5 is a yes, under it a no, 0.5 and null leave the case open.
    """
    p, y = F.coalesce("value", F.lit(0.5)), F.col("y")
    joined = run.select("id", "value").join(truth.select("id", "grp", "y"), "id", "left")
    known = y.isNotNull()
    parts = {"n": known, "tp": (p > 0.5) & (y == 1), "tn": (p < 0.5) & (y == 0), "fp": (p > 0.5) & (y == 0), "fn": (p < 0.5) & (y == 1), "open": known & (p == 0.5), "missing": ~known}
    squares = F.coalesce(F.sum(F.when(known, (p - y) * (p - y))), F.lit(0.0)).alias("squares")
    return joined.groupBy("grp").agg(*[F.count_if(c).alias(k) for k, c in parts.items()], squares)


def merge_run(run: DataFrame, truth: DataFrame, table: str, checkpoint: str, small: int = 500_000, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that writes the counts of every micro-batch of ``run`` into ``table`` (Parquet, a folder a batch).

    A batch overwrites its own folder only, so one that is run again after a failure leaves the table as it was; the folder of the checkpoint remembers which batches are done.
    The truth stays a table: its rows of up to ``small`` are broadcast, else each batch is joined to it by hash.
    """

    def put(batch: DataFrame, number: int) -> None:
        counts = batch_counts(batch, broadcast_if_small(truth, small))
        counts.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return run.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def merged_counts(spark: SparkSession, table: str) -> DataFrame:
    """grp and the counts of all batches so far."""
    rows = spark.read.schema(SCHEMA).parquet(table)
    return rows.groupBy("grp").agg(*[F.sum(c).alias(c) for c in COUNTS], F.sum("squares").alias("squares"))


def measures_so_far(counts: DataFrame) -> DataFrame:
    """grp, n, missing, accuracy, c_at_1, f1 and brier (1 - mean squared error) from merged counts."""
    right, n = F.col("tp") + F.col("tn"), F.col("n")
    return counts.select(
        "grp",
        "n",
        "missing",
        m.ratio(right, n).alias("accuracy"),
        m.ratio(right + F.col("open") * right / n, n).alias("c_at_1"),
        m.f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"),
        (1 - m.ratio(F.col("squares"), n)).alias("brier"),
    )
