"""Score files that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import measures as m
from assayer.operators import validate

RUN = "id string, value double, ts timestamp"


def read_run(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines (id, value, ts) from files that appear in a folder."""
    return spark.readStream.schema(RUN).option("maxFilesPerTrigger", files_per_batch).json(folder)


def validate_stream(run: DataFrame) -> DataFrame:
    """Errors of each row on its own: no state, so it holds for streams and tables alike."""
    return validate.errors(run, "id", {"MISSING_ID": F.col("id").isNull(), "MISSING_VALUE": F.col("value").isNull(), "OUT_OF_RANGE": F.coalesce((F.col("value") < 0) | (F.col("value") > 1), F.lit(False))})


def accumulate_counts(run: DataFrame, truth: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts per event-time window from which every threshold measure follows: n, tp, fp, fn, open. Late rows are dropped after ``delay``."""
    y, p = F.col("y"), F.col("value")
    joined = run.withWatermark("ts", delay).join(truth, "id")
    return joined.groupBy(F.window("ts", width)).agg(
        F.count(F.lit(1)).alias("n"), m.count_if((p > 0.5) & (y == 1)).alias("tp"), m.count_if((p > 0.5) & (y == 0)).alias("fp"), m.count_if((p < 0.5) & (y == 1)).alias("fn"), m.count_if(p == 0.5).alias("open")
    )
