"""Sinks: measures as text, annotations as XML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def measure_lines(measures: DataFrame) -> DataFrame:
    """(key, value) rows as ``measure{ key: "k" value: "v" }`` blocks, in the column value."""
    block = F.concat(F.lit('measure{\n  key: "'), F.col("key"), F.lit('"\n  value: "'), F.col("value").cast("string"), F.lit('"\n}'))
    return measures.select(block.alias("value"))


def long_form(row: DataFrame) -> DataFrame:
    """A one-row report as (key, value) rows."""
    numbers = [c for c, kind in row.dtypes if kind in ("double", "bigint", "int", "float")]
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in numbers])
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def write_measures(measures: DataFrame, path: str) -> None:
    measure_lines(measures).write.mode("overwrite").text(path)


def write_annotations(rows: DataFrame, path: str, name: str) -> None:
    """Passages as XML, one document element per ref."""
    feature = F.struct(F.lit(name).alias("_name"), F.col("off").alias("_this_offset"), F.col("len").alias("_this_length"), F.when(F.col("ext"), F.col("sref")).alias("_source_reference"), F.when(F.col("ext"), F.col("soff")).alias("_source_offset"), F.when(F.col("ext"), F.col("slen")).alias("_source_length"))
    docs = rows.groupBy(F.col("ref").alias("_reference")).agg(F.collect_list(feature).alias("feature"))
    docs.write.format("xml").option("rootTag", "documents").option("rowTag", "document").mode("overwrite").save(path)


def write_answers(rows: DataFrame, path: str, kind: str = "jsonl") -> None:
    """Answers as JSON lines, or as CSV or TSV with a header. The rows are written by as many tasks as they have partitions."""
    if kind == "jsonl":
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif kind in ("csv", "tsv"):
        rows.write.mode("overwrite").option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)
    else:
        raise ValueError(f"unknown kind of answers {kind}")
