"""Validators: each returns rows (item, error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def errors(df: DataFrame, item: str, checks: dict[str, Column]) -> DataFrame:
    """One row per item and failed check. A check is the condition of the error; null counts as an error."""
    found = F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()])
    return df.select(F.col(item).cast("string").alias("item"), F.explode(F.filter(found, lambda e: e.isNotNull())).alias("error"))


def missing_ids(truth: DataFrame, run: DataFrame, key: str) -> DataFrame:
    return truth.select(key).join(run.select(key), key, "left_anti").select(F.col(key).cast("string").alias("item"), F.lit("MISSING_ID").alias("error"))


def id_sets(truth: DataFrame, run: DataFrame, key: str) -> DataFrame:
    """Ids that only one side has."""
    extra = run.select(key).join(truth.select(key), key, "left_anti").select(F.col(key).cast("string").alias("item"), F.lit("UNKNOWN_ID").alias("error"))
    return missing_ids(truth, run, key).unionByName(extra)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(key).cast("string").alias("item"), F.lit("DUPLICATE_ID").alias("error"))


def required(df: DataFrame, item: str, columns: list[str]) -> DataFrame:
    """Missing or blank attributes."""
    return errors(df, item, {f"MISSING_{c.upper()}": F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in columns})


def offsets(spans: DataFrame, texts: DataFrame, key: str, item: str, off: str, len_: str, text_len: str) -> DataFrame:
    """Negative offsets, and ranges that end behind their text."""
    joined = spans.join(texts.select(key, text_len), key, "left")
    return errors(joined, item, {"NEGATIVE_OFFSET": F.col(off) < 0, "BEYOND_TEXT": F.col(off) + F.col(len_) > F.col(text_len)})


def referential(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, item: str, error: str) -> DataFrame:
    known = parent.select(F.col(parent_key).alias("_known"))
    return child.join(known, child[child_key] == F.col("_known"), "left_anti").select(F.col(item).cast("string").alias("item"), F.lit(error).alias("error"))


def changes(df: DataFrame, item: str, changes_: str, paragraphs: str) -> DataFrame:
    """Arrays that are missing, hold other values than 0 and 1, or don't have one entry per paragraph boundary."""
    c = F.col(changes_)
    return errors(df, item, {"MISSING_KEY": c.isNull(), "INVALID_FORMAT": F.coalesce(F.exists(c, lambda x: ~x.isin(0, 1)), F.lit(False)), "INVALID_LENGTH": F.coalesce(F.size(c) != F.col(paragraphs) - 1, F.lit(False))})


def authors(df: DataFrame, item: str, authors_: str, paragraphs: str, most: int = 5) -> DataFrame:
    """Author numbers outside 1 .. ``most``, and arrays without one entry per paragraph."""
    a = F.col(authors_)
    return errors(df, item, {"INVALID_AUTHOR": F.exists(a, lambda x: (x < 1) | (x > most)), "INVALID_LENGTH": F.size(a) != F.col(paragraphs)})


def labels(df: DataFrame, item: str, labels_: str, vocabulary: list[str]) -> DataFrame:
    unknown = F.filter(F.col(labels_), lambda x: ~x.isin(*vocabulary))
    return errors(df, item, {"UNKNOWN_LABEL": F.size(unknown) > 0, "NO_LABEL": F.size(labels_) == 0})


def nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: its name and number of nulls and blanks."""
    counts = df.agg(*[F.sum((F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("long")).alias(c) for c in columns])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c) for c in columns]))).alias("item", "n"))
