"""Perturbed copies of texts, made once each: masked spans drawn by keyed hashes, and a table of results by content."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.plans import cut


def masked_spans(text: Column, copy: Column, share: float = 0.15, span: int = 2, seed: int = 7, mask: str = "<mask>") -> Column:
    """The text's words with spans of ``span`` words replaced by ``mask``, so many that about ``share`` of the words are; joined by blanks.

    The words are cut into blocks of ``span`` and a gap of one; the blocks with the least hashes of (hash of seed, copy and text; block) are masked. So masks never touch, and a
    text and copy number always give the same result, wherever it is computed. Texts shorter than a span are left as they are.
    """
    step = span + 1

    def mask_of(x: Column) -> Column:
        """x: a struct of the words and a hash of the text; as a lambda's variable it is worked out once and not for every word."""
        blocks = F.floor(F.size(x["words"]) / step).cast("int")
        wanted = F.least(blocks, F.greatest(F.lit(1), F.round(F.size(x["words"]) * share / span).cast("int")))
        rank = lambda b: F.struct(F.xxhash64(x["h"], b).alias("h"), b.alias("b"))
        ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0))), rank))
        return F.struct(x["words"].alias("words"), x["h"].alias("h"), F.when(blocks > 0, F.element_at(ranked, F.greatest(wanted, F.lit(1)))).alias("last"))

    def put(x: Column) -> Column:
        def word(w: Column, i: Column) -> Column:
            block = F.floor(i / step).cast("int")
            hit = (i % step < span) & (block < F.floor(F.size(x["words"]) / step)) & (F.struct(F.xxhash64(x["h"], block).alias("h"), block.alias("b")) <= x["last"])
            return F.when(F.coalesce(hit, F.lit(False)), F.when(i % step == 0, F.lit(mask))).otherwise(w)

        return F.array_join(F.filter(F.transform(x["words"], word), lambda w: w.isNotNull()), " ")

    words = F.filter(F.split(text, r"[\x09-\x0D ]+"), lambda w: w != "")
    one = F.array(F.struct(words.alias("words"), F.xxhash64(F.lit(seed), copy, text).alias("h")))
    return F.when(text.isNotNull(), F.transform(F.transform(one, mask_of), put)[0])


def content_key(text: Column, parameters: str) -> Column:
    """The SHA-256 of a text and of what is done to it."""
    return F.sha2(F.concat(F.lit(f"{parameters}\0"), text), 256)


SCHEMA = "key string, value string"


def known_results(spark: SparkSession, folder: str) -> DataFrame:
    """(key, value) of all that has been stored; of results that two runs stored at once the least value counts."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(folder).groupBy("key").agg(F.min("value").alias("value"))


def cached(texts: DataFrame, text: str, parameters: str, folder: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``texts`` with ``value``, computed by ``compute`` ((key, text) to (key, value)) only for texts that ``folder`` has no result of.

    Misses are found by an anti join on the content's key, each distinct text once. They are written into a new subfolder by one job, which shows up whole or not at all, and nothing that is
    there is changed; so a run that fails leaves no half row and the next one takes up what is missing. A null text has a null value.
    """
    spark = texts.sparkSession
    keyed = texts.withColumn("key", content_key(F.col(text), parameters))
    asked = keyed.filter(F.col("key").isNotNull()).select("key", F.col(text).alias("text")).dropDuplicates(["key"])
    misses = cut(asked.join(known_results(spark, folder).select("key"), "key", "left_anti"))
    if not misses.isEmpty():
        compute(misses).select("key", "value").write.parquet(f"{folder}/{uuid.uuid4().hex}")
    return keyed.join(known_results(spark, folder), "key", "left").drop("key")
