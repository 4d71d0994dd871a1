"""A training-corpus pipeline over ``documents``: quality, two deduplications, mixing, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage's result as Parquet into the shared checkpoint folder and reads it again for the next. An empty
table goes through all stages; columns besides those of ``documents`` are carried up to the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import exact_dedup, mixing, near_copies, quality, queries
from assayer.plans import checkpoint_folder, remove_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep. A null, empty or short text is rejected; repeated rows get one verdict."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id. Null and empty texts are equal; repeated rows become one; a null id
    stays only where no other has its text."""
    return exact_dedup.drop_copies(docs, keep="min")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Near copies have a similarity of 0.8 or more over shingles of 5 words; SimHash of 1024 bits finds them. Texts without words are one group."""
    return near_copies.drop_near_copies(docs, width=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, by the weights of the mixing query; no document twice. Null languages and sources are a node each; ties in the order go by id."""
    return mixing.take_mixed(docs, queries.MIX_WEIGHTS, share=queries.MIX_SHARE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left; a null or empty text has none, and a null id counts as 0 in the keyed hash."""
    return queries.encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: No SQL: components of near copies and merges are outside it. The tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")  # the next stage is written whole, so nothing reads this one again
    return docs
