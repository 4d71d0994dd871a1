"""SimHash near-duplicates: pigeonring filtering, then the full Hamming check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.graph import components
from assayer.plans import bounded_batches, cut, join_counted

BITS = 64


def _fingerprints(width: int):
    import xxhash

    digest = xxhash.xxh64_intdigest

    def one(text: bytes | None) -> int:
        words = (text or b"").lower().split()
        if not words:
            return 0
        if len(words) <= width:
            hashes = [digest(b" ".join(words), 42)]
        else:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
            hashes = [digest(line[s : e - 1], 42) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)]
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([one(t.as_py()) for t in texts], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the 64-bit SimHash of each text as a signed long.

    A-Z are lower-cased; shingles are ``width`` words (split at ASCII white space)
    joined by one space, repeats included; fewer words give one shingle. Each
    shingle's hash is XXH64 of its UTF-8 bytes with seed 42. A bit is 1 if it is 1
    in over half of the hashes. A text without words, or null, has fingerprint 0.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_fingerprints(width), "id long, fp long")


def _hamming(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def chain_length(distance: int, segments: int) -> int:
    """Consecutive segments that must be equal: the longest chain whose budget is below one bit."""
    return (segments - 1) // distance if distance else segments


def similar_fingerprints(fps: DataFrame, distance: int = 2, segments: int = 16, bucket_cap: int = 64) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs within ``distance`` bits.

    ``fps`` holds distinct fingerprints in column fp. The 64 bits are a ring of
    ``segments`` equal segments. If two fingerprints differ in at most d bits, then some
    start exists from which every chain of l segments differs in at most
    ``l * d / segments`` bits (the pigeonring principle). For short chains that budget is
    under one bit, so those segments are equal: they are the bucket key. Pairs inside a
    bucket must then keep the budget on every longer chain, and last comes the full
    Hamming check.

    A bucket of over ``bucket_cap`` fingerprints makes no pairs. Its members are
    linked exactly in another way: each lists the points within ``distance // 2`` bits of
    itself, and members sharing a point are within ``distance`` of each other; a point
    has at most 65 members, and each is linked to the least. This needs distance 2.
    """
    if distance != 2 or BITS % segments:
        raise ValueError("distance 2 and a divisor of 64 segments are supported")
    size, run = BITS // segments, chain_length(distance, segments)
    fp = F.col("fp")

    def turned(by: int):
        return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))

    starts = F.array(*[F.struct(F.lit(i).alias("start"), turned(i * size).alias("ring")) for i in range(segments)])
    keyed = fps.select("fp", F.explode(starts).alias("s")).select(
        "fp", F.col("s.start").alias("start"), F.col("s.ring").alias("ring"), F.shiftrightunsigned(F.col("s.ring"), BITS - run * size).alias("key")
    )
    sizes = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut(keyed.join(sizes, ["start", "key"]))
    small = shared.filter(F.col("n") <= bucket_cap)
    a, b = small.alias("a"), small.alias("b")
    pairs = a.join(b, (F.col("a.start") == F.col("b.start")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
    differ = F.col("a.ring").bitwiseXOR(F.col("b.ring"))
    for length in range(run + 1, segments + 1):
        head = differ if length == segments else F.shiftrightunsigned(differ, BITS - length * size)
        pairs = pairs.filter(F.bit_count(head) <= length * distance // segments)
    pairs = pairs.filter(_hamming(F.col("a.fp"), F.col("b.fp")) <= distance)
    links = pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    crowded = shared.filter(F.col("n") > bucket_cap).select("fp").distinct()
    around = F.array(fp, *[fp.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(BITS)])
    least = F.min("fp").over(Window.partitionBy("point"))
    stars = crowded.select("fp", F.explode(around).alias("point")).withColumn("least", least).filter(F.col("fp") != F.col("least"))
    return links.unionByName(stars.select(F.col("least").alias("a"), F.col("fp").alias("b"))).distinct()


def simhash_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2, segments: int | None = None, bucket_cap: int = 64
) -> DataFrame:
    """One row per row of ``df``: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most ``distance``
    differing bits, the row's own included. Equal fingerprints meet before any pair
    is made, so a group of copies costs one row. Without ``segments``, 16 of them give keys of 28 bits; from 2**26 distinct fingerprints
    on, 64 give 31. Null ids take no part in the minimum
    (a component of null ids only has null). Repeated rows each come out; other columns are not
    read; an empty table gives an empty result.
    """
    marked = cut(fingerprints(df, id_col, text_col, width))
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")))
    if segments is None:
        segments = 16 if distinct.count() < 1 << 26 else 64
    labels = components(similar_fingerprints(distinct.select("fp"), distance, segments, bucket_cap))
    member = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least", "rows", F.coalesce("label", "fp").alias("label"))
    smallest = member.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = cut(join_counted(member, cut(smallest), "label", "n").select("fp", "component_id", "rows"))
    return join_counted(marked, named, "fp", "rows").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
