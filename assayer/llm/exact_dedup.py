"""Exact deduplication by 128-bit content hash with a byte comparison inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.plans import cut, fresh_names, join_counted

#: Groups of copies of which so many are broadcast: a hash, an id and a count each.
SMALL = 500_000


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", small: int = SMALL) -> DataFrame:
    """One row per row of ``df``: its group of equal texts and whether it stays.

    Rows are grouped by MD5 (128 bits) of the text's UTF-8 bytes, without their texts. Only
    groups of two rows or more are looked at again: each takes its smallest and largest text in byte
    order, pre-aggregated before the shuffle; the two are equal exactly if all texts of the group are, which
    compares the bytes without bringing a group together. A group in which they
    differ is a hash collision and is regrouped by the texts themselves.

    ``keep``: the id that stays, ``min`` or ``max`` of the group. ``small``: groups of copies up to which they are broadcast.

    Result: ``id_col``, keep_id, group_size (long), kept, text_sha256. A null text
    counts as empty. Null ids never win against others; a group of null ids only
    has a null keep_id and keeps its rows. Repeated rows (one id, one text) are one document: they count
    in group_size and share one verdict. Other columns of ``df`` are not read. An
    empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).alias("id"), _text(text_col).alias("t"))
    groups, exact = _groups(docs, keep, small)
    rows = docs.select("id", _hash(F.col("t")).alias("h"), F.sha2("t", 256).alias("text_sha256"))
    joined = join_counted(rows, groups, "h", "group_size", "left", small)
    alone = F.col("group_size").isNull()
    found = joined.filter(alone | ~F.col("collided")).select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256"
    )
    if exact is not None:
        apart = docs.withColumn("h", _hash(F.col("t"))).join(exact, ["h", "t"])
        found = found.unionByName(apart.select("id", "keep_id", "group_size", F.sha2("t", 256).alias("text_sha256")))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def _text(text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _hash(text):
    return F.unhex(F.md5(text))


def _groups(docs: DataFrame, keep: str, small: int) -> tuple[DataFrame, DataFrame | None]:
    """Of ``docs(id, t)``: (h, keep_id, group_size, collided) of the hashes of two rows or more, and groups by text of those that collide, if any do."""
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    best = F.min if keep == "min" else F.max
    size = F.count(F.lit(1)).alias("group_size")
    hashed = docs.withColumn("h", _hash(F.col("t")))
    counted = cut(hashed.groupBy("h").agg(best("id").alias("keep_id"), size).filter("group_size > 1"))
    copies = join_counted(hashed.select("h", "t"), counted.select("h", "group_size"), "h", "group_size", "inner", small)
    ends = copies.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    collided = cut(ends.filter(F.col("lo") != F.col("hi")).select("h", F.lit(True).alias("collided")))
    if collided.isEmpty():
        return counted.withColumn("collided", F.lit(False)), None
    marked = counted.join(F.broadcast(collided), "h", "left").na.fill(False, ["collided"])  # MD5 collisions: made by hand, and few
    exact = hashed.join(F.broadcast(collided.select("h")), "h", "left_semi").groupBy("h", "t").agg(best("id").alias("keep_id"), size)
    return cut(marked), cut(exact)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", small: int = SMALL) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; repeated rows of one that stays collapse.

    Rows without a copy go through without a shuffle while there are up to ``small`` groups of copies; of a
    group, only the rows with the id that stays move, so no group of copies meets in one task. Nulls, empty texts and empty tables
    as in ``exact_dedup``; columns of any name are carried through.
    """
    h, i, t, stay, n, bad = fresh_names(df, "h", "id", "t", "keep_id", "group_size", "collided")
    groups, exact = _groups(df.select(F.col(id_col).alias("id"), _text(text_col).alias("t")), keep, small)
    groups = groups.select(F.col("h").alias(h), F.col("keep_id").alias(stay), F.col("group_size").alias(n), F.col("collided").alias(bad))
    rows = df.withColumns({h: _hash(_text(text_col)), i: F.col(id_col)})
    rows = join_counted(rows, groups, h, n, "left", small)
    alone = rows.filter(F.col(f"`{n}`").isNull())
    first = rows.filter(F.col(f"`{n}`").isNotNull() & ~F.col(f"`{bad}`") & F.col(f"`{i}`").eqNullSafe(F.col(f"`{stay}`"))).dropDuplicates([h, i])
    kept = alone.unionByName(first)
    if exact is not None:
        apart = df.withColumns({h: _hash(_text(text_col)), t: _text(text_col), i: F.col(id_col)})
        exact = exact.select(F.col("h").alias(h), F.col("t").alias(t), F.col("keep_id").alias(stay))
        more = apart.join(exact, [h, t]).filter(F.col(f"`{i}`").eqNullSafe(F.col(f"`{stay}`"))).dropDuplicates([h, t, i])
        kept = kept.select(*_all(df)).unionByName(more.select(*_all(df)))
    return kept.select(*_all(df))


def _all(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]
