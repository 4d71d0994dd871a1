"""Resampling of multi-label rows to target counts: the rarest class first, with what earlier classes have brought along."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.plans import cut

#: Shares of the hash range that are numbered one by one; their counts are summed in one task.
SHARES = 16


class Strategy(NamedTuple):
    """Places in the classes by falling size, as shares of their number, whose counts are the targets; a class goes to the nearest. ``over`` and ``under``: whether rows
    are repeated or left out. ``then`` is a second pass over what the first has left."""

    targets: tuple[float, ...]
    over: bool
    under: bool
    then: Strategy | None = None


#: Balanced to the median class, or cut down to it; only the largest quarter cut; both ends; to the nearest of three steps, balanced or cut.
STRATEGIES = {
    "ruos_m": Strategy((1 / 2,), True, True),
    "rus_m": Strategy((1 / 2,), False, True),
    "rus_top": Strategy((1 / 4,), False, True),
    "ruos_ends": Strategy((1 / 4,), False, True, Strategy((3 / 4,), True, False)),
    "ruos_q": Strategy((1 / 6, 3 / 6, 5 / 6), True, True),
    "rus_q": Strategy((1 / 6, 3 / 6, 5 / 6), False, True),
}


def class_sizes(rows: DataFrame, labels: str, times: Column | None = None) -> list[tuple[str, int]]:
    """(class, rows), the largest first, ties by name: a row a class, so the driver may hold them."""
    n = F.sum(times if times is not None else F.lit(1))
    found = rows.select(F.explode(labels).alias("c"), *(["times"] if times is not None else [])).groupBy("c").agg(n.alias("n")).collect()
    return sorted(((r["c"], r["n"]) for r in found), key=lambda x: (-x[1], x[0]))


def nearest_target(targets: list[int], size: int) -> int:
    return min(targets, key=lambda t: abs(t - size))


def numbered(rows: DataFrame, key: str, seed: Column) -> DataFrame:
    """``rows`` with ``place``, from 0 on, in the order of a keyed hash of the key; ties by the key.

    The hash range is cut into 2**16 shares: their counts are summed up in one small window, and rows are ranked inside their share only.
    """
    h = F.xxhash64(seed, F.col(key))
    hashed = rows.withColumns({"_h": h, "_share": F.shiftright(h, 64 - SHARES)})
    counts = hashed.groupBy("_share").agg(F.count(F.lit(1)).alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("_share").orderBy("_h", key)) - 1
    joined = hashed.withColumn("_rank", rank).join(F.broadcast(counts.select("_share", offset.alias("_offset"))), "_share")  # 65,536 rows at most
    return joined.withColumn("place", F.col("_offset") + F.col("_rank")).drop("_h", "_share", "_rank", "_offset")


def drawn(rows: DataFrame, key: str, n: int, seed: int, what: str) -> DataFrame:
    """(key, times): ``n`` draws with replacement from the rows, each by a hash of its number."""
    many = rows.count()
    if not many or not n:
        return rows.select(key).limit(0).withColumn("times", F.lit(0).cast("long"))
    tag = F.lit(f"{seed}:{what}")
    places = rows.sparkSession.range(n).select(F.pmod(F.xxhash64(tag, "id"), F.lit(many)).alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("times"))
    return numbered(rows.select(key), key, tag).join(places, "place").select(key, "times")


def _one_label_only(free: int, single: int, multi: int) -> bool:
    """Whether rows of one label are enough to draw from."""
    return free < 3 * single or single > 10 * multi


def sample_classes(rows: DataFrame, key: str, labels: str, strategy: Strategy, seed: int = 5) -> DataFrame:
    """(key, times): how often each row is taken.

    Classes are taken from the rarest to the most frequent. A class has as many free places as its target lacks of the labels that rows taken so far have; one that is full is passed over. Rows of
    the class that are not taken yet fill the places, each once, if there are enough places; else places are drawn from them with replacement, from those of one label if these are
    many. Places that stay free are drawn from all rows of the class likewise. Draws are keyed by hashes, so the result is the same however rows are split. A row has each of its
    labels once; rows without labels are never taken; keys are unique. The driver goes through the classes, which are few; rows stay where they are but for joins by key.
    """
    rows = cut(rows.select(key, F.array_distinct(labels).alias("labels"), F.lit(1).cast("long").alias("many")))
    taken = _pass(rows, key, strategy, f"{seed}")
    if strategy.then is not None:
        kept = cut(rows.drop("many").join(taken.withColumnRenamed("times", "many"), key))
        taken = _pass(kept, key, strategy.then, f"{seed}:then")
    return taken


def _pass(rows: DataFrame, key: str, strategy: Strategy, seed: str) -> DataFrame:
    """One pass over rows (key, labels, many), each of which stands for ``many`` equal ones."""
    rows = cut(rows.withColumn("times", F.col("many")))
    sizes = class_sizes(rows, "labels", F.col("times"))
    taken = rows.select(key, F.col("times")).limit(0)
    if not sizes:
        return taken
    places = [min(round(len(sizes) * x), len(sizes) - 1) for x in strategy.targets]
    targets, sampled = [sizes[p][1] for p in places], dict.fromkeys((c for c, _ in sizes), 0)
    for name, size in reversed(sizes):
        target = nearest_target(targets, size)
        if (target > size and not strategy.over) or (target < size and not strategy.under):
            target = size
        free = target - sampled[name]
        if free <= 0:
            continue
        mine = cut(rows.filter(F.array_contains("labels", name)).join(taken.select(key, F.lit(True).alias("had")), key, "left").withColumn("had", F.coalesce("had", F.lit(False))))
        counts = mine.agg(*[F.coalesce(F.sum(F.when(c, F.col("times"))), F.lit(0)).alias(n) for n, c in (("single", F.size("labels") == 1), ("all", F.lit(True)), ("left", ~F.col("had")), ("left_single", ~F.col("had") & (F.size("labels") == 1)))]).collect()[0]
        parts, single = [], F.size("labels") == 1
        if free >= counts["left"]:
            parts.append(mine.filter(~F.col("had")).select(key, "times"))
            free -= counts["left"]
            if free:
                alone = _one_label_only(free, counts["single"], counts["all"] - counts["single"])
                parts.append(_repeated(mine.filter(single) if alone else mine, key, free, seed, f"over:{name}"))
        else:
            alone = _one_label_only(free, counts["left_single"], counts["left"] - counts["left_single"])
            parts.append(_repeated(mine.filter(~F.col("had") & (single if alone else F.lit(True))), key, free, seed, f"under:{name}"))
        for p in parts:
            taken = taken.unionByName(p)
        taken = cut(taken.groupBy(key).agg(F.sum("times").alias("times")))
        sampled.update(class_sizes(taken.join(rows.select(key, "labels"), key), "labels", F.col("times")))
    return taken


def _repeated(rows: DataFrame, key: str, n: int, seed: str, what: str) -> DataFrame:
    """Draws from rows that stand for ``times`` equal ones each."""
    each = rows.select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")).withColumn("one", F.struct(key, "copy"))
    found = drawn(each.select("one"), "one", n, 0, f"{seed}:{what}")
    return found.groupBy(F.col(f"one.{key}").alias(key)).agg(F.sum("times").alias("times"))
