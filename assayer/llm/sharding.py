"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    """A 64-bit finaliser (splitmix64)."""
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


@dataclass
class Ring:
    """Virtual nodes of all shards in clockwise order.

    ``points[i]`` ends arc i: a key at position x belongs to the first point at or
    after x (the first point of all past the last). ``order(i)`` lists the shards
    met clockwise from there, each once.
    """

    shards: int
    virtual_nodes: int = 128
    seed: int = 7
    points: np.ndarray = field(init=False)
    owners: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        made = sorted((_mix(_mix(self.seed + s * 0x1000193) + v), s) for s in range(self.shards) for v in range(self.virtual_nodes))
        self.points = np.array([p for p, _ in made], dtype=np.uint64)
        self.owners = np.array([s for _, s in made], dtype=np.int64)

    def arc(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.points, positions, side="left") % len(self.points)

    def order(self, arc: int) -> list[int]:
        seen: dict[int, None] = {}
        n = len(self.owners)
        for k in range(n):
            seen.setdefault(int(self.owners[(arc + k) % n]))
            if len(seen) == self.shards:
                break
        return list(seen)


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Row capacity of each shard; with no slack they sum to ``total`` and differ by one at most."""
    if slack <= 0:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [-int(-(1 + slack) * total // shards)] * shards


def place(ring: Ring, counts: dict[int, int], slack: float) -> list[tuple[int, int, int, int]]:
    """Segments (arc, first rank, shard, first slot) that place ``counts[arc]`` keys of each arc.

    Step 0 offers every arc's keys to the shard its arc belongs to; step k offers what
    is left over to the k-th next shard clockwise. A shard takes keys in ring order
    until it is full. So a key leaves its own shard only if that is full, and goes to
    the next shard with room.
    """
    room = capacities(sum(counts.values()), ring.shards, slack)
    used = [0] * ring.shards
    done = dict.fromkeys(counts, 0)
    orders = {a: ring.order(a) for a in counts}
    segments = []
    for step in range(ring.shards):
        for arc in sorted(counts):
            left = counts[arc] - done[arc]
            shard = orders[arc][step]
            take = min(left, room[shard] - used[shard])
            if take > 0:
                segments.append((arc, done[arc], shard, used[shard]))
                done[arc] += take
                used[shard] += take
    return segments


def shard_documents(
    df: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    virtual_nodes: int = 128,
    slack: float = 0.0,
    seed: int = 7,
) -> DataFrame:
    """Place every row: ``id_col``, size, text_crc32, law, shard, slot, grown_shard.

    The ring position of a row is XXH64 of its id. Only the number of keys in
    each arc reaches the driver (``shards * virtual_nodes`` rows, whatever the input);
    it plans which ranks of an arc go to which shard, and each row finds its shard and
    slot from its rank. No row meets others but those of its own arc. With
    ``slack`` 0 the law is ``rows``: shard sizes differ by at most one. With slack e no
    shard holds more than ``ceil((1 + e) * rows / shards)``.

    size: UTF-8 bytes of the text plus 1; null texts have none and a CRC of 0. A null
    id hashes as a key of its own; repeated rows are placed one by one. Other columns
    are not read; an empty table gives an empty result.
    """
    spark = df.sparkSession
    ring = Ring(shards, virtual_nodes, seed)
    shared = spark.sparkContext.broadcast(ring.points)

    @F.pandas_udf("int")
    def arc_of(position: pd.Series) -> pd.Series:
        points = shared.value
        found = np.searchsorted(points, position.to_numpy(dtype="int64").view(np.uint64), side="left") % len(points)
        return pd.Series(found.astype(np.int32))

    position = F.xxhash64(F.col(id_col), F.lit(seed))
    counts = {r["arc"]: r["n"] for r in df.select(arc_of(position).alias("arc")).groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments = place(ring, counts, slack)
    by_arc: dict[int, list] = {}
    for arc, first, shard, slot in segments:
        by_arc.setdefault(arc, []).append((first, shard, slot))
    plan = F.broadcast(  # at most shards * virtual_nodes rows
        spark.createDataFrame(
            [(arc, [{"first": f, "shard": s, "slot": b} for f, s, b in sorted(parts)]) for arc, parts in by_arc.items()],
            "arc int, parts array<struct<first: bigint, shard: int, slot: bigint>>",
        )
    )
    text = F.col(text_col).cast("string")
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "utf-8")), F.lit(0)).cast("long").alias("text_crc32"),
        position.alias("position"),
    ).withColumn("arc", arc_of("position"))
    rank = Window.partitionBy("arc").orderBy("position", "id", "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(rank) - 1).join(plan, "arc")
    part = F.element_at(F.filter("parts", lambda p: p["first"] <= F.col("rank")), -1)
    return ranked.withColumn("p", part).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows" if slack <= 0 else "bounded").alias("law"),
        F.col("p.shard").alias("shard"),
        (F.col("p.slot") + F.col("rank") - F.col("p.first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
