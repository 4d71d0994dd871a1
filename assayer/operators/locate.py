"""Where a passage stands in a text that has it almost word for word: the longest block in common, and how much of both is matched."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assayer.plans import bounded_batches

BASE = 0x9E3779B97F4A7C15


class Hashed:
    """A sequence of code points whose pieces of any length have a 64-bit hash at once."""

    def __init__(self, text: str):
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.points)
        steps = np.full(n + 1, BASE, np.uint64)
        back = np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
        steps[0] = back[0] = 1
        power = np.cumprod(steps, dtype=np.uint64)
        self.back = np.cumprod(back, dtype=np.uint64)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)))

    def pieces(self, low: int, high: int, size: int) -> np.ndarray:
        """Hashes of the pieces of ``size`` that begin from ``low`` on and end by ``high``."""
        at = slice(low, high - size + 1)
        x = (self.sums[low + size : high + 1] - self.sums[at]) * self.back[at]
        return x ^ (x >> np.uint64(29))


def longest_block(a: Hashed, b: Hashed, span: tuple[int, int, int, int]) -> tuple[int, int, int]:
    """(place in a, place in b, size) of the longest piece that a[span[0]:span[1]] and b[span[2]:span[3]] share; the first place in a, then in b. By bisection on the size."""
    a0, a1, b0, b1 = span
    low, high, best = 0, min(a1 - a0, b1 - b0), None
    while low < high:
        size = (low + high + 1) // 2
        mine, other = a.pieces(a0, a1, size), b.pieces(b0, b1, size)
        shared = np.flatnonzero(np.isin(mine, other))
        if len(shared):
            low, best = size, (int(shared[0]), mine[shared[0]])
        else:
            high = size - 1
    if not low:
        return a0, b0, 0
    place = int(np.flatnonzero(b.pieces(b0, b1, low) == best[1])[0])
    return a0 + best[0], b0 + place, low


def matched_share(a: Hashed, b: Hashed) -> float:
    """Twice the characters in blocks in common over all characters: the longest block first, then those on either side of it."""
    total, open_ = 0, [(0, len(a.points), 0, len(b.points))]
    while open_:
        span = open_.pop()
        i, j, size = longest_block(a, b, span)
        if size:
            total += size
            open_ += [(span[0], i, span[2], j), (i + size, span[1], j + size, span[3])]
    n = len(a.points) + len(b.points)
    return 2 * total / n if n else 1.0


def near_offset(text: str, piece: str, least: float = 0.85) -> tuple[int, int] | None:
    """(offset, size) of the longest block, if it is at least the share ``least`` of the piece and more than that share of both is matched; else None."""
    n, m = len(text), len(piece)
    if not m or 2 * min(n, m) <= least * (n + m):
        return None
    a, b = Hashed(text), Hashed(piece)
    at, _, size = longest_block(a, b, (0, n, 0, m))
    return (at, size) if size >= least * m and matched_share(a, b) > least else None


def near_offsets(pairs: DataFrame, keys: list[str], text: str, piece: str, least: float = 0.85) -> DataFrame:
    """keys, offset, size of each pair's piece in its text (``near_offset``); -1 and 0 where it is not found. Null texts count as empty; each pair is worked out by itself."""
    bounded_batches(pairs.sparkSession)
    fields = [pairs.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [near_offset(t or "", p or "", least) or (-1, 0) for t, p in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)]
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], names=[*keys, "offset", "size"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "offset long, size long"])
    return pairs.select(*keys, text, piece).mapInArrow(run, schema)
