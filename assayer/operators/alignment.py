"""Greedy passage alignment of text pairs: seeds of equal n-grams, extended character by character, each passage skipped once it is found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.retrieval import gram_hashes
from assayer.plans import bounded_batches, broadcast_if_small, cut

#: ASCII punctuation and white space: what alignment passes over.
PASSED = np.zeros(128, bool)
PASSED[[*range(0x09, 0x0E), *range(0x20, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: Characters of the n-grams by which pairs meet before the longer seeds are looked at.
ANCHOR = 16


class Kept:
    """The kept characters of a text: code points as they are, their lower case, and where they stand."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.flatnonzero((points >= 128) | ~PASSED[np.minimum(points, 127)])
        self.size, self.points = len(points), points[self.at]
        kinds, where = np.unique(self.points, return_inverse=True)
        # a character whose lower case is longer than one stays as it is
        self.lower = np.array([ord(x) if len(x := chr(p).lower()) == 1 else p for p in kinds.tolist()], np.uint32)[where] if len(kinds) else self.points

    def hashes(self, length: int) -> np.ndarray:
        return gram_hashes(self.lower.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), length)

    def end(self, k: int) -> int:
        """The offset of kept character k, or of the text's end behind the last."""
        return int(self.at[k]) if k < len(self.at) else self.size


def anchors(kept: Kept, length: int) -> np.ndarray:
    """Hashes of n-grams such that two texts with an equal n-gram of ``length`` kept characters share one: the least of every window of shorter n-grams."""
    short = min(ANCHOR, length)
    hashes = kept.hashes(short) * np.uint64(0xD1342543DE82EF95)
    width = length - short + 1
    if len(hashes) < width:
        return hashes[:0]
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, width).min(axis=1))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the common start."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        apart = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(apart):
            return at + int(apart[0])
        at, step = min(at + step, n), 2 * step
    return n


def greedy_passages(this: str, source: str, length: int) -> list[tuple[int, int, int, int]]:
    """(this start, this end, source start, source end) of the passages that a walk over ``source`` finds in ``this``.

    At each place whose next ``length`` kept characters, lower-cased, also stand in ``this``, every such occurrence is extended while the kept characters are equal as
    they are; the longest extension wins, the first among equals, and reaches up to the next kept character. Where none goes beyond the seed, the seed is the passage
    and its last character its end. The walk goes on at the end of the passage. ``length`` is 2 or more.
    """
    a, b = Kept(this), Kept(source)
    index, seeds = a.hashes(length), b.hashes(length)
    if not len(index) or not len(seeds):
        return []
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    low, high = np.searchsorted(ordered, seeds, side="left"), np.searchsorted(ordered, seeds, side="right")
    hits = np.flatnonzero(high > low)
    found, at = [], 0
    for p in hits.tolist():
        if p < at:
            continue
        places = [q for q in order[low[p] : high[p]].tolist() if np.array_equal(a.lower[q : q + length], b.lower[p : p + length])]
        if not places:
            continue
        start, last = int(b.at[p]), int(b.at[p + length - 1])
        best = (int(a.at[places[0]]), int(a.at[places[0] + length - 1]), start, last)
        goes_on = p + length - 1
        for q in places:
            same = _common(a.points[q:], b.points[p:])
            end = b.end(p + same) if same else start
            if end - 1 - start > best[3] - best[2]:
                best = (int(a.at[q]), a.end(q + same), start, end)
                goes_on = p + same
        found.append(best)
        at = goes_on
    return found


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(Kept(t), length) if t else np.zeros(0, np.uint64) for t in batch.column(1).to_pylist()]
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
            flat = np.concatenate([np.zeros(0, np.uint64), *found])
            yield pa.RecordBatch.from_arrays([keys, pa.array(flat.view(np.int64))], names=["key", "anchor"])

    return run


def candidate_pairs(texts: DataFrame, sources: DataFrame, key: str, source_key: str, text: str, length: int, max_broadcast: int = 500_000) -> DataFrame:
    """key, source_key: all pairs that share an n-gram of ``length`` kept characters, and few others.

    Pairs meet by the least hash of each window of short n-grams, which equal passages share, so about an eighth of the places make rows. Up to
    ``max_broadcast`` anchors of the sources go to all tasks, and no text's anchors are shuffled; beyond that the two sides meet by a hash join.
    """
    kinds = [dict(df.dtypes)[k] for df, k in ((texts, key), (sources, source_key))]
    known = sources.select(source_key, text).mapInArrow(_anchor_rows(length), f"key {kinds[1]}, anchor long").withColumnRenamed("key", source_key)
    mine = texts.select(key, text).mapInArrow(_anchor_rows(length), f"key {kinds[0]}, anchor long").withColumnRenamed("key", key)
    return mine.join(broadcast_if_small(cut(known), max_broadcast), "anchor").select(key, source_key).distinct()


def greedy_alignment(
    texts: DataFrame, sources: DataFrame, key: str, source_key: str, text: str = "text", length: int = 50, pairs: DataFrame | None = None, max_broadcast: int = 500_000
) -> DataFrame:
    """key, source_key, n (from 1), this_offset, this_length, source_offset, source_length: the passages of ``greedy_passages`` of every pair that has any.

    ``pairs`` (key, source_key) restricts the pairs; without it all pairs are held against each other, by way of ``candidate_pairs``. Each pair is a row of its own, with its two
    texts, and is walked by itself. Offsets and lengths are in code points. Null texts have no passages; keys that repeat are texts of their own only if
    ``pairs`` tells them apart; an empty table gives an empty result.
    """
    bounded_batches(texts.sparkSession)
    met = cut(candidate_pairs(texts, sources, key, source_key, text, length, max_broadcast))
    if pairs is not None:
        met = met.join(pairs.select(key, source_key).distinct(), [key, source_key], "left_semi")
    mine = texts.select(key, F.col(text).alias("this")).join(broadcast_if_small(met.select(key).distinct(), max_broadcast), key, "left_semi")
    rows = met.join(mine, key).join(sources.select(source_key, F.col(text).alias("source")), source_key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [greedy_passages(a or "", b or "", length) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            flat = np.array([x for xs in found for x in xs], np.int64).reshape(-1, 4)
            number = np.array([k + 1 for xs in found for k in range(len(xs))], np.int64)
            columns = [number, flat[:, 0], flat[:, 1] - flat[:, 0], flat[:, 2], flat[:, 3] - flat[:, 2]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *[pa.array(np.ascontiguousarray(c)) for c in columns]], names=names_)

    names_ = [key, source_key, "n", "this_offset", "this_length", "source_offset", "source_length"]
    kinds = [dict(df.dtypes)[k] for df, k in ((texts, key), (sources, source_key))]
    schema = f"`{key}` {kinds[0]}, `{source_key}` {kinds[1]}, " + ", ".join(f"{c} long" for c in names_[2:])
    return rows.select(key, source_key, "this", "source").mapInArrow(run, schema)
