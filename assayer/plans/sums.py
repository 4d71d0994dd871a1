"""Sums of arrays over all rows, added up in the tasks and then in a few."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tasks that add up what the others have found; the driver adds up theirs.
GATHERERS = 16


def _row(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])


def array_sum(df: DataFrame, size: int, of_batches: Callable[[Iterable[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of ``of_batches`` (``size`` doubles) over the tasks of ``df``.

    ``size`` must not grow with the rows: each task sends one array, and if there are many tasks, ``GATHERERS`` of them add
    up the others' first. Sums come in no fixed order, so they are equal up to rounding.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _row(np.asarray(of_batches(batches), np.float64))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py())
        yield _row(total)

    found = df.mapInArrow(first, "total binary")
    if found.rdd.getNumPartitions() > GATHERERS:
        found = found.repartition(GATHERERS).mapInArrow(again, "total binary")
    total = np.zeros(size)
    for r in found.collect():
        total += np.frombuffer(r["total"])
    return total
