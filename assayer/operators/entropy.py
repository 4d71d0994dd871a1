"""Cross-entropies of two texts under each other's context model, pair by pair."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from assayer.plans import bounded_batches


def contexts(text: str, order: int) -> tuple[list[Counter], list[Counter]]:
    """By order: how often each context with its next character occurs, and each context before any character."""
    pairs = [Counter(text[i : i + o + 1] for i in range(len(text) - o)) for o in range(order + 1)]
    alone = [Counter(text[i : i + o] for i in range(len(text) - o)) for o in range(order + 1)]
    return pairs, alone


def cross_entropy_of(text: str, model: tuple[list[Counter], list[Counter]], order: int) -> float | None:
    """Mean bits a character of ``text``: its share after the longest context in which the model saw it, else 1/256; None for an empty text."""
    if not text:
        return None
    pairs, alone = model
    bits = 0.0
    steps = Counter(text[max(0, i - order) : i + 1] for i in range(len(text)))
    for step, n in steps.items():
        p = 1 / 256
        for o in range(len(step) - 1, -1, -1):
            seen = pairs[o].get(step[len(step) - 1 - o :])
            if seen:
                p = seen / alone[o][step[len(step) - 1 - o : -1]]
                break
        bits -= n * math.log2(p)
    return bits / len(text)


def pair_entropies(pairs: DataFrame, keys: list[str], first: str, second: str, order: int = 5) -> DataFrame:
    """keys, h12, h21: the entropy of the second text under the first one's model, and the other way round.

    A pair is worked out by itself, in the task that has it; both texts whole. Null texts count as empty; the entropy of an empty text is null, and under
    the model of an empty text every character has 8 bits.
    """
    bounded_batches(pairs.sparkSession)
    fields = [pairs.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True):
                a, b = a or "", b or ""
                found.append((cross_entropy_of(b, contexts(a, order), order), cross_entropy_of(a, contexts(b, order), order)))
            columns = [pa.array([x[k] for x in found], pa.float64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], names=[*keys, "h12", "h21"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "h12 double, h21 double"])
    return pairs.select(*keys, first, second).mapInArrow(run, schema)
