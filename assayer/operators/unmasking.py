"""Unmasking: how fast two halves of a text stop being told apart when the features that tell them apart are taken away."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assayer.plans import bounded_batches

#: Texts whose classifiers are fitted together.
TOGETHER = 64


@dataclass(frozen=True)
class Settings:
    """Rounds of elimination, features at the start and taken away a round, folds, chunks of a half and n-grams in each, characters of an n-gram, width of the smoothing."""

    rounds: int = 35
    features: int = 200
    taken: int = 4
    folds: int = 10
    chunks: int = 60
    size: int = 700
    gram: int = 3
    smoothing: int = 3
    seed: int = 24


def fit_margin(kernel: np.ndarray, sign: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Weights of the rows in the classifier of least ``|w|^2 / 2 + c * sum(max(0, 1 - y m)^2)``, from the rows' inner products: w is the rows' sum with these weights.

    Newton steps: the rows within the margin give a small linear system; a step is halved until it lowers the objective.
    """
    weights = np.zeros(len(sign))
    margins = kernel @ weights

    def cost(a: np.ndarray, m: np.ndarray) -> float:
        lack = np.maximum(0, 1 - sign * m)
        return a @ m / 2 + c * (lack @ lack)

    value = cost(weights, margins)
    for _ in range(100):
        near = np.flatnonzero(sign * margins < 1)
        new = np.zeros(len(sign))
        new[near] = np.linalg.solve(kernel[np.ix_(near, near)] + np.eye(len(near)) / (2 * c), sign[near])
        step, way = 1.0, new - weights
        while step > 1e-6:
            tried = weights + step * way
            told = kernel @ tried
            if (lower := cost(tried, told)) < value - 1e-10 * max(1.0, value):
                break
            step /= 2
        else:
            return weights
        weights, margins, value = tried, told, lower
    return weights


def fit_margins(kernels: np.ndarray, sign: np.ndarray, c: float = 1.0) -> np.ndarray:
    """``fit_margin`` for many classifiers at once: kernels (problem, row, row), the same signs for all."""
    weights = np.zeros(kernels.shape[:2])
    margins, value = np.zeros_like(weights), np.full(len(kernels), c * float(len(sign)))
    going, ridge = np.arange(len(kernels)), np.eye(len(sign)) / (2 * c)
    for _ in range(100):
        if not len(going):
            break
        kernel, old, told_old = kernels[going], weights[going], margins[going]
        near = sign * told_old < 1
        way = np.linalg.solve(kernel * (near[:, :, None] & near[:, None, :]) + ridge, (near * sign)[:, :, None])[:, :, 0] - old
        moved = (kernel @ way[:, :, None])[:, :, 0]
        left, step, better = np.arange(len(going)), 1.0, []
        while step > 1e-6 and len(left):
            tried, told = old[left] + step * way[left], told_old[left] + step * moved[left]
            lack = np.maximum(0, 1 - sign * told)
            cost = (tried * told).sum(axis=1) / 2 + c * (lack * lack).sum(axis=1)
            lower = cost < (was := value[going[left]]) - 1e-10 * np.maximum(1.0, was)
            at = going[left[lower]]
            weights[at], margins[at], value[at] = tried[lower], told[lower], cost[lower]
            better.append(at)
            left, step = left[~lower], step / 2
        going = np.sort(np.concatenate(better))
    return weights


def chunk_counts(text: str, s: Settings) -> np.ndarray | None:
    """(chunks of the first half and then of the second, features): counts of the most frequent n-grams in chunks drawn with replacement, keyed by the text; None if a half has none."""
    sides = (len(text) // 2, len(text) - len(text) // 2)
    if min(sides) < s.gram:
        return None
    alphabet, number = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
    codes = number[: len(text) - s.gram + 1].astype(np.int64)
    distinct = len(alphabet)
    for k in range(1, s.gram):
        if distinct * len(alphabet) >= 1 << 62:
            codes = np.unique(codes, return_inverse=True)[1]  # in the same order
            distinct = int(codes.max()) + 1
        codes, distinct = codes * len(alphabet) + number[k : len(text) - s.gram + 1 + k], distinct * len(alphabet)
    key = hashlib.sha256(f"{s.seed}\0{text}".encode("utf-8", "surrogatepass")).digest()
    rng = np.random.default_rng(int.from_bytes(key[:8], "little"))
    drawn = [rng.integers(0, size - s.gram + 1, s.size) + start for start, size in zip((0, sides[0]), sides, strict=True) for _ in range(s.chunks)]
    found, place = np.unique(codes[np.concatenate(drawn)], return_inverse=True)
    chunk = np.repeat(np.arange(2 * s.chunks), s.size)
    counts = np.bincount(chunk * len(found) + place, minlength=2 * s.chunks * len(found)).reshape(2 * s.chunks, len(found))
    best = np.argsort(-counts.sum(axis=0), kind="stable")[: s.features]  # ties by the gram
    return counts[:, best].astype(np.float64)


def accuracy_curves(counts: np.ndarray, s: Settings) -> np.ndarray:
    """(text, round): by how much more than by guessing the halves are told apart in cross-validation (0 to 1), smoothed; counts (text, chunk, feature).

    After a round the ``taken`` features that speak most for the first half, in the classifier of the first fold, go. Folds take every ``folds``-th chunk of each half.
    """
    texts, chunks, features = counts.shape
    half = chunks // 2
    sign = np.repeat([1.0, -1.0], half)
    fold = np.tile(np.arange(half) % s.folds, 2)
    found = []
    for _ in range(min(s.rounds, (features - 1) // s.taken)):
        kernel, right, first = counts @ counts.transpose(0, 2, 1) + 1, [], None
        for k in range(s.folds):
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            weights = fit_margins(kernel[:, train[:, None], train], sign[train])
            margins = (kernel[:, test[:, None], train] @ weights[:, :, None])[:, :, 0]
            right.append(np.mean(np.where(margins > 0, 1.0, -1.0) == sign[test], axis=1))
            if first is None:
                first = np.round((weights[:, None, :] @ counts[:, train])[:, 0], 9)
        found.append(np.maximum(0.0, (np.mean(right, axis=0) - 0.5) * 2))
        kept = np.sort(np.argsort(-first, axis=1, kind="stable")[:, s.taken :], axis=1)
        counts = np.take_along_axis(counts, kept[:, None, :], axis=2)
    curves = np.array(found).reshape(len(found), texts).T
    if not s.smoothing or len(found) < s.smoothing:
        return curves
    return np.array([np.convolve(curve, np.ones(s.smoothing) / s.smoothing, mode="valid") for curve in curves])


def unmask(df: DataFrame, key: str, text: str, settings: Settings | None = None) -> DataFrame:
    """key, curve, value: the accuracy curve of each text and ``1 / (1 + exp(2 * mean(curve - 0.75)))``, near 1 for texts whose halves soon look alike.

    Texts are worked out where they lie, those of as many features together; draws are keyed by the text, so neither splits nor other rows matter. A text too short for two halves with n-grams has an empty
    curve and the value 0.5, as has a null one.
    """
    s = settings or Settings()
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            curves, values = [np.zeros(0)] * batch.num_rows, [0.5] * batch.num_rows
            alike: dict[int, list[tuple[int, np.ndarray]]] = {}

            def settle(group: list[tuple[int, np.ndarray]], curves: list = curves, values: list = values) -> None:
                for (k, _), curve in zip(group, accuracy_curves(np.array([c for _, c in group]), s), strict=True):
                    curves[k] = curve
                    values[k] = float(1 / (1 + np.exp(2 * np.mean(curve - 0.75)))) if len(curve) else 0.5
                group.clear()

            for k, t in enumerate(batch.column(1).to_pylist()):
                if (counts := chunk_counts(t or "", s)) is not None:
                    group = alike.setdefault(counts.shape[1], [])
                    group.append((k, counts))
                    if len(group) == TOGETHER:
                        settle(group)
            for group in alike.values():
                if group:
                    settle(group)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curves, pa.list_(pa.float64())), pa.array(values, pa.float64())], names=[key, "curve", "value"])

    return df.select(key, text).repartition(4 * df.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, curve array<double>, value double")
