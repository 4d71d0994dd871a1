"""Boosted trees from histograms: all labels, folds and settings are grown in the same passes over the rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.plans import broadcast_if_small, cut
from assayer.plans.sums import array_sum


class Setting(NamedTuple):
    """One ensemble: the label it predicts (its place in ``y``), the fold it does not see (None: it sees all), depth and learning rate."""

    label: int
    left_out: int | None
    depth: int = 3
    rate: float = 0.25


class Forest(NamedTuple):
    """``features``, ``cuts``, ``values`` (tree, ensemble, node): a row goes right where its bin is over the cut; feature -1 ends at the node's value. ``sizes``: trees an
    ensemble uses; ``losses`` (tree, ensemble): mean log loss of the fold left out after so many trees."""

    settings: list[Setting]
    features: np.ndarray
    cuts: np.ndarray
    values: np.ndarray
    sizes: list[int]
    losses: np.ndarray


def best_grams(chi: DataFrame, most: int) -> DataFrame:
    """gram, idx: the ``most`` grams of the highest chi2, numbered by it, ties by the gram. Only those are numbered in one task."""
    kept = chi.orderBy(F.col("chi2").desc(), "gram").limit(most)
    return cut(kept.select("gram", (F.row_number().over(Window.orderBy(F.col("chi2").desc(), "gram")) - 1).alias("idx")))


def binned(values: DataFrame, key: str, bins: int, small: int = 200_000) -> DataFrame:
    """key, idx, value: the bin of each value, from 1 to ``bins`` - 1, cut at quantiles of the feature's own values; bin 0 is of texts without the feature."""
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    edges = values.groupBy("idx").agg(F.percentile_approx("value", shares, 10_000).alias("edges"))
    place = 1 + F.size(F.filter("edges", lambda e: e < F.col("value")))
    return values.join(broadcast_if_small(cut(edges), small), "idx").select(key, "idx", place.cast("double").alias("value"))


def _bins(batch: pa.RecordBatch, idx: int, val: int, size: int) -> np.ndarray:
    sizes = batch.column(idx).value_lengths().to_numpy()
    x = np.zeros((batch.num_rows, size), np.uint8)
    x[np.repeat(np.arange(batch.num_rows), sizes), batch.column(idx).flatten().to_numpy()] = batch.column(val).flatten().to_numpy()
    return x


def _nodes(x: np.ndarray, feature: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    """The node of one tree that each row reaches."""
    node, every = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        f = feature[node]
        node = np.where(f < 0, node, 2 * node + 1 + (x[every, f] > cuts[node]))
    return node


def _margins(x: np.ndarray, trees: tuple[np.ndarray, np.ndarray, np.ndarray], m: int, depth: int, many: int) -> np.ndarray:
    total = np.zeros(len(x))
    for t in range(many):
        total += trees[2][t, m][_nodes(x, trees[0][t, m], trees[1][t, m], depth)]
    return total


def _loss(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, margin) - y * margin


def _splits(g: np.ndarray, h: np.ndarray, shrink: float, least: float) -> tuple[int, int, float, float, float, float] | None:
    """(feature, cut, sums left of it: g, h, and right) of the best split of a node from its histograms (feature, bin); None if none gains."""
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    all_g, all_h = g[0].sum(), h[0].sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + shrink) + right_g**2 / (right_h + shrink) - all_g**2 / (all_h + shrink)
    gain = np.where((left_h >= least) & (right_h >= least), np.round(gain, 9), -np.inf)
    f, c = np.unravel_index(gain.argmax(), gain.shape)
    if not gain[f, c] > 1e-6:
        return None
    return int(f), int(c), left_g[f, c], left_h[f, c], right_g[f, c], right_h[f, c]


def fit_trees(
    rows: DataFrame, size: int, settings: list[Setting], bins: int = 8, trees: int = 20, patience: int = 10, shrink: float = 1.0, least: float = 1.0
) -> Forest:
    """Ensembles of up to ``trees`` trees for log loss; ``rows`` have idx and val (bins of ``size`` features), fold, and y, an array of 0, 1 or null by label.

    Each level of a tree is one pass: every task sums first and second derivatives by ensemble, node, feature and bin, whose number does not depend on the rows, and the
    driver picks the splits (ties: the first feature, the lowest cut). Leaves are ``-g / (h + shrink)`` times the rate; a side needs ``least`` of h. All ensembles share the passes. An ensemble that leaves a fold
    out keeps the trees up to its least loss there; all stop once none has improved for ``patience`` trees. Rows without a label are not seen by its ensembles.
    """
    held = cut(rows.select("idx", "val", F.col("fold").cast("int").alias("fold"), F.transform("y", lambda y: F.coalesce(y.cast("int"), F.lit(-1))).alias("y")))
    many, depth = len(settings), max(s.depth for s in settings)
    nodes = 2 ** (depth + 1) - 1
    features, cuts, values = np.full((0, many, nodes), -1), np.zeros((0, many, nodes), np.int64), np.zeros((0, many, nodes))
    losses: list[np.ndarray] = []

    def histograms(level: int, growing: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(sums (ensemble, node of the level, feature, bin, g and h), mean loss of each ensemble's left-out fold)."""
        shape = (many, 2**level, size, bins, 2)
        done = (features, cuts, values)

        def run(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
            sums, lost = np.zeros(shape), np.zeros((many, 2))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, fold = _bins(batch, 0, 1, size), batch.column(2).to_numpy()
                ys = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
                for m, s in enumerate(settings):
                    y = ys[:, s.label]
                    margin = _margins(x, done, m, depth, len(done[0]))
                    if s.left_out is not None:
                        out = (fold == s.left_out) & (y >= 0)
                        lost[m] += (_loss(margin[out], y[out]).sum(), out.sum())
                    node = _nodes(x, growing[0][m], growing[1][m], level) - (2**level - 1)
                    mine = np.flatnonzero((y >= 0) & (node >= 0) & (True if s.left_out is None else fold != s.left_out))
                    p = 1 / (1 + np.exp(-margin[mine]))
                    place = ((node[mine, None] * size + np.arange(size)) * bins + x[mine]).ravel()
                    for k, d in enumerate((p - y[mine], p * (1 - p))):
                        sums[m, ..., k] += np.bincount(place, np.repeat(d, size), 2**level * size * bins).reshape(shape[1:-1])
            return np.concatenate((sums.ravel(), lost.ravel()))

        found = array_sum(held, many * 2**level * size * bins * 2 + 2 * many, run)
        lost = found[-2 * many :].reshape(many, 2)
        return found[: -2 * many].reshape(shape), lost[:, 0] / np.maximum(lost[:, 1], 1)

    while True:
        feature, at, value = np.full((many, nodes), -1), np.zeros((many, nodes), np.int64), np.zeros((many, nodes))
        ends = len(features) == trees
        for level in range(1 if ends else depth):
            sums, lost = histograms(level, (feature, at))
            if level == 0:
                losses.append(lost)
                best = np.array(losses).argmin(axis=0)
                ends = ends or (any(s.left_out is not None for s in settings) and all(len(losses) - 1 - best[m] >= patience for m, s in enumerate(settings) if s.left_out is not None))
                if ends:
                    break
            for m, s in enumerate(settings):
                for k in range(2**level):
                    node = 2**level - 1 + k
                    g, h = sums[m, k, 0, :, 0].sum(), sums[m, k, 0, :, 1].sum()
                    if level == 0:
                        value[m, node] = -s.rate * g / (h + shrink)
                    split = _splits(sums[m, k, :, :, 0], sums[m, k, :, :, 1], shrink, least) if level < s.depth and h > 0 else None
                    if split:
                        feature[m, node], at[m, node] = split[:2]
                        for child, (cg, ch) in enumerate((split[2:4], split[4:6])):
                            value[m, 2 * node + 1 + child] = -s.rate * cg / (ch + shrink)
        if ends:
            break
        features, cuts, values = (np.concatenate([a, b[None]]) for a, b in ((features, feature), (cuts, at), (values, value)))
    history = np.array(losses)
    sizes = [len(features) if s.left_out is None else int(history[:, m].argmin()) for m, s in enumerate(settings)]
    return Forest(settings, features, cuts, values, sizes, history)


def chances(rows: DataFrame, key: str, forest: Forest, size: int) -> DataFrame:
    """key, setting (its number), p: for each row the chance that its label holds, by the ensembles that did not see the row's fold."""
    kind = dict(rows.dtypes)[key]
    depth = max(s.depth for s in forest.settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = _bins(batch, 1, 2, size), batch.column(3).to_numpy()
            for m, s in enumerate(forest.settings):
                out = np.flatnonzero(fold == s.left_out if s.left_out is not None else np.ones(len(fold), bool))
                p = 1 / (1 + np.exp(-_margins(x[out], forest[1:4], m, depth, forest.sizes[m])))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out)), pa.array(np.full(len(out), m, np.int32)), pa.array(p)], names=[key, "setting", "p"])

    return rows.select(key, "idx", "val", F.col("fold").cast("int").alias("fold")).mapInArrow(run, f"`{key}` {kind}, setting int, p double")


def folds(key: Column, many: int, seed: int = 23) -> Column:
    """A fold from 0 to ``many`` - 1 by a hash of the key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(many)).cast("int")


def cross_validate(rows: DataFrame, key: str, size: int, labels: int, many: int, depths: list[int], rates: list[float], **how) -> tuple[Forest, DataFrame]:
    """(forest, chances (key, setting, p)): an ensemble for every label, fold, depth and rate, all grown together; each row is judged by those that did not see its fold."""
    settings = [Setting(label, k, d, r) for label in range(labels) for d in depths for r in rates for k in range(many)]
    forest = fit_trees(rows, size, settings, **how)
    return forest, chances(rows, key, forest, size)
