"""Linear classifiers over sparse n-gram features: one-against-rest margins and multinomial log-linear models, fitted by distributed gradients."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.features import pieces, text_gram_counts
from assayer.plans import bounded_batches, cut
from assayer.plans.sums import array_sum

#: Weights (features x classes) a model may have: the driver holds a few arrays of them.
MOST_WEIGHTS = 1 << 23


def ordered_vocabulary(counts: DataFrame, least: int, most: int, n: str = "n") -> DataFrame:
    """gram, idx: the up to ``most`` grams that occur ``least`` times or more in all, numbered by falling frequency, then by the gram itself.

    ``counts`` has a row per text and gram. Only the ``most`` rows kept are numbered in one task.
    """
    totals = counts.groupBy("gram").agg(F.sum(n).alias("total")).filter(F.col("total") >= least)
    kept = totals.orderBy(F.col("total").desc(), "gram").limit(most)
    return cut(kept.select("gram", (F.row_number().over(Window.orderBy(F.col("total").desc(), "gram")) - 1).alias("idx")))


def relative_values(counts: DataFrame, key: str, lengths: DataFrame, vocabulary: DataFrame, train: DataFrame) -> DataFrame:
    """key, gram, idx, value: frequency relative to the text's ``length``, divided by the gram's largest in the texts of ``train``.

    A gram that no training text has is left out; values of other texts may be over 1.
    """
    rel = counts.join(F.broadcast(vocabulary), "gram").join(lengths.select(key, "length"), key).withColumn("f", F.col("n") / F.col("length"))
    top = rel.join(train.select(key), key, "left_semi").groupBy("idx").agg(F.max("f").alias("top"))
    return rel.join(F.broadcast(top), "idx").select(key, "gram", "idx", (F.col("f") / F.col("top")).alias("value"))


def char_rows(docs: DataFrame, text: str, size: int, vocabulary: DataFrame) -> DataFrame:
    """``docs`` without the text, with idx (ascending) and val: the n-grams of ``size`` characters that ``vocabulary`` (gram, idx; as few as a model has) lists, by their
    frequency relative to the text's length. A text is worked out where it lies, so no n-gram is shuffled. A null text has none."""
    number = {r["gram"]: r["idx"] for r in vocabulary.select("gram", "idx").collect()}
    others = [c for c in docs.columns if c != text]
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(others)).to_pylist()]
            for piece in pieces([len(t) for t in texts]):
                mine = texts[piece]
                of, place, grams, many = text_gram_counts(mine, np.arange(len(mine)), size)
                idx = np.array([number.get(g, -1) for g in grams], np.int64)[place]
                kept = np.flatnonzero(idx >= 0)
                kept = kept[np.lexsort((idx[kept], of[kept]))]
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of[kept], minlength=len(mine))))), pa.int32())
                value = many[kept] / np.array([len(t) for t in mine], np.float64)[of[kept]]
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (idx[kept].astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([*[c.slice(piece.start, len(mine)) for c in batch.columns[: len(others)]], *lists], names=[*others, "idx", "val"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), "idx array<int>, val array<double>"])
    return docs.select(*others, text).mapInArrow(run, schema)


def largest_scaled(rows: DataFrame, train: Column, size: int) -> DataFrame:
    """``rows`` with each value divided by its feature's largest among the rows where ``train`` holds; features that these lack are left out. ``size`` features, as few as a model has."""
    top = np.zeros(size)
    for r in rows.filter(train).select(F.explode(F.arrays_zip("idx", "val")).alias("x")).groupBy("x.idx").agg(F.max("x.val").alias("top")).collect():
        top[r["idx"]] = r["top"]
    at = {c: k for k, c in enumerate(rows.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(at["idx"]).value_lengths().to_numpy()
            flat, values = batch.column(at["idx"]).flatten().to_numpy(), batch.column(at["val"]).flatten().to_numpy()
            known = top[flat] > 0
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes))))), pa.int32())
            new = {"idx": pa.ListArray.from_arrays(ends, pa.array(flat[known])), "val": pa.ListArray.from_arrays(ends, pa.array(values[known] / top[flat[known]]))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(k)) for c, k in at.items()], names=list(at))

    return rows.mapInArrow(run, rows.schema)


def tf_idf_values(counts: DataFrame, key: str, vocabulary: DataFrame, train: DataFrame) -> DataFrame:
    """key, gram, idx, value: n times the smoothed inverse document frequency ``ln((1 + N) / (1 + df)) + 1`` of the training texts, in rows of length 1."""
    known = counts.join(F.broadcast(vocabulary), "gram")
    texts = train.select(key).distinct()
    df = known.join(texts, key, "left_semi").groupBy("idx").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log((1 + F.lit(texts.count())) / (1 + F.col("df"))) + 1
    raw = known.join(F.broadcast(df), "idx").withColumn("w", F.col("n") * weight)
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "gram", "idx", (F.col("w") / F.col("norm")).alias("value"))


def sparse_rows(values: DataFrame, key: str, texts: DataFrame) -> DataFrame:
    """The rows of ``texts`` with idx (ascending) and val arrays of their features, empty for texts without any."""
    one = F.array_sort(F.collect_list(F.struct("idx", "value")))  # a text's own features
    rows = values.groupBy(key).agg(one.alias("fs")).select(key, F.col("fs.idx").alias("idx"), F.col("fs.value").alias("val"))
    joined = texts.join(rows, key, "left")
    return joined.withColumns({"idx": F.coalesce("idx", F.array().cast("array<int>")), "val": F.coalesce("val", F.array().cast("array<double>"))})


class LinearModel(NamedTuple):
    """Classes in order, weights (features + 1, classes) whose last row is the intercept, the loss it was fitted to, and the objective of each round."""

    classes: list[str]
    weights: np.ndarray
    loss: str
    objective: list[float]


def _margins(idx: pa.Array, val: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(margins (n, classes), flat features, flat values, row of each)."""
    sizes = idx.value_lengths().to_numpy()
    flat, values = idx.flatten().to_numpy(), val.flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    margins = np.stack([np.bincount(row, values * weights[flat, c], len(sizes)) for c in range(weights.shape[1])], axis=1)
    return margins + weights[-1], flat, values, row


def _slopes(loss: str, margins: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    """The loss of rows and its slope at each margin."""
    own = np.zeros(margins.shape, bool)
    own[np.arange(len(label)), label] = True
    if loss == "squared hinge":
        sign = np.where(own, 1.0, -1.0)
        lack = np.maximum(0, 1 - sign * margins)
        return float((lack * lack).sum()), -2 * sign * lack
    top = margins.max(axis=1, keepdims=True)
    whole = top[:, 0] + np.log(np.exp(margins - top).sum(axis=1))
    return float((whole - margins[own]).sum()), np.exp(margins - whole[:, None]) - own


def objective(rows: DataFrame, weights: np.ndarray, loss: str, c: float) -> tuple[float, np.ndarray]:
    """Value and gradient of ``|w|^2 / 2 + c * sum of losses``; rows (label int, idx, val). With the log loss the intercept is not shrunk."""
    size = weights.size

    def run(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        total, slope = 0.0, np.zeros_like(weights)
        for batch in batches:
            if batch.num_rows:
                margins, flat, values, row = _margins(batch.column(1), batch.column(2), weights)
                lost, g = _slopes(loss, margins, batch.column(0).to_numpy())
                total += lost
                for k in range(weights.shape[1]):
                    slope[:, k] += np.bincount(flat, values * g[row, k], len(weights))
                slope[-1] += g.sum(axis=0)
        return np.concatenate(([total], slope.ravel()))

    found = array_sum(rows.select("label", "idx", "val"), size + 1, run)
    shrunk = weights if loss == "squared hinge" else np.concatenate([weights[:-1], np.zeros((1, weights.shape[1]))])
    return c * found[0] + (shrunk * shrunk).sum() / 2, c * found[1:].reshape(weights.shape) + shrunk


def minimise(of: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, tolerance: float, most_rounds: int, memory: int = 8) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with halved steps; ends when the gradient is ``tolerance`` of the first one's length, or raises after ``most_rounds``."""
    x, (value, slope) = start, of(start)
    first, history, values = np.linalg.norm(slope), [], [value]
    for _ in range(most_rounds):
        if np.linalg.norm(slope) <= tolerance * max(first, 1e-12):
            return x, values
        way, kept = -slope, []
        for s, y, r in reversed(history):
            a = r * (s * way).sum()
            way = way - a * y
            kept.append(a)
        if history:
            s, y, r = history[-1]
            way = way / (r * (y * y).sum())
        else:
            way = way / max(1.0, np.linalg.norm(slope))
        for (s, y, r), a in zip(history, reversed(kept), strict=True):
            way = way + (a - r * (y * way).sum()) * s
        down, step = (slope * way).sum(), 1.0
        for _ in range(40):
            nearer, (new, new_slope) = x + step * way, of(x + step * way)
            if new <= value + 1e-4 * step * down:
                break
            step /= 2
        else:
            return x, values  # no step is lower any more: at the precision of doubles
        s, y = nearer - x, new_slope - slope
        if (s * y).sum() > 1e-12 * (y * y).sum():
            history = [*history, (s, y, 1 / (s * y).sum())][-memory:]
        x, value, slope = nearer, new, new_slope
        values.append(value)
    raise RuntimeError(f"the fit did not settle in {most_rounds} rounds")


def fit_linear(rows: DataFrame, label: str, size: int, loss: str = "squared hinge", c: float = 1.0, tolerance: float = 1e-4, most_rounds: int = 300) -> LinearModel:
    """The model of ``rows`` (``label``, idx, val) with ``size`` features.

    ``squared hinge``: a margin of each class against the rest, ``|w|^2 / 2 + c * sum(max(0, 1 - y m)^2)`` with the intercept among the weights.
    ``log``: one multinomial log-linear model over all classes. Rows are read once a round, in place, and only one array of features x classes leaves each task;
    these are bounded by ``MOST_WEIGHTS``, whatever the rows. Rows without a label are left out; with fewer than two classes there is nothing to fit and a ValueError.
    """
    if loss not in ("squared hinge", "log"):
        raise ValueError(f"unknown loss {loss}")
    known = rows.filter(F.col(label).isNotNull())
    classes = sorted(r[0] for r in known.select(F.col(label).cast("string")).distinct().collect())
    if len(classes) < 2:
        raise ValueError("a classifier needs two classes at least")
    if (size + 1) * len(classes) > MOST_WEIGHTS:
        raise ValueError(f"{size} features and {len(classes)} classes are over {MOST_WEIGHTS} weights; keep fewer features")
    number = F.array_position(F.array(*[F.lit(x) for x in classes]), F.col(label).cast("string")) - 1
    numbered = cut(known.select(number.cast("int").alias("label"), "idx", "val"))
    weights, values = minimise(lambda w: objective(numbered, w, loss, c), np.zeros((size + 1, len(classes))), tolerance, most_rounds)
    return LinearModel(classes, weights, loss, values)


def class_scores(rows: DataFrame, key: str, model: LinearModel, author: str = "author") -> DataFrame:
    """key, ``author``, score: every row's margin for each class, or its probability with the log loss."""
    kind = dict(rows.dtypes)[key]
    n = len(model.classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = _margins(batch.column(1), batch.column(2), model.weights)[0]
            if model.loss == "log":
                margins = np.exp(margins - margins.max(axis=1, keepdims=True))
                margins /= margins.sum(axis=1, keepdims=True)
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(model.classes * batch.num_rows, pa.string()), pa.array(margins.ravel())], names=[key, author, "score"])

    return rows.select(key, "idx", "val").mapInArrow(run, f"`{key}` {kind}, `{author}` string, score double")


def answers(scores: DataFrame, key: str, gap: float = 0.0, author: str = "author", unknown: str = "<UNK>") -> DataFrame:
    """key, answer, score, second: the class with the best score, or ``unknown`` if the second best is nearer than ``gap``; ties go by name.

    No window: the two best of a row are folded in one aggregation over its classes.
    """
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(author).alias("a"))))  # an entry a class
    top = scores.groupBy(key).agg(best.alias("b"))
    first, second = -F.col("b")[0]["s"], -F.get("b", F.lit(1))["s"]
    answer = F.when(first - F.coalesce(second, F.lit(0.0)) < gap, unknown).otherwise(F.col("b")[0]["a"])
    return top.select(key, answer.alias("answer"), first.alias("score"), second.alias("second"))


def answered_half(p: Column, radius: float) -> Column:
    """A probability, or 0.5 if it is within ``radius`` of it: no answer."""
    return F.when(F.abs(p - 0.5) <= radius, F.lit(0.5)).otherwise(p)
