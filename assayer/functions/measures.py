"""Measures as aggregate columns: each takes columns and can be used in any ``groupBy().agg``.

Scores are in [0, 1]; exactly 0.5 means no answer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def ratio(top: Column, bottom: Column, empty: float | None = 0.0) -> Column:
    """``top / bottom`` as a double; ``empty`` where the bottom is 0."""
    value = F.lit(empty).cast("double")
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double")).otherwise(value)


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    return ratio((1 + beta * beta) * precision * recall, beta * beta * precision + recall)


def c_at_1(y: Column, p: Column) -> Column:
    """Accuracy that credits unanswered items with the accuracy on all items."""
    n = F.count(F.lit(1)).cast("double")
    right = count_if((p != 0.5) & ((p > 0.5) == (y == 1))).cast("double")
    open_ = count_if(p == 0.5).cast("double")
    return (right + open_ * right / n) / n


def f1_from_counts(tp: Column, fp: Column, fn: Column, empty: float | None = 0.0) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn, empty)


def f1_answered(y: Column, p: Column) -> Column:
    """F1 over the items with an answer."""
    return f1_from_counts(count_if((p > 0.5) & (y == 1)), count_if((p > 0.5) & (y == 0)), count_if((p < 0.5) & (y == 1)))


def f1_all(y: Column, p: Column, empty: float | None = 0.0) -> Column:
    """F1 with unanswered items as negatives."""
    return f1_from_counts(count_if((p > 0.5) & (y == 1)), count_if((p > 0.5) & (y == 0)), count_if((p <= 0.5) & (y == 1)), empty)


def f05u(y: Column, p: Column, empty: float | None = 0.0) -> Column:
    """F0.5 that counts unanswered items as false negatives."""
    tp, fp = count_if((p > 0.5) & (y == 1)), count_if((p > 0.5) & (y == 0))
    fn, open_ = count_if((p < 0.5) & (y == 1)), count_if(p == 0.5)
    return ratio(1.25 * tp, 1.25 * tp + 0.25 * (fn + open_) + fp, empty)


def brier(y: Column, p: Column, clip: bool = False) -> Column:
    """Complement of the Brier score."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) if clip else p
    return 1 - F.avg((p - y) * (p - y))


def mcc(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Matthews correlation; 0 where a margin is empty."""
    tp, tn, fp, fn = (c.cast("double") for c in (tp, tn, fp, fn))
    return ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def harmonic_mean(x: Column) -> Column:
    """Null where a value is 0, for the mean isn't defined there."""
    return F.when(F.min(x) > 0, F.count(x) / F.sum(1 / x))


def binarize(p: Column, threshold: float = 0.5, triple: bool = False) -> Column:
    """1 from the threshold on, else 0; NaN counts as the threshold; ``triple`` keeps 0.5."""
    p = F.nanvl(p, F.lit(threshold))
    cut_ = F.when(p >= threshold, 1.0).otherwise(0.0)
    return F.when(p == 0.5, 0.5).otherwise(cut_) if triple else cut_


def clip01(p: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def plagdet(precision: Column, recall: Column, granularity: Column) -> Column:
    """F1 over the binary logarithm of 1 + granularity; 0 for impossible arguments."""
    f1 = 2 * precision * recall / (precision + recall)
    bad = ((precision == 0) & (recall == 0)) | (precision < 0) | (recall < 0) | (granularity < 1)
    return F.when(bad, 0.0).otherwise(f1 / F.log2(1 + granularity))
