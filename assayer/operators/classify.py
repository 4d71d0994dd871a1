"""Classification, multi-label and sequence-label measures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import measures as m
from assayer.plans import cut

UNKNOWN = "<UNK>"


def first_answers(run: DataFrame, key: str, order: str) -> DataFrame:
    """One answer per key: the first by ``order``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return run.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def answers_for(gold: DataFrame, run: DataFrame, key: str = "id", label: str = "label", missing: str = UNKNOWN) -> DataFrame:
    """Every gold row with the run's label as ``pred``."""
    return gold.join(run.select(key, F.col(label).alias("pred")), key, "left").withColumn("pred", F.coalesce("pred", F.lit(missing)))


def class_counts(df: DataFrame, groups: list[str], truth: str = "label", pred: str = "pred", hit: Column | None = None) -> DataFrame:
    """groups, cls, tp, fp, fn: hits and misses by the true class, false alarms by the predicted one.

    ``hit`` decides whether a prediction is right; equality if not given. One shuffle: every row
    gives one count to its true and one to its predicted class.
    """
    hit = F.col(truth) == F.col(pred) if hit is None else hit
    hit = F.coalesce(hit, F.lit(False))
    one = lambda cls, tp, fp, fn: F.struct(cls.alias("cls"), tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"))
    no = F.lit(0)
    parts = F.array(one(F.col(truth), hit, no, ~hit), one(F.col(pred), no, ~hit, no))
    return df.select(*groups, F.explode(parts).alias("x")).groupBy(*groups, F.col("x.cls").alias("cls")).agg(F.sum("x.tp").alias("tp"), F.sum("x.fp").alias("fp"), F.sum("x.fn").alias("fn"))


def with_prf(counts: DataFrame, empty: float | None = 0.0) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": m.ratio(tp, tp + fp, empty), "recall": m.ratio(tp, tp + fn, empty), "f1": m.f1_from_counts(tp, fp, fn, empty)})


def macro(counts: DataFrame, groups: list[str], gold_only: bool = True, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Mean precision, recall and F1 over the classes; only those that are in the truth if asked."""
    rows = with_prf(counts)
    if gold_only:
        rows = rows.filter(F.col("tp") + F.col("fn") > 0)
    if exclude:
        rows = rows.filter(~F.col("cls").isin(*exclude))
    return rows.groupBy(*groups).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def macro_of_means(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Macro precision over the classes answered, macro recall over the classes asked for, and F1 of the two means."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    means = counts.groupBy(*groups).agg(F.avg(m.ratio(tp, tp + fp, None)).alias("precision"), F.avg(m.ratio(tp, tp + fn, None)).alias("recall"))
    return means.withColumn("f1", m.f_beta(F.col("precision"), F.col("recall")))


def age_hit(truth: Column, pred: Column) -> Column:
    """Whether a birth year is near enough: the window is wider for the old."""
    width = -0.1 * truth + 202.8
    return pred.between((truth - width).cast("int"), (truth + width).cast("int"))


def binary_report(df: DataFrame, groups: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Accuracy, precision, recall, F1 of both classes and their mean, Matthews correlation."""
    t, p = F.col(y) == 1, F.col(yhat) == 1
    c = df.groupBy(*groups).agg(m.count_if(t & p).alias("tp"), m.count_if(~t & p).alias("fp"), m.count_if(t & ~p).alias("fn"), m.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = c.withColumns(
        {
            "accuracy": m.ratio(tp + tn, tp + tn + fp + fn),
            "precision": m.ratio(tp, tp + fp),
            "recall": m.ratio(tp, tp + fn),
            "f1": m.f1_from_counts(tp, fp, fn),
            "f1_negative": m.f1_from_counts(tn, fn, fp),
            "mcc": m.mcc(tp, tn, fp, fn),
        }
    )
    return out.withColumn("f1_macro", (F.col("f1") + F.col("f1_negative")) / 2)


def multilabel(df: DataFrame, groups: list[str], id_: str = "id", label: str = "label", y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Micro and macro precision, recall, F1 over rows (id, label, y, yhat), and exact-match accuracy per id."""
    t, p = F.col(y) == 1, F.col(yhat) == 1
    by_label = df.groupBy(*groups, label).agg(m.count_if(t & p).alias("tp"), m.count_if(~t & p).alias("fp"), m.count_if(t & ~p).alias("fn"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return with_prf(by_label).groupBy(*groups).agg(
        m.ratio(tp, tp + fp).alias("micro_precision"),
        m.ratio(tp, tp + fn).alias("micro_recall"),
        m.f1_from_counts(tp, fp, fn).alias("micro_f1"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )


def subset_accuracy(df: DataFrame, groups: list[str], id_: str = "id", y: str = "y", yhat: str = "yhat") -> DataFrame:
    rows = df.groupBy(*groups, id_).agg(F.bool_and(F.col(y) == F.col(yhat)).alias("same"))
    return rows.groupBy(*groups).agg(F.avg(F.col("same").cast("double")).alias("subset_accuracy"))


def ordinal_index(df: DataFrame, groups: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Ordinal classification index per group: 0 is perfect.

    A shortest path through the confusion matrix of K ordered classes from one corner to the other: a cell
    takes off its share of ``n / (sum n |r - c| + N)`` and adds ``0.75 n |r - c| / (N (K - 1))``. Only the
    matrix, at most K * K rows, reaches Python.
    """
    cells = df.groupBy(*groups, F.col(y).cast("long").alias("r"), F.col(yhat).cast("long").alias("c")).agg(F.count(F.lit(1)).alias("n"))

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        classes = sorted({*pdf["r"], *pdf["c"]})
        k, total = len(classes), int(pdf["n"].sum())
        at = {v: i for i, v in enumerate(classes)}
        n = [[0] * k for _ in range(k)]
        for r, c, x in zip(pdf["r"], pdf["c"], pdf["n"], strict=True):
            n[at[r]][at[c]] = int(x)
        spread = sum(n[i][j] * abs(i - j) for i in range(k) for j in range(k))
        cost = [[-n[i][j] / (spread + total) + (0.75 / (total * (k - 1)) * n[i][j] * abs(i - j) if k > 1 else 0.0) for j in range(k)] for i in range(k)]
        best = [[0.0] * k for _ in range(k)]
        for i in range(k):
            for j in range(k):
                before = [best[a][b] for a, b in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if a >= 0 and b >= 0]
                best[i][j] = (min(before) if before else 1.0) + cost[i][j]
        first = {g: [pdf[g].iloc[0]] for g in groups}
        return pd.DataFrame({**first, "oci": [best[-1][-1]]})

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{g} {kinds[g]}" for g in groups), "oci double"])
    return cells.groupBy(*groups).applyInPandas(path, schema)


def contingency(df: DataFrame, groups: list[str], ref: str = "ref", sys: str = "sys") -> DataFrame:
    return df.groupBy(*groups, ref, sys).agg(F.count(F.lit(1)).alias("n"))


def relabel(df: DataFrame, groups: list[str], label: str, name: str) -> DataFrame:
    """Dense ids from 0 in the order of the labels."""
    labels = df.select(*groups, label).distinct().withColumn(name, F.dense_rank().over(Window.partitionBy(*groups).orderBy(label)) - 1)
    return df.join(labels, [*groups, label])


def assign(counts: dict[tuple[int, int], int], size: int) -> list[int]:
    """For each row 0 .. ``size`` - 1 its column in the one-to-one map with the largest sum of counts; of equal maps the first in the order of the rows' columns.

    Shortest augmenting paths over whole numbers: a count is scaled up so far that the preference for smaller columns, row by row, only decides ties.
    """
    scale = size**size + 1
    cost = [[-counts.get((i, j), 0) * scale + j * size ** (size - 1 - i) for j in range(size)] for i in range(size)]
    u, v = [0] * (size + 1), [0] * (size + 1)
    owner = [0] * (size + 1)  # rows from 1 by column; column 0 holds the row that is placed
    for row in range(1, size + 1):
        owner[0] = row
        at, least, came, done = 0, [None] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        while owner[at]:
            done[at] = True
            i, step, nearest = owner[at], None, 0
            for j in range(1, size + 1):
                if not done[j]:
                    slack = cost[i - 1][j - 1] - u[i] - v[j]
                    if least[j] is None or slack < least[j]:
                        least[j], came[j] = slack, at
                    if step is None or least[j] < step:
                        step, nearest = least[j], j
            for j in range(size + 1):
                if done[j]:
                    u[owner[j]] += step
                    v[j] -= step
                elif least[j] is not None:
                    least[j] -= step
            at = nearest
        while at:
            owner[at], at = owner[came[at]], came[at]
    found = [0] * size
    for j in range(1, size + 1):
        found[owner[j] - 1] = j - 1
    return found


def best_assignment(df: DataFrame, groups: list[str], ref: str = "ref", sys: str = "sys", size: int = 1) -> DataFrame:
    """groups, ref, sys: the one-to-one map of dense ids with the most matches; of equals the first permutation.

    A group is as large as its largest id asks, and ``size`` ids a side at least. Only its contingency counts, at most
    K * K rows, reach Python. Ids must be whole numbers from 0.
    """
    return _assignment(contingency(df, groups, ref, sys), groups, ref, sys, size)


def _assignment(counts: DataFrame, groups: list[str], ref: str, sys: str, size: int) -> DataFrame:
    """``best_assignment`` from the contingency."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf[[ref, sys]] < 0).any(axis=None):
            raise ValueError("ids are whole numbers from 0; relabel first")
        n = max(size, int(pdf[ref].max()) + 1, int(pdf[sys].max()) + 1)
        found = assign({(int(r), int(s)): int(c) for r, s, c in zip(pdf[ref], pdf[sys], pdf["n"], strict=True)}, n)
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] * n for g in groups}, ref: range(n), sys: found})

    kinds = dict(counts.dtypes)
    return counts.groupBy(*groups).applyInPandas(solve, ", ".join([*(f"{g} {kinds[g]}" for g in groups), f"{ref} int", f"{sys} int"]))


def diarization(df: DataFrame, groups: list[str], ref: str = "ref", sys: str = "sys", size: int = 1) -> DataFrame:
    """Per group: der, the share of items outside the matched clusters, and jer, the mean Jaccard error of the reference's."""
    counts = cut(contingency(df, groups, ref, sys))
    refs = counts.groupBy(*groups, ref).agg(F.sum("n").alias("n_ref"))
    syss = counts.groupBy(*groups, sys).agg(F.sum("n").alias("n_sys"))
    matched = refs.join(_assignment(counts, groups, ref, sys, size), [*groups, ref]).join(syss, [*groups, sys], "left").join(counts, [*groups, ref, sys], "left")
    both = F.coalesce("n", F.lit(0))
    error = 1 - both / (F.col("n_ref") + F.coalesce("n_sys", F.lit(0)) - both)
    return matched.groupBy(*groups).agg(((F.sum("n_ref") - F.sum(both)) / F.sum("n_ref")).alias("der"), F.avg(error).alias("jer"))
