"""Verification: truth 0/1 against scores, per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import measures as m
from assayer.plans import fresh_names


def align(truth: DataFrame, run: DataFrame, key: str = "id", value: str = "value", impute=0.5) -> DataFrame:
    """Every truth row with its answer as ``p``; a missing one is imputed."""
    answers = run.groupBy(key).agg(F.min(value).alias("p"))
    return truth.join(answers, key, "left").withColumn("p", F.coalesce("p", F.lit(impute)))


def unknown_ids(truth: DataFrame, run: DataFrame, key: str = "id") -> DataFrame:
    """Answers to questions that weren't asked."""
    return run.select(key).join(truth.select(key), key, "left_anti")


#: Ranges of scores that are summed up before the scores inside them.
RANGES = 1 << 16


def score_points(df: DataFrame, groups: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Positives and negatives at each distinct score, and cumulative counts from the highest score down.

    Scores are summed up by ranges first: one window sees the ranges of a group, at most ``RANGES`` + 1, and another the scores of one range, so
    no task holds all scores of a group. Scores outside [0, 1] lie in the outermost ranges.
    """
    points = df.groupBy(*groups, p).agg(m.count_if(F.col(y) == 1).alias("pos"), m.count_if(F.col(y) == 0).alias("neg"))
    (at,) = fresh_names(points, "_range")
    points = points.withColumn(at, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p).cast("double"))) * RANGES))
    above = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(F.col(at).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = points.groupBy(*groups, at).agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    ranges = ranges.select(*groups, at, *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_{c}") for c in ("tp", "fp")]).alias("r")
    inside = Window.partitionBy(*groups, at).orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumns({"tp": F.sum("pos").over(inside), "fp": F.sum("neg").over(inside)}).alias("s")
    same = reduce(lambda a, b: a & b, [F.col(f"s.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in [*groups, at]])
    counts = [(F.col(f"s.{c}") + F.col(f"r._{c}")).alias(c) for c in ("tp", "fp")]
    return points.join(ranges, same).select(*[F.col(f"s.`{c}`") for c in [*groups, p]], "s.pos", "s.neg", *counts)


def auc(df: DataFrame, groups: list[str], y: str = "y", p: str = "p", one_class: float | None = 0.0) -> DataFrame:
    """Area under the ROC curve, ties averaged; ``one_class`` where a class is missing.

    Rows are first counted per distinct score; each positive stands above all negatives that are not counted down to its score, and above half of those at it.
    """
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    area = F.sum(pos) * F.sum(neg) - F.sum(pos * F.col("fp")) + F.sum(pos * neg) / 2
    return score_points(df, groups, y, p).groupBy(*groups).agg(m.ratio(area, F.sum(pos) * F.sum(neg), one_class).alias("auc"))


def report(df: DataFrame, groups: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """AUC, c@1, F1, F0.5u, Brier complement and their mean per group."""
    yc, pc = F.col(y), F.col(p)
    parts = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), m.c_at_1(yc, pc).alias("c_at_1"), m.f1_answered(yc, pc).alias("f1"), m.f05u(yc, pc).alias("f05u"), m.brier(yc, pc).alias("brier")
    )
    both = parts.join(auc(df, groups, y, p), groups) if groups else parts.crossJoin(auc(df, groups, y, p))
    return both.withColumn("overall", (F.col("auc") + F.col("c_at_1") + F.col("f1") + F.col("f05u") + F.col("brier")) / 5)


def roc_with_gaps(df: DataFrame, groups: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """ROC points where rows without a score are unanswered: they stretch the axes but make no points.

    Answered rows by falling score give cumulative rates over all positives and all negatives; unanswered
    negatives move the curve to the right from its start, and the point (1, 1) closes it.
    """
    rows = df.withColumn("answered", F.col(p).isNotNull())
    totals = rows.groupBy(*groups).agg(
        m.count_if(F.col(y) == 1).alias("n_pos"), m.count_if(F.col(y) == 0).alias("n_neg"), m.count_if(~F.col("answered") & (F.col(y) == 0)).alias("open_neg")
    )
    totals = totals.withColumns({"n_pos": F.greatest("n_pos", F.lit(1)), "n_neg": F.greatest("n_neg", F.lit(1))})
    points = score_points(rows.filter("answered"), groups, y, p).join(totals, groups)
    curve = points.select(*groups, F.col("tp").alias("k"), (F.col("tp") / F.col("n_pos")).alias("tpr"), ((F.col("fp") + F.col("open_neg")) / F.col("n_neg")).alias("fpr"))
    start = totals.select(*groups, F.lit(-1).cast("long").alias("k"), F.lit(0.0).alias("tpr"), (F.col("open_neg") / F.col("n_neg")).alias("fpr"))
    end = totals.select(*groups, (F.col("n_pos") + 1).alias("k"), F.lit(1.0).alias("tpr"), F.lit(1.0).alias("fpr"))
    return curve.unionByName(start).unionByName(end)


def trapezoid(points: DataFrame, groups: list[str], x: str = "fpr", y: str = "tpr") -> DataFrame:
    """Area under the points of each group."""
    order = Window.partitionBy(*groups).orderBy(x, y, "k")
    steps = points.withColumns({"px": F.lag(x).over(order), "py": F.lag(y).over(order)})
    return steps.groupBy(*groups).agg(F.coalesce(F.sum((F.col(x) - F.col("px")) * (F.col(y) + F.col("py")) / 2), F.lit(0.0)).alias("auc"))


def best_offset(df: DataFrame, measure: Column, steps: int = 1000, drop: float = 0.01) -> DataFrame:
    """The additive offset of the scores that is best for ``measure`` (an aggregate over ``y`` and ``q``).

    Offsets -1 .. 1 in ``steps`` steps are tried in turn. Once a value has beaten the first, the search
    ends at the first value under the best so far less ``drop``. Ties go to the smaller offset.
    """
    spark = df.sparkSession
    offsets = F.broadcast(spark.range(steps).select(F.col("id").alias("k"), (F.col("id") * 2 / F.lit(float(steps)) - 1).alias("offset")))
    counted = df.groupBy("y", "p").agg(F.count(F.lit(1)).alias("w"))
    tried = counted.crossJoin(offsets).withColumn("q", m.clip01(F.col("p") + F.col("offset"))).groupBy("k", "offset").agg(measure.alias("value"))
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ahead = tried.withColumns({"best": F.max("value").over(upto), "first": F.first("value").over(Window.orderBy("k"))})
    ends = ahead.withColumn("stop", F.min(F.when((F.col("best") > F.col("first")) & (F.col("value") < F.col("best") - drop), F.col("k"))).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    seen = ends.filter(F.col("stop").isNull() | (F.col("k") <= F.col("stop")))
    return seen.groupBy().agg(F.max_by("offset", F.struct("value", -F.col("k"))).alias("offset"), F.max("value").alias("value"))


def threshold_cells(p: Column, threshold, guess: Column, steps: int) -> Column:
    """A cell for scores that compare alike with all thresholds 0 .. ``steps`` - 1, ``threshold(k)``: how many are at most p, and whether p equals the last of them.

    ``guess`` is about that number; it may be one off, for the comparisons themselves decide.
    """
    g = F.greatest(F.lit(-1), F.least(F.lit(steps), F.floor(guess))).cast("long")
    at = lambda k: (k >= 0) & (k < steps) & (threshold(k) <= p)
    k = F.when(at(g + 1), g + 1).when(at(g), g).when(at(g - 1), g - 1).otherwise(F.greatest(F.lit(-1).cast("long"), F.least(g - 2, F.lit(steps - 1).cast("long"))))
    return 2 * k + ((k >= 0) & (threshold(k) == p)).cast("long")


def sweep(df: DataFrame, low: float, high: float, steps: int) -> DataFrame:
    """Precision, recall and F1 at each of ``steps`` thresholds; scores are counted per interval of thresholds before they meet them, so few rows do whatever the scores."""
    width = (high - low) / steps
    cell = threshold_cells(F.col("p"), lambda k: k * F.lit(width) + F.lit(low), (F.col("p") - low) / width, steps)
    thresholds = F.broadcast(df.sparkSession.range(steps).select((F.col("id") * F.lit(width) + F.lit(low)).alias("threshold")))
    counted = df.groupBy(cell.alias("cell")).agg(F.min("p").alias("p"), m.count_if(F.col("y") == 1).alias("pos"), m.count_if(F.col("y") == 0).alias("neg"))
    at = F.col("p") >= F.col("threshold")
    sums = counted.crossJoin(thresholds).groupBy("threshold").agg(
        F.sum(F.when(at, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(at, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(~at, F.col("pos")).otherwise(0)).alias("fn")
    )
    return sums.select("threshold", m.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), m.ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), m.f1_from_counts(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def correct_scores(s: Column, p1, p2) -> Column:
    """Rescale with a band without answers: below ``p1`` to [0, .49], between to .5, above ``p2`` to [.51, 1]."""
    p1, p2 = (F.lit(float(x)) if isinstance(x, (int, float)) else x for x in (p1, p2))
    return F.when(s <= p1, 0.49 * s / p1).when(s < p2, F.lit(0.5)).otherwise(0.51 + 0.49 * (s - p2) / (1 - p2))


def threshold_grid(df: DataFrame, steps: int = 98) -> DataFrame:
    """The pair p1 < p2 of thresholds (k/100) whose corrected scores have the best c@1 + F0.5u; first best wins."""
    ks = df.sparkSession.range(1, steps + 1)
    grid = ks.select(F.col("id").alias("i")).join(ks.select(F.col("id").alias("j")), F.col("i") < F.col("j"))
    grid = F.broadcast(grid.select("i", "j", (F.col("i") / 100).alias("p1"), (F.col("j") / 100).alias("p2")))
    cell = threshold_cells(F.col("p"), lambda k: (k + 1) / 100, F.col("p") * 100 - 1, steps)
    counted = df.groupBy(cell.alias("cell")).agg(F.min("p").alias("p"), m.count_if(F.col("y") == 1).alias("pos"), m.count_if(F.col("y") == 0).alias("neg"))
    q = F.when(F.col("p") <= F.col("p1"), -1).when(F.col("p") < F.col("p2"), 0).otherwise(1)
    one = lambda side, c: F.sum(F.when(q == side, F.col(c)).otherwise(0)).cast("double")
    sums = counted.crossJoin(grid).groupBy("i", "j").agg(
        one(1, "pos").alias("tp"), one(1, "neg").alias("fp"), one(-1, "pos").alias("fn"), one(-1, "neg").alias("tn"), (one(0, "pos") + one(0, "neg")).alias("u")
    )
    n, right = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") + F.col("u"), F.col("tp") + F.col("tn")
    total = (right + F.col("u") * right / n) / n + m.ratio(1.25 * F.col("tp"), 1.25 * F.col("tp") + 0.25 * (F.col("fn") + F.col("u")) + F.col("fp"))
    return sums.withColumn("value", F.round(total, 9)).groupBy().agg(
        F.max_by(F.struct("i", "j"), F.struct("value", -F.col("i"), -F.col("j"))).alias("b"), F.max("value").alias("value")
    ).select((F.col("b.i") / 100).alias("p1"), (F.col("b.j") / 100).alias("p2"), "value")
