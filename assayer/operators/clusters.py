"""Clusterings, ranked links, segmentations, and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import measures as m
from assayer.operators.intervals import overlap_length


def bcubed(truth: DataFrame, answer: DataFrame, groups: list[str]) -> DataFrame:
    """B-cubed precision, recall and F per group over (group, cluster, doc).

    A document's precision is the share of its answer cluster that is in its true cluster. Documents missing
    in the answer are clusters of their own; documents only in the answer make their clusters larger. Counts per pair of clusters
    suffice: n documents of one pair have n shares of n.
    """
    t = truth.select(*groups, F.col("cluster").alias("t"), "doc")
    a = answer.select(*groups, F.col("cluster").alias("a"), "doc")
    size_t, size_a = t.groupBy(*groups, "t").agg(F.count(F.lit(1)).alias("nt")), a.groupBy(*groups, "a").agg(F.count(F.lit(1)).alias("na"))
    cells = t.join(a, [*groups, "doc"], "left").groupBy(*groups, "t", "a").agg(F.count(F.lit(1)).alias("n"))
    full = cells.join(size_t, [*groups, "t"]).join(size_a, [*groups, "a"], "left")
    alone = F.col("a").isNull()
    n = F.col("n").cast("double")
    sums = full.groupBy(*groups).agg(
        (F.sum(F.when(alone, n).otherwise(n * n / F.col("na"))) / F.sum("n")).alias("precision"),
        (F.sum(F.when(alone, n / F.col("nt")).otherwise(n * n / F.col("nt"))) / F.sum("n")).alias("recall"),
    )
    return sums.withColumn("f", m.f_beta(F.col("precision"), F.col("recall")))


def link_average_precision(truth: DataFrame, ranked: DataFrame, groups: list[str], order: str) -> DataFrame:
    """Average precision of scored links (a, b, score) against true ones (a, b), both unordered.

    Self links and later copies of a link (by ``order``) are dropped before ranking.
    """
    lo, hi = F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")
    true = truth.select(*groups, lo, hi).distinct()
    links = ranked.filter(F.col("a") != F.col("b")).groupBy(*groups, lo, hi).agg(F.min_by("score", order).alias("score"))
    marked = links.join(true.withColumn("hit", F.lit(1)), [*groups, "x", "y"], "left")
    rank = Window.partitionBy(*groups).orderBy(F.col("score").desc(), "x", "y")
    at = marked.withColumns({"rank": F.row_number().over(rank), "hits": F.sum("hit").over(rank.rowsBetween(Window.unboundedPreceding, 0))}).filter("hit = 1")
    found = at.groupBy(*groups).agg(F.sum(F.col("hits") / F.col("rank")).alias("s"))
    totals = true.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    return totals.join(found, groups, "left").select(*groups, (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("ap"))


def char_bcubed(truth: DataFrame, answer: DataFrame, groups: list[str]) -> DataFrame:
    """B-cubed over characters: (group, cluster, s, e) with inclusive ends; a group without answers scores 0."""
    t = truth.select(*groups, F.col("cluster").alias("t"), F.col("s").alias("ts"), (F.col("e") + 1).alias("te"))
    a = answer.select(*groups, F.col("cluster").alias("a"), F.col("s").alias("as_"), (F.col("e") + 1).alias("ae"))
    size_t = t.groupBy(*groups, "t").agg(F.sum(F.col("te") - F.col("ts")).alias("nt"))
    size_a = a.groupBy(*groups, "a").agg(F.sum(F.col("ae") - F.col("as_")).alias("na"))
    shared = overlap_length(F.col("ts"), F.col("te"), F.col("as_"), F.col("ae"))
    near = t.join(a, [*groups]).filter((F.col("ts") < F.col("ae")) & (F.col("as_") < F.col("te")))
    cells = near.groupBy(*groups, "t", "a").agg(F.sum(shared).alias("n")).join(size_t, [*groups, "t"]).join(size_a, [*groups, "a"])
    n = F.col("n").cast("double")
    tops = cells.groupBy(*groups).agg(F.sum(n * n / F.col("na")).alias("p"), F.sum(n * n / F.col("nt")).alias("r"))
    all_t, all_a = size_t.groupBy(*groups).agg(F.sum("nt").alias("all_t")), size_a.groupBy(*groups).agg(F.sum("na").alias("all_a"))
    row = all_t.join(all_a, groups, "left").join(tops, groups, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    row = row.select(*groups, zero(F.col("p") / F.col("all_a")).alias("precision"), zero(F.col("r") / F.col("all_t")).alias("recall"))
    return row.withColumn("f", m.f_beta(F.col("precision"), F.col("recall")))


def minor_authors(truth: DataFrame, groups: list[str]) -> DataFrame:
    """All segments but those of the largest cluster (the first of equals), as half-open ranges ``off``, ``len``."""
    sizes = truth.groupBy(*groups, "cluster").agg(F.sum(F.col("e") - F.col("s")).alias("chars"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(F.col("chars").desc(), "cluster")))
    return truth.join(ranked.filter("rank > 1").select(*groups, "cluster"), [*groups, "cluster"]).select(
        *groups, "cluster", F.col("s").alias("off"), (F.col("e") - F.col("s")).alias("len")
    )


def window_measures(df: DataFrame, groups: list[str], k: int, order: str = "pos", gold: str = "y", hypo: str = "yhat") -> DataFrame:
    """WindowDiff and WinPR over all full windows of ``k`` positions per group."""
    last = Window.partitionBy(*groups).orderBy(order).rowsBetween(-(k - 1), 0)
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(order))
    sums = df.withColumns({"_g": F.sum(gold).over(last), "_h": F.sum(hypo).over(last), "_place": place}).filter(F.col("_place") >= k)
    g, h = F.col("_g"), F.col("_h")
    tp, fp, fn = (F.sum(c) for c in (F.least(g, h), F.greatest(F.lit(0), h - g), F.greatest(F.lit(0), g - h)))
    out = sums.groupBy(*groups).agg(F.avg((g != h).cast("double")).alias("windowdiff"), m.ratio(tp, tp + fp).alias("win_precision"), m.ratio(tp, tp + fn).alias("win_recall"))
    return out.withColumn("win_f", m.f_beta(F.col("win_precision"), F.col("win_recall")))


def border_positions(df: DataFrame, id_: str = "id", text: str = "text", borders: str = "borders") -> DataFrame:
    """Character offsets of borders as word positions, the word count, and the half segment length.

    A word ends where a blank follows another character, at the characters from the second to the last but one. A
    border at character b lies at the number of word ends up to b. k is half of the mean
    segment length, rounded half to even.
    """
    inner = F.substring(F.col(text), 2, F.greatest(F.length(text) - 2, F.lit(0)))
    ends = lambda upto: F.regexp_count(F.concat(F.substring(F.col(text), 1, 1), upto), F.lit("[^ ] "))
    inside = F.filter(F.col(borders), lambda b: (b >= 1) & (b < F.length(text) - 1))
    at = F.transform(inside, lambda b: ends(F.substring(F.col(text), F.lit(2), b)).cast("long"))
    words = (ends(inner) + 1).cast("long")
    return df.select(id_, at.alias("positions"), words.alias("words")).withColumn("k", F.bround(F.col("words") / (F.size("positions") + 1) / 2).cast("long"))


def span_scores(gold: DataFrame, run: DataFrame, keys: list[str], by: list[str] | None = None, compat: bool = False) -> DataFrame:
    """Fractional span precision, recall and F1 over (keys, s, e) with half-open ends, per ``by``.

    Every pair of spans with equal keys adds its overlap as a share of the run's span to precision and of the
    gold span to recall. ``compat`` takes the run's share for recall too, as a published per-label score does. Two empty
    sides score 1.
    """
    by = by or []
    g = gold.select(*keys, F.col("s").alias("gs"), F.col("e").alias("ge"))
    r = run.select(*keys, F.col("s").alias("rs"), F.col("e").alias("re"))
    shared = overlap_length(F.col("gs"), F.col("ge"), F.col("rs"), F.col("re"))
    hits = g.join(r, keys).filter((F.col("gs") < F.col("re")) & (F.col("rs") < F.col("ge")))
    p = F.sum(shared / (F.col("re") - F.col("rs"))).alias("p")
    q = (F.sum(shared / (F.col("re") - F.col("rs"))) if compat else F.sum(shared / (F.col("ge") - F.col("gs")))).alias("q")
    parts = [g.groupBy(*by).agg(F.count(F.lit(1)).alias("ng")), r.groupBy(*by).agg(F.count(F.lit(1)).alias("nr")), hits.groupBy(*by).agg(p, q)]
    row = parts[0].join(parts[1], by, "full").join(parts[2], by, "left") if by else parts[0].crossJoin(parts[1]).crossJoin(parts[2])
    ng, nr = F.coalesce("ng", F.lit(0)), F.coalesce("nr", F.lit(0))
    row = row.withColumns({"precision": m.ratio(F.coalesce("p", F.lit(0.0)), nr), "recall": m.ratio(F.coalesce("q", F.lit(0.0)), ng)})
    f1 = F.when((ng == 0) & (nr == 0), 1.0).otherwise(m.f_beta(F.col("precision"), F.col("recall")))
    return row.select(*by, "precision", "recall", f1.alias("f1"))


def clean_spans(df: DataFrame, empty_label: str = "X") -> DataFrame:
    """Half-open spans without the empty label and without ends before starts."""
    return df.filter((F.col("label") != empty_label) & (F.col("e") >= F.col("s"))).withColumn("e", F.col("e") + 1)
