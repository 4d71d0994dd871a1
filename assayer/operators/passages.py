"""Passage detection: cases against detections.

Both have columns ref, off, len, sref, soff, slen, ext; a row without a source (ext
false) has an empty sref and zeros. Rows are distinct. All joins are on ref, with
the interval test as a residual condition, so work is dealt out by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import measures as m
from assayer.operators.intervals import union_length

COLUMNS = ("ref", "off", "len", "sref", "soff", "slen", "ext")


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*COLUMNS).distinct().select(*[F.col(c).alias(f"{prefix}_{c}") for c in COLUMNS])


def overlap_pairs(cases: DataFrame, dets: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs (c_*, d_*) that share text on this side and, if both have a source, on the source side."""
    c, d = _named(cases, "c"), _named(dets, "d")
    this = (F.col("d_off") + F.col("d_len") > F.col("c_off")) & (F.col("d_off") < F.col("c_off") + F.col("c_len"))
    source = (F.col("c_sref") == F.col("d_sref")) & (F.col("d_soff") + F.col("d_slen") > F.col("c_soff")) & (F.col("d_soff") < F.col("c_soff") + F.col("c_slen"))
    both = F.col("c_ext") & F.col("d_ext")
    return c.join(d, (F.col("c_ref") == F.col("d_ref")) & this & (~both | source), how)


def clip(pairs: DataFrame) -> DataFrame:
    """The shared part of each pair, as off, len, soff, slen, under the case's ref and sref."""
    both = F.col("c_ext") & F.col("d_ext")
    off, soff = F.greatest("c_off", "d_off"), F.greatest("c_soff", "d_soff")
    end = F.least(F.col("c_off") + F.col("c_len"), F.col("d_off") + F.col("d_len"))
    send = F.least(F.col("c_soff") + F.col("c_slen"), F.col("d_soff") + F.col("d_slen"))
    return pairs.withColumns(
        {
            "ref": F.col("c_ref"),
            "off": off,
            "len": F.greatest(F.lit(0), end - off),
            "sref": F.when(both, F.col("c_sref")).otherwise(""),
            "soff": F.when(both, soff).otherwise(0),
            "slen": F.when(both, F.greatest(F.lit(0), send - soff)).otherwise(0),
            "ext": both,
        }
    )


def sides(df: DataFrame, keys: list[str]) -> DataFrame:
    """One range per side: keys, side, doc, s, e."""
    this = F.struct(F.lit("this").alias("side"), F.col("ref").alias("doc"), F.col("off").alias("s"), (F.col("off") + F.col("len")).alias("e"))
    source = F.struct(F.lit("source").alias("side"), F.col("sref").alias("doc"), F.col("soff").alias("s"), (F.col("soff") + F.col("slen")).alias("e"))
    return df.select(*keys, F.explode(F.filter(F.array(this, source), lambda x: x["e"] > x["s"])).alias("x")).select(*keys, "x.*")


def covered_chars(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Characters covered at least once, this side plus source side, over all documents; 0 for no rows."""
    keys = keys or []
    per = union_length(sides(df, keys), [*keys, "side", "doc"])
    return per.groupBy(*keys).agg(F.coalesce(F.sum("covered"), F.lit(0)).cast("long").alias("covered"))


CASE = [f"c_{c}" for c in COLUMNS]


def case_recall(cases: DataFrame, dets: DataFrame) -> DataFrame:
    """Every case with the share of its characters, on both sides, that detections cover; and how many detect it."""
    clipped = clip(overlap_pairs(cases, dets))
    per = union_length(sides(clipped, CASE), [*CASE, "side"]).groupBy(*CASE).agg(F.sum("covered").alias("hit"))
    counts = clipped.groupBy(*CASE).agg(F.count(F.lit(1)).alias("detections"))
    joined = _named(cases, "c").join(per.join(counts, CASE), CASE, "left")
    return joined.withColumns({"hit": F.coalesce("hit", F.lit(0)), "detections": F.coalesce("detections", F.lit(0))}).withColumn(
        "recall", m.ratio(F.col("hit"), F.col("c_len") + F.col("c_slen"))
    )


def _macro(part: DataFrame, name: str) -> DataFrame:
    return part.agg(F.avg("recall").alias(name), F.count(F.lit(1)).alias("n"))


def _either_empty(value: Column, n1: Column, n2: Column) -> Column:
    return F.when((n1 == 0) & (n2 == 0), 1.0).when((n1 == 0) | (n2 == 0), 0.0).otherwise(value)


def measures(cases: DataFrame, dets: DataFrame) -> DataFrame:
    """One row: macro and micro recall and precision, granularity, and plagdet of both averages."""
    by_case, by_det = case_recall(cases, dets), case_recall(dets, cases)
    macro = _macro(by_case, "macro_recall").withColumnRenamed("n", "n_cases").crossJoin(_macro(by_det, "macro_precision").withColumnRenamed("n", "n_dets"))
    found = F.avg(F.when(F.col("detections") > 0, F.col("detections")))
    gran = by_case.agg(F.coalesce(found, F.lit(1.0)).alias("granularity"))
    true = covered_chars(clip(overlap_pairs(cases, dets)).select(*COLUMNS)).withColumnRenamed("covered", "true_chars")
    parts = covered_chars(cases.select(*COLUMNS).distinct()).withColumnRenamed("covered", "case_chars").crossJoin(
        covered_chars(dets.select(*COLUMNS).distinct()).withColumnRenamed("covered", "det_chars")
    )
    row = macro.crossJoin(gran).crossJoin(true).crossJoin(parts)  # one row each
    n1, n2 = F.col("n_cases"), F.col("n_dets")
    row = row.withColumns(
        {
            "macro_recall": _either_empty(F.col("macro_recall"), n1, n2),
            "macro_precision": _either_empty(F.col("macro_precision"), n1, n2),
            "micro_recall": _either_empty(m.ratio(F.col("true_chars"), F.col("case_chars")), n1, n2),
            "micro_precision": _either_empty(m.ratio(F.col("true_chars"), F.col("det_chars")), n1, n2),
        }
    )
    return row.withColumns(
        {
            "macro_plagdet": m.plagdet(F.col("macro_precision"), F.col("macro_recall"), F.col("granularity")),
            "micro_plagdet": m.plagdet(F.col("micro_precision"), F.col("micro_recall"), F.col("granularity")),
        }
    )


def restrict_to_pairs(dets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Detections whose (ref, sref) is listed."""
    return dets.join(pairs.select("ref", "sref"), ["ref", "sref"], "left_semi")


def _passing(cases: DataFrame, dets: DataFrame, tau_recall: float, tau_precision: float) -> tuple[DataFrame, DataFrame]:
    """Cases found and detections that are right, at the two thresholds."""
    pairs = clip(overlap_pairs(cases, dets))
    by_case, by_det = case_recall(cases, dets), case_recall(dets, cases)
    good_case = by_case.filter(F.col("recall") >= tau_recall).select(*CASE)
    good_det = by_det.filter(F.col("recall") >= tau_precision).select(*[F.col(f"c_{c}").alias(f"d_{c}") for c in COLUMNS])
    det = [f"d_{c}" for c in COLUMNS]
    found = pairs.join(good_det, det, "left_semi").join(good_case, CASE, "left_semi").select(*CASE).distinct()
    shared = pairs.withColumn("part", m.ratio(F.col("len") + F.col("slen"), F.col("c_len") + F.col("c_slen")))
    right = shared.filter(F.col("part") >= tau_recall).join(good_det, det, "left_semi").select(*det).distinct()
    return found, right


def case_level(cases: DataFrame, dets: DataFrame, tau_recall: float = 0.5, tau_precision: float = 0.5) -> DataFrame:
    """Precision, recall and F1 in whole cases.

    A case is found if its recall reaches ``tau_recall`` and one of its detections has a precision of
    ``tau_precision``; a detection is right if it has that precision and alone covers ``tau_recall`` of a case.
    """
    found, right = _passing(cases, dets, tau_recall, tau_precision)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    row = n(found, "found").crossJoin(n(right, "right")).crossJoin(n(_named(cases, "c"), "n_cases")).crossJoin(n(_named(dets, "d"), "n_dets"))
    row = row.withColumns({"recall": m.ratio(F.col("found"), F.col("n_cases")), "precision": m.ratio(F.col("right"), F.col("n_dets"))})
    return row.withColumn("f1", m.f_beta(F.col("precision"), F.col("recall")))


def document_level(cases: DataFrame, dets: DataFrame, pairs: DataFrame, tau_recall: float = 0.5, tau_precision: float = 0.5) -> DataFrame:
    """The same in document pairs (ref, sref); what counts as found must be listed in ``pairs``."""
    found, right = _passing(cases, dets, tau_recall, tau_precision)
    listed = pairs.select("ref", "sref").distinct()

    def n(df: DataFrame, prefix: str, name: str, only_listed: bool) -> DataFrame:
        doc = df.select(F.col(f"{prefix}_ref").alias("ref"), F.col(f"{prefix}_sref").alias("sref")).distinct()
        doc = doc.join(listed, ["ref", "sref"], "left_semi") if only_listed else doc
        return doc.agg(F.count(F.lit(1)).alias(name))

    row = n(found, "c", "found", True).crossJoin(n(right, "d", "right", True)).crossJoin(n(_named(cases, "c"), "c", "n_cases", False)).crossJoin(n(_named(dets, "d"), "d", "n_dets", False))
    row = row.withColumns({"recall": m.ratio(F.col("found"), F.col("n_cases")), "precision": m.ratio(F.col("right"), F.col("n_dets"))})
    return row.withColumn("f1", m.f_beta(F.col("precision"), F.col("recall")))
