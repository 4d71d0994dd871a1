"""Paraphrases by pivots: two phrases mean alike as far as they share translations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.plans import cut, join_counted


def phrase_table(pairs: DataFrame, first: str = "e", second: str = "f") -> DataFrame:
    """e, f, n, p_fe, p_ef: how often two phrases stand for each other, and both conditional shares."""
    counts = cut(pairs.groupBy(F.col(first).alias("e"), F.col(second).alias("f")).agg(F.count(F.lit(1)).alias("n")))
    sums = [cut(counts.groupBy(c).agg(F.sum("n").alias(f"n_{c}"), F.count(F.lit(1)).alias(f"rows_{c}"))) for c in ("e", "f")]
    both = join_counted(join_counted(counts, sums[0], "e", "rows_e"), sums[1], "f", "rows_f")
    return both.select("e", "f", "n", (F.col("n") / F.col("n_e")).alias("p_fe"), (F.col("n") / F.col("n_f")).alias("p_ef"))


def pivot_paraphrases(table: DataFrame, least: float = 0.01, least_sum: float = 0.0) -> DataFrame:
    """e, other, p: ``sum over f of p(f | e) * p(other | f)`` for other phrases than e, of ``least_sum`` or more.

    Translations of a chance below ``least`` are not followed, either way: that is the method's threshold, and it bounds the work, since a phrase has at most 1 / ``least`` pivots and a pivot at
    most so many phrases. A pivot's phrases are gathered into one bounded row, and the rows of a pivot that many phrases share are not shuffled to one task: its row is broadcast to them.
    """
    onward = table.filter(F.col("p_ef") >= least).groupBy("f").agg(F.collect_list(F.struct(F.col("e").alias("other"), F.col("p_ef").alias("p"))).alias("others"))
    into = cut(table.filter(F.col("p_fe") >= least).select("e", "f", "p_fe"))
    sizes = into.groupBy("f").agg(F.count(F.lit(1)).alias("many"))
    met = join_counted(into, cut(onward.join(sizes, "f")), "f", "many").select("e", "p_fe", F.explode("others").alias("o")).filter(F.col("o.other") != F.col("e"))
    found = met.groupBy("e", F.col("o.other").alias("other")).agg(F.sum(F.col("p_fe") * F.col("o.p")).alias("p"))
    return found.filter(F.col("p") >= least_sum)
