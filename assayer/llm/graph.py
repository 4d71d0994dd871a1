"""Connected components of a large link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.plans import cut, join_counted, packed


def components(links: DataFrame, max_rounds: int = 60, small: int = 200_000) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``; label: the least node of its component.

    Each round every node takes the least label among its own and its neighbours',
    then the label of that label, so that long chains halve; a label of many nodes is broadcast to them. Rounds go on until no
    label changes. Labels live in the shared checkpoint folder between rounds; the
    driver sees only the number of changes. Tables have no more partitions than their rows fill, and up to ``small`` links send the labels to them, so that rounds over few links leave few files.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    n = edges.count()
    edges = packed(edges, n)
    sent = F.broadcast if n <= small else lambda x: x
    labels = cut(packed(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), n))
    for _ in range(max_rounds):
        near = edges.join(sent(labels), edges.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hooked = cut(packed(labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), n))
        roots = hooked.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        jump = cut(packed(labels.select(F.col("node").alias("via"), F.col("label").alias("further")).join(roots, F.col("via") == roots.label).select("label", "further", "n"), n))
        least = F.least("label", F.coalesce("further", "label"))
        new = cut(packed(join_counted(hooked, jump, "label", "n", "left").select("node", least.alias("label"), (least != F.col("old")).alias("moved")), n))
        labels = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
