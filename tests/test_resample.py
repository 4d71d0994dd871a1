"""Resampling against a plain walk over lists with the same draws."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayer.operators import resample as rs


def walk(spark, rows, strategy, seed):
    """Times each row is taken, by lists; rows: {id: labels}, with repeats after a first pass."""

    def hashes(values, tag, type_):
        df = spark.createDataFrame([(v,) for v in values], type_).select(F.xxhash64(F.lit(tag), *["one" if "one" in type_ else "id"]).alias("h"))
        return [r["h"] for r in df.collect()]

    def draw(items, n, tag):
        if not items or not n:
            return []
        order = [x for _, x in sorted(zip(hashes(items, tag, "one struct<id:long,copy:long>"), items, strict=True))]
        return [order[h % len(order)] for h in hashes(list(range(n)), tag, "id long")]

    def one_pass(items, strategy, seed):
        labels = lambda x: rows[x[0]]
        sizes = sorted(Counter(c for x in items for c in labels(x)).items(), key=lambda x: (-x[1], x[0]))
        targets = [sizes[min(round(len(sizes) * t), len(sizes) - 1)][1] for t in strategy.targets]
        taken = []
        for name, size in reversed(sizes):
            target = min(targets, key=lambda t: abs(t - size))
            if (target > size and not strategy.over) or (target < size and not strategy.under):
                target = size
            free = target - sum(name in labels(x) for x in taken)
            if free <= 0:
                continue
            mine = [x for x in items if name in labels(x)]
            had = {x[0] for x in taken}
            left = [x for x in mine if x[0] not in had]
            if free >= len(left):
                new, free, source, tag = list(left), free - len(left), mine, f"over:{name}"
            else:
                new, source, tag = [], left, f"under:{name}"
            single = [x for x in source if len(labels(x)) == 1]
            if free < 3 * len(single) or len(single) > 10 * (len(source) - len(single)):
                source = single
            taken += new + draw(source, free, f"0:{seed}:{tag}")
        return taken

    taken = one_pass([(i, 1) for i in rows], strategy, f"{seed}")
    if strategy.then:
        taken = one_pass([(i, k + 1) for i, n in Counter(x[0] for x in taken).items() for k in range(n)], strategy.then, f"{seed}:then")
    return Counter(x[0] for x in taken)


@pytest.mark.parametrize("name", rs.STRATEGIES)
def test_strategies_against_a_walk(spark, name):
    rng = random.Random(6)
    chances = {"a": 0.7, "b": 0.4, "c": 0.25, "d": 0.1, "e": 0.05, "f": 0.03}
    rows = {i: [c for c, p in chances.items() if rng.random() < p] for i in range(160)}
    df = spark.createDataFrame(list(rows.items()), "id long, labels array<string>").repartition(4)
    got = {r["id"]: r["times"] for r in rs.sample_classes(df, "id", "labels", rs.STRATEGIES[name]).collect()}
    assert got == walk(spark, rows, rs.STRATEGIES[name], 5)
    assert all(rows[i] for i in got)


def test_numbers_are_gapless_and_empty_tables(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    places = [r["place"] for r in rs.numbered(df, "k", F.lit("x")).collect()]
    assert sorted(places) == list(range(3000))
    empty = spark.createDataFrame([], "id long, labels array<string>")
    assert rs.sample_classes(empty, "id", "labels", rs.STRATEGIES["ruos_q"]).collect() == []
    assert sum(r["times"] for r in rs.drawn(df, "k", 500, 1, "y").collect()) == 500 and rs.drawn(df.limit(0), "k", 5, 1, "y").collect() == []
