"""Vector codes against plain Lloyd rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from assayer.llm import vector_codes


def plain_lloyd(rows, parts, entries, rounds, scale):
    """[(id, label, code, error)], codebooks: all distances in every round, in Python's whole numbers."""
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    book = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((apart(cut(v, p), c), e) for e, c in enumerate(book[p])) for p in range(parts)] for _, _, v in kept]
    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for e in range(len(first)):
                mine = [cut(v, p) for (_, _, v), n in zip(kept, near, strict=True) if n[p][1] == e]
                if mine:
                    book[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, label, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n)) for (i, label, _), n in zip(kept, assign(), strict=True)], book


def frame(spark, rows, more="", pad=()):
    return spark.createDataFrame([(*r, *pad) for r in rows], "vec_id long, embedding array<float>, label int" + more).repartition(3)


def hold(spark, rows, **how):
    want, book = plain_lloyd(rows, how["parts"], how["entries"], how["rounds"], how["scale"])
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for p in book for c in p for x in c).encode()).hexdigest()
    got = vector_codes.coded_table(frame(spark, rows), **how)
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in got.collect()) == order((i, code, error, sums[label], digest) for i, label, code, error in want)


def float32(x):
    return float(np.float32(x))


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_against_plain_rounds(spark, seed):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(9)]
    rows = [(i, [float32(m + rng.gauss(0, 0.4)) for m in middles[i % 9]], rng.choice([None, 1, 2])) for i in range(400)]
    hold(spark, rows, parts=4, entries=16, rounds=6, scale=4096)


def test_ties_repeats_nulls_and_broken_vectors(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(60), [float(rng.randrange(-2, 3)) for _ in range(8)], rng.choice([None, 7])) for _ in range(300)]  # few values, so many ties
    rows += rows[:40] + [(None, [1.0] * 8, None), (1, None, 2), (2, [None] * 8, 2), (3, [float("nan")] * 8, 2), (4, [float("inf")] * 8, 2), (5, [-0.5] * 7 + [float("-inf")], 2)]
    hold(spark, rows, parts=4, entries=8, rounds=6, scale=2)


def test_fewer_rows_than_entries_and_none(spark):
    hold(spark, [(1, [0.5] * 8, None), (2, [1.5] * 8, 3)], parts=8, entries=16, rounds=3, scale=4096)
    assert vector_codes.coded_table(frame(spark, [(1, None, 1)])).collect() == []


def test_bounds_spare_distances_and_other_columns_stay_out(spark):
    rng = random.Random(4)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(16)]
    rows = [(i, [float32(m + rng.gauss(0, 0.05)) for m in middles[i % 16]], i % 3) for i in range(1000)]
    names = "id, key, code, error, n, part".split(", ")
    clashing = frame(spark, rows, "".join(f", {c} string" for c in names), names)
    codes = vector_codes.compress_vectors(clashing, parts=2)
    assert codes.asked[0] == 1000 * 2 * 16 and codes.asked[-1] < codes.asked[0] / 4
    assert codes.rows.columns == ["id", "label", "code", "error"] and codes.rows.count() == 1000
    assert vector_codes.coded_table(clashing.withColumnRenamed("vec_id", "Code_"), "Code_", parts=2).columns[0] == "Code_"


def test_refused(spark):
    for rows in ([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], [(1, [1.0] * 7, 1)], [(1, [1e6] * 8, 1)]):
        with pytest.raises(Exception, match="vectors must|scaled component"):
            vector_codes.compress_vectors(frame(spark, rows))
