"""Unmasking against a classifier fitted the long way and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from assayer.operators import unmasking as un

SMALL = un.Settings(rounds=5, features=30, taken=3, folds=3, chunks=9, size=60)


def long_way(x, sign, c=1.0, steps=60_000):
    """The same classifier by small steps down the gradient."""
    w, rate = np.zeros(x.shape[1]), 0.9 / (1 + 2 * c * np.linalg.norm(x, 2) ** 2)
    for _ in range(steps):
        lack = np.maximum(0, 1 - sign * (x @ w))
        w = w - rate * (w - 2 * c * x.T @ (sign * lack))
    return w


@pytest.mark.parametrize("seed", range(4))
def test_margins_from_inner_products(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(20, 6)) + 0.3 * np.repeat([1, -1], 10)[:, None]
    sign = np.repeat([1.0, -1.0], 10)
    weights = un.fit_margin(x @ x.T, sign)
    assert x.T @ weights == pytest.approx(long_way(x, sign), abs=1e-5)


def plain_curve(counts, s):
    half, kept, curve = len(counts) // 2, list(range(counts.shape[1])), []
    for _ in range(min(s.rounds, (len(kept) - 1) // s.taken)):
        scores, first = [], None
        for k in range(s.folds):
            rows = [(counts[i][kept], 1.0 if i < half else -1.0, i % half % s.folds == k) for i in range(2 * half)]
            x = np.array([[*r, 1.0] for r, _, out in rows if not out])
            y = np.array([z for _, z, out in rows if not out])
            w = x.T @ un.fit_margin(x @ x.T, y)
            scores.append(np.mean([((np.array([*r, 1.0]) @ w > 0) == (z > 0)) for r, z, out in rows if out]))
            first = w[:-1] if first is None else first
        curve.append(max(0.0, 2 * np.mean(scores) - 1))
        worst = sorted(range(len(kept)), key=lambda i: (-round(first[i], 9), i))[: s.taken]
        kept = [k for i, k in enumerate(kept) if i not in worst]
    return [np.mean(curve[i : i + s.smoothing]) for i in range(len(curve) - s.smoothing + 1)]


def test_curves_values_and_independence(spark):
    rng = random.Random(3)
    prose = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(i, prose("aabcde  ", 600)) for i in range(6)] + [(10 + i, prose("aabcd ", 300) + prose("vwxyzz ", 300)) for i in range(3)] + [(20, None), (21, "abc"), (22, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    got = {r["id"]: (r["curve"], r["value"]) for r in un.unmask(df.repartition(3), "id", "text", SMALL).collect()}
    alone = {r["id"]: (r["curve"], r["value"]) for r in un.unmask(df.filter("id in (1, 10)"), "id", "text", SMALL).collect()}
    assert alone == {i: got[i] for i in alone}
    for i, t in texts[:-3]:
        curve = plain_curve(un.chunk_counts(t, SMALL), SMALL)
        assert got[i][0] == pytest.approx(curve) and got[i][1] == pytest.approx(1 / (1 + np.exp(2 * np.mean(np.array(curve) - 0.75))))
    assert [got[i] for i in (20, 21, 22)] == [([], 0.5)] * 3
    assert min(got[i][1] for i in range(6)) > max(got[i][1] for i in (10, 11, 12))  # halves of one source soon look alike


def test_many_classifiers_at_once():
    rng = np.random.default_rng(5)
    sign = np.repeat([1.0, -1.0], 10)
    x = rng.normal(size=(40, 20, 6)) * rng.choice([0.1, 1, 10], size=(40, 1, 1)) + rng.choice([0, 0.3, 3], size=(40, 1, 1)) * sign[:, None]
    kernels = x @ x.transpose(0, 2, 1)
    together = un.fit_margins(kernels, sign)
    assert np.allclose(kernels @ together[:, :, None], np.array([k @ un.fit_margin(k, sign) for k in kernels])[:, :, None], atol=1e-6)


@pytest.mark.parametrize("text", ["abab cdcd éé\U0001f600" * 9, "xyxyxyx", "".join(map(chr, range(60, 400)))])
def test_chunks_against_counted_draws(text):
    halves = [text[: len(text) // 2], text[len(text) // 2 :]]
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{SMALL.seed}\0{text}".encode()).digest()[:8], "little"))
    grams = [[h[i : i + 3] for i in range(len(h) - 2)] for h in halves]
    chunks = [Counter(g[i] for i in rng.integers(0, len(g), SMALL.size).tolist()) for g in grams for _ in range(SMALL.chunks)]
    whole = sum(chunks, Counter())
    best = sorted(whole, key=lambda g: (-whole[g], g))[: SMALL.features]
    assert un.chunk_counts(text, SMALL).tolist() == [[x[g] for g in best] for x in chunks]
