"""Trained baselines against small dense solvers and plain walks."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import entropy as en
from assayer.operators import features as ft
from assayer.operators import linear as ln
from assayer.operators import trees as tr


def sparse(spark, x, labels, more=(), names=""):
    rows = [(i, str(label) if label is not None else None, [k for k in range(len(v)) if v[k]], [float(a) for a in v if a], *extra) for i, (v, label, *extra) in enumerate(zip(x, labels, *more, strict=True))]
    return spark.createDataFrame(rows, f"id long, label string, idx array<int>, val array<double>{names}").repartition(3)


def blobs(seed, n, size, classes):
    rng = np.random.default_rng(seed)
    middles = 3 * rng.normal(size=(classes, size))
    y = rng.integers(0, classes, n)
    x = np.where(rng.random((n, size)) < 0.5, middles[y] + rng.normal(size=(n, size)), 0)
    return np.round(x, 3), y


def dense_newton(of, w, steps=200):
    """The least of a smooth convex function by Newton steps on a numerical curvature."""
    for _ in range(steps):
        value, slope = of(w)
        if np.abs(slope).max() < 1e-7:
            break
        curve = np.stack([(of(w + 1e-5 * e)[1] - of(w - 1e-5 * e)[1]) / 2e-5 for e in np.eye(len(w))])
        way, step = -np.linalg.solve(curve + 1e-9 * np.eye(len(w)), slope), 1.0
        while of(w + step * way)[0] > value + 1e-4 * step * (slope * way).sum() and step > 1e-10:
            step /= 2
        w = w + step * way
    return w


def test_margins_against_a_dense_solver(spark):
    x, y = blobs(1, 120, 6, 3)
    model = ln.fit_linear(sparse(spark, x, y), "label", 6, c=1.0, tolerance=1e-7)
    wide = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    for k in range(3):
        sign = np.where(y == k, 1.0, -1.0)

        def of(w, sign=sign):
            lack = np.maximum(0, 1 - sign * (wide @ w))
            return (w @ w) / 2 + (lack**2).sum(), w - 2 * wide.T @ (sign * lack)

        assert model.weights[:, k] == pytest.approx(dense_newton(of, np.zeros(7)), abs=1e-4)
    assert model.objective == sorted(model.objective, reverse=True)
    scores = {(r["id"], r["author"]): r["score"] for r in ln.class_scores(sparse(spark, x, y), "id", model).collect()}
    assert all(scores[i, str(k)] == pytest.approx(wide[i] @ model.weights[:, k]) for i in range(120) for k in range(3))
    assert np.mean([max(range(3), key=lambda k: scores[i, str(k)]) == y[i] for i in range(120)]) > 0.8


def test_log_linear_against_a_dense_solver(spark):
    x, y = blobs(2, 90, 4, 3)
    model = ln.fit_linear(sparse(spark, x, y), "label", 4, loss="log", c=0.5, tolerance=1e-7)
    wide = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    mask = np.ones((5, 3))
    mask[-1] = 0

    def of(flat):
        w = flat.reshape(5, 3)
        m = wide @ w
        p = np.exp(m - m.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return ((w * mask) ** 2).sum() / 2 - 0.5 * np.log(p[np.arange(90), y]).sum(), (w * mask + 0.5 * wide.T @ (p - np.eye(3)[y])).ravel()

    best = dense_newton(of, np.zeros(15)).reshape(5, 3)
    centred = lambda w: w - w.mean(axis=1, keepdims=True)  # noqa: E731  a shift of all intercepts changes nothing
    assert centred(model.weights) == pytest.approx(centred(best), abs=1e-3)
    found = ln.class_scores(sparse(spark, x, y), "id", model).groupBy("id").agg({"score": "sum"}).collect()
    assert all(r[1] == pytest.approx(1) for r in found)


def test_a_closed_case(spark):
    """Without features the chances are the shares of the classes."""
    model = ln.fit_linear(sparse(spark, [[0.0]] * 8, [0, 0, 0, 0, 0, 0, 1, 1]), "label", 1, loss="log", tolerance=1e-9)
    got = {r["author"]: r["score"] for r in ln.class_scores(sparse(spark, [[0.0]], [0]), "id", model).collect()}
    assert got == {"0": pytest.approx(0.75, abs=1e-6), "1": pytest.approx(0.25, abs=1e-6)}


def test_fit_refuses_what_it_cannot_fit(spark):
    with pytest.raises(ValueError, match="two classes"):
        ln.fit_linear(sparse(spark, [[1.0]] * 3, [1, 1, None]), "label", 1)
    with pytest.raises(ValueError, match="weights"):
        ln.fit_linear(sparse(spark, [[1.0], [2.0]], [1, 2]), "label", ln.MOST_WEIGHTS)
    with pytest.raises(ValueError, match="loss"):
        ln.fit_linear(sparse(spark, [[1.0]], [1]), "label", 1, loss="other")


def test_values_of_grams(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abcd") for _ in range(rng.randrange(5, 40)))) for i in range(30)] + [(99, "zz")]
    counts = [(i, g, n) for i, t in texts for g, n in Counter(t[k : k + 2] for k in range(len(t) - 1)).items()]
    train = [i for i, _ in texts if i < 20]
    c = spark.createDataFrame(counts, "id long, gram string, n long")
    lengths = spark.createDataFrame([(i, len(t)) for i, t in texts], "id long, length int")
    t = spark.createDataFrame([(i,) for i in train], "id long")
    totals = Counter()
    for i, g, n in counts:
        totals[g] += n if i in train else 0
    vocabulary = sorted((g for g, n in totals.items() if n >= 5), key=lambda g: (-totals[g], g))[:12]
    voc = ln.ordered_vocabulary(c.join(t, "id", "left_semi"), 5, 12)
    assert [r["gram"] for r in voc.orderBy("idx").collect()] == vocabulary
    f = {(i, g): n / len(dict(texts)[i]) for i, g, n in counts if g in vocabulary}
    top = {g: max(v for (i, h), v in f.items() if h == g and i in train) for g in vocabulary}
    values = ln.relative_values(c, "id", lengths, voc, t)
    assert {(r["id"], r["gram"]): r["value"] for r in values.collect()} == {k: pytest.approx(v / top[k[1]]) for k, v in f.items()}
    rows = {r["id"]: (r["idx"], r["val"]) for r in ln.sparse_rows(values, "id", lengths).collect()}
    assert rows[99] == ([], []) and all(ids == sorted(ids) for ids, _ in rows.values())
    df = {g: sum((i, g) in f for i in train) for g in vocabulary}
    raw = {(i, g): n * (math.log((1 + len(train)) / (1 + df[g])) + 1) for i, g, n in counts if g in vocabulary}
    norm = {i: math.sqrt(sum(v * v for (j, _), v in raw.items() if j == i)) for i, _ in texts}
    assert {(r["id"], r["gram"]): r["value"] for r in ln.tf_idf_values(c, "id", voc, t).collect()} == {(i, g): pytest.approx(v / norm[i]) for (i, g), v in raw.items()}


def test_answers_and_the_open_band(spark):
    scores = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.85), (2, "b", 0.5), (2, "a", 0.5), (3, "c", 2.0)], "id int, author string, score double")
    assert sorted(map(tuple, ln.answers(scores, "id", 0.1).select("id", "answer").collect())) == [(1, "<UNK>"), (2, "<UNK>"), (3, "c")]
    assert sorted(map(tuple, ln.answers(scores, "id").select("id", "answer").collect())) == [(1, "a"), (2, "a"), (3, "c")]
    from pyspark.sql import functions as F

    p = spark.createDataFrame([(0.44,), (0.45,), (0.5,), (0.56,)], "p double")
    assert [r[0] for r in p.select(ln.answered_half(F.col("p"), 0.05)).collect()] == [0.44, 0.5, 0.5, 0.56]


def plain_trees(x, y, many, depth, rate, bins, judged=None):
    """Margins after each tree, of all rows, by splitting lists of rows."""
    margin, judged = np.zeros(len(x)), np.ones(len(x), bool) if judged is None else judged
    history = [margin.copy()]
    for _ in range(many):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        step = np.zeros(len(x))

        def grow(rows, left):
            train = rows[judged[rows]]
            G, H = g[train].sum(), h[train].sum()
            best = (1e-6, None)
            if left:
                for f in range(x.shape[1]):
                    for c in range(bins - 1):
                        a = train[x[train, f] <= c]
                        b = train[x[train, f] > c]
                        if h[a].sum() >= 1 and h[b].sum() >= 1:
                            gain = round(g[a].sum() ** 2 / (h[a].sum() + 1) + g[b].sum() ** 2 / (h[b].sum() + 1) - G**2 / (H + 1), 9)
                            if gain > best[0]:
                                best = (gain, (f, c))
            if best[1] is None:
                step[rows] = -rate * G / (H + 1)
            else:
                f, c = best[1]
                grow(rows[x[rows, f] <= c], left - 1)
                grow(rows[x[rows, f] > c], left - 1)

        grow(np.arange(len(x)), depth)
        margin = margin + step
        history.append(margin.copy())
    return history


def tree_rows(spark, x, ys, fold):
    y = [[None if a < 0 else int(a) for a in row] for row in ys.T.tolist()]
    return sparse(spark, x, [0] * len(x), (y, fold.tolist()), ", y array<int>, fold int")


def test_trees_against_plain_splits(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((150, 5)) < 0.6, rng.integers(1, 4, (150, 5)), 0)
    ys = np.stack([((x[:, 0] > 1) ^ (x[:, 3] > 2)), (x[:, 1] + x[:, 2] + rng.integers(0, 3, 150) > 4)]).astype(int)
    ys[1, :20] = -1  # without a label
    fold = rng.integers(0, 3, 150)
    settings = [tr.Setting(0, None, 2, 0.5), tr.Setting(1, 1, 3, 0.25)]
    rows = tree_rows(spark, x, ys, fold)
    forest = tr.fit_trees(rows, 5, settings, bins=4, trees=6, patience=99)
    whole = plain_trees(x, ys[0], 6, 2, 0.5, 4)
    known = ys[1] >= 0
    part = plain_trees(x, np.where(known, ys[1], 0), 6, 3, 0.25, 4, known & (fold != 1))
    out = known & (fold == 1)
    losses = [np.mean(np.logaddexp(0, m[out]) - ys[1][out] * m[out]) for m in part]
    assert forest.losses[:, 1] == pytest.approx(losses) and forest.sizes == [6, int(np.argmin(losses))]
    got = {(r["id"], r["setting"]): r["p"] for r in tr.chances(rows, "id", forest, 5).collect()}
    sure = lambda m: 1 / (1 + math.exp(-m))
    assert got == {(i, 0): pytest.approx(sure(whole[6][i])) for i in range(150)} | {(i, 1): pytest.approx(sure(part[forest.sizes[1]][i])) for i in range(150) if fold[i] == 1}


def test_every_row_is_judged_by_what_did_not_see_it(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (90, 3))
    ys = np.stack([(x[:, 0] > 1).astype(int)])
    fold = rng.integers(0, 3, 90)
    rows = tree_rows(spark, x, ys, fold)
    forest, chances = tr.cross_validate(rows, "id", 3, 1, 3, [2], [0.5, 0.25], bins=4, trees=5, patience=2)
    got = chances.collect()
    assert len(got) == 180 and all(forest.settings[r["setting"]].left_out == fold[r["id"]] for r in got)
    assert np.mean([(r["p"] >= 0.5) == ys[0][r["id"]] for r in got]) > 0.95
    assert tr.chances(rows.limit(0), "id", forest, 3).collect() == []


def test_bins_are_quantiles(spark):
    values = spark.createDataFrame([(i, 0, float(i)) for i in range(1, 101)] + [(1, 1, 7.0), (2, 1, 7.0)], "id int, idx int, value double")
    got = tr.binned(values, "id", 5).collect()
    sizes = Counter(r["value"] for r in got if r["idx"] == 0)
    assert sizes == {1.0: 25, 2.0: 25, 3.0: 25, 4.0: 25} and {r["value"] for r in got if r["idx"] == 1} == {1.0}


def test_entropies_of_pairs(spark):
    def plain(text, model, order):
        bits = 0
        for i, c in enumerate(text):
            for o in range(min(i, order), -1, -1):
                ctx = text[i - o : i]
                after = [model[k + o] for k in range(len(model) - o) if model[k : k + o] == ctx]
                if c in after:
                    bits -= math.log2(after.count(c) / len(after))
                    break
            else:
                bits += 8
        return bits / len(text) if text else None

    rng = random.Random(8)
    text = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(60)))
    rows = [(i, text(), text()) for i in range(20)] + [(50, None, "abc"), (51, "", ""), (52, "aé", "éa")]
    got = {r["id"]: (r["h12"], r["h21"]) for r in en.pair_entropies(spark.createDataFrame(rows, "id int, a string, b string"), ["id"], "a", "b", 3).collect()}
    for i, a, b in rows:
        assert got[i] == (pytest.approx(plain(b or "", a or "", 3)), pytest.approx(plain(a or "", b or "", 3)))


def test_topics_fall_and_equal_dense_updates(spark):
    from assayer.operators import topics as tp

    rng = np.random.default_rng(9)
    v = np.where(rng.random((40, 12)) < 0.4, np.round(rng.random((40, 12)), 3), 0)
    v[5] = 0
    rows = sparse(spark, v, [0] * 40).select("id", "idx", "val")
    found = tp.factorise(rows, "id", 12, 3, rounds=12, seed=4)
    from pyspark.sql import functions as F

    first = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda t: (F.pmod(F.xxhash64(F.lit(4), F.col("id"), t), F.lit(1 << 20)) + 1) / F.lit(float(1 << 20)))
    w = np.array([r["w"] for r in rows.select("id", first.alias("w")).orderBy("id").collect()])
    h, losses = tp.start_factors(3, 12, 4), []
    for k in range(12):
        w = w * (v @ h.T) / np.maximum(w @ h @ h.T, 1e-12)
        losses.append(((v - w @ h) ** 2).sum())
        if k < 11:
            h = h * (w.T @ v) / np.maximum(w.T @ w @ h, 1e-12)
    assert found.losses == pytest.approx(losses) and all(a >= b - 1e-9 for a, b in zip(found.losses, found.losses[1:], strict=False)) and losses[-1] < 0.8 * losses[0]
    assert found.terms == pytest.approx(h)
    got = {r["id"]: r["w"] for r in found.mixtures.collect()}
    assert all(got[i] == pytest.approx(w[i].tolist()) for i in range(40)) and got[5] == [0, 0, 0]
    again = tp.factorise(rows.repartition(7), "id", 12, 3, rounds=12, seed=4)
    assert again.terms == pytest.approx(found.terms)
    cos = tp.mixture_cosine(found.mixtures.filter("id = 1").select(F.col("w").alias("a")).crossJoin(found.mixtures.select("id", F.col("w").alias("b"))), "a", "b")
    want = [0.0 if not w[i].any() else float(w[1] @ w[i] / np.sqrt((w[1] @ w[1]) * (w[i] @ w[i]))) for i in range(40)]
    assert [r["cosine"] for r in cos.orderBy("id").collect()] == pytest.approx(want)


def test_best_grams_without_counting_all(spark):
    """The pruned search gives the grams that counting everything gives, and counts no long gram of rare words."""
    rng = random.Random(8)
    texts = [(i, i % 3 % 2, [rng.choice("aabbbcdefgh") if rng.random() < 0.8 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(40))]) for i in range(120)]
    df = spark.createDataFrame([*texts, (500, 1, None)], "id int, cls int, ws array<string>")
    grams = {(i, c): [" ".join(ws[k : k + n]) for n in range(1, 5) for k in range(len(ws) - n + 1)] for i, c, ws in texts}
    total = Counter(g for gs in grams.values() for g in gs)
    best = sorted(total, key=lambda g: (-total[g], g))[:60]
    found = {r["gram"]: r["n"] for r in ft.most_frequent_grams(df, F.col("ws"), 4, 60).collect()}
    assert sorted(found, key=lambda g: (-found[g], g))[:60] == best and all(total[g] == n for g, n in found.items()) and len(found) < 0.2 * len(total)
    assert {r["gram"]: r["n"] for r in ft.most_frequent_grams(df, F.col("ws"), 4, 10**6).collect()} == dict(total)
    share = {c: sum(x[1] == c for x in [*texts, (0, 1)]) / 121 for c in (0, 1)}
    of = Counter((c, g) for (_, c), gs in grams.items() for g in set(gs))
    chi = lambda g: round(sum((of[c, g] - (n := of[0, g] + of[1, g]) * s) ** 2 / (n * s) for c, s in share.items()), 6)
    want = sorted(((-chi(g), g) for g in total if of[0, g] + of[1, g] >= 5))[:25]
    got = sorted((-r["chi2"], r["gram"]) for r in ft.most_dependent_grams(df, "cls", F.col("ws"), 4, 5, 25).collect())[:25]
    assert [g for _, g in got] == [g for _, g in want] and [x for x, _ in got] == pytest.approx([x for x, _ in want], abs=2e-6)
    listed = spark.createDataFrame([(g, k) for k, g in enumerate(best)], "gram string, idx int")
    counts = {(r["id"], r["gram"]): (r["idx"], r["n"]) for r in ft.listed_gram_counts(df, ["id"], F.col("ws"), 4, listed).collect()}
    assert counts == {(i, g): (best.index(g), n) for (i, _), gs in grams.items() for g, n in Counter(gs).items() if g in best}


def test_char_rows_and_their_scale(spark):
    texts = [(1, True, "abcabcabd"), (2, True, "bcabxé"), (3, False, "abcabcabcabx"), (4, False, None), (5, True, "ab")]
    df = spark.createDataFrame(texts, "id int, train boolean, text string").repartition(2)
    listed = {"abc": 2, "bca": 0, "xyz": 1, "abx": 3}
    rows = ln.char_rows(df, "text", 3, spark.createDataFrame(list(listed.items()), "gram string, idx int"))
    got = {r["id"]: dict(zip(r["idx"], r["val"], strict=True)) for r in rows.collect()}
    want = {i: {listed[g]: n / len(t) for g, n in Counter(t[k : k + 3] for k in range(len(t) - 2)).items() if g in listed} if t else {} for i, _, t in texts}
    assert got == want and all(list(r["idx"]) == sorted(r["idx"]) for r in rows.collect())
    top = {k: max(want[i].get(k, 0) for i in (1, 2, 5)) for k in range(4)}
    scaled = {r["id"]: dict(zip(r["idx"], r["val"], strict=True)) for r in ln.largest_scaled(rows, F.col("train"), 4).collect()}
    assert scaled == {i: {k: v / top[k] for k, v in x.items() if top[k]} for i, x in want.items()}
    assert "hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()  # no n-gram is shuffled


def test_char_grams_of_groups_and_pairs(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for letters in ("ab", "aé\U0001f600\U0010ffff", "xyz ") for _ in range(8)]
    wide = ["".join(chr(c) for c in range(k, k + 3000)) for k in (50, 90)]  # a group and an n-gram do not fit into one number
    for ts, size in ((texts, 1), (texts, 3), (wide, 6), ([], 2), (["a", ""], 2)):
        group = np.array([k % 3 for k in range(len(ts))], np.int64)
        of, place, grams, many = ft.text_gram_counts(ts, group, size)
        want = Counter((int(g), t[k : k + size]) for g, t in zip(group, ts, strict=True) for k in range(len(t) - size + 1))
        assert {(int(g), grams[k]): int(n) for g, k, n in zip(of, place, many, strict=True)} == want
    pairs = [(0, ["abab", "ba"], ["bab"]), (1, [None, "xy"], []), (2, None, ["é"]), (3, ["ab"], ["ab", None])]
    got = {(r["id"], r["gram"]): (r["a"], r["b"], r["all_a"], r["all_b"]) for r in ft.pair_gram_counts(spark.createDataFrame(pairs, "id int, x array<string>, y array<string>"), ["id"], "x", "y", 2).collect()}
    assert got == {(0, "ab"): (2, 1, 4, 2), (0, "ba"): (2, 1, 4, 2), (1, "xy"): (1, 0, 1, 0), (3, "ab"): (1, 1, 1, 1)}


def test_chunks_of_terms_without_a_shuffle(spark):
    from pyspark.sql import functions as F

    from assayer.operators import topics as tp

    rng = np.random.default_rng(3)
    texts = [[f"w{k}" for k in rng.integers(0, 30, n)] for n in (0, 1, 7, 8, 9, 40, 123)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, tokens array<string>").repartition(3)
    chunks = [(i, c, t[c * 8 : c * 8 + 8]) for i, t in enumerate(texts) for c in range(-(-len(t or []) // 8))]
    totals = tp.chunk_terms(df, "tokens", 8)
    assert "Generate" not in totals._jdf.queryExecution().toString()
    got = {r["gram"]: (r["df"], r["total"]) for r in totals.collect()}
    assert got.pop(None) == (len(chunks), 0)
    assert got == {w: (sum(w in c for _, _, c in chunks), sum(c.count(w) for _, _, c in chunks)) for w in {w for _, _, c in chunks for w in c}}
    vocabulary = tp.frequent_terms(totals, len(chunks), 2, 0.5, 10)
    best = sorted((w for w, (d, _) in got.items() if 2 <= d <= 0.5 * len(chunks)), key=lambda w: (-got[w][1], w))[:10]
    assert [r["gram"] for r in vocabulary.orderBy("idx").collect()] == best
    rows = {(r["id"], r["chunk"]): (r["idx"], r["val"]) for r in tp.chunk_rows(df, "id", "tokens", 8, vocabulary, len(chunks)).collect()}
    assert set(rows) == {(i, c) for i, c, _ in chunks}
    for i, c, words in chunks:
        w = {k: words.count(g) * (np.log((1 + len(chunks)) / (1 + got[g][0])) + 1) for k, g in enumerate(best) if g in words}
        assert rows[i, c][0] == list(w) and rows[i, c][1] == pytest.approx([x / np.sqrt(sum(y * y for y in w.values())) for x in w.values()])
    found = tp.factorise(tp.chunk_rows(df, "id", "tokens", 8, vocabulary, len(chunks)).withColumn("key", F.concat_ws(":", "id", "chunk")).drop("chunk"), "key", len(best), 2, rounds=2)
    assert found.mixtures.columns == ["key", "w", "id"] and {(r["key"].split(":")[0]) for r in found.mixtures.collect()} == {str(i) for i, _, _ in chunks}
