"""Known answers and invariants of the measures."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayer.functions import measures as m
from assayer.functions import text as tx
from assayer.operators import classify, clusters, features, intervals, passages, retrieval, scores, similarity, validate

#: Published known answers for passage annotations; the expected numbers below belong to them.
ANN = {
    1: ("tref1", 0, 100, "sref1", 0, 100, True),
    2: ("tref1", 0, 100, "", 0, 0, False),
    3: ("tref1", 100, 100, "sref1", 100, 100, True),
    4: ("tref1", 0, 200, "sref1", 0, 200, True),
    5: ("tref1", 0, 1, "sref1", 0, 1, True),
    6: ("tref1", 99, 1, "sref1", 99, 1, True),
    7: ("tref2", 0, 100, "sref2", 0, 100, True),
    8: ("tref2", 0, 100, "", 0, 0, False),
    9: ("tref2", 50, 100, "sref2", 50, 100, True),
    10: ("tref2", 25, 75, "sref2", 25, 75, True),
}


def anns(spark, *ids):
    return spark.createDataFrame([ANN[i] for i in ids], "ref string, off long, len long, sref string, soff long, slen long, ext boolean")


def one(df, *columns):
    row = df.collect()[0]
    return row[0] if not columns else tuple(row[c] for c in columns)


@pytest.mark.parametrize(("a", "b", "hit"), [(1, 2, True), (1, 4, True), (1, 5, True), (1, 6, True), (1, 3, False), (1, 7, False), (1, 10, False)])
def test_overlap(spark, a, b, hit):
    assert (passages.overlap_pairs(anns(spark, a), anns(spark, b)).count() == 1) is hit


def test_case_recall_and_macro(spark):
    recall = lambda c, *d: passages.case_recall(anns(spark, c), anns(spark, *d)).collect()[0]["recall"]
    assert recall(1, 2) == 0.5 and recall(7, 10) == 0.75
    measure = lambda cases, dets, name: passages.measures(anns(spark, *cases), anns(spark, *dets)).collect()[0][name]
    assert measure([1, 7], [1], "macro_recall") == 0.5
    assert measure([1], [4], "macro_precision") == 0.5
    assert measure([7], [9, 10], "macro_precision") == 0.75
    assert measure([1], [3, 4], "macro_precision") == 0.25
    assert measure([1], [2, 3, 4], "granularity") == 2
    assert measure([1, 3], [2, 4], "granularity") == 1.5


def test_empty_sides(spark):
    none = anns(spark, 1).limit(0)
    both = passages.measures(none, none).collect()[0]
    assert (both["macro_recall"], both["micro_precision"], both["granularity"]) == (1.0, 1.0, 1.0)
    half = passages.measures(anns(spark, 1), none).collect()[0]
    assert (half["macro_recall"], half["micro_recall"], half["macro_plagdet"]) == (0.0, 0.0, 0.0)


def test_plagdet(spark):
    row = spark.range(1).select(m.plagdet(F.lit(1.0), F.lit(1.0), F.lit(2.0)), m.plagdet(F.lit(0.75), F.lit(0.25), F.lit(2.0))).collect()[0]
    assert row[0] == pytest.approx(0.63092975) and row[1] == pytest.approx(0.23659865)


def test_union_is_at_most_the_sum(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 5, 12), ("a", 20, 21), ("b", 3, 4)], "k string, s long, e long")
    assert {r["k"]: r["covered"] for r in intervals.union_length(rows, ["k"]).collect()} == {"a": 13, "b": 1}
    assert intervals.islands(rows, ["k"], gap=8).count() == 2


def test_auc_of_reversed_scores(spark):
    rows = spark.createDataFrame([(i % 2, (i * 7 % 10) / 10) for i in range(40)], "y int, p double")
    forward, back = one(scores.auc(rows, [])), one(scores.auc(rows.withColumn("p", 1 - F.col("p")), []))
    assert forward == pytest.approx(1 - back)
    assert one(scores.auc(rows.filter("y = 1"), [])) == 0.0


def test_scores_with_gaps(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.1), (0, 0.7)], "y int, p double")
    y, p = F.col("y"), F.col("p")
    got = rows.agg(m.c_at_1(y, p), m.f1_answered(y, p), m.f05u(y, p), m.brier(y, p)).collect()[0]
    assert got[0] == pytest.approx((2 + 1 * 2 / 4) / 4)
    assert got[1] == pytest.approx(2 / 3)
    assert got[2] == pytest.approx(1.25 / (1.25 + 0.25 + 1))
    assert got[3] == pytest.approx(1 - (0.01 + 0.25 + 0.01 + 0.49) / 4)


def test_age_windows(spark):
    cases = [(2008, 2006, True), (2008, 2005, False), (1988, 1984, True), (1988, 1983, False), (1938, 1929, True), (1938, 1948, False)]
    rows = spark.createDataFrame(cases, "t int, p int, hit boolean")
    assert all(r["got"] == r["hit"] for r in rows.withColumn("got", classify.age_hit(F.col("t"), F.col("p"))).collect())


def test_lenient_precision_and_recall(spark):
    rows = spark.createDataFrame([(t, 2008) for t in range(2008, 2013)], "label int, pred int")
    counts = classify.with_prf(classify.class_counts(rows, [], hit=classify.age_hit(F.col("label"), F.col("pred"))))
    by = {r["cls"]: r for r in counts.collect()}
    assert [round(by[t]["precision"], 4) for t in range(2008, 2013)] == [0.3333, 1, 1, 0, 0]
    assert [by[t]["recall"] for t in range(2008, 2013)] == [1, 1, 1, 0, 0]


def test_diarization_errors(spark):
    rows = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 0, 1), (2, 1, 0)], "problem int, ref int, sys int")
    got = {r["problem"]: r for r in classify.diarization(rows, ["problem"]).collect()}
    assert got[1]["jer"] == 0.75 and got[2]["jer"] == 0 and got[2]["der"] == 0


def test_assignment_is_the_first_best_permutation(spark):
    from itertools import permutations

    rng = random.Random(5)
    for n in (1, 2, 4, 6):
        for _ in range(20):
            counts = {(i, j): rng.randrange(4) for i in range(n) for j in range(n)}
            best = max(permutations(range(n)), key=lambda p: (sum(counts[i, j] for i, j in enumerate(p)), [-j for j in p]))
            assert classify.assign(counts, n) == list(best)


def test_more_than_five_clusters_count(spark):
    rows = [(1, c, c) for c in range(5) for _ in range(3)] + [(1, 5 + k % 2, 5 + (k + 1) % 2 if k > 3 else k % 5) for k in range(6)]
    rows += [(2, c, (c + 3) % 9) for c in range(9) for _ in range(c + 1)]
    got = {r["problem"]: r for r in classify.diarization(spark.createDataFrame(rows, "problem int, ref int, sys int"), ["problem"]).collect()}
    assert got[1]["der"] > 0 and got[2]["der"] == 0 and got[2]["jer"] == 0
    wrong = [(1, c, c) for c in range(5) for _ in range(3)] + [(1, 5, c) for c in range(3)] + [(1, 6, c) for c in range(3)]
    got = classify.diarization(spark.createDataFrame(wrong, "problem int, ref int, sys int"), ["problem"]).collect()[0]
    assert got["der"] == pytest.approx(6 / 21)


def test_bm25_both_ways(spark):
    rng = random.Random(1)
    docs = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(12))]) for i in range(700)]
    asked = [(f"q{k}", [rng.choice("abcdxyz") for _ in range(4)]) for k in range(5)]
    used = [t for _, t in docs if t]
    mean = sum(map(len, used)) / len(used)
    want = {}
    for q, terms in asked:
        scores = []
        for i, tokens in docs:
            if set(terms) & set(tokens):
                part = 0.0
                for t in terms:
                    df, tf = sum(t in x for _, x in docs), tokens.count(t)
                    part += math.log(1 + (len(used) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens) / mean))
                scores.append((-round(part, 6), i))
        want[q] = [(i, pytest.approx(-s)) for s, i in sorted(scores)[:10]]
    queries = spark.createDataFrame([(q, t) for q, terms in asked for t in terms], "qid string, token string")
    table = spark.createDataFrame(docs, "docno long, tokens array<string>").repartition(3)
    for limit in (1000, 0):
        got = {}
        for r in retrieval.bm25(queries, table, top=10, max_broadcast=limit).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append((r["docno"], r["score"]))
        assert got == {q: v for q, v in want.items() if v}


def test_threshold_cells_change_no_comparison(spark):
    rng = random.Random(3)
    scores_ = [rng.random() for _ in range(300)] + [k / 100 for k in range(101)] + [0.25, 0.75, 0.0, 1.0, -3.0, 7.0]
    rows = [(rng.randrange(2), p) for p in scores_]
    df = spark.createDataFrame(rows, "y int, p double")
    for r in scores.sweep(df, 0.25, 0.75, 40).collect():
        tp = sum(y == 1 and p >= r["threshold"] for y, p in rows)
        fp = sum(y == 0 and p >= r["threshold"] for y, p in rows)
        assert r["precision"] == pytest.approx(tp / (tp + fp)) and r["recall"] == pytest.approx(tp / sum(y for y, _ in rows))


def test_char_gram_counts_and_row_matches(spark):
    texts = [("a", "añb👍añ"), ("a", "añ"), (None, "xx"), ("b", None), ("b", "")]
    got = {(r["k"], r["length"], r["gram"]): r["n"] for r in features.char_gram_counts(spark.createDataFrame(texts, "k string, t string"), ["k"], "t", [1, 2]).collect()}
    want = {}
    for k, t in texts:
        for n in (1, 2):
            for i in range(len(t or "") - n + 1):
                want[k, n, t[i : i + n]] = want.get((k, n, t[i : i + n]), 0) + 1
    assert got == want
    rows = spark.createDataFrame([(1, "abab", "ab"), (2, "", "x"), (3, None, None)], "id int, h string, r string")
    got = sorted(tuple(r) for r in similarity.row_matches(rows, ["id"], "h", "r", range(1, 4)).collect())
    assert got == [(1, 1, 2, 4, 2), (1, 2, 1, 3, 1), (1, 3, 0, 2, 0), (2, 1, 0, 0, 1)]


def test_style_change_f1(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (0, 0), (0, 0)], "y int, yhat int")
    assert classify.binary_report(rows, []).collect()[0]["f1_macro"] == pytest.approx(0.77, abs=0.01)


def paths(k):
    """Monotone paths from (0, 0) to (k-1, k-1) with steps right, down, diagonal."""
    out = [[(0, 0)]]
    done = []
    while out:
        path = out.pop()
        r, c = path[-1]
        if (r, c) == (k - 1, k - 1):
            done.append(path)
        out += [[*path, (a, b)] for a, b in ((r + 1, c), (r, c + 1), (r + 1, c + 1)) if a < k and b < k]
    return done


def test_ordinal_index_is_the_cheapest_path(spark):
    pairs = [(1, 1)] * 5 + [(1, 2)] * 2 + [(2, 2)] * 4 + [(3, 1)] * 3 + [(3, 3)] * 6 + [(2, 3)]
    rows = spark.createDataFrame([(0, a, b) for a, b in pairs], "g int, y int, yhat int")
    n = {(a - 1, b - 1): pairs.count((a, b)) for a, b in set(pairs)}
    total, k = len(pairs), 3
    spread = sum(v * abs(r - c) for (r, c), v in n.items())
    cost = lambda cell: -n.get(cell, 0) / (spread + total) + 0.75 / (total * (k - 1)) * n.get(cell, 0) * abs(cell[0] - cell[1])
    best = min(1 + sum(map(cost, path)) for path in paths(k))
    assert classify.ordinal_index(rows, ["g"]).collect()[0]["oci"] == pytest.approx(best)
    perfect = rows.withColumn("yhat", F.col("y"))
    assert classify.ordinal_index(perfect, ["g"]).collect()[0]["oci"] == pytest.approx(0)


def test_bcubed_micro_cases(spark):
    truth = spark.createDataFrame([(0, 1, d) for d in "ab"] + [(0, 2, d) for d in "cd"], "problem int, cluster int, doc string")
    same = clusters.bcubed(truth, truth, ["problem"]).collect()[0]
    assert (same["precision"], same["recall"], same["f"]) == (1, 1, 1)
    alone = clusters.bcubed(truth, truth.limit(0), ["problem"]).collect()[0]
    assert (alone["precision"], alone["recall"]) == (1.0, 0.5)


def test_window_measures(spark):
    gold, hypo = "00000010000000001000000", "00000001000000010000000"
    rows = spark.createDataFrame([(0, i, int(a), int(b)) for i, (a, b) in enumerate(zip(gold, hypo, strict=True))], "g int, pos int, y int, yhat int")
    got = clusters.window_measures(rows, ["g"], 3).collect()[0]
    windows = [(gold[i : i + 3].count("1"), hypo[i : i + 3].count("1")) for i in range(len(gold) - 2)]
    assert got["windowdiff"] == pytest.approx(sum(a != b for a, b in windows) / len(windows))
    assert got["win_precision"] == pytest.approx(sum(min(w) for w in windows) / sum(b for _, b in windows))


def test_ngrams_are_linear_and_whole(spark):
    text = "añb👍c"
    row = spark.range(1).select(tx.char_ngrams(F.lit(text), 2), tx.char_ngrams(F.lit("a"), 2), tx.ngrams(F.array(*map(F.lit, "abc")), 2), tx.ngrams(F.array(F.lit("a")), 2)).collect()[0]
    assert row[0] == [text[i : i + 2] for i in range(4)] and row[1] == [] and row[2] == ["a b", "b c"] and row[3] == []


def test_entropy_backs_off(spark):
    train = spark.createDataFrame([("A", "abab")], "author string, text string")
    test = spark.createDataFrame([("t", "abz")], "key string, text string")
    model = features.context_counts(train, ["author"], "text", 2)
    got = features.cross_entropy(test, "key", "text", model, "author", 2).collect()[0]["entropy"]
    assert got == pytest.approx((-math.log2(1 / 2) - math.log2(1) - math.log2(1 / 256)) / 3)


def test_bleu_of_equal_and_foreign_texts(spark):
    rows = spark.createDataFrame([(1, "a b c d e".split(), "a b c d e".split()), (2, ["x"], ["y"]), (3, [], ["y"])], "id int, h array<string>, r array<string>")
    assert [r["bleu"] for r in similarity.sentence_bleu(rows, ["id"], "h", "r").orderBy("id").collect()] == [pytest.approx(1), 0, 0]


def test_pair_measures_without_a_match(spark):
    pairs = lambda *p: spark.createDataFrame(p, "a int, b int")
    got = retrieval.pair_prf(pairs((1, 2), (3, 4)), pairs((2, 1), (1, 2), (5, 6))).collect()[0]
    assert got["precision"] == pytest.approx(1 / 3) and got["recall"] == 0.5


def test_validators(spark):
    rows = spark.createDataFrame([("p1", [0, 1], 3), ("p2", [0, 2], 3), ("p3", None, 2), ("p4", [1], 3)], "id string, ch array<int>, n int")
    found = {(r["item"], r["error"]) for r in validate.changes(rows, "id", "ch", "n").collect()}
    assert found == {("p2", "INVALID_FORMAT"), ("p3", "MISSING_KEY"), ("p4", "INVALID_LENGTH")}


def test_seeds_and_islands_against_brute_force(spark):
    left = spark.createDataFrame([(1, "Some text, with a shared passage here."), (2, "nothing alike"), (3, "")], "doc_id int, text string")
    right = spark.createDataFrame([(7, "A SHARED passage: here, too"), (8, "x")], "item_id int, text string")
    keep = lambda t: "".join(c for c in t.lower() if c.isalnum())
    n = 6
    expected = set()
    for i, a in ((r["doc_id"], keep(r["text"])) for r in left.collect()):
        for j, b in ((r["item_id"], keep(r["text"])) for r in right.collect()):
            expected |= {(i, j, x, y) for x in range(len(a) - n + 1) for y in range(len(b) - n + 1) if a[x : x + n] == b[y : y + n]}
    seeds = retrieval.seed_matches(left, right, "doc_id", "item_id", "text", n)
    assert {(r["doc_id"], r["item_id"], r["left_pos"], r["right_pos"]) for r in seeds.collect()} == expected
    island = retrieval.diagonal_islands(seeds, ["doc_id", "item_id"], n).collect()
    shared = "asharedpassagehere"
    start = keep("Some text, with a shared passage here.").index(shared)
    assert [(r["left_start"], r["left_end"], r["right_start"]) for r in island] == [(start, start + len(shared), 0)]


def test_impostor_shares_against_brute_force(spark):
    rng = random.Random(3)
    some = lambda names: [(n, g, rng.randrange(1, 9) / 8) for n in names for g in rng.sample("abcdefghijkl", 7)]
    u, a, o = some(range(4)), some(["x", "y", "z"]), some(range(100, 160, 5))
    frames = [spark.createDataFrame(r, f"{k}, gram string, f double") for r, k in ((u, "text int"), (a, "author string"), (o, "other int"))]
    rounds, sample, seed = 25, 5, 7
    got = {(int(r["text"]), r["author"]): r["share"] for r in features.impostor_shares(*frames, iterations=rounds, sample=sample, seed=seed).collect()}

    ks = spark.range(1, rounds + 1).select(F.col("id").cast("int").alias("k"))
    hashed = ks.crossJoin(frames[0].select("gram").union(frames[1].select("gram")).union(frames[2].select("gram")).distinct())
    hashed = hashed.select("k", "gram", (F.pmod(F.xxhash64(F.lit(seed), F.lit("gram"), "k", "gram"), F.lit(1 << 30)) / 2.0**30).alias("u"))
    kept = {(r["k"], r["gram"]) for r in hashed.collect() if r["u"] < 0.5}
    drawn = ks.crossJoin(frames[0].select("text").distinct()).crossJoin(frames[2].select("other").distinct())
    ranks = {(r["k"], r["text"], r["other"]): r["h"] for r in drawn.withColumn("h", F.xxhash64(F.lit(seed), F.lit("impostor"), "k", F.col("text").cast("string"), F.col("other").cast("string"))).collect()}

    def distance(p, q, k):
        p, q = ({g: f for g, f in x.items() if (k, g) in kept} for x in (p, q))
        least = sum(min(p.get(g, 0), q.get(g, 0)) for g in p | q)
        return round(1 - least / (sum(max(p.get(g, 0), q.get(g, 0)) for g in p | q) + 1e-6), 9)

    of = lambda rows, name: {g: f for n, g, f in rows if n == name}
    want, met = {}, set()
    for t in range(4):
        for x in "xyz":
            wins = 0
            for k in range(1, rounds + 1):
                chosen = sorted(range(100, 160, 5), key=lambda n: (ranks[k, t, n], n))[:sample]
                met |= set(chosen)
                wins += distance(of(u, t), of(a, x), k) <= min(distance(of(u, t), of(o, n), k) for n in chosen)
            want[t, x] = wins / rounds
    assert got == pytest.approx(want) and len(met) == 12
    assert {r["share"] for r in features.impostor_shares(*frames[:2], frames[2].limit(0), iterations=2).collect()} == {None}


def test_nist_counts_only_what_matches(spark):
    rng = random.Random(4)
    draw = lambda: [rng.choice("abcdefghij") for _ in range(rng.randrange(25))]
    rows = [(k // 2 if k < 6 else k, k % 2, draw(), draw()) for k in range(40)] + [(99, 5, [], []), (98, 6, ["a"], [])]
    df = spark.createDataFrame(rows, "id int, part int, h array<string>, r array<string>")
    got = {r["part"]: r["nist"] for r in similarity.corpus_nist(df, ["id"], ["part"], "h", "r").collect()}
    grams = lambda t, n: Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1))

    def plain(part):
        mine, of = {}, [r for r in rows if r[1] == part]
        for i, _, h, r in of:
            mine.setdefault(i, []).append((h, r))
        refs = {n: sum((grams(r, n) for *_, r in of), Counter()) for n in range(1, 6)}
        lh, lr, score = sum(len(r[2]) for r in of), sum(len(r[3]) for r in of), 0.0
        for n in range(1, 6):
            info = 0.0
            for texts in mine.values():
                h, r = (sum((grams(t[k], n) for t in texts), Counter()) for k in range(2))
                info += sum(m * math.log2((lr if n == 1 else refs[n - 1][g[:-1]]) / refs[n][g]) for g, m in (h & r).items())
            whole = sum(max(len(r[2]) - n + 1, 0) for r in of)
            score += info / whole if whole else 0
        return score * math.exp(math.log(0.5) / math.log(1.5) ** 2 * math.log(min(1, lh / lr)) ** 2) if lr else 0.0

    assert got == {part: pytest.approx(plain(part)) for part in (0, 1, 6)}
