"""Alignments against all that are possible, and the stemmer against known stems."""

import itertools
import random

import pytest

from assayer.functions.stem import stem
from assayer.operators import meteor as mt

#: Known answers of the published algorithm.
STEMS = (
    "consign consigned consigning consignment consist consisted consistency consistent consistently consisting consists consolation consolations consolatory console consoled "
    "knack knave knavish kneaded kneeling knees knights knitting knots generate generously communication communal arsenal skies dying news hopping hoping falling filled "
    "happily relational conditional rationalization hopefulness callousness sensibility electricity adjustable replacement adoption agreed feed bus gas this kiwis cries tie ties cry by say"
).split()
KNOWN = (
    "consign consign consign consign consist consist consist consist consist consist consist consol consol consolatori consol consol "
    "knack knave knavish knead kneel knee knight knit knot generat generous communic communal arsenal sky die news hop hope fall fill "
    "happili relat condit ration hope callous sensibl electr adjust replac adopt agre feed bus gas this kiwi cri tie tie cri by say"
).split()


def test_stems():
    assert [stem(w) for w in STEMS] == KNOWN


def every_alignment(first, second):
    a, b = [stem(w) for w in first], [stem(w) for w in second]
    best = None
    choices = [[None, *(i for i, s in enumerate(a) if s == t)] for t in b]
    for some in itertools.product(*choices):
        used = [i for i in some if i is not None]
        if len(used) == len(set(used)):
            pairs = [(i, j) for j, i in enumerate(some) if i is not None]
            rank = (-len(pairs), mt.count_chunks(pairs), sum(abs(i - j) for i, j in pairs))
            best = rank if best is None else min(best, rank)
    return best


@pytest.mark.parametrize("seed", range(80))
def test_most_words_then_fewest_chunks(seed):
    rng = random.Random(seed)
    words = ["run", "runs", "the", "cat", "cats", "a", "sat"][: rng.randrange(2, 8)]
    first, second = ([rng.choice(words) for _ in range(rng.randrange(7))] for _ in range(2))
    found = mt.align_words(first, second, beam=2000)
    assert (-len(found.pairs), found.chunks, sum(abs(i - j) for i, j in found.pairs)) == every_alignment(first, second) or first == second
    assert found.chunks == mt.count_chunks(found.pairs)
    narrow = mt.align_words(first, second)
    assert len(narrow.pairs) == len(found.pairs) and narrow.chunks <= found.chunks + 1


def test_counts_and_scores(spark):
    rows = [(1, "the cat sat on the mat".split(), "on the mat sat the cat".split()), (2, "a b c".split(), "a b c".split()), (3, "He was Running".split(), "she runs".split()), (4, None, ["x"]), (5, [], []), (6, ["a"], ["b"])]
    counts = mt.alignment_counts(spark.createDataFrame(rows, "id int, a array<string>, b array<string>"), ["id"], "a", "b", ["the", "on", "a"])
    got = {r["id"]: r for r in counts.withColumn("score", mt.meteor_score(counts)).collect()}
    assert (got[1]["matched"], got[1]["chunks"], got[1]["exact"], got[1]["functions1"], got[1]["matched_functions2"]) == (6, 3, 6, 3, 3)
    assert got[1]["score"] == pytest.approx(1 - 0.6 * 0.5**0.2) and got[2]["score"] == 1
    assert (got[3]["matched"], got[3]["exact"]) == (1, 0)
    p, r = 0.75 / 1.5, 0.75 / 2.25
    assert got[3]["score"] == pytest.approx(1 / (0.85 / p + 0.15 / r) * (1 - 0.6))
    assert got[4]["score"] == got[5]["score"] == got[6]["score"] == 0


def test_a_path_costs_the_same_however_long_it_is():
    """Partial alignments share their pairs and do not each copy them."""
    import tracemalloc

    a = [f"w{k % 600}x" for k in range(1200)]
    tracemalloc.start()
    found = mt.align_words(a, [*a[1:], "other"])
    size = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found.pairs) == 1199 and found.chunks == 1
    assert size < 1_500_000
