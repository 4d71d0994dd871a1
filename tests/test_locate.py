"""Offsets of passages against the standard library's matcher."""

import random
from difflib import SequenceMatcher

import pytest

from assayer.operators import locate as lo


@pytest.mark.parametrize("seed", range(60))
def test_blocks_and_shares(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcé"[: rng.randrange(2, 5)]) for _ in range(rng.randrange(n)))
    a = text(60)
    b = "".join(c for c in a if rng.random() < 0.9) + text(8) if seed % 2 else text(60)
    m = SequenceMatcher(None, a, b, autojunk=False)
    x, y = lo.Hashed(a), lo.Hashed(b)
    block = m.find_longest_match(0, len(a), 0, len(b))
    assert lo.longest_block(x, y, (0, len(a), 0, len(b))) == ((block.a, block.b, block.size) if block.size else (0, 0, 0))
    assert lo.matched_share(x, y) == pytest.approx(m.ratio())


def test_offsets_of_pairs(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(99)}" for _ in range(400)]
    whole = " ".join(words)
    rows = [(1, whole, whole[3:]), (2, whole, whole.replace(words[380], "other", 1)), (3, whole, whole[:50]), (4, whole, None), (5, None, "a"), (6, "", ""), (7, "abcdefghij", "Xbcdefghij"), (8, "abcdefghij", "XXcdefghij")]
    got = {r["id"]: (r["offset"], r["size"]) for r in lo.near_offsets(spark.createDataFrame(rows, "id int, t string, p string").repartition(3), ["id"], "t", "p").collect()}
    for i, t, p in rows:
        t, p = t or "", p or ""
        m = SequenceMatcher(None, t, p, autojunk=False)
        b = m.find_longest_match(0, len(t), 0, len(p))
        assert got[i] == ((b.a, b.size) if p and b.size >= 0.85 * len(p) and m.ratio() > 0.85 else (-1, 0)), i
    assert got[1] == (3, len(whole) - 3) and got[7] == (1, 9) and got[3] == got[8] == (-1, 0)
