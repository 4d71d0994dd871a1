"""Greedy alignment against a walk that looks at one character after the other."""

import random
import string

import pytest

from assayer.operators import alignment as al

PASSED = set(string.punctuation + string.whitespace)


def walk(this, source, length):
    """The passages by a buffer of characters and a table of n-grams, one character at a time."""
    table, held = {}, []
    for i, c in enumerate(this):
        if c not in PASSED:
            held = [*held, (i, c)][-length:]
            if len(held) == length:
                table.setdefault("".join(x.lower() for _, x in held), []).append((held[0][0], i))
    found, held, behind = [], [], -1
    for i, c in enumerate(source):
        if i <= behind or c in PASSED:
            continue
        held.append((i, c))
        if len(held) < length:
            continue
        gram = "".join(x.lower() for _, x in held)
        if gram not in table:
            held = held[1:]
            continue
        start = held[0][0]
        best = (*table[gram][0], start, i)
        for s, _ in table[gram]:
            x, y = s, start
            while x < len(this) and y < len(source) and this[x] == source[y]:
                x, y = x + 1, y + 1
                while x < len(this) and this[x] in PASSED:
                    x += 1
                while y < len(source) and source[y] in PASSED:
                    y += 1
            if y - 1 - start > best[3] - best[2]:
                best = (s, x, start, y)
        found.append(best)
        behind = best[3]
        held = [(behind, source[behind])] if behind < len(source) else []
        if behind >= len(source):
            break
    return found


def mixed(rng, n, letters="abcDE é"):
    return "".join(rng.choice(letters + " .,") for _ in range(n))


@pytest.mark.parametrize("seed", range(60))
def test_passages_of_a_pair(seed):
    rng = random.Random(seed)
    shared = [mixed(rng, rng.randrange(5, 60)) for _ in range(3)]
    def text():
        parts = [mixed(rng, rng.randrange(40)) for _ in range(4)]
        for s in shared:
            s = rng.choice([s, s.replace(" ", ", "), s.swapcase(), s[: len(s) // 2] + "X" + s[len(s) // 2 :], s + s])
            parts.insert(rng.randrange(5), s)
        return "".join(parts)
    a, b, length = text(), text(), rng.choice([3, 5, 9])
    assert al.greedy_passages(a, b, length) == walk(a, b, length)


def test_few_letters_and_edges():
    rng = random.Random(99)
    for _ in range(200):
        a, b, n = mixed(rng, rng.randrange(30), "ab"), mixed(rng, rng.randrange(30), "aB"), rng.choice([2, 3, 4])
        assert al.greedy_passages(a, b, n) == walk(a, b, n)
    assert al.greedy_passages("", "", 5) == [] and al.greedy_passages("abcde", "abcde", 5) == walk("abcde", "abcde", 5)


@pytest.mark.parametrize("max_broadcast", [500_000, 0])
def test_every_pair_of_two_tables(spark, max_broadcast):
    rng = random.Random(7)
    sources = [(k, mixed(rng, 300)) for k in range(12)] + [(50, None), (51, "")]
    texts = []
    for k in range(40):
        parts = [mixed(rng, 100)]
        for _ in range(rng.randrange(3)):
            s = rng.choice(sources[:12])[1]
            at = rng.randrange(200)
            parts += [s[at : at + rng.randrange(20, 100)], mixed(rng, 50)]
        texts.append((k, "".join(parts)))
    texts += [(100, None), (101, "")]
    left, right = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(sources, "item_id int, text string")
    got = al.greedy_alignment(left, right, "doc_id", "item_id", length=20, max_broadcast=max_broadcast)
    want = [(d, i, n + 1, p[0], p[1] - p[0], p[2], p[3] - p[2]) for d, t in texts for i, s in sources for n, p in enumerate(walk(t or "", s or "", 20))]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    some = spark.createDataFrame([(d, i) for d, _ in texts[:20] for i, _ in sources], "doc_id long, item_id int")
    got = al.greedy_alignment(left, right, "doc_id", "item_id", length=20, pairs=some, max_broadcast=max_broadcast)
    assert sorted(map(tuple, got.collect())) == sorted(w for w in want if w[0] < 20)
    assert al.greedy_alignment(left.limit(0), right, "doc_id", "item_id").collect() == []
