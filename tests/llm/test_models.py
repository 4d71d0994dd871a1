"""The language model against a plain forward pass and differences of its loss; the ring's columns against plain Python."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from assayer.llm import lm_scoring, sharding
from assayer.llm.lm_scoring import END, Network, Settings, Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = Settings(lookup=12, head=6, per_class=2, hidden=3, steps=5)
COUNTS = [(END, 9), *((w.encode(), n) for w, n in zip("abcdefghijk", range(12, 1, -1), strict=True))]

COUNTS_IN_ORDER = sorted(COUNTS, key=lambda x: (x[0] != END, -x[1], x[0]))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", None) for i, t in rows], SCHEMA).repartition(3)


def network(seed=1):
    words = Words(COUNTS, 100, 16, SMALL)
    net = Network(words, SMALL)
    net.flat[:] = np.random.default_rng(seed).normal(0, 0.5, len(net.flat))
    return words, net


def plain_log_chance(words, net, targets, inputs):
    """Natural log of the chance of each token (of its class beyond the lookup), one unit at a time."""
    p, h, found = net.p, [0.0] * SMALL.hidden, []
    n = SMALL.hidden
    for goal, given in zip(targets.tolist(), inputs.tolist(), strict=True):
        if given == words.start:
            h = [0.0] * n
        x, u = p["x"][given].tolist(), p["u"].tolist()
        g = [sum(h[a] * u[a][b] for a in range(n)) for b in range(3 * n)]
        z = [(1 + math.tanh(g[a] + x[a])) / 2 for a in range(n)]
        r = [(1 + math.tanh(g[n + a] + x[n + a])) / 2 for a in range(n)]
        new = [math.tanh(r[a] * g[2 * n + a] + x[2 * n + a]) for a in range(n)]
        h = [z[a] * h[a] + (1 - z[a]) * new[a] for a in range(n)]
        softmax = lambda v, at: v[at] - math.log(sum(math.exp(y) for y in v))
        k = int(words.class_of[goal])
        logp = softmax([sum(h[a] * float(p["vc"][a, c]) for a in range(n)) + float(p["bc"][c]) for c in range(words.classes)], k)
        if k < words.head_classes:
            mine = [sum(h[a] * float(p["vw"][k, m, a]) for a in range(n)) + float(p["bw"][k, m]) for m in range(SMALL.per_class)]
            logp += softmax(mine, goal - k * SMALL.per_class)
        else:
            logp += float(words.inside[goal])
        found.append(logp)
    return found


def test_score_is_the_plain_forward_pass():
    words, net = network()
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefghijkz") for _ in range(n)).encode() for n in (0, 1, 3, 17, 40)]
    coded = [words.encode(t) for t in texts]
    got = net.score([t for t, _, _ in coded], [i for _, i, _ in coded])
    assert got == pytest.approx([sum(plain_log_chance(words, net, t, i)) / math.log(10) for t, i, _ in coded], rel=1e-4)


def test_gradients_are_differences_of_the_loss():
    words, net = network()
    rng = np.random.default_rng(4)
    targets = rng.integers(0, words.n + 1, (5, 2))
    inputs = rng.integers(0, words.start, (5, 2))
    inputs[0] = inputs[3, 1] = words.start  # a document starts inside a lane
    found = {}

    def keep(name, g, rows):
        full = np.zeros_like(net.p[name])
        full[rows] = g
        found[name] = full

    net._descend = keep
    net.learn(inputs, targets, np.zeros((2, 3), np.float32))
    loss = lambda: -np.mean([plain_log_chance(words, net, targets[:, k], inputs[:, k]) for k in range(2)])
    for name, values in net.p.items():
        for at in itertools.islice(rng.permutation(values.size).tolist(), 40):
            place, step = np.unravel_index(at, values.shape), 1e-2
            old = float(values[place])
            values[place] = old + step
            up = loss()
            values[place] = old - step
            down = loss()
            values[place] = old
            assert found[name][place] == pytest.approx((up - down) / (2 * step), abs=2e-4), (name, place)


def test_texts_encoded_together():
    """The same as word by word, whatever bytes the texts have: only six are white space, only A-Z have lower case."""
    words, _ = network()
    texts = [b"", b" ", b"a b", b"  A\tb\n\nzz c\r\x0b\x0c", b"\xffq \xc3\x84 a", b"x" * 300 + b" k", b"\n", bytes(range(256)), b"a\x1cb \xc2\x85 \xc2\xa0 c", b"a" * 3 + b" "]
    number = {w: i for i, (w, _) in enumerate(COUNTS_IN_ORDER)}
    for group in (texts, texts[:1], texts[:2], [b"\t"] * 3, []):
        want_targets, want_inputs, want_rare, want_ends = [], [], [], []
        for raw in group:
            given = words.start
            for w in [*raw.lower().split(), END]:
                want_targets.append(number.get(w, words.n))
                want_inputs.append(given)
                if w not in number:
                    want_rare.append(w)
                given = number[w] if number.get(w, words.n) < words.head else words.head + words.suffix(w)
            want_ends.append(len(want_targets))
        targets, inputs, ends, rare = words.encode_all(group)
        assert (targets.tolist(), inputs.tolist(), ends.tolist(), rare.to_pylist()) == (want_targets, want_inputs, want_ends, want_rare)


def test_exponentials_do_not_go_class_by_class(monkeypatch):
    """A small window costs as many calls with many classes as with few."""
    for per_class in (1, 3):
        s = Settings(lookup=12, head=6, per_class=per_class, hidden=3, steps=5)
        net = Network(Words(COUNTS, 100, 16, s), s)
        calls, exp = [], np.exp
        monkeypatch.setattr(lm_scoring.np, "exp", lambda *a, **k: calls.append(1) or exp(*a, **k))  # noqa: B023
        ids = np.arange(10).reshape(5, 2)
        net.learn(ids, ids, np.zeros((2, 3), np.float32))
        monkeypatch.undo()
        assert len(calls) == 2


def test_held_out_texts_gain_over_the_counts(spark):
    """Texts whose words follow from the one before: the counts cannot know, the network does."""
    rng = random.Random(5)
    follow = {f"w{k}": [f"w{(k * 7 + j) % 40}" for j in (1, 2)] for k in range(40)}

    def text():
        w = [f"w{rng.randrange(40)}"]
        while len(w) < 60:
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    rows = [(i, text()) for i in range(1200)]
    got = [r for r in lm_scoring.score_documents(frame(spark, rows)).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in got)
    gain = (sum(r["score"] for r in got) - sum(r["base_score"] for r in got)) / tokens
    assert gain > 0.1, gain


def test_ring_columns(spark):
    rows = [(i, "é" * (i % 50)) for i in range(500)] + [(600, None), (601, ""), (None, "x"), (7, "same"), (7, "same")]
    got = sharding.shard_documents(frame(spark, rows)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
