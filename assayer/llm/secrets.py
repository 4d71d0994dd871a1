"""Secret scans: fixed shapes, and a linear-chain conditional random field that tags further tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.text_hash import word_hashes
from assayer.plans import bounded_batches, cut

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What any text with a base span has, in lower case, unless it has a long run of hexadecimal digits.
NEEDLES = (b"password", b"passwd", b"secret", b"token", b"key", b"akia")
HEX_RUN = 24

BEGIN, INSIDE, OUTSIDE = 0, 1, 2
FORBIDDEN = -1e9
#: Tokens before and behind a sampled span, or of a sampled stretch without one.
AROUND = 40
#: Code points that make up a word token; each other character but white space is a token of its own.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)]] = True
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Tokens that are scored together.
PIECE = 1 << 19


def _flags(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, z in ranges:
        out[a : z + 1] = True
    return out


DIGIT, UPPER, LOWER = _flags((0x30, 0x39)), _flags((0x41, 0x5A)), _flags((0x61, 0x7A))
SMALL_HEX, ANY_HEX = _flags((0x30, 0x39), (0x61, 0x66)), _flags((0x30, 0x39), (0x61, 0x66), (0x41, 0x46))
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[UPPER] += 32
#: The class of a byte inside a token: 0 a digit, 1 upper case, 2 lower case, 3 any other.
CLASS = np.where(DIGIT, 0, np.where(UPPER, 1, np.where(LOWER, 2, 3))).astype(np.int8)

#: Kinds of features of a token and how many values each has. A neighbour has a word (by hash) and a look; the last value of these stands for no neighbour.
WORDS, LOOKS = 1 << 13, 128
KINDS_OF_FEATURES = {
    "size": 17, "mix": 125, "changes": 13, "hex": 8, "mixed": 32, "sign": 256,
    "word before": WORDS + 1, "word second before": WORDS + 1, "word behind": WORDS + 1, "look before": LOOKS + 1, "look second before": LOOKS + 1, "look behind": LOOKS + 1,
    "glue": 4, "signs in file": 6, "tokens in file": 8,
}
FIRST_OF = dict(zip(KINDS_OF_FEATURES, np.cumsum([0, *KINDS_OF_FEATURES.values()])[:-1].tolist(), strict=True))
DIMENSIONS = sum(KINDS_OF_FEATURES.values())
SALTS = {"word before": 0x9E3779B97F4A7C15, "word second before": 0xC2B2AE3D27D4EB4F, "word behind": 0x165667B19E3779F9}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed shapes in code points, by start then kind."""
    spans = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(spans)


def secret_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the secrets themselves within the base spans: an assignment's value, not its name; overlapping ones united."""
    found = [m.span(1) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 20] + [m.span() for m in HEX.finditer(text)]
    united: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if united and s < united[-1][1]:
            united[-1] = (united[-1][0], max(e, united[-1][1]))
        else:
            united.append((s, e))
    return united


def tokenise(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the tokens of texts that lie one behind the other, each from one of ``bounds`` to the next."""
    kind = np.where(WORD_BYTE[data], 1, np.where(BLANK[data], 0, 2)).astype(np.int8)
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    edge[bounds] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    full = kind[starts] > 0
    return starts[full], ends[full]


class Tokens:
    """The tokens of texts that lie one behind the other, and their features, piece by piece."""

    def __init__(self, raw: bytes, bounds: np.ndarray):
        self.data = np.frombuffer(raw, np.uint8)
        self.starts, self.ends = tokenise(self.data, bounds) if len(raw) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        n = len(self.starts)
        text = np.searchsorted(bounds, self.starts, side="right") - 1
        first = np.ones(n, bool)
        first[1:] = text[1:] != text[:-1]
        self.firsts = np.flatnonzero(first)  # of each text that has tokens
        self.place = np.arange(n) - np.repeat(self.firsts, np.diff(np.append(self.firsts, n)))
        self.last = np.append(first[1:], True)[:n]
        behind = np.append(self.starts[1:] > self.ends[:-1], True)[:n] | self.last
        self.glue = 2 * np.append(True, behind[:-1])[:n] + behind
        sizes = np.diff(np.append(self.firsts, n))
        signs = np.add.reduceat((~WORD_BYTE[self.data[self.starts]]).astype(np.int64), self.firsts) if n else sizes
        share = np.minimum(signs * 16 // np.maximum(sizes, 1), 5)
        length = np.minimum(np.log2(np.maximum(sizes, 1)) / 2, 7).astype(np.int64)
        self.file = np.stack([share + FIRST_OF["signs in file"], length + FIRST_OF["tokens in file"]], axis=1)
        self.text = np.cumsum(first) - 1  # among texts that have tokens

    def features(self, low: int, high: int) -> list[np.ndarray]:
        """A row number of the weights for each kind of feature of the tokens from ``low`` to ``high``."""
        a, z = max(0, low - 2), min(len(self.starts), high + 1)
        base = int(self.starts[a])
        data, starts, ends = self.data[base : int(self.ends[z - 1])], self.starts[a:z] - base, self.ends[a:z] - base
        within = np.zeros(len(data) + 1, np.int32)

        def count(flag: np.ndarray) -> np.ndarray:
            np.cumsum(flag, out=within[1:])
            return within[ends] - within[starts]

        n, kind = (ends - starts).astype(np.int32), CLASS[data]
        digits, upper, lower, hexes = (count(flag[data]) for flag in (DIGIT, UPPER, LOWER, ANY_HEX))
        turns = np.zeros(len(data), bool)
        turns[1:] = kind[1:] != kind[:-1]
        turns[starts] = False
        changes = count(turns)
        size = np.where(n < 5, n, np.minimum(n // 4, 12) + 4)
        grade = np.minimum(n // 8, 6)
        sign = np.where(WORD_BYTE[data[starts]], 0, data[starts])
        mixed = np.where((n >= 8) & (digits > 0) & (upper + lower > 0), grade * 4 + 2 * (upper > 0) + (lower > 0) + 1, 0)
        look = np.minimum(size, 15) * 8 + 4 * (digits > 0) + 2 * (upper > 0) + (lower > 0)
        hashes = word_hashes(LOWERED[data], starts, ends)
        own = slice(low - a, high - a)
        found = {
            "size": size[own], "mix": (4 * digits // n * 25 + 4 * upper // n * 5 + 4 * lower // n)[own], "changes": np.minimum(changes, 12)[own],
            "hex": np.where((n >= 6) & (digits > 0) & (hexes == n), grade + 1, 0)[own], "mixed": mixed[own], "sign": sign[own],
        }
        place, last = self.place[low:high], self.last[low:high]
        at = np.arange(low - a, high - a)
        for which, other, there in (("before", at - 1, place > 0), ("second before", at - 2, place > 1), ("behind", at + 1, ~last)):
            other = np.where(there, other, 0)
            word = (hashes[other] * np.uint64(SALTS[f"word {which}"]) >> np.uint64(64 - 13)).astype(np.int64)
            found[f"word {which}"], found[f"look {which}"] = np.where(there, word, WORDS), np.where(there, look[other], LOOKS)
        rows = [found[k] + FIRST_OF[k] for k in list(KINDS_OF_FEATURES)[:-3]]
        file = self.file[self.text[low:high]]
        return [*rows, self.glue[low:high] + FIRST_OF["glue"], file[:, 0], file[:, 1]]


def likely_texts(raw: bytes, bounds: np.ndarray) -> np.ndarray:
    """Which of the texts between ``bounds`` may have a base span: a needle, or a long run of hexadecimal digits."""
    found = np.zeros(len(bounds) - 1, bool)
    lowered = raw.lower()
    for needle in NEEDLES:
        at = lowered.find(needle)
        while at >= 0:
            text = int(np.searchsorted(bounds, at, side="right")) - 1
            found[text] = True
            at = lowered.find(needle, int(bounds[text + 1]))  # the rest of this text is settled
    hexes = np.concatenate(([False], SMALL_HEX[np.frombuffer(raw, np.uint8)], [False]))
    edge = np.flatnonzero(hexes[1:] != hexes[:-1])
    starts, ends = edge[0::2], edge[1::2]
    long = ends - starts >= HEX_RUN
    for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        found[int(np.searchsorted(bounds, s, side="right")) - 1 : int(np.searchsorted(bounds, e - 1, side="right"))] = True
    return found


class Model(NamedTuple):
    """Weights (feature, tag) and transitions (tag, tag) of the field; a text begins and ends outside."""

    weights: np.ndarray
    steps: np.ndarray


def windows(text: str, key: int) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(features (tokens, kinds), tags, whether it has a secret) of stretches of a text: around its first four secrets, or one at a place drawn by ``key``."""
    raw = text.encode("utf-8", "surrogatepass")
    tokens = Tokens(raw, np.array([0, len(raw)]))
    n = len(tokens.starts)
    if not n:
        return []
    tags, at, b = np.full(n, OUTSIDE), 0, 0
    for s, e in secret_values(text):  # code points to bytes
        b += len(text[at:s].encode("utf-8", "surrogatepass"))
        size = len(text[s:e].encode("utf-8", "surrogatepass"))
        i, j = np.searchsorted(tokens.ends, b, side="right"), np.searchsorted(tokens.starts, b + size, side="left")
        tags[i:j] = INSIDE
        tags[i : i + (j > i)] = BEGIN
        b, at = b + size, e
    begins = np.flatnonzero(tags == BEGIN)[:4]
    if len(begins):
        cuts = [(max(0, int(i) - AROUND), min(n, int(i) + AROUND)) for i in begins]
    else:
        first = key % max(1, n - 2 * AROUND)
        cuts = [(first, min(n, first + 2 * AROUND))]
    return [(np.stack(tokens.features(low, high), axis=1), tags[low:high], bool(len(begins))) for low, high in cuts]


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
        likely = likely_texts(b"".join(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64))
        rows = []
        for key, raw, flag in zip(batch.column(0).to_pylist(), texts, likely.tolist(), strict=True):
            if not flag and key & 15:
                continue  # stretches of a sixteenth of the plain texts are candidates, drawn by their hash
            for k, (features, tags, secret) in enumerate(windows(raw.decode("utf-8", "replace"), key & 0x7FFFFFFF)):
                rows.append((key ^ k, secret, features.ravel(), tags))
        if rows:
            types = [pa.int64(), pa.bool_(), *[pa.list_(pa.int32())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["key", "secret", "features", "tags"])


def sample_windows(docs: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` stretches with base secrets and as many without, those of the least hashes of their texts; equal texts count once."""
    cut_out = docs.select(F.xxhash64("text").alias("key"), "text").mapInArrow(_sample, "key long, secret boolean, features array<int>, tags array<int>")
    kept = cut(cut_out)
    halves = [kept.filter(F.col("secret") == flag).dropDuplicates(["key"]).orderBy("key").limit(bound) for flag in (True, False)]
    return cut(halves[0].unionByName(halves[1]))


def _padded(rows: list[tuple[list, list]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features (b, t, kinds), tags (b, t), lengths) of stretches; what lies behind a stretch's end is not looked at."""
    longest, kinds = max(len(r[1]) for r in rows), len(rows[0][0]) // len(rows[0][1])
    features, tags = np.zeros((len(rows), longest, kinds), np.int64), np.full((len(rows), longest), OUTSIDE)
    for k, (flat, own) in enumerate(rows):
        features[k, : len(own)] = np.reshape(flat, (len(own), kinds))
        tags[k, : len(own)] = own
    return features, tags, np.array([len(r[1]) for r in rows])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def gradient(model: Model, features: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood, token marginals minus truth (b, t, 3), expected minus true steps (3, 3), scores) of padded stretches, by forward and backward sums."""
    b, t = tags.shape
    scores = model.weights[features].sum(axis=2)
    inside = np.arange(t)[None, :] < lengths[:, None]
    ahead, back = np.zeros((b, t, 3)), np.zeros((b, t, 3))
    ahead[:, 0] = scores[:, 0] + model.steps[OUTSIDE]
    for i in range(1, t):
        new = _log_sum(ahead[:, i - 1, :, None] + model.steps[None], 1) + scores[:, i]
        ahead[:, i] = np.where(inside[:, i, None], new, ahead[:, i - 1])
    back[:, -1] = model.steps[:, OUTSIDE]
    for i in range(t - 2, -1, -1):
        new = _log_sum(model.steps[None] + (scores[:, i + 1] + back[:, i + 1])[:, None, :], 2)
        back[:, i] = np.where(inside[:, i + 1, None], new, model.steps[:, OUTSIDE])
    total = _log_sum(ahead[:, -1] + model.steps[:, OUTSIDE], 1)
    chance = np.exp(ahead + back - total[:, None, None]) * inside[..., None]
    truth = np.eye(3)[tags] * inside[..., None]
    pairs = ahead[:, :-1, :, None] + model.steps + (scores[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
    steps = (np.exp(np.minimum(pairs, 0)) * inside[:, 1:, None, None]).sum(axis=(0, 1))
    steps[OUTSIDE] += chance[:, 0].sum(axis=0)
    last = chance[np.arange(b), lengths - 1]
    steps[:, OUTSIDE] += last.sum(axis=0)
    true = np.zeros((3, 3))
    np.add.at(true, (tags[:, :-1][inside[:, 1:]], tags[:, 1:][inside[:, 1:]]), 1)
    np.add.at(true, (np.full(b, OUTSIDE), tags[:, 0]), 1)
    np.add.at(true, (tags[np.arange(b), lengths - 1], np.full(b, OUTSIDE)), 1)
    where = np.where(inside, tags, OUTSIDE)
    right = np.take_along_axis(scores, where[..., None], 2)[..., 0] * inside
    path = right.sum() + (true * np.where(model.steps > FORBIDDEN / 2, model.steps, 0)).sum()
    return float(path - total.sum()), chance - truth, steps - true, scores


def train_locally(rows: list[tuple], model: Model, epochs: int, rate: float, keep: float, batch: int = 32) -> Model:
    """AdaGrad over the stretches in the given order, from ``model``; ``keep`` shrinks weights towards zero at each epoch."""
    weights, steps = model.weights.astype(np.float64), model.steps.astype(np.float64)
    seen, seen_steps = np.full(weights.shape, 1e-2), np.full((3, 3), 1e-2)
    free = steps > FORBIDDEN / 2
    for _ in range(epochs):
        for at in range(0, len(rows), batch):
            features, tags, lengths = _padded(rows[at : at + batch])
            _, wrong, wrong_steps, _ = gradient(Model(weights, steps), features, tags, lengths)
            flat, each = features.reshape(-1), np.repeat(wrong.reshape(-1, 3), features.shape[2], axis=0)
            slope = np.stack([np.bincount(flat, each[:, t], len(weights)) for t in range(3)], axis=1)
            seen += slope * slope
            weights -= rate * slope / np.sqrt(seen)
            seen_steps += wrong_steps * wrong_steps
            steps = np.where(free, steps - rate * wrong_steps / np.sqrt(seen_steps), FORBIDDEN)
        weights *= keep
    return Model(weights.astype(np.float32), steps)


def empty_model() -> Model:
    steps = np.zeros((3, 3))
    steps[OUTSIDE, INSIDE] = FORBIDDEN
    return Model(np.zeros((DIMENSIONS, 3), np.float32), steps)


def train(windows_: DataFrame, shards: int = 8, rounds: int = 2, epochs: int = 4, rate: float = 0.2, keep: float = 0.98) -> Model:
    """The field fitted to the sampled stretches by iterated parameter mixing.

    The stretches are dealt to ``shards`` by their hash, so input splits do not matter; in each round every shard trains from the common weights and the
    weighted mean of the ``shards`` results is the next. The sample is bounded, and so is what a shard holds.
    """
    model = empty_model()
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")  # low bits of the key have decided what was sampled
    dealt = cut(windows_.repartitionById(shards, shard).sortWithinPartitions("key"))
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], given: Model = model) -> Iterator[pa.RecordBatch]:
            rows = [tuple(r.values()) for b in batches for r in b.select(["features", "tags"]).to_pylist()]
            if rows:
                made = train_locally(rows, given, epochs, rate, keep)
                columns = [pa.array([len(rows)]), pa.array([made.weights.tobytes()]), pa.array([made.steps.tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, names=["n", "weights", "steps"])

        made = dealt.mapInArrow(run, "n long, weights binary, steps binary").collect()  # one row a shard
        n = sum(r["n"] for r in made)
        if not n:
            return model
        mean = lambda c, t: sum(np.frombuffer(r[c], t).astype(np.float64) * (r["n"] / n) for r in sorted(made, key=lambda r: (r["n"], r["weights"])))
        model = Model(mean("weights", np.float32).reshape(-1, 3).astype(np.float32), mean("steps", np.float64).reshape(3, 3))
    return model


def viterbi(scores: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The best tags of a sequence that begins and ends outside; of equal paths the one that is outside for longer."""
    best, back = steps[OUTSIDE] + scores[0], []
    for i in range(1, len(scores)):
        through = best[::-1, None] + steps[::-1]
        back.append(2 - through.argmax(axis=0))
        best = through.max(axis=0) + scores[i]
    tag = 2 - int((best + steps[:, OUTSIDE])[::-1].argmax())
    tags = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        tags.append(tag)
    return np.array(tags[::-1])


def decode(scores: np.ndarray, steps: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """``viterbi`` of each text; ``firsts``: the number of each text's first token (texts without tokens left out).

    Only stretches that may hold a secret are walked. A token's gain is what it can add over the path outside, at most: its better secret tag and the best step. If
    no run of tokens through it has a gain above the least that leaving may cost, every best path is outside there, and cuts the chain.
    """
    n = len(scores)
    tags = np.full(n, OUTSIDE)
    if not n:
        return tags
    none = steps[OUTSIDE, OUTSIDE]
    entering = max(steps[OUTSIDE, BEGIN], steps[BEGIN, BEGIN], steps[INSIDE, BEGIN], steps[BEGIN, INSIDE], steps[INSIDE, INSIDE]) - none
    leaving = max(steps[BEGIN, OUTSIDE], steps[INSIDE, OUTSIDE]) - none
    gain = (np.maximum(scores[:, BEGIN], scores[:, INSIDE]) - scores[:, OUTSIDE]).astype(np.float64) + entering
    wall = np.zeros(n)
    wall[firsts] = 1e12  # no run goes from one text into the next
    sums = np.cumsum(gain)
    before = np.concatenate(([0.0], sums[:-1]))
    text = np.cumsum(wall > 0) - 1
    shift = text * 1e9
    upto = sums - (np.minimum.accumulate(before - shift) + shift)
    onward = np.maximum.accumulate((sums - shift)[::-1])[::-1] + shift - before
    maybe = upto + onward - gain + leaving > -0.1  # with room for rounding
    at = np.flatnonzero(maybe)
    if len(at):
        cuts = np.flatnonzero((at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])) + 1
        for run in np.split(at, cuts):
            tags[run] = viterbi(scores[run], steps)
    return tags


def tag_tokens(model: Model, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, tags) of the tokens of texts that lie between ``bounds`` of ``raw``."""
    tokens = Tokens(raw, bounds)
    n = len(tokens.starts)
    scores = np.zeros((n, 3), np.float32)
    for at in range(0, n, PIECE):
        for rows in tokens.features(at, min(n, at + PIECE)):
            scores[at : at + PIECE] += model.weights[rows]
    return tokens.starts, tokens.ends, decode(scores, model.steps, tokens.firsts)


def _kind_of(value: str) -> int:
    """The kind a discovered secret goes by, from its shape."""
    if value.startswith("AKIA"):
        return 1
    return 2 if re.fullmatch(r"[0-9a-f]+", value) else 0


def _tagged_spans(starts: np.ndarray, ends: np.ndarray, tags: np.ndarray) -> Iterator[tuple[int, int]]:
    for i in np.flatnonzero(tags == BEGIN).tolist():
        j = i + 1
        while j < len(tags) and tags[j] == INSIDE:
            j += 1
        yield int(starts[i]), int(ends[j - 1])


def _scan(shared, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
            bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
            joined = b"".join(texts)
            likely = likely_texts(joined, bounds)
            starts, ends, tags = tag_tokens(model, joined, bounds)
            marked: dict[int, list[tuple[int, int]]] = {}
            for s, e in _tagged_spans(starts, ends, tags):
                marked.setdefault(int(np.searchsorted(bounds, s, side="right")) - 1, []).append((s, e))
            bases, mores = [], []
            for k, raw in enumerate(texts):
                base, more = [], []
                if k in marked or likely[k]:
                    text = raw.decode("utf-8", "replace")
                    base = base_spans(text)
                    at, place = 0, 0  # bytes and code points so far
                    for s, e in marked.get(k, ()):
                        s, e = s - int(bounds[k]), e - int(bounds[k])
                        place += len(raw[at:s].decode("utf-8", "replace"))
                        value = raw[s:e].decode("utf-8", "replace")
                        span, at, place = (place, place + len(value), _kind_of(value)), e, place + len(value)
                        if len(value) >= least and all(b[1] <= span[0] or span[1] <= b[0] for b in base):
                            more.append(span)
                bases.append([dict(zip("sek", b, strict=True)) for b in base])
                mores.append([dict(zip("sek", b, strict=True)) for b in more])
            span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("k", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, span), pa.array(mores, span)], names=["id", "base", "more"])

    return run


def _spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    by_place = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"], x["k"], x["e"])))
    return F.array_join(F.transform(by_place, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000, least: int = 6) -> DataFrame:
    """One row per row of ``df``: the base counts and hash, and all spans.

    n_assign, n_access, n_hex and base_sha256 are of the fixed shapes (``base_spans``); ``spans`` holds those and the discovered ones as ``kind:start:end``, by start then
    kind, in code points, end exclusive; n_discovered counts the latter, which are of ``least`` characters or more, overlap no base span, and go by the kind of their shape.

    1. Tokens are runs of letters, digits and underscores; each other sign is one. Their true tags (begin, inside, outside) are those of the base spans' values.
    2. At most ``sample`` stretches of 80 tokens around such secrets and as many elsewhere, those of the least hashes, train the field (``train``). Features of a token are
       length and mix of its characters, the words and looks of the two before and the one behind, white space on either side, and the file's share of signs and length;
       not its own word, so a secret is known by what it looks like and where it stands.
    3. One pass over all whole texts tags every token by Viterbi, without a shuffle (``decode`` skips only what no best path can touch).

    Nothing but the bounded sample and 8 sets of weights leaves the tasks. A null text counts as empty; a table without base spans trains nothing and gives base spans only; null ids and
    repeated rows each come out; other columns are not read; an empty table gives an empty result.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    taken = sample_windows(docs, sample)
    model = empty_model() if taken.filter("secret").isEmpty() else train(taken)
    if not model.weights.any():
        model.steps[OUTSIDE, BEGIN] = FORBIDDEN
    shared = spark.sparkContext.broadcast(tuple(model))
    schema = f"id {docs.schema['id'].dataType.simpleString()}, base array<struct<s:bigint,e:bigint,k:int>>, more array<struct<s:bigint,e:bigint,k:int>>"
    found = docs.mapInArrow(_scan(shared, least), schema)
    kinds = F.transform("base", lambda x: x["k"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        F.col("id").alias(id_col),
        *counts,
        F.sha2(_spans_text(F.col("base")), 256).alias("base_sha256"),
        _spans_text(F.concat("base", "more")).alias("spans"),
        F.size("more").cast("long").alias("n_discovered"),
    )
