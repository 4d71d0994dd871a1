"""Language-model scoring: a gated recurrent network with a class-factored softmax, in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.plans import bounded_batches, cut

#: The token that ends each document: no word, for words hold no white space.
END = b"\n"
SUFFIX_BUCKETS = 256
#: Texts are encoded together, up to so many bytes, so that the table of words is hashed once for all of them.
ENCODED_BYTES = 8 << 20


@dataclass(frozen=True)
class Settings:
    """Sizes of the model and of its training.

    lookup: the most frequent words of up to ``longest_word`` bytes, at most so many, whose counts every task holds.
    head: the most frequent of those, which have outputs of their own, in classes of ``per_class``.
    """

    lookup: int = 131_072
    head: int = 2048
    per_class: int = 64
    hidden: int = 16
    steps: int = 16
    lanes: int = 512
    first_lanes: int = 64
    lane_tokens: int = 256
    rate: float = 0.08
    rounds: int = 3
    seed: int = 3
    chunk_tokens: int = 2_000_000
    combiners: int = 8
    longest_word: int = 256


class Words:
    """What all tasks know of the training counts: the frequent words, and sums over the rest.

    A word's class: ``head`` words by frequency rank in groups of ``per_class``; then one class of the
    more frequent half of the other lookup words by count, one of the less frequent, and one of all words beyond. In
    the last three a word has the chance (count + 1) over the class's sum of such.
    """

    def __init__(self, counted: list[tuple[bytes, int]], total: int, distinct: int, s: Settings):
        counted = sorted(counted, key=lambda x: (x[0] != END, -x[1], x[0]))
        self.total, self.distinct = total, distinct
        self.words = pa.array([w for w, _ in counted], pa.binary())
        self.n = len(counted)
        self.head = min(s.head, self.n)
        self.head_classes = -(-s.head // s.per_class)
        self.classes = self.head_classes + 3
        counts = np.array([c for _, c in counted] + [0], dtype=np.float64)
        rank = np.arange(self.n + 1)
        split = self.head + (self.n - self.head) // 8
        self.class_of = np.where(rank < self.head, rank // s.per_class, np.where(rank < split, self.head_classes, self.head_classes + 1)).astype(np.int32)
        self.class_of[self.n] = self.head_classes + 2
        known = counts[:-1].sum()
        self.seen = counts > 0
        self.rest_sum = max(1, total - known + distinct - int(self.seen.sum()) + 1)
        self.base_sum = total + distinct + 1
        inside = np.zeros(self.n + 1)
        weight = np.zeros(self.classes)
        np.add.at(weight, self.class_of[:-1], counts[:-1] + 1)
        later = rank[:-1] >= self.head
        inside[:-1][later] = np.log((counts[:-1] + 1)[later] / weight[self.class_of[:-1][later]])
        self.inside = inside  # natural log of the chance within the class, where it doesn't depend on the state
        self.base = np.log10((counts + 1) / self.base_sum)
        self.base[self.n] = 0.0  # counted with the rest
        suffix = np.array([self.head + self.suffix(w) for w, _ in counted[self.head :]], dtype=np.int32)
        self.input_of = np.concatenate([np.arange(self.head, dtype=np.int32), suffix, [0]]).astype(np.int32)
        prior = np.zeros(self.classes)
        np.add.at(prior, self.class_of[:-1], counts[:-1] + 1)
        prior[-1] = self.rest_sum
        self.class_prior = np.log(np.maximum(prior, 1e-3) / max(prior.sum(), 1.0)).astype(np.float32)
        word = np.full(self.head_classes * s.per_class, -30.0)
        word[: self.head] = np.log(counts[: self.head] + 1)
        self.word_prior = word.reshape(self.head_classes, s.per_class).astype(np.float32)
        self.word_top = self.word_prior.max(axis=1)
        self.start = s.head + SUFFIX_BUCKETS
        self.inputs = self.start + 1
        self.end = next(i for i, (w, _) in enumerate(counted) if w == END)

    @staticmethod
    def suffix(word: bytes) -> int:
        return (word[-1] * 31 + (word[-2] if len(word) > 1 else 0)) % SUFFIX_BUCKETS

    def encode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(targets, inputs, words beyond the lookup) of a whole text with its end token; target ``n`` is a word beyond."""
        targets, inputs, _, rare = self.encode_all([raw])
        return targets, inputs, rare.to_pylist()

    def encode_all(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(targets, inputs, where each text ends, words beyond the lookup) of whole texts, one after the other, each with its end token."""
        data = pa.array(raw, pa.binary())
        # Arrow's ASCII functions take the bytes as they are: other bytes need not be UTF-8
        pieces = pc.ascii_split_whitespace(pc.ascii_lower(pa.Array.from_buffers(pa.string(), len(data), data.buffers())))
        ends, words = pieces.offsets.to_numpy()[1:], pieces.flatten()
        _, places, letters = words.buffers()
        places = np.frombuffer(places, np.int32)[: len(words) + 1]
        words = pa.Array.from_buffers(pa.binary(), len(words), words.buffers())
        filled = places[1:] > places[:-1]
        found = pc.index_in(words, value_set=self.words).fill_null(self.n).to_numpy()
        unknown = np.flatnonzero(filled & (found == self.n))
        rare = words.take(pa.array(unknown))
        given = self.input_of[found]
        if len(unknown):  # ``suffix`` of all of them
            letters = np.frombuffer(letters, np.uint8)
            last, several = places[unknown + 1] - 1, places[unknown + 1] - places[unknown] > 1
            given[unknown] = self.head + (letters[last] * np.int32(31) + np.where(several, letters[last - 1], 0)) % SUFFIX_BUCKETS
        if not filled.all():  # white space at the start or the end of a text leaves an empty piece
            ends = np.concatenate(([0], np.cumsum(filled)))[ends]
            found, given = found[filled], given[filled]
        counts = np.diff(ends, prepend=0) + 1
        ends = np.cumsum(counts)
        inner = np.ones(int(ends[-1]) if len(ends) else 0, bool)
        inner[ends - 1] = False
        targets = np.full(len(inner), self.end, np.int32)
        targets[inner] = found
        inputs = np.empty(len(inner), np.int32)
        inputs[ends - counts] = self.start
        inputs[1:][inner[:-1]] = given
        return targets, inputs, ends, rare


class Network:
    """Gated recurrent units over words; a softmax over classes, then one over a class's words.

    Weights are one flat float32 vector, so that tasks can send and average them.
    Outputs start as the unigram model: zero weights and log counts as biases.
    """

    def __init__(self, words: Words, s: Settings, flat: np.ndarray | None = None):
        self.w, self.s = words, s
        h, c, k, m = s.hidden, words.classes, words.head_classes, s.per_class
        shapes = {"x": (words.inputs, 3 * h), "u": (h, 3 * h), "vc": (h, c), "bc": (c,), "vw": (k, m, h), "bw": (k, m)}
        if flat is None:
            rng = np.random.default_rng(s.seed)
            flat = np.concatenate(
                [
                    rng.normal(0, 0.3, shapes["x"]).ravel(),
                    rng.normal(0, 0.5 / np.sqrt(h), shapes["u"]).ravel(),
                    np.zeros(h * c),
                    words.class_prior,
                    np.zeros(k * m * h),
                    words.word_prior.ravel(),
                ]
            )
        self.flat = np.array(flat, dtype=np.float32)
        self.p, self.g2, at = {}, {}, 0
        for name, shape in shapes.items():
            size = int(np.prod(shape))
            self.p[name] = self.flat[at : at + size].reshape(shape)
            at += size
        self.updates = 0

    @staticmethod
    def step(x: np.ndarray, h: np.ndarray, turned: np.ndarray, out: np.ndarray):
        """One time step for all lanes, one lane a column: the new state into ``out``; (update and reset gates, candidate, its recurrent part).

        A gate is ``(1 + tanh a) / 2``: the logistic function of 2a, with the factor left to the weights.
        """
        H = len(h)
        g = turned @ h
        inner, gates = g[2 * H :], g[: 2 * H]
        gates += x[: 2 * H]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        new = gates[H:] * inner
        new += x[2 * H :]
        np.tanh(new, out=new)
        np.subtract(h, new, out=out)
        out *= gates[:H]
        out += new
        return gates, new, inner

    def outputs(self, states: np.ndarray, targets: np.ndarray, learn: bool):
        """Without ``learn`` the natural log chance of each target (of its class, for words beyond the lookup), else the gradient of the mean loss by state; and its gradients by weight.

        Each row of ``states`` ends in a one, which meets the biases.
        """
        p, n, H, heads = self.p, len(targets), self.s.hidden, self.w.head_classes
        classes = self.w.class_of[targets]
        # in the order of the classes each class is one slice
        order = np.argsort(classes.astype(np.int8) if self.w.classes < 128 else classes, kind="stable")
        ends = np.cumsum(np.bincount(classes, minlength=self.w.classes)).tolist()
        states, targets, classes = states.take(order, axis=0), targets.take(order), classes.take(order)
        each = np.float32(1 / n)
        rows = np.arange(n)
        biases = p["bw"] - self.w.word_top[:, None]
        reach = max(float(np.abs(p["vc"]).sum(axis=0).max() + p["bc"].max()), float(np.abs(p["vw"]).sum(axis=2).max() + biases.max()))
        chance = states @ np.concatenate((p["vc"], p["bc"][None]))
        logp, grads, back = None, {}, None
        if not learn:
            logp = chance[rows, classes].astype(np.float64) + self.w.inside[targets]
        total = self._exponentials(chance, reach)
        if learn:
            chance *= (each / total)[:, None]
            chance[rows, classes] -= each
            back = chance @ p["vc"].T
            both = states.T @ chance
            grads = {"vc": both[:H], "bc": both[H]}
        else:
            logp -= np.log(total)
        # the words of all classes in one array, so that only products are taken class by class
        m = ends[heads - 1]
        slices = [(k, start, stop) for k, (start, stop) in enumerate(zip([0, *ends], ends[:heads], strict=False)) if start < stop]
        weights = np.concatenate((p["vw"], biases[:, :, None]), axis=2)
        chance = np.empty((m, self.s.per_class), np.float32)
        for k, start, stop in slices:
            np.matmul(states[start:stop], weights[k].T, out=chance[start:stop])
        rows, place = rows[:m], targets[:m] - classes[:m] * self.s.per_class
        if not learn:
            logp[:m] += chance[rows, place]
        total = self._exponentials(chance, reach)
        if learn:
            chance *= (each / total)[:, None]
            chance[rows, place] -= each
            both = np.zeros_like(weights)
            for k, start, stop in slices:
                back[start:stop] += chance[start:stop] @ p["vw"][k]
                np.matmul(chance[start:stop].T, states[start:stop], out=both[k])
            grads["vw"], grads["bw"] = np.ascontiguousarray(both[:, :, :H]), both[:, :, H].copy()
        else:
            logp[:m] -= np.log(total)
        given = np.empty_like(back if learn else logp)
        given[order] = back if learn else logp
        return given, grads

    @staticmethod
    def _exponentials(logits: np.ndarray, reach: float) -> np.ndarray:
        """Exponentiate in place; the sum of each row. States are within 1, so no logit is over ``reach``; beyond 80, float32 would overflow."""
        if reach > 80:
            np.minimum(logits, 80, out=logits)
        np.exp(logits, out=logits)
        return logits @ np.ones(logits.shape[1], np.float32)

    def learn(self, inputs: np.ndarray, targets: np.ndarray, state: np.ndarray) -> np.ndarray:
        """One truncated window, (steps, lanes): update the weights, return the carried state.

        Inside, a lane is a column: each gate is then one block of memory, in all operations.
        """
        H, (steps, lanes) = self.s.hidden, inputs.shape
        x = np.ascontiguousarray(self.p["x"].take(inputs, axis=0).transpose(0, 2, 1))
        keep = (inputs != self.w.start).astype(np.float32)
        starts = (keep == 0).any(axis=1).tolist()
        trace, states = [], np.ones((steps, H + 1, lanes), np.float32)
        h, turned = np.ascontiguousarray(state.T), np.ascontiguousarray(self.p["u"].T)
        befores = np.empty((steps, H, lanes), np.float32)
        for t in range(steps):
            before = np.multiply(h, keep[t], out=befores[t]) if starts[t] else h  # no state is carried over the start of a document
            h = states[t, :H]
            trace.append((before, *self.step(x[t], before, turned, h)))
        back, grads = self.outputs(states.transpose(0, 2, 1).reshape(-1, H + 1), targets.ravel(), True)
        back = np.ascontiguousarray(back.reshape(steps, lanes, H).transpose(0, 2, 1))
        dx, u = np.empty((3 * H, steps, lanes), np.float32), self.p["u"]
        du = np.zeros((3 * H, H), np.float32)
        dg = np.empty((3 * H, lanes), np.float32)
        carry = np.zeros((H, lanes), np.float32)
        slope, bend, move = np.empty((2 * H, lanes), np.float32), np.empty((H, lanes), np.float32), np.empty((H, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            before, gates, new, inner = trace[t]
            z, r = gates[:H], gates[H:]
            d = back[t]
            d += carry
            kept = d * z
            np.subtract(1, gates, out=slope)
            slope *= gates
            slope *= 2
            both, last = dg[: 2 * H], dg[2 * H :]
            dnew = dx[2 * H :, t]
            np.subtract(d, kept, out=dnew)
            np.multiply(new, new, out=bend)
            np.subtract(1, bend, out=bend)
            dnew *= bend
            np.subtract(before, new, out=move)
            np.multiply(d, move, out=both[:H])
            np.multiply(dnew, inner, out=both[H:])
            both *= slope
            np.multiply(dnew, r, out=last)
            dx[: 2 * H, t] = both
            du += dg @ before.T
            kept += u @ dg
            if starts[t]:
                kept *= keep[t]
            carry = kept
        del trace
        grads["u"] = np.ascontiguousarray(du.T)
        for name, g in grads.items():
            self._descend(name, g, slice(None))
        ids = inputs.ravel()
        used = np.flatnonzero(np.bincount(ids, minlength=self.w.inputs))
        number = np.empty(self.w.inputs, np.int64)
        number[used] = np.arange(len(used))
        ids = number[ids]
        sums = np.array([np.bincount(ids, weights=row, minlength=len(used)) for row in dx.reshape(3 * H, -1)])
        self._descend("x", np.ascontiguousarray(sums.T, np.float32), used)
        self.updates += 1
        return h.T

    def _descend(self, name: str, g: np.ndarray, rows) -> None:
        """An Adagrad step."""
        seen = self.g2.setdefault(name, np.full_like(self.p[name], 1e-7))
        if isinstance(rows, slice):
            seen += g * g
            g *= np.float32(self.s.rate)
            g /= np.sqrt(seen)
            self.p[name] -= g
        else:
            squares = seen[rows] + g * g
            seen[rows] = squares
            g *= np.float32(self.s.rate)
            g /= np.sqrt(squares, out=squares)
            self.p[name][rows] -= g

    def fit(self, texts: Iterator[bytes]) -> int:
        """One pass; returns the number of tokens. State is carried over the windows of a lane."""
        s, tokens = self.s, 0
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        have = 0

        def train(last: bool) -> int:
            nonlocal kept, have
            targets = np.concatenate([t for t, _ in kept])
            inputs = np.concatenate([i for _, i in kept])
            lanes = s.first_lanes if self.updates < 300 else s.lanes
            length = s.lane_tokens
            done = 0
            while len(targets) - done >= lanes * length or (last and len(targets) - done >= s.steps):
                left = len(targets) - done
                if left < lanes * length:
                    length = s.steps if left < s.steps * 8 else min(length, max(s.steps, left // 8 // s.steps * s.steps))
                    lanes = max(1, min(lanes, left // length))
                size = lanes * length
                cut_t = targets[done : done + size].reshape(lanes, length).T
                cut_i = inputs[done : done + size].reshape(lanes, length).T
                state = np.zeros((lanes, s.hidden), np.float32)
                for t in range(0, length, s.steps):
                    state = self.learn(cut_i[t : t + s.steps], cut_t[t : t + s.steps], state)
                done += size
                if not last:
                    lanes = s.first_lanes if self.updates < 300 else s.lanes
            if last and done < len(targets):  # fewer than a window: one lane of them all
                self.learn(inputs[done:, None], targets[done:, None], np.zeros((1, s.hidden), np.float32))
                done = len(targets)
            kept, have = [(targets[done:], inputs[done:])], len(targets) - done
            return done

        for raw in _grouped(texts, len):
            targets, inputs, ends, _ = self.w.encode_all(raw)
            start = 0
            for stop in ends.tolist():
                kept.append((targets[start:stop], inputs[start:stop]))
                have, start = have + stop - start, stop
                if have >= s.lanes * s.lane_tokens:
                    tokens += train(False)
        if have:
            tokens += train(True)
        return tokens

    def score(self, targets: list[np.ndarray], inputs: list[np.ndarray]) -> np.ndarray:
        """log10 chance of each whole document, words beyond the lookup by their class only.

        Every document is a lane from its first token to its last; longer ones come
        first, so the lanes still running are always the first ones.
        """
        s, H = self.s, self.s.hidden
        lengths = np.array([len(t) for t in targets])
        order = np.argsort(-lengths, kind="stable")
        ordered = lengths[order]
        # all tokens by time, then lane: the lanes running at a time are one slice
        longest = int(ordered[0]) if len(ordered) else 0
        running = np.searchsorted(-ordered, -np.arange(longest), side="left")  # lanes with a token at t
        ends = np.cumsum(running).tolist()
        starts = np.cumsum(ordered) - ordered
        times = np.arange(int(ordered.sum())) - np.repeat(starts, ordered)
        by_time = np.argsort(times.astype(np.uint16) if longest <= 1 << 16 else times, kind="stable")
        all_t = np.concatenate([targets[i] for i in order]).take(by_time)
        all_i = np.concatenate([inputs[i] for i in order]).take(by_time)
        totals = np.zeros(len(lengths))
        h, turned = np.zeros((H, len(lengths)), np.float32), np.ascontiguousarray(self.p["u"].T)
        limit = max(1, 262_144 // H)
        t, at = 0, 0
        while t < longest:
            after = min(longest, t + max(1, limit // int(running[t])))
            stop = ends[after - 1]
            x = np.ascontiguousarray(self.p["x"].take(all_i[at:stop], axis=0).T)
            states = np.ones((H + 1, stop - at), np.float32)
            place, lanes = 0, []
            for n in running[t:after].tolist():
                new = states[:H, place : place + n]
                self.step(x[:, place : place + n], h[:, :n], turned, new)
                h, place = new, place + n
                lanes.append(np.arange(n))
            h = h.copy()
            logp, _ = self.outputs(np.ascontiguousarray(states.T), all_t[at:stop], False)
            totals += np.bincount(np.concatenate(lanes), weights=logp, minlength=len(totals))
            t, at = after, stop
        out = np.empty(len(lengths))
        out[order] = totals / np.log(10)
        return out


def _grouped(items: Iterator, size: Callable) -> Iterator[list]:
    """Lists of successive items whose sizes sum to ``ENCODED_BYTES`` at most; an item of more is alone."""
    group, have = [], 0
    for item in items:
        more = size(item)
        if group and have + more > ENCODED_BYTES:
            yield group
            group, have = [], 0
        group.append(item)
        have += more
    if group:
        yield group


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        words = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([counts[w] for w in words], pa.int64())], names=["w", "n"])

    for batch in batches:
        for t in batch.column(0).cast(pa.binary()):
            counts.update((t.as_py() or b"").lower().split())
            counts[END] += 1
            if len(counts) > 300_000:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


def count_words(docs: DataFrame) -> DataFrame:
    """(w, n): every word of the text column, and the end token, with its count."""
    return docs.select("text").mapInArrow(_count_words, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def learn_words(counts: DataFrame, s: Settings) -> Words:
    """The frequent words for the tasks, at most ``s.lookup`` of bounded length, found by a histogram of counts."""
    short = F.octet_length("w") <= s.longest_word
    step = F.floor(F.log(F.col("n")) * 64)
    found = counts.groupBy(F.when(short, step).alias("b")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).collect()  # about 2000 rows at most
    least, have = None, 0
    for r in sorted((r for r in found if r["b"] is not None), key=lambda r: -r["b"]):
        have += r["words"]
        if have > s.lookup - 1:
            break
        least = r["b"]
    frequent = [] if least is None else [(bytes(r["w"]), r["n"]) for r in counts.filter(short & (step >= least)).collect()]
    if all(w != END for w, _ in frequent):
        frequent += [(END, r["n"]) for r in counts.filter(F.col("w") == F.lit(END)).collect()] or [(END, 0)]
    distinct = sum(r["words"] for r in found)
    return Words(frequent, sum(r["tokens"] for r in found), distinct, s)


COPIES = "part int, tokens long, weights binary"


def train(docs: DataFrame, words: Words, s: Settings) -> np.ndarray:
    """The weights after one pass over ``docs(id, text)``, in ``s.rounds`` parts by a hash of the id.

    In each round every task trains a copy on its rows, and the copies are averaged by their tokens in a tree:
    combining tasks sum about 32 vectors each as they stream in, level by level, until ``s.combiners`` are left for the driver.
    """
    sc = docs.sparkSession.sparkContext
    shared_words = sc.broadcast(words)
    flat = Network(words, s).flat
    for r in range(s.rounds):
        weights = sc.broadcast(flat)

        def fit(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            net = Network(shared_words.value, s, weights.value)
            tokens = net.fit(t.as_py() or b"" for batch in batches for t in batch.column(0).cast(pa.binary()))
            if tokens:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([tokens], pa.int64()), pa.array([net.flat.tobytes()], pa.binary())], names=["part", "tokens", "weights"]
                )

        def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, summed, part = 0, None, TaskContext.get().partitionId()
            for batch in batches:
                for n, w in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    mine = np.frombuffer(w.as_py(), np.float32).astype(np.float64) * n
                    summed = mine if summed is None else summed + mine
                    total += n
            if total:
                mean = (summed / total).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([total], pa.int64()), pa.array([mean], pa.binary())], names=["part", "tokens", "weights"]
                )

        mine = docs.filter(F.pmod(F.xxhash64("id", F.lit(s.seed)), F.lit(s.rounds)) == r).select("text")
        copies = mine.mapInArrow(fit, COPIES)
        parts = docs.rdd.getNumPartitions()
        while parts > 64 * s.combiners:
            parts = -(-parts // 32)
            copies = copies.repartition(parts, "part").mapInArrow(combine, COPIES)
        sums = copies.repartition(s.combiners, "part").mapInArrow(combine, COPIES).collect()
        if sums:
            total = sum(x["tokens"] for x in sums)
            flat = sum(np.frombuffer(x["weights"], np.float32).astype(np.float64) * (x["tokens"] / total) for x in sums).astype(np.float32)
    return flat


def _score(words, weights, s: Settings):
    fields = [("uid", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())]
    names = [f for f, _ in fields] + ["items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        net = Network(known, s, weights.value)
        uid = TaskContext.get().partitionId() << 40
        rows, targets, inputs, item_words, item_counts, ends, have = [], [], [], [], [], [0], 0

        def flush() -> pa.RecordBatch:
            scores = net.score(targets, inputs).tolist()
            made = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields[:6], strict=True)]
            items = pa.StructArray.from_arrays([pa.array(item_words, pa.binary()), pa.array(item_counts, pa.int32())], names=["w", "n"])
            return pa.RecordBatch.from_arrays([*made, pa.array(scores), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], names=names)

        texts = (
            (id_, held, t.as_py() or b"")
            for batch in batches
            for id_, held, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True)
        )
        for group in _grouped(texts, lambda row: len(row[2])):
            goals, givens, stops, beyond = known.encode_all([raw for *_, raw in group])
            beyond, start, first = beyond.to_pylist(), 0, 0
            after = np.cumsum(np.concatenate(([0], goals == known.n)))[stops].tolist()
            for (id_, held, _), stop, last in zip(group, stops.tolist(), after, strict=True):
                goal, counted = goals[start:stop], Counter(beyond[first:last])
                # the first item stands for the document; its key is no word
                item_words.append(b" %d" % uid)
                item_words.extend(counted)
                item_counts.append(0)
                item_counts.extend(counted.values())
                ends.append(len(item_words))
                rows.append((uid, id_, held, len(goal), int(known.seen[goal].sum()), float(known.base[goal].sum())))
                targets.append(goal)
                inputs.append(givens[start:stop])
                uid, have, start, first = uid + 1, have + len(goal), stop, last
                if have >= s.chunk_tokens:
                    yield flush()
                    rows, targets, inputs, item_words, item_counts, ends, have = [], [], [], [], [], [0], 0
        if rows:
            yield flush()

    return run


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: CRC-32 of its id as text is 2 modulo 7; a null id is not."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """One row per row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text (A-Z lower-cased, split at ASCII white space) and one
    end. Counts come from all rows that are not held out; base_score sums log10((c + 1) / (N + V + 1)).
    The network learns from the same rows, whole, in one pass, and score is its log10 chance of the whole text, with state
    carried from the first token to the last.

    The most frequent words, a fixed number, are held by every task. Other words meet their
    counts in a join; by the choice of the frequent ones no such word has a large share of the rows.
    Their part of both scores is summed per document afterwards.

    Null texts count as empty: they have the end token alone. Rows with a null id are trained on. Repeated rows each
    count and come out. Other columns are not read; an empty table gives an empty result. The weights depend on how rows are
    split into tasks, as the copies of the network are averaged; a task that is repeated gives the same copy. Documents are told apart by
    task and row, so rows must come in the same order if a task is repeated, as they do from files; ``cut`` others first.
    Without any training row no word is known and base_score is 0.
    """
    s = settings or Settings()
    bounded_batches(df.sparkSession)
    sc = df.sparkSession.sparkContext
    docs = df.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    learnt = docs.filter(~F.col("held_out"))
    counts = cut(count_words(learnt))
    words = learn_words(counts, s)
    weights = train(learnt.select("id", "text"), words, s)
    schema = "uid long, id long, held_out boolean, n_tokens long, known long, base double, model double, items array<struct<w:binary,n:int>>"
    scored = docs.mapInArrow(_score(sc.broadcast(words), sc.broadcast(weights), s), schema)
    doc = ["id", "held_out", "n_tokens", "known", "base", "model"]
    items = scored.select("uid", *doc, F.posexplode("items").alias("pos", "item"))
    first = [F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in doc]
    items = items.select("uid", *first, "item.w", "item.n")
    joined = items.join(counts.select("w", F.col("n").alias("c")), "w", "left")
    c = F.coalesce("c", F.lit(0))
    per = joined.groupBy("uid").agg(
        *[F.max(x).alias(x) for x in doc],
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known_rest"),
        F.sum(F.col("n") * F.log10((c + 1) / F.lit(float(words.base_sum)))).alias("base_rest"),
        F.sum(F.col("n") * F.log10((c + 1) / F.lit(float(words.rest_sum)))).alias("model_rest"),
    )
    return per.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("known_rest")).cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("base_rest")).alias("base_score"),
        (F.col("model") + F.col("model_rest")).alias("score"),
    )
