"""Whole-text tokenising and rolling hashes on numpy arrays (64-bit, modulo 2**64)."""

from __future__ import annotations

import numpy as np

#: ASCII white space: x20 and x09 to x0D. ``bytes.split()`` splits at the same bytes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Power tables up to this length are kept by the process; longer ones, for longer texts, go with the text.
KEPT_POWERS = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of each at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = n if n > KEPT_POWERS else 1 << max(12, (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        have = (made[0], made[1])
        if n <= KEPT_POWERS:
            _POWERS[base] = have
    return have


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the words of a text in UTF-8."""
    data = np.frombuffer(raw, np.uint8)
    space = SPACE[data]
    edge = np.ones(len(data) + 2, bool)
    edge[1:-1] = space
    turn = edge[1:] != edge[:-1]
    at = np.flatnonzero(turn)
    return data, at[0::2], at[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes. A long text is taken in pieces between words, so memory stays small."""
    if len(data) < KEPT_POWERS or not len(starts):
        return _word_hashes(data, starts, ends)
    found, at = [], 0
    while at < len(starts):
        low = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, low + KEPT_POWERS - 1, side="right")))
        found.append(_word_hashes(data[low : int(ends[end - 1])], starts[at:end] - low, ends[at:end] - low))
        at = end
    return np.concatenate(found)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers(BYTE_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Grams:
    """Rolling hashes of n-grams of any length over one sequence of hashes."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        power, self.inverse = _powers(WORD_BASE, self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * power[: self.n], out=self.sums[1:])

    def of(self, width: int) -> np.ndarray:
        """The hash of the n-gram that starts at each place."""
        if self.n < width:
            return np.zeros(0, np.uint64)
        return _mixed((self.sums[width:] - self.sums[:-width]) * self.inverse[: self.n - width + 1])


def repeated(hashes: np.ndarray) -> np.ndarray | None:
    """Flags of the values that occur twice or more; None if all differ."""
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return None
    at = np.searchsorted(twice, hashes)
    at[at == len(twice)] = 0
    return twice[at] == hashes


def covered(flags: np.ndarray, width: int, n: int) -> np.ndarray:
    """Flags of the n words that lie in a flagged window of ``width`` words."""
    steps = np.zeros(n + 1, np.int64)
    steps[: len(flags)] += flags
    steps[width : width + len(flags)] -= flags
    return np.cumsum(steps[:-1]) > 0


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, by block prefixes and suffixes."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    before = np.minimum.accumulate(square, axis=1).ravel()
    after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])
