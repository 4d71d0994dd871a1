"""SentencePiece encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.plans import bounded_batches

MARK = "▁"
#: Stands for a mark that is in the text itself; a lone surrogate is in no valid text.
OWN_MARK = "\udc81"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
CACHE_ENTRIES = 150_000
#: Occurrences that are segmented together, about; and columns of one array while they are.
TOGETHER, COLUMNS = 1 << 16, 1 << 13
#: Units of more characters are merged one by one.
LONGEST = 48
#: Rows that are encoded before they are passed on; their ids take far more room than the texts.
ROWS = 500


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a merge-type model by id, with their scores; the 256 byte pieces and control pieces apart."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    special: frozenset[int]
    bytes_at: tuple[int, ...]
    digest: str

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a model file with byte fallback; the driver reads it, and executors get this object."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        pieces = tuple(model.id_to_piece(i) for i in range(n))
        found = {int(m[1], 16): i for i in range(n) if model.is_byte(i) and (m := BYTE_PIECE.fullmatch(pieces[i]))}
        if len(found) != 256:
            raise ValueError("a model with byte fallback is needed")
        special = frozenset(i for i in range(n) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        scores = tuple(model.get_score(i) for i in range(n))
        digest = hashlib.sha256(repr((pieces, scores)).encode("utf-8", "surrogatepass")).hexdigest()
        return cls(pieces, scores, special, tuple(found[b] for b in range(256)), digest)


MASK = (1 << 64) - 1
PLACE = (1 << 32) - 1
#: A rank behind all others: no candidate.
NEVER = 1 << 31
#: For a unit that is not remembered: no skip lies behind so many candidates.
LACKING = (b"", 1 << 62)


GOLDEN = 0x9E3779B97F4A7C15


def _mixed(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def _mixed_all(x: np.ndarray) -> np.ndarray:
    """``_mixed`` of an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Encoder:
    """Encodes and decodes texts under one vocabulary, dropout rate and seed.

    A text gets a leading space and its spaces become marks, as the model file asks. No
    piece has a mark behind another character, or a line feed, so merging goes on inside
    units: marks with what follows up to the next mark or line feed. In a unit the agenda
    holds every pair of neighbours that forms a piece, best score first, then leftmost. Each
    candidate popped off it is skipped with the chance ``dropout``, drawn anew for each
    occurrence by a keyed hash of (seed, document, place; number of the candidate in its
    agenda). The hash gives the gaps from one skip to the next, which are geometric if each
    candidate is drawn by itself. What is left and no piece becomes byte pieces.

    A unit's segmentation without a skip is remembered, with the candidates popped: it serves every
    occurrence whose first skip lies behind them. Of two generations of such units the older one is dropped when the younger is full. All other
    occurrences of many texts are segmented together, an agenda a column of an array, each step taking the best candidate of every column.
    """

    def __init__(self, vocabulary: Vocabulary, dropout: float = 0.1, seed: int = 11):
        self.v = vocabulary
        usable = [i for i in range(len(vocabulary.pieces)) if i not in vocabulary.special]
        self.by_rank = sorted(usable, key=lambda i: (-vocabulary.scores[i], i))
        self.rank = {vocabulary.pieces[i]: r for r, i in enumerate(self.by_rank)}
        self.packed = {vocabulary.pieces[i]: array("i", [i]).tobytes() for i in self.by_rank}
        self.dropout, self.seed = dropout, seed
        self.reach = self._reach(dropout)
        self.reach_all = np.array(self.reach, np.uint64)
        self.text_of = [p.replace(MARK, " ").encode() for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.bytes_at):
            self.text_of[i] = bytes([b])
        for i in vocabulary.special - set(vocabulary.bytes_at):
            self.text_of[i] = b""
        self.all_text = np.frombuffer(b"".join(self.text_of), np.uint8)
        self.lengths = np.array([len(t) for t in self.text_of], np.int32)
        self.starts = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.rank):
            raise ValueError("pieces may have marks at their front only, and no line feed")
        self.unit = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.known: dict[str, tuple[bytes, int]] = {}
        self.older: dict[str, tuple[bytes, int]] = {}
        self.room = CACHE_ENTRIES
        self._symbols()

    def _symbols(self) -> None:
        """Numbers for all parts of a unit: pieces by rank, then characters inside pieces that are no piece themselves, then one number for all other characters, which no piece has.

        ``pair_key`` and ``pair_rank`` are a hash table from two symbols to the rank of their concatenation.
        """
        symbol = dict(self.rank)
        for p in self.rank:
            for c in p:
                symbol.setdefault(c, len(symbol))
        self.unknown = len(symbol)
        self.symbol_of = np.full(0x110000, self.unknown, np.int32)
        for c, k in symbol.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = k
        self.pieces = len(self.rank)
        self.id_of = np.array(self.by_rank, np.int32)
        pairs = [(symbol[a], symbol[b], r) for p, r in self.rank.items() for i in range(1, len(p)) if (a := p[:i]) in symbol and (b := p[i:]) in symbol]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        keys = left << 32 | right
        self.bits = max(4, (4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.pair_key, self.pair_rank = np.full(size, -1, np.int64), np.full(size, NEVER, np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.pair_key[at] == -1
            self.pair_key[at[free]] = keys[free]  # of several keys for one slot the last one gets it
            placed = self.pair_key[at] == keys
            self.pair_rank[at[placed]] = rank[placed]
            keys, rank, at = keys[~placed], rank[~placed], (at[~placed] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(GOLDEN)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; ``NEVER`` where it is no piece."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        there = self.pair_key[at]
        out = self.pair_rank[at]
        other = np.flatnonzero(there != keys)
        out[other] = NEVER
        other = other[there[other] != -1]
        while len(other):  # the slot is another pair's: look at the next one
            at[other] = (at[other] + 1) & (len(self.pair_key) - 1)
            there = self.pair_key[at[other]]
            hit = there == keys[other]
            out[other[hit]] = self.pair_rank[at[other[hit]]]
            other = other[~hit & (there != -1)]
        return out

    @staticmethod
    def _reach(dropout: float) -> list[int]:
        """Ascending: the chances, of 2**64, that a gap has over k candidates, for all k where that is one at least."""
        chances, chance = [], 2.0**64
        while dropout > 0 and (chance := chance * (1 - dropout)) >= 1:
            chances.append(int(chance))
        return chances[::-1]

    def _gap(self, key: int, number: int) -> int:
        """The candidates that are kept before the ``number``-th skip under a key, since the skip before it."""
        if not self.dropout:
            return NEVER
        return len(self.reach) - bisect_right(self.reach, _mixed(key + number * GOLDEN & MASK))

    def _ids(self, parts: list[str]) -> bytes:
        """The packed ids of pieces, and of bytes where there is no piece."""
        packed = self.packed
        return b"".join([packed.get(p) or self._as_bytes(p) for p in parts])

    def _as_bytes(self, part: str) -> bytes:
        return array("i", [self.v.bytes_at[b] for b in part.replace(OWN_MARK, MARK).encode("utf-8", "surrogatepass")]).tobytes()

    def _merge_list(self, unit: str, key: int) -> list[str]:
        return self._by_list(unit, key, self._gap(key, 1))[0]

    def _merge_heap(self, unit: str, key: int) -> list[str]:
        return self._by_heap(unit, key, self._gap(key, 1))[0]

    def _by_list(self, unit: str, key: int, skip: int) -> tuple[list[str], int]:
        """The pieces of a short unit and the candidates popped, of which ``skip`` is the first skipped.

        The agenda is a list over the neighbours, searched for its least rank.
        """
        part = list(unit)
        rank = self.rank.get
        agenda = [rank(a + b, NEVER) for a, b in zip(part, part[1:], strict=False)]
        popped, number = 0, 1
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            popped += 1
            if popped > skip:
                agenda[i] = NEVER
                number += 1
                skip += 1 + self._gap(key, number)
                continue
            part[i] = both = part[i] + part[i + 1]
            del part[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank(both + part[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(part[i - 1] + both, NEVER)
        return part, popped

    def _by_heap(self, unit: str, key: int, skip: int) -> tuple[list[str], int]:
        """The same for a long unit, with a heap."""
        part: list = list(unit)
        n = len(part)
        rank = self.rank.get
        agenda = [(r << 32) | i for i in range(n - 1) if (r := rank(part[i] + part[i + 1])) is not None]
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        popped, number = 0, 1
        while agenda:
            top = heappop(agenda)
            left = top & PLACE
            if part[left] is None or (right := after[left]) >= n:
                continue
            both = part[left] + part[right]
            if rank(both) != top >> 32:
                continue  # an end has been merged meanwhile
            popped += 1
            if popped > skip:
                number += 1
                skip += 1 + self._gap(key, number)
                continue
            part[left], part[right] = both, None
            after[left] = further = after[right]
            if further < n:
                before[further] = left
                if (r := rank(both + part[further])) is not None:
                    heappush(agenda, (r << 32) | left)
            if (previous := before[left]) >= 0 and (r := rank(part[previous] + both)) is not None:
                heappush(agenda, (r << 32) | previous)
        return [p for p in part if p is not None], popped

    def _segment(self, unit: str, key: int, skip: int) -> tuple[bytes, int]:
        """The packed ids of an occurrence and the candidates popped."""
        parts, popped = (self._by_heap if len(unit) > LONGEST else self._by_list)(unit, key, skip)
        return self._ids(parts), popped

    def _columns(self, units: list[str], keys: np.ndarray, skips: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """``_segment`` of many occurrences of units of two to ``LONGEST`` characters: a column for each, a row for each character."""
        n = len(units)
        lengths = np.fromiter(map(len, units), np.int64, n)
        height, ends = int(lengths.max()), np.cumsum(lengths)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        column = np.repeat(np.arange(n), lengths)
        row = np.arange(len(points)) - np.repeat(ends - lengths, lengths)
        symbols = np.full((height, n), self.unknown, np.int64)
        symbols[row, column] = self.symbol_of[points]
        # a candidate is (rank, row of its left part), and the least one of a column comes next
        rows = np.arange(height)[:, None]
        agenda = np.full((height, n), NEVER << 6, np.int64)
        agenda[:-1] = self._ranks(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(height - 1, n) << 6 | rows[:-1]
        after = np.repeat(rows + 1, n, axis=1)
        before = np.repeat(rows - 1, n, axis=1)
        live = rows < lengths
        popped, number, skip, keys = np.zeros(n, np.int64), np.ones(n, np.uint64), skips.astype(np.int64), keys.astype(np.uint64)
        flat_symbols, flat_agenda, flat_after, flat_before, flat_live = (x.reshape(-1) for x in (symbols, agenda, after, before, live))
        going = np.arange(n)
        narrow = agenda  # the columns of ``going``
        while len(going):
            best = narrow.min(axis=0)
            more = np.flatnonzero(best < NEVER << 6)
            going, best = going[more], best[more]
            if not len(going):
                break
            popped[going] += 1
            skipped = popped[going] > skip[going]
            left = (best & 63) * n + going
            out = going[skipped]
            if len(out):
                flat_agenda[left[skipped]] = NEVER << 6
                number[out] += np.uint64(1)
                drawn = _mixed_all(keys[out] + number[out] * np.uint64(GOLDEN))
                skip[out] += 1 + len(self.reach) - np.searchsorted(self.reach_all, drawn, "right")
            merged = ~skipped
            at, left, rank = going[merged], left[merged], best[merged] >> 6
            right = flat_after[left] * n + at
            further = flat_after[right]
            flat_symbols[left] = rank  # pieces are numbered by rank
            flat_after[left] = further
            flat_live[right] = False
            flat_agenda[right] = NEVER << 6
            place = left // n
            inner = further < height
            here, further_at = left[inner], further[inner] * n + at[inner]
            flat_before[further_at] = place[inner]
            flat_agenda[left[~inner]] = NEVER << 6
            flat_agenda[here] = self._ranks(rank[inner], flat_symbols[further_at]) << 6 | place[inner]
            previous = flat_before[left]
            inner = previous >= 0
            previous, at = previous[inner], at[inner]
            previous_at = previous * n + at
            flat_agenda[previous_at] = self._ranks(flat_symbols[previous_at], rank[inner]) << 6 | previous
            narrow = agenda if len(going) > n * 0.8 else agenda[:, going]
            if narrow is agenda:
                going = np.arange(n)
        kept = live.T
        last, found = np.cumsum(kept.sum(axis=1)), symbols.T[kept]
        blob = self.id_of[np.minimum(found, self.pieces - 1)].astype("<i4").tobytes()
        stops = (last * 4).tolist()
        ids = [blob[i:j] for i, j in zip([0, *stops], stops, strict=False)]
        for k in np.unique(np.searchsorted(last, np.flatnonzero(found >= self.pieces), "right")).tolist():  # some part is no piece
            cuts = [*np.flatnonzero(kept[k]).tolist(), len(units[k])]
            ids[k] = self._ids([units[k][i:j] for i, j in zip(cuts, cuts[1:], strict=False)])
        return ids, popped

    def _settle(self, out: list[bytes], waiting: list[tuple]) -> None:
        """Put the packed ids of all waiting occurrences into ``out``; units without a skip are remembered.

        Each entry of ``waiting`` has arrays of places in ``out`` and of first skips and keys, and a list of units.
        """
        places, skips, keys = (np.concatenate([w[i] for w in waiting]) for i in range(3))
        units = [u for w in waiting for u in w[3]]
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(lengths, kind="stable")
        low, high = np.searchsorted(lengths[order], [2, LONGEST + 1]) if len(units) > 64 else (0, 0)
        alone = np.concatenate((order[:low], order[high:]))
        groups = [([units[i]], [i], [node[0]], [node[1]]) for i in alone.tolist() for node in [self._segment(units[i], int(keys[i]), int(skips[i]))]]
        for at in range(low, high, COLUMNS):
            mine = order[at : min(high, at + COLUMNS)]
            some = [units[i] for i in mine.tolist()]
            groups.append((some, mine, *self._columns(some, keys[mine], skips[mine])))
        for some, mine, found, popped in groups:
            for place, ids in zip(places[mine].tolist(), found, strict=True):
                out[place] = ids
            for k in np.flatnonzero(popped <= skips[mine]).tolist():
                unit = some[k]
                if len(unit) <= 64 and unit not in self.known:
                    self._remember(unit, (found[k], int(popped[k])))
        waiting.clear()

    def _remember(self, unit: str, node: tuple[bytes, int]) -> None:
        if self.room <= 0:
            self.older, self.known, self.room = self.known, {}, CACHE_ENTRIES
        self.known[unit] = node
        self.room -= 1

    def encode_all(self, texts: list[str], documents: list[int]) -> list[np.ndarray]:
        """The ids (int32) of whole texts."""
        out, ends, waiting, have = [], [], [], 0
        for text, document in zip(texts, documents, strict=True):
            if MARK in text:
                text = text.replace(MARK, OWN_MARK)
            units = self.unit.findall(MARK + text.replace(" ", MARK)) if text else []
            start = _mixed(_mixed(self.seed & MASK) + document & MASK)
            for low in range(0, len(units), TOGETHER):
                part = units[low : low + TOGETHER]
                keys = _mixed_all(np.arange(low + 1, low + len(part) + 1, dtype=np.uint64) * np.uint64(GOLDEN) + np.uint64(start))
                if self.dropout:
                    first = len(self.reach) - np.searchsorted(self.reach_all, _mixed_all(keys + np.uint64(GOLDEN)), "right")
                else:
                    first = np.full(len(part), NEVER)
                nodes = list(map(self.known.get, part, repeat(LACKING)))
                base = len(out)
                out.extend(map(itemgetter(0), nodes))
                behind = first >= np.fromiter(map(itemgetter(1), nodes), np.int64, len(part))
                miss = np.flatnonzero(~behind)
                if self.older:
                    for i in miss.tolist():
                        if nodes[i] is LACKING and (node := self.older.get(part[i])) is not None:
                            self._remember(part[i], node)
                            if first[i] >= node[1]:
                                out[base + i], behind[i] = node[0], True
                    miss = np.flatnonzero(~behind)
                if len(miss):
                    waiting.append((base + miss, first[miss], keys[miss], [part[i] for i in miss.tolist()]))
                    have += len(miss)
                if have >= TOGETHER:
                    self._settle(out, waiting)
                    have = 0
            ends.append(len(out))
        if waiting:
            self._settle(out, waiting)
        return [np.frombuffer(b"".join(out[i:j]), "<i4") for i, j in zip([0, *ends], ends, strict=False)]

    def encode(self, text: str, document: int = 0) -> np.ndarray:
        """The ids (int32) of a whole text."""
        return self.encode_all([text], [document])[0]

    def decode_bytes(self, ids) -> bytes:
        """The UTF-8 text of ``ids``; the leading space that encoding adds is dropped. The bytes of all pieces are gathered at once, a piece of the ids at a time."""
        ids, out = np.asarray(ids, np.int32), []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at : at + (1 << 18)]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths, dtype=np.int32)
            places = np.arange(int(ends[-1]), dtype=np.int32)
            places += np.repeat(self.starts[part] - (ends - lengths), lengths)
            out.append(self.all_text[places].tobytes())
        return b"".join(out)[1:]

    def decode(self, ids) -> str:
        """The text of ``ids``."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


#: Encoders of this process by their parameters; a Python worker keeps them from task to task.
_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(vocabulary: Vocabulary, *how) -> Encoder:
    key = (vocabulary.digest, *how)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary, *how)
    return _ENCODERS[key]


def encode_documents(
    df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1, seed: int = 11
) -> DataFrame:
    """``id_col``, ids (array of int), n_tokens, lossless (decoding gives the text back) for every whole text.

    The vocabulary is broadcast; its size is fixed by the model. Rows are encoded one by one with no shuffle, and
    the result depends on (id, text, seed) only, so a lost task repeats it. Null and empty texts have no
    ids. A null id counts as 0 in the keyed hash. Repeated rows get equal ids; other
    columns are not read; an empty table gives an empty result.
    """
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, dropout, seed)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            found = encoder.encode_all([t.decode("utf-8", "replace") for t in texts], [i or 0 for i in batch.column(0).to_pylist()])
            same = [encoder.decode_bytes(ids) == raw for ids, raw in zip(found, texts, strict=True)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, pa.array(np.diff(ends).astype(np.int64)), pa.array(same, pa.bool_())], names=["id", "ids", "n_tokens", "lossless"]
            )

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "id long, ids array<int>, n_tokens long, lossless boolean").withColumnRenamed("id", id_col)


def decode_documents(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and text for every row of ids; null or empty ids give an empty text. Repeated rows each come out; an empty table gives an empty result."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, 0.0)
        for batch in batches:
            texts = [encoder.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return docs.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
