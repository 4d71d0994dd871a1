"""Word alignment of two texts by exact words and stems, and the score built on it."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.stem import stem
from assayer.operators import similarity as sim
from assayer.plans import bounded_batches


class Aligned(NamedTuple):
    """Pairs (first place, second place), and how many chunks they form: runs that are next to each other in both texts."""

    pairs: list[tuple[int, int]]
    chunks: int


def count_chunks(pairs: list[tuple[int, int]]) -> int:
    ordered = sorted((b, a) for a, b in pairs)
    return sum(k == 0 or (b, a) != (ordered[k - 1][0] + 1, ordered[k - 1][1] + 1) for k, (b, a) in enumerate(ordered))


def align_words(first: list[str], second: list[str], beam: int = 40) -> Aligned:
    """The alignment of most words, among these of fewest chunks, among these of the least distance between the places.

    Words match if they are equal or have the same stem, so the number of matches of a stem is the smaller of its counts in both texts: a place of the second text may be left out
    only while enough of its stem's places remain. A beam over the second text keeps the ``beam`` best partial alignments; paths that have taken the same words and end
    at the same place go on alike, so only the better one is kept. Equal texts are aligned place by place.
    """
    if first == second:
        return Aligned([(k, k) for k in range(len(first))], 1 if first else 0)
    a, b = [stem(w) for w in first], [stem(w) for w in second]
    where: dict[str, list[int]] = defaultdict(list)
    for k, s in enumerate(a):
        where[s].append(k)
    left_over = {s: n - min(n, len(where.get(s, ()))) for s, n in Counter(b).items()}  # places of the second text that stay without a match
    ahead: dict[str, int] = Counter(b)
    # a partial alignment: (-matches, chunks, distance), places taken, the place behind the last match (-1 behind a gap), and its pairs as a chain from the last one back
    paths = [((0, 0, 0), 0, -1, None)]
    for j, s in enumerate(b):
        ahead[s] -= 1
        places = where.get(s)
        if not places:
            if any(end != -1 for _, _, end, _ in paths):
                paths = list(_best((cost, taken, -1, chain) for cost, taken, _, chain in paths))
            continue
        new = []
        for cost, taken, end, chain in paths:
            matched, chunks, far = cost
            free = 0
            for i in places:
                if not taken >> i & 1:
                    free += 1
                    new.append(((matched - 1, chunks + (i != end), far + abs(i - j)), taken | 1 << i, i + 1, (chain, i, j)))
            if not free or (left_over[s] and free <= ahead[s]):
                new.append((cost, taken, -1, chain))
        paths = list(_best(new)) if len(new) > 1 else new
        if len(paths) > beam:
            paths.sort(key=lambda p: p[0])
            last = paths[beam - 1][0]
            if paths[beam][0] == last:  # only here does the order of the pairs tell who stays
                tied = sorted((p for p in paths if p[0] == last), key=lambda p: _pairs(p[3]))
                paths = [p for p in paths if p[0] < last] + tied
            del paths[beam:]
    least = min(p[0] for p in paths)
    tied = [p for p in paths if p[0] == least]
    top = tied[0] if len(tied) == 1 else min(tied, key=lambda p: _pairs(p[3]))
    return Aligned(_pairs(top[3]), least[1])


def _pairs(chain: tuple | None) -> list[tuple[int, int]]:
    found = []
    while chain:
        chain, i, j = chain
        found.append((i, j))
    return found[::-1]


def _best(paths: Iterable[tuple]) -> Iterable[tuple]:
    """Of paths that have taken the same places and end at the same one, that of least cost; of equal ones that of the least pairs, which are only then written out."""
    best: dict[tuple[int, int], tuple] = {}
    for p in paths:
        old = best.setdefault((p[1], p[2]), p)
        if old is not p and (p[0] < old[0] or p[0] == old[0] and _pairs(p[3]) < _pairs(old[3])):
            best[p[1], p[2]] = p
    return best.values()


COUNTS = ["n1", "n2", "functions1", "functions2", "matched", "matched_functions1", "matched_functions2", "exact", "chunks"]


def alignment_counts(pairs: DataFrame, keys: list[str], first: str, second: str, function_words: list[str], beam: int = 40) -> DataFrame:
    """keys and counts of words, of function words, of matches and of chunks, for pairs of word arrays; each pair is aligned by itself in its task.

    Words are taken in lower case. Null arrays count as empty.
    """
    bounded_batches(pairs.sparkSession)
    stop = frozenset(function_words)
    fields = [pairs.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True):
                x, y = ([w.lower() for w in ws or ()] for ws in (x, y))
                found = align_words(x, y, beam)
                of = [sum(w in stop for w in ws) for ws in (x, y, [x[i] for i, _ in found.pairs], [y[j] for _, j in found.pairs])]
                rows.append((len(x), len(y), *of[:2], len(found.pairs), *of[2:], sum(x[i] == y[j] for i, j in found.pairs), found.chunks))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], names=[*keys, *COUNTS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} long" for c in COUNTS)])
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is given is kept: the rows are few bytes and much work
    return pairs.select(*keys, first, second).repartition(tasks, *keys).mapInArrow(run, schema)


def meteor_score(counts: DataFrame) -> Column:
    """The score of rows of ``alignment_counts``: the second text is judged against the first."""
    c = lambda name: counts[name]
    share = lambda side: sim.weighted_share(c("matched") - c(f"matched_functions{side}"), c(f"matched_functions{side}"), c(f"n{side}") - c(f"functions{side}"), c(f"functions{side}"))
    whole = (c("chunks") == 1) & (c("matched") == c("n1")) & (c("matched") == c("n2"))
    return sim.meteor(share(2), share(1), c("chunks").cast("double"), c("matched").cast("double"), F.coalesce(whole, F.lit(False)))
