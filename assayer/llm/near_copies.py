"""Near copies at a Jaccard similarity over word shingles: wide SimHash, pigeonring filtering, Hamming check, exact check."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain as chained
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.graph import components
from assayer.llm.text_hash import Grams, _mixed, word_bounds, word_hashes
from assayer.plans import bounded_batches, broadcast_if_small, cut, fresh_names, join_counted, packed

#: Bits of a segment of the ring; keys and budgets are in segments. Keys start at every second one, a byte.
SEGMENT = 4
#: Segments behind a key that are held against their budgets, two by two, before a pair is formed.
AHEAD = 16
#: Texts of up to so many shingles are also compared by the shingles themselves: a SimHash of few shingles is coarse.
SHORT = 16
#: Hubs of a crowded bucket, and hubs that a member of crowded buckets is held against.
HUBS = 4
#: Bits of a set's parities.
PARITIES = 1024
#: Nodes that are broadcast, at most, and rows with a set each in a partition.
FEW, WIDE = 200_000, 1000
#: Members of crowded buckets that are compared in one cell: so many against so many, about.
BLOCK = 2048


def shingles(raw: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles of ``width`` words (A-Z lower-cased); one of all words if they are fewer."""
    data, starts, ends = word_bounds(raw.lower())
    if not len(starts):
        return np.zeros(0, np.uint64)
    return np.unique(Grams(word_hashes(data, starts, ends)).of(min(width, len(starts))))


def wide_fingerprint(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The SimHash (bytes) of a set of 64-bit hashes, each stretched to ``bits`` by mixing it with constants."""
    salts = _mixed(np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), 255):  # so many ones fit into a byte
        words = _mixed(hashes[at : at + 255, None] ^ salts[None, :])
        ones += np.add.reduce(np.unpackbits(words.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes))


def parities(hashes: np.ndarray) -> np.ndarray:
    """``PARITIES`` bits (bytes): whether a set has an odd number of hashes in each of so many bins. Each hash that only one of two sets has turns one bit, so the sets differ in at least as many hashes as bits."""
    counts = np.bincount((_mixed(hashes) >> np.uint64(32)) % np.uint64(PARITIES), minlength=PARITIES)
    return np.packbits((counts & 1).astype(np.uint8))


def hamming_limit(similarity: float, bits: int, deviations: float = 0) -> int:
    """The bits in which SimHashes of two sets of that Jaccard similarity differ, and so many standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def _mark(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py() or b"", width) for t in batch.column(2).cast(pa.binary())]
            made = [wide_fingerprint(h, bits) for h in sets]
            flat = np.concatenate(made) if made else np.zeros(0, np.uint8)
            prints = pa.FixedSizeListArray.from_arrays(pa.array(flat.view("<i8")), bits // 64).cast(pa.list_(pa.int64()))
            short = [h.view(np.int64) if 0 < len(h) <= SHORT else () for h in sets]
            odd = np.concatenate([parities(h) for h in sets]) if sets else np.zeros(0, np.uint8)
            odds = pa.FixedSizeListArray.from_arrays(pa.array(odd.view("<i8")), PARITIES // 64).cast(pa.list_(pa.int64()))
            size = pa.array([len(h) for h in sets], pa.int32())
            columns = [batch.column(0), batch.column(1), prints, pa.array(short, pa.list_(pa.int64())), odds, size]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "fp", "short", "odd", "size"])

    return run


def _keys(bits: int, chain: int):
    """For every place of the ring a key (the place and the next ``chain`` segments) and the ``AHEAD`` segments behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, odd = bits // 8, chain % 2
        size = chain // 2 + odd  # bytes that a key touches
        places = np.arange(n, dtype=np.int64)[None, :] << (SEGMENT * chain)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                ring = batch.column(1).flatten().to_numpy().astype("<i8").view(np.uint8).reshape(batch.num_rows, n)
                ring = np.concatenate([ring, ring[:, : size + 8]], axis=1)
                key = np.zeros((batch.num_rows, n), np.int64)
                for k in range(size):
                    key = key << 8 | ring[:, k : k + n]
                ahead = np.zeros((batch.num_rows, n), np.uint64)
                if odd:
                    ahead |= key.astype(np.uint64) & np.uint64(15)
                    key >>= 4
                for k in range(size, size + 8 - odd):
                    ahead = ahead << np.uint64(8) | ring[:, k : k + n]
                if odd:
                    ahead = ahead << np.uint64(4) | (ring[:, size + 7 : size + 7 + n] >> 4)
                node = np.repeat(batch.column(0).to_numpy(), n)
                yield pa.RecordBatch.from_arrays([pa.array((key | places).ravel()), pa.array(ahead.ravel().view(np.int64)), pa.array(node)], names=["key", "ahead", "node"])

    return run


def _within(x: np.ndarray, budgets: list[int]) -> np.ndarray:
    """Whether every prefix of whole bytes of the differing bits keeps its budget."""
    fits = np.ones(len(x), bool)
    for k, budget in enumerate(budgets, 1):
        fits &= np.bitwise_count(x >> np.uint64(64 - 8 * k)) <= budget
    return fits


def _meet(cap: int, budgets: list[int], shift: int = 0, every: int = 1):
    """Rows sorted by (key, ahead, node): the pairs (a, b) inside buckets of up to ``cap``. Larger ones give each member as (key, a, null), and at every
    ``every``-th place (the key's bits from ``shift`` on) the pairs of members that lie beside each other in the order of the bits behind the key. Buckets stream through, whatever their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        crowd: int | None = None  # the key of a crowded bucket that goes on
        for batch in chained(batches, [None]):
            key, ahead, node = held if batch is None else (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True))
            pairs, many = [], []
            held = [key, ahead, node]
            if len(key):
                starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
                sizes = np.diff(np.concatenate((starts, [len(key)])))
                crowded = sizes > cap
                goes_on = crowd is not None and int(key[0]) == crowd
                if goes_on:  # its last row is here again, for its neighbour
                    crowded[0] = True
                whole = np.ones(len(starts), bool)
                crowd = None
                if batch is not None:
                    if crowded[-1]:
                        crowd = int(key[-1])
                        held = [x[-1:] for x in (key, ahead, node)]
                    else:
                        whole[-1] = False
                        held = [x[int(starts[-1]) :] for x in (key, ahead, node)]
                else:
                    held = [np.zeros(0, np.int64)] * 3
                big = np.repeat(whole & crowded, sizes)
                if big.any():
                    beside = np.flatnonzero(big[1:] & (key[1:] == key[:-1]) & ((key[1:] >> shift) % every == 0))
                    beside = beside[_within((ahead[beside] ^ ahead[beside + 1]).view(np.uint64), budgets)]
                    pairs.append((key[beside], node[beside], node[beside + 1]))
                    if goes_on:
                        big[0] = False
                    many.append((key[big], node[big]))
                few = np.repeat(whole & ~crowded & (sizes > 1), sizes)
                key, ahead, node = key[few], ahead[few], node[few]
                for apart in range(1, min(cap, len(key))):
                    same = np.flatnonzero(key[apart:] == key[:-apart])
                    if not len(same):
                        break
                    same = same[_within((ahead[same] ^ ahead[same + apart]).view(np.uint64), budgets)]
                    pairs.append((key[same], node[same], node[same + apart]))
            columns = [np.concatenate(c) for c in zip(*pairs, strict=True)] if pairs else [np.zeros(0, np.int64)] * 3
            more = [np.concatenate(c) for c in zip(*many, strict=True)] if many else [np.zeros(0, np.int64)] * 2
            none = np.concatenate([np.zeros(len(columns[0]), bool), np.ones(len(more[0]), bool)])
            if len(none):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([columns[0], more[0]])),
                        pa.array(np.concatenate([columns[1], more[1]])),
                        pa.array(np.concatenate([columns[2], more[1]]), mask=none),
                    ],
                    names=["key", "a", "b"],
                )

    return run


def _hub_pairs(members: DataFrame, total: int, shift: int) -> DataFrame:
    """(a, b): a hub, and a member, of the ``total`` (key, node) of crowded buckets, that is held against it; ``HUBS`` at most for each member.

    A node's degree is the number of crowded buckets it is in. A text that many others were made from agrees with most of them at every place and so has the highest degree. The hubs of
    a bucket are its nodes of the highest degree in each of ``HUBS`` shares of the nodes by hash; a member is held against the best hub that it meets in each of ``HUBS`` shares of
    the places (the key's bits from ``shift`` on). These are aggregations with partial sums, and a key of many members is broadcast to them (``join_counted``), so no bucket meets in one task.
    """
    degree = members.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    rows = cut(packed(members.join(degree, "node"), total))
    best = [F.max(F.when(F.pmod("node", F.lit(HUBS)) == k, F.struct("degree", "node"))) for k in range(HUBS)]
    hubs = cut(packed(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array(*best).alias("hubs")), total))
    met = join_counted(rows.select("key", "node"), hubs, "key", "n", small=20_000)
    other = F.array_max(F.filter("hubs", lambda h: h["node"] != F.col("node")))
    share = F.pmod(F.shiftright("key", shift), F.lit(HUBS))
    mine = met.groupBy("node").agg(*[F.max(F.when(share == k, other)).alias(f"h{k}") for k in range(HUBS)])
    few = F.array_distinct(F.array_compact(F.array(*[F.col(f"h{k}.node") for k in range(HUBS)])))
    return mine.select(F.explode(few).alias("a"), F.col("node").alias("b"))


def _apart(similarity: float) -> float:
    """The share of the hashes of two sets of that Jaccard similarity, each set's counted, that only one of them has."""
    return (1 - similarity) / (1 + similarity)


def _compare(limit: int, similarity: float):
    """Rows sorted by (key, i, j), a cell each, with (left, node, label, size, bits: fp and odd): (a, b) of each left row and each other row of its cell of another label within
    ``limit`` differing bits whose parities leave the similarity possible. Cells are bounded, so a task holds a batch and a cell."""
    apart = _apart(similarity)

    def cell(left: np.ndarray, node: np.ndarray, label: np.ndarray, size: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
        mine, others = np.flatnonzero(left), np.flatnonzero(~left)
        found = []
        prints, odd = np.ascontiguousarray(words[others, : -PARITIES // 64].T), words[:, -PARITIES // 64 :]
        for at in range(0, len(mine), 256):
            rows = mine[at : at + 256]
            differ = np.zeros((len(rows), len(others)), np.uint16)
            for k, column in enumerate(prints):
                differ += np.bitwise_count(words[rows, k, None] ^ column[None, :])
            r, c = np.nonzero((differ <= limit) & (label[rows, None] != label[None, others]))
            r, c = rows[r], others[c]
            fits = np.zeros(len(r), bool)
            for k in range(0, len(r), 1 << 14):
                x, y = r[k : k + (1 << 14)], c[k : k + (1 << 14)]
                fits[k : k + (1 << 14)] = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1, dtype=np.int64) <= apart * (size[x] + size[y]) + 1e-6
            found.append((node[r[fits]], node[c[fits]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in chained(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:7]] + [batch.column(7).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)]
                held = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if held is None:
                continue
            key, i, j, left, node, label, size, words = held
            starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [len(key)]))
            if batch is not None:
                starts = starts[:-1]
            held = [x[int(starts[-1]) :] for x in held] if batch is not None else None
            found = [cell(left[a:b], node[a:b], label[a:b], size[a:b], words[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True) if left[a:b].any() and not left[a:b].all()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])

    return run


def _rest_pairs(members: DataFrame, rows: int, prints: DataFrame, labels: DataFrame, limit: int, similarity: float) -> DataFrame | None:
    """(a, b): pairs within ``limit`` bits whose parities leave the similarity possible and that have no common label yet, all that meet in a crowded bucket of the ``rows`` members (key, node) among them; None if no bucket has several labels.

    A bucket's members of other labels than its most frequent one are few as a rule. These are held against all nodes of that label in crowded buckets, once, in however many buckets they meet it, and
    against each other in each bucket. Both are cut into cells of about ``BLOCK`` by ``BLOCK``, dealt by hash, so no bucket and no label meets in one task, and only pairs within ``limit`` come out. A bucket of one
    label has no cell. Where a crowd has no links the work is quadratic in its size; the memory is not.
    """
    named = cut(packed(members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), rows))
    per = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    several = per.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    several = cut(packed(several.select("key", "n", F.col("top.label").alias("top")), rows))
    if several.isEmpty():
        return None
    few = cut(packed(join_counted(named, several, "key", "n", small=20_000).filter("label <> top").select("key", "node", "label", "top"), rows))
    met = cut(packed(few.select(F.xxhash64(F.lit(0), "top").alias("key"), "node", "label", "top").distinct(), rows))
    tops = packed(met.groupBy("key", "top").agg(F.count(F.lit(1)).alias("n")), rows)
    nodes = cut(packed(named.select("node", "label").distinct(), rows))
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    wanted = cut(packed(tops.select("key", F.col("top").alias("label")).join(sizes, "label"), rows))
    tops = join_counted(nodes, wanted, "label", "n", small=20_000).select("key", "node", "label")
    among = few.select(F.xxhash64(F.lit(1), "key").alias("key"), "node", "label")
    left, right = met.select("key", "node", "label").unionByName(among), tops.unionByName(among)
    sided = cut(packed(left.withColumn("left", F.lit(True)).unionByName(right.withColumn("left", F.lit(False))), 4 * rows))
    count = lambda side: F.count(F.when(side, 1))
    shares = sided.groupBy("key").agg(count(F.col("left")).alias("lefts"), count(~F.col("left")).alias("rights"), F.count(F.lit(1)).alias("n"), F.min("label").alias("least"), F.max("label").alias("most"))
    shares = cut(packed(shares.filter("least <> most").drop("least", "most"), rows))
    held = join_counted(sided, shares, "key", "n", small=20_000).join(prints.select("node", "size", F.concat("fp", "odd").alias("bits")), "node")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    dealt = lambda n: F.array(F.pmod(F.xxhash64(F.lit(2), "node"), blocks(n)).cast("int"))
    each = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    cells = held.withColumn("i", F.explode(F.when(F.col("left"), dealt("lefts")).otherwise(each("lefts"))))
    cells = cells.withColumn("j", F.explode(F.when(F.col("left"), each("rights")).otherwise(dealt("rights")))).select("key", "i", "j", "left", "node", "label", "size", "bits")
    found = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare(limit, similarity), "a long, b long")
    return cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def common_parts(hashes: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """(keys, numbers left out) of the parts of a set that a set of that similarity may have in common with it: all but few of its hashes.

    Two sets have the similarity exactly if some part of both has a key in common and the numbers they leave out of it sum to (1 / similarity - 1) of its size at most.
    """
    values, n = [int(x) for x in hashes], len(hashes)
    total, keys, out = sum(values), [], []
    for left in range(int(n * (1 - similarity) + 1e-9) + 1):
        for some in combinations(values, left):
            keys.append((total - sum(some) + (n - left) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
            out.append(left)
    return keys, out


def _parts(similarity: float):
    """(key, node, left, size) for each part of a short set that may be common to another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lefts, rows, sizes = [], [], [], []
            for k, x in enumerate(batch.column(1)):
                mine, left = common_parts(x.values.to_numpy().view(np.uint64), similarity)
                keys += mine
                lefts += left
                rows += [k] * len(mine)
                sizes += [len(x) - y for y in left]
            node = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), node, pa.array(lefts, pa.int32()), pa.array(sizes, pa.int32())], names=["key", "node", "left", "size"])

    return run


def _short_links(short: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of short sets (node, short) with the components that all links would have.

    In a group of sets that share a part, whatever two may be linked are also linked to the one that leaves out least; so each is linked to that one only.
    """
    parts = cut(short.mapInArrow(_parts(similarity), "key long, node long, left int, size int"))
    total = parts.count()
    parts = packed(parts, total)
    least = parts.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("left", "node")).alias("least")).filter("n > 1")
    least = cut(packed(least.select(F.xxhash64("key", "size").alias("part"), "n", F.col("least.node").alias("a"), F.col("least.left").alias("other")), total))
    met = join_counted(parts.withColumn("part", F.xxhash64("key", "size")), least, "part", "n", small=20_000).filter("node <> a")
    fits = F.col("left") + F.col("other") <= F.lit(1 / similarity - 1) * F.col("size") + 1e-9
    return met.filter(fits).select("a", F.col("node").alias("b"))


def _fetch(pairs: DataFrame, total: int, table: DataFrame, what: str) -> DataFrame:
    """The ``total`` ``pairs(a, b)`` with column ``what`` of ``table(node, what)`` for both as u and v; a node may be in many pairs. Up to ``FEW`` nodes are sent to the table, which stays where it is."""
    given = pairs
    for side, name in (("a", "u"), ("b", "v")):
        n = cut(packed(given.groupBy(F.col(side).alias("node")).agg(F.count(F.lit(1)).alias("n")), total))
        right = table.join(broadcast_if_small(n, FEW), "node").select(F.col("node").alias(side), F.col(what).alias(name), "n")
        right = cut(packed(right, total, WIDE))
        pairs = join_counted(pairs, right, side, "n", "inner", 2000, 2000).drop("n")
    return pairs


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t.as_py() or b"", width).view(np.int64) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "set"])

    return run


def _linked(near: DataFrame, docs: DataFrame, prints: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs ``near`` (a, b) whose sets of shingles have the similarity."""
    total = near.count()
    nodes = cut(packed(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * total))
    chosen = cut(packed(prints.join(broadcast_if_small(nodes, FEW), "node").select("node", "th"), 2 * total))
    texts = docs.join(broadcast_if_small(chosen, 500_000), "th").dropDuplicates(["node"]).select("node", "text")
    sets = cut(packed(texts, 2 * total, WIDE).mapInArrow(_sets(width), "node long, set array<long>"))
    shared = F.size(F.array_intersect("u", "v"))
    return packed(_fetch(near, total, sets, "set"), total, WIDE).filter(shared >= F.lit(similarity) * (F.size("u") + F.size("v") - shared) - 1e-9).select("a", "b")


def near_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    bits: int = 1024,
    chain: int = 5,
    bucket_cap: int = 8,
    beside_every: int = 16,
) -> DataFrame:
    """One row per row of ``df``: id, th (XXH64 of the text) and component_id, the smallest id linked over near copies.

    Near copies have a Jaccard similarity of ``similarity`` or more between their sets of shingles of ``width`` words (A-Z lower-cased, split at ASCII
    white space; fewer words are one shingle; all texts without words are near copies). Every link has been checked on the sets of shingles.

    1. Each text gets a SimHash of ``bits`` bits of its distinct shingles. Equal ones meet before any pair is made.
    2. Pigeonring filter. The bits are a ring of m 4-bit segments, and d (``hamming_limit``, with two standard deviations) differing bits are allowed on the whole
       ring, so d / m on a segment. Two texts meet if from some byte of the ring a chain of ``chain`` segments is equal. They are a candidate
       pair if the longer chains, up to 16 segments more, keep their budgets of l * d / m bits.
    3. A bucket of over ``bucket_cap`` fingerprints does not make all its pairs at once: each member is first held against a few hubs (``_hub_pairs``) and against
       its neighbours in the order of the bits behind the key, the latter at every ``beside_every``-th place. Its pairs grow with its members, and are few for each.
    4. Candidate pairs are linked if they are within d bits on the whole ring and their sets of shingles have the similarity exactly. Sets are fetched only where the parities of
       their shingles leave the similarity possible (``parities``, a bound that excludes no link).
    5. The rest of a crowded bucket's pairs: those whose texts are not in one group by then are all compared (``_rest_pairs``). So the cap loses no link between groups: groups are those of all pairs that meet.
    6. Texts of up to 16 shingles also meet by the parts that sets of that similarity have in common (``common_parts``), exactly.

    The equal chain is met by chance: at a similarity of 0.8, 15 % of the bits differ, and a chain of 20 bits is equal at one of the 128
    bytes of 1024 bits with a chance of about 0.97, and the chance grows with the similarity. ``bits`` and ``chain`` are the same whatever the number of rows; for
    over some ten million different texts 4096 and 7 (28 bits) have about the same chance and 64 times fewer meetings by accident, at four times the keys.

    Null texts count as empty. Null ids never are the smallest unless there are no others. Repeated rows each come out. Other
    columns are not read; an empty table gives an empty result. Ids are integers.
    """
    bounded_batches(df.sparkSession)
    limit = hamming_limit(similarity, bits, 2)
    budgets = [(chain + k) * limit * SEGMENT // bits for k in range(2, AHEAD + 1, 2)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    marked = cut(docs.mapInArrow(_mark(width, bits), "id long, th long, fp array<long>, short array<long>, odd array<long>, size int").withColumn("node", F.xxhash64("fp")))
    one = marked.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"), F.any_value(F.struct("fp", "short", "th", "odd", "size")).alias("one"))
    prints = cut(one.select("node", "least", "rows", "one.*"))
    keyed = prints.select("node", "fp").mapInArrow(_keys(bits, chain), "key long, ahead long, node long")
    spread = keyed.repartition("key").sortWithinPartitions("key", "ahead", "node")
    met = cut(spread.mapInArrow(_meet(bucket_cap, budgets, SEGMENT * chain, beside_every), "key long, a long, b long"))

    held = met.agg(F.count(F.when(F.col("b").isNull(), 1)), F.count("b")).collect()[0]
    members, most = held[0], held[1] + HUBS * held[0]
    crowded = cut(packed(met.filter("b is null").select("key", F.col("a").alias("node")), members))
    hub_pairs = _hub_pairs(crowded, members, SEGMENT * chain)
    pairs = met.filter("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut(packed(packed(pairs, held[1]).unionByName(hub_pairs).distinct(), most))
    differ = lambda c: F.aggregate(F.zip_with(f"u.{c}", f"v.{c}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    possible = differ("odd") <= F.lit(_apart(similarity)) * (F.col("u.size") + F.col("v.size")) + 1e-6
    sketches = prints.select("node", F.struct("fp", "odd", "size").alias("sketch"))
    near = cut(packed(_fetch(pairs, most, sketches, "sketch"), most, 5 * WIDE).filter((differ("fp") <= limit) & possible).select("a", "b"))
    short = _short_links(prints.filter(F.size("short") > 0).select("node", "short"), similarity)
    links = cut(_linked(near, docs, prints, width, similarity).unionByName(short))
    linked = links.count()
    links = cut(packed(_thinned(packed(packed(links, linked).distinct(), linked)), 2 * linked))
    labels = components(links)
    rest = _rest_pairs(crowded, members, prints, labels, limit, similarity)
    if rest is not None and not rest.isEmpty():
        more = cut(_linked(rest, docs, prints, width, similarity))
        if not more.isEmpty():
            labels = components(cut(_thinned(links.unionByName(more).distinct())))

    member = prints.join(broadcast_if_small(labels, FEW), "node", "left").select("node", "least", "rows", F.coalesce("label", "node").alias("label"))
    smallest = member.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = cut(join_counted(member, cut(smallest), "label", "n").select("node", "component_id", "rows"))
    return join_counted(marked.select("id", "th", "node"), named, "node", "rows").select(F.col("id").alias(id_col), "th", "component_id")


def _thinned(links: DataFrame) -> DataFrame:
    """Links with the same components, about one a node: a node met under many least ones keeps the least of these, and that is linked to the others, which are few in all."""
    least = F.min("a").over(Window.partitionBy("b"))
    marked = links.withColumn("least", least)
    own = marked.select(F.col("least").alias("a"), "b")
    others = marked.filter(F.col("least") != F.col("a")).select(F.col("least").alias("a"), F.col("a").alias("b"))
    return own.unionByName(others).distinct()


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = 500_000, **how) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their group of near copies (``near_groups``), with all columns.

    Up to ``small`` rows to drop are broadcast, so that no text moves. Of repeated rows all stay, for they are one
    document; deduplicate exactly first. Nulls, empty texts and tables as there; columns of any name are carried through.
    """
    i, th = fresh_names(df, "id", "th")
    groups = near_groups(df, id_col, text_col, **how)
    late = groups.filter(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("l_id"), F.col("th").alias("l_th")).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.withColumns({i: F.col(id_col).cast("long"), th: F.xxhash64(text)})
    l_id, l_th = fresh_names(rows, "l_id", "l_th")
    late = cut(late).toDF(l_id, l_th)
    same = F.col(f"`{i}`").eqNullSafe(F.col(f"`{l_id}`")) & (F.col(f"`{th}`") == F.col(f"`{l_th}`"))
    return rows.join(broadcast_if_small(late, small), same, "left_anti").drop(i, th)
