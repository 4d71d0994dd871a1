"""Exact, near and substring deduplication against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import brute_near, brute_shingles

from assayer.llm import exact_dedup, graph, near_copies, simhash, substring_dedup
from assayer.llm.text_hash import covered, repeated, sliding_min

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", None) for i, t in rows], SCHEMA).repartition(3)


def words(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    shared, long_ = words(rng, 80), words(rng, 6000)
    rows = [(i, words(rng, rng.randrange(0, 150))) for i in range(40)]
    rows += [(100 + i, f"{words(rng, 30)} {shared} {words(rng, 20)}") for i in range(12)]
    rows += [(200 + i, long_) for i in range(3)] + [(210, long_[: len(long_) // 2]), (211, "a " * 400), (212, "a " * 300)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "ünï ␣ " * 60), (303, "ünï ␣ " * 60), (None, shared), (304, shared.upper())]
    return rows


def brute_substrings(rows, window=50):
    def tokens(t):
        return (t or "").encode().split()

    first = {}
    for i, t in rows:
        w = tokens(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None and (key not in first or first[key] > i):
                first[key] = i
    out = []
    for i, t in rows:
        w = tokens(t)
        gone = set()
        for k in range(len(w) - window + 1):
            low = first.get(tuple(w[k : k + window]))
            if i is not None and low is not None and low < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [500, 3])
def test_substrings_match_brute_force(spark, corpus, crowd):
    found = substring_dedup.dedup_substrings(frame(spark, corpus), crowd=crowd)
    got = sorted((tuple(r)[:4] for r in found.collect()), key=str)
    assert got == brute_substrings(corpus)


def test_kept_texts(spark):
    rng = random.Random(1)
    shared = words(rng, 60)
    df = frame(spark, [(1, f"x {shared} y"), (2, f"p {shared} q r")])
    texts = dict(substring_dedup.kept_texts(df, substring_dedup.dedup_substrings(df)).collect())
    assert texts == {1: f"x {shared} y", 2: "p q r"}


def test_automaton_statistics():
    automaton = substring_dedup.SuffixAutomaton()
    automaton.add([1, 2, 3, 1, 2, 4])
    automaton.add([9, 2, 4, 4])
    assert list(automaton.matching_statistics([1, 2, 4, 4, 7, 3, 1])) == [1, 2, 3, 3, 0, 1, 2]


def test_word_hashes_of_long_texts_are_those_of_pieces(monkeypatch):
    from assayer.llm import text_hash

    raw = b"alpha  beta " + b"x" * 5000 + b" gamma\n" + b"some more words here " * 400
    whole = text_hash.word_hashes(*text_hash.word_bounds(raw))
    monkeypatch.setattr(text_hash, "KEPT_POWERS", 64)
    assert (text_hash.word_hashes(*text_hash.word_bounds(raw)) == whole).all()


def test_shard_knows_the_smallest_id():
    a, b = np.arange(10), np.array([50, 3, 4, 5, 6, 51])
    shard = substring_dedup.Shard([(7, a), (3, b)], 3)
    assert list(shard.repeats(9, [2, 3, 4, 5, 6, 7, 8, 60])) == [0, 1, 2, 3, 4]
    assert list(shard.repeats(5, [2, 3, 4, 5, 6, 7, 8, 60])) == [1, 2]  # 3 4 5 and 4 5 6 stand under id 3
    assert list(shard.repeats(3, [3, 4, 5])) == []


def test_hot_windows_stream_past_the_shards(spark):
    rng = random.Random(6)
    passage, other = words(rng, 70), words(rng, 55)
    rows = [(i, f"{words(rng, rng.randrange(40))} {passage} {words(rng, 9)} {other if i % 2 else ''}") for i in range(40)]
    rows += [(50, None), (None, passage), (3, f"{passage} {passage}"), (60, passage.upper()), (61, passage)]
    got = sorted((tuple(r)[:4] for r in substring_dedup.dedup_substrings(frame(spark, rows), crowd=10).collect()), key=str)
    assert got == brute_substrings(rows)


def test_sliding_min_and_flags():
    values = np.random.default_rng(3).integers(0, 1000, 257).astype(np.uint64)
    assert sliding_min(values, 26).tolist() == [values[i : i + 26].min() for i in range(257 - 25)]
    assert repeated(np.array([5, 7, 5, 9], np.uint64)).tolist() == [True, False, True, False]
    assert repeated(np.array([1, 2], np.uint64)) is None
    assert covered(np.array([True, False, False]), 2, 4).tolist() == [True, True, False, False]


def test_exact_against_brute_force(spark, corpus):
    for keep, best in (("max", max), ("min", min)):
        groups = {}
        for i, t in corpus:
            groups.setdefault(t or "", []).append(i)
        expected = []
        for i, t in corpus:
            ids = [x for x in groups[t or ""] if x is not None]
            top = best(ids) if ids else None
            expected.append((i, top, len(groups[t or ""]), i == top, hashlib.sha256((t or "").encode()).hexdigest()))
        for small in (exact_dedup.SMALL, 0):
            got = [tuple(r) for r in exact_dedup.exact_dedup(frame(spark, corpus), keep=keep, small=small).collect()]
            assert sorted(got, key=str) == sorted(expected, key=str)


def test_drop_copies_keeps_columns_and_one_of_each(spark, corpus):
    kept = exact_dedup.drop_copies(frame(spark, corpus))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = kept.collect()
    assert len(rows) == len({t or "" for _, t in corpus})


def test_collisions_are_split_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "_hash", lambda text: F.unhex(F.md5(F.substring(text, 1, 1))))
    df = frame(spark, [(1, "aa"), (2, "ab"), (3, "aa"), (4, "b")])
    got = sorted(tuple(r)[:4] for r in exact_dedup.exact_dedup(df).collect())
    assert got == [(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False), (4, 4, 1, True)]
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(df).collect()) == [1, 2, 4]


def brute_fingerprint(text, width=3):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, words(rng, 120, 50)) for i in range(60)]
    for i in range(60):
        w = rows[i][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "one two"), (303, "One  two"), (303, "One  two"), (304, "x " * 5000)]
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    expected = sorted((i, f"{prints[k]:016x}", least[root(k)]) for k, (i, _) in enumerate(rows))
    for cap in (64, 1):
        got = sorted(tuple(r) for r in simhash.simhash_groups(frame(spark, rows), bucket_cap=cap).collect())
        assert got == expected


def test_near_groups_against_brute_force(spark):
    rng = random.Random(3)

    def changed(t, n):
        w = t.split()
        for k in rng.sample(range(len(w)), n):
            w[k] = f"c{rng.randrange(10**6)}"
        return " ".join(w)

    base = [words(rng, 200) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + 30 * i + k, changed(t, k)) for i, t in enumerate(base) for k in (1, 2, 20)]  # far from the threshold, where SimHashes may tell either way
    crowd = words(rng, 300)
    rows += [(1000 + k, changed(crowd, 1 + k % 3)) for k in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "a b"), (2004, "A  b"), (2005, "a c"), (None, base[0]), (5, base[5]), (7, "x " * 4000)]
    expected = sorted(((i, g) for (i, _), g in zip(rows, brute_near(rows), strict=True)), key=str)
    for cap in (64, 2):
        got = near_copies.near_groups(frame(spark, rows), bucket_cap=cap).select("doc_id", "component_id")
        assert sorted(map(tuple, got.collect()), key=str) == expected
    # keys of 28 bits on more bits, as for large tables
    got = near_copies.near_groups(frame(spark, rows[:60]), bits=4096, chain=7).select("doc_id", "component_id")
    few = brute_near(rows[:60])
    assert sorted(map(tuple, got.collect())) == sorted((i, g) for (i, _), g in zip(rows[:60], few, strict=True))
    kept = near_copies.drop_near_copies(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, g in expected if i == g)


def test_fingerprint_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    one = frame(spark, [(1, "Uno due tre")]).select(F.xxhash64(F.lit("uno due tre")).alias("h")).collect()[0]["h"]
    assert simhash.fingerprints(frame(spark, [(1, "Uno due tre")])).collect()[0]["fp"] == one


def test_similar_fingerprints_find_all_pairs(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base for _ in range(3)]
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert {tuple(r) for r in simhash.similar_fingerprints(fps).collect()} == expected


def variants(rng, text, n, changes):
    """Texts with single words changed far apart, so that each change takes five shingles away."""
    w = text.split()
    rows = []
    for _ in range(n):
        new = list(w)
        at = rng.sample(range(3, len(w) - 3, 6), changes)
        for k in at:
            new[k] = f"v{rng.randrange(10**9)}"
        rows.append(" ".join(new))
    return rows


@pytest.mark.parametrize("n", [150, 1500])
def test_variants_of_a_template_are_one_group_however_many(spark, n):
    """Pairs of variants are far below the similarity: only the template links them, at 0.815."""
    rng = random.Random(n)
    template = words(rng, 200)
    rows = [(1, template)] + [(10 + i, t) for i, t in enumerate(variants(rng, template, n, 4))] + [(10**6 + i, words(rng, 200)) for i in range(50)]
    shared = brute_shingles(template) & brute_shingles(rows[1][1])
    assert 0.8 <= len(shared) / len(brute_shingles(template) | brute_shingles(rows[1][1])) < 0.83
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(frame(spark, rows)).collect()}
    found = sum(got[10 + i] == 1 for i in range(n)) / n
    assert found >= 0.9, found
    assert all(got[i] == i for i in got if i >= 10**6)


def test_texts_that_only_share_a_frame_stay_apart(spark):
    """A crowded bucket alone links nothing: these share two thirds of their words, and are below the similarity."""
    rng = random.Random(12)
    head = words(rng, 140)
    rows = [(i, f"{head} {words(rng, 60)}") for i in range(200)]
    copies = [(1000 + i, t.replace(t.split()[-2], "other")) for i, t in rows[:20]]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(frame(spark, rows + copies)).collect()}
    assert all(got[i] == i for i, _ in rows) and all(got[i] == i - 1000 for i, _ in copies)


def test_crowded_buckets_lose_no_link_of_all_pairs(spark, monkeypatch):
    """Texts that share seven tenths of their words fill the buckets; near copies of some, close to the threshold, are grouped as without a cap."""
    rng = random.Random(21)
    head = words(rng, 140, 10**6)
    rows = [(i, f"{head} {words(rng, 60, 10**6)}") for i in range(700)]
    rows += [(1000 + i, variants(rng, t, 1, 4)[0]) for i, t in rows[:300]]
    groups = lambda **how: {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(frame(spark, rows), **how).collect()}
    whole = groups(bucket_cap=10_000)
    assert sum(whole[1000 + i] == i for i in range(300)) >= 280
    monkeypatch.setattr(near_copies, "BLOCK", 16)  # several cells a bucket
    capped = groups()
    lost = [i for i, g in whole.items() if capped[i] != capped[g]]
    assert not lost, lost
    assert all(capped[1000 + i] in (i, 1000 + i) for i in range(300)) and all(capped[i] == i for i in range(700))


def test_parities_exclude_no_link_and_most_others():
    rng = np.random.default_rng(8)
    for n in (1, 17, 80, 600, 5000):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for changed in (0, 1, n // 20, n // 9, n // 4):
            other = np.concatenate([base[changed:], rng.integers(0, 1 << 63, changed).astype(np.uint64)])
            bits = int(np.bitwise_count(near_copies.parities(base) ^ near_copies.parities(other)).sum())
            assert bits <= 2 * changed
            if 80 <= n <= 600 and changed == n // 4:  # a similarity of 0.6
                assert bits > near_copies._apart(0.8) * 2 * n


def test_pairs_of_a_shared_frame_are_not_fetched(spark, monkeypatch):
    """Texts that share seven tenths of their words are within the bits of a link, and no link: few of their pairs reach the sets of shingles."""
    rng = random.Random(22)
    head = words(rng, 140, 10**6)
    rows = [(i, f"{head} {words(rng, 60, 10**6)}") for i in range(300)]
    seen, linked = [], near_copies._linked
    monkeypatch.setattr(near_copies, "_linked", lambda near, *more: (seen.append(near.count()), linked(near, *more))[1])
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(frame(spark, rows)).collect()}
    assert all(got[i] == i for i in got) and sum(seen) <= 10, seen


def test_few_links_stay_in_few_partitions(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40, 2)], "a long, b long").repartition(8)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # as for tables that Spark does not coalesce by itself
    try:
        labels = graph.components(links)
    finally:
        spark.conf.unset(coalesce)
    assert labels.rdd.getNumPartitions() == 1
    assert {tuple(r) for r in labels.collect()} == {(i, i - i % 2) for i in range(40)}


def test_crowded_buckets_stream_through(spark):
    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 12, 400))
    ahead = rng.integers(0, 1 << 62, 400)
    order = np.lexsort((ahead, key))
    key, ahead, node = key[order], ahead[order], np.arange(400)
    table = pa.Table.from_arrays([pa.array(key), pa.array(ahead), pa.array(node)], names=["key", "ahead", "node"])
    for cap in (8, 33, 1000):
        whole = None
        for size in (400, 7, 1):
            out = pa.Table.from_batches(near_copies._meet(cap, [64] * 8)(iter(table.to_batches(max_chunksize=size)))).to_pylist()
            got = sorted(str(sorted(r.items())) for r in out)
            whole = whole or got
            assert got == whole
        members = [r["a"] for r in out if r["b"] is None]
        sizes = np.bincount(key)
        assert sorted(members) == [n for n in range(400) if sizes[key[n]] > cap]
        pairs = sum(int(x) * (int(x) - 1) // 2 if x <= cap else int(x) - 1 for x in sizes if x)
        assert len(out) - len(members) == pairs


def test_short_sets_link_as_all_pairs_would(spark):
    rng = np.random.default_rng(4)
    pool = rng.integers(-(1 << 62), 1 << 62, 40)
    sets = {}
    for i in range(250):
        base = set(pool[(i % 5) * 8 : (i % 5) * 8 + 8 + i % 9].tolist())
        for _ in range(rng.integers(0, 4)):
            base.symmetric_difference_update({int(rng.choice(pool))})
        if base:
            sets[i] = base
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, short array<long>")
    labels = {r["node"]: r["label"] for r in graph.components(near_copies._short_links(df, 0.8)).collect()}
    assert {i: labels.get(i, i) for i in sets} == group and len(set(group.values())) < len(group)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    labels = {r["node"]: r["label"] for r in graph.components(links).collect()}
    assert all(labels[i] == 0 for i in range(41)) and labels[101] == 100


@pytest.mark.parametrize("operator", [exact_dedup.exact_dedup, exact_dedup.drop_copies, simhash.simhash_groups, near_copies.near_groups, near_copies.drop_near_copies, substring_dedup.dedup_substrings])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []
