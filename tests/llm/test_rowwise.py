"""Operators that judge rows one by one, sharding and mixing."""

import hashlib
import random
import re

import pytest
from brute import brute_base, brute_mix, brute_pii, brute_quality

from assayer.llm import lm_scoring, mixing, pii, quality, sharding, url_filter
from assayer.llm.lm_scoring import END, Network, Settings, Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", None) for i, t in rows], SCHEMA).repartition(2)


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "example.com", "/d")]


def brute_rule(host, path):
    fits = [(h.count("."), len(p), v == "block", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, "allow")


def test_url_filter_both_ways(spark):
    urls = ["https://A.Example.NET/en/x?q", "http://example.net/en", "http://x.net", "http://net/", "ftp://example.com/de/#a", "http://example.com/dx", "no scheme", None, "", "http://org/fr/", "http:///p", "http://badexample.net/q", "x://y://z.net/a"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for limit in (10, 0):
        rows = {r["page_id"]: r for r in url_filter.filter_urls(df, RULES, max_broadcast_rules=limit).collect()}
        for i, u in enumerate(urls):
            m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
            host, path = (m[1].lower(), m[2]) if m else ("", "")
            rule, verdict = brute_rule(host, path)
            assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) == (host, path, rule, verdict), u


def test_trie_prefers_block_for_one_rule_listed_twice():
    assert url_filter.UrlTrie([("allow", "a.b", "/"), ("block", "a.b", "/")]).find("a.b", "/x") == ("block", "a.b/")


def test_sharding_law_and_slots(spark):
    rows = [(i, "x" * (i % 50)) for i in range(1003)] + [(7, "same"), (7, "same"), (None, None)]
    got = sharding.shard_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(16)) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())


def test_sharding_moves_little_and_is_bounded(spark):
    df = frame(spark, [(i, "t") for i in range(4000)])
    before = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, 16, slack=0.1).collect()}
    after = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, 17, slack=0.1).collect()}
    assert max(list(before.values()).count(s) for s in range(16)) <= -(-1.1 * 4000 // 16)
    assert sum(before[i] != after[i] for i in before) < 0.2 * 4000  # a plain modulus moves about 94 %


def test_place_against_key_by_key():
    ring = sharding.Ring(4, 8)
    rng = random.Random(1)
    counts = {a: rng.randrange(30) for a in range(len(ring.points))}
    room = sharding.capacities(sum(counts.values()), 4, 0.0)
    used, expected = [0] * 4, {}
    left = dict(counts)
    for step in range(4):
        for arc in sorted(counts):
            shard = ring.order(arc)[step]
            while left[arc] and used[shard] < room[shard]:
                expected[(arc, counts[arc] - left[arc])] = shard
                left[arc], used[shard] = left[arc] - 1, used[shard] + 1
    got = {}
    segments = sharding.place(ring, counts, 0.0)
    for arc, first, shard, _ in segments:
        ends = [f for a, f, *_ in segments if a == arc and f > first]
        for k in range(first, min(ends, default=counts[arc])):
            got[(arc, k)] = shard
    assert got == expected


def test_quality_measures(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a b c", "é# ü* " * 40, "one two three four five six seven eight nine ten\n" * 3, "x" * 50000]
    texts += [" ".join(rng.choice("abcdé") for _ in range(rng.randrange(200))) for _ in range(40)]
    rows = list(enumerate(texts))
    judged = {r["doc_id"]: r for r in quality.quality_rules(frame(spark, rows)).collect()}
    for i, t in rows:
        n, *rest = brute_quality(t)
        assert (judged[i]["n_words"], judged[i]["word_chars"], judged[i]["n_symbols"], judged[i]["n_dup_lines"], judged[i]["n_repeat_words"]) == (n, *rest)
        failed = n < 10 or 100 * rest[-1] > 20 * n
        assert judged[i]["base_failed"] == failed and not (failed and judged[i]["kept"])
    kept = quality.keep_good(frame(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in judged.items() if r["kept"]}
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_pii_base_spans_follow_the_patterns():
    text = "é a.b@c.de @x y@z p@q..r 1@2.3@4.5 10.0.0.255 256.1.1.1 1.2.3.4.5 x 4111 1111 1111 1111 +1 (929) 555-1803 +12 34"
    spans = pii.base_spans(text)
    assert [(s, e) for k, s, e in spans if k == 0] == [m.span() for m in EMAIL.finditer(text)]
    assert [text[s:e] for k, s, e in spans if k == 1] == ["10.0.0.255", "1.2.3.4"]
    assert [text[s:e] for k, s, e in spans if k == 2] == ["4111 1111 1111 1111"]
    assert [text[s:e] for k, s, e in spans if k == 3] == ["+1 (929) 555-1803"]
    assert pii.base_spans("9" * 30000) == [] and pii.base_spans("a" * 30000 + "@" * 50) == []


def pii_rows():
    """Prose with identifiers in telling contexts, in idle ones, and of shapes that no seed has."""
    rng = random.Random(12)
    word = lambda: rng.choice("lorem ipsum dolor sit amet the of and with".split())
    prose = lambda n: " ".join(word() for _ in range(n))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    rows = [(i, f"{prose(5)} please call mobile +1 (929) 555-{1000 + i} now or later {prose(3)}") for i in range(30)]
    rows += [(100 + i, f'{prose(4)} token = "{hexa(40)}" {prose(4)}') for i in range(20)]
    rows += [(200 + i, f"{prose(4)} mail to user{i}@host.example please {prose(2)} 10.0.0.{i} {prose(3)}") for i in range(12)]
    rows += [(300, "please call mobile (929) 555-9999 now or later"), (301, "chapter 12 of 2020 has (123) 456-7890 pages"), (302, None), (303, "")]
    rows += [(304, f'{prose(3)} token = "live_9f3k-unseen7" {prose(3)}'), (305, "the mobile 17 now"), (306, f"the {hexa(40)} and of"), (307, "please call mobile x77-1234 now and token = secret")]
    rows += [(308, f"{prose(200)} 1.2.3.4 " * 30 + "a@b.example, call mobile 0171 555 12 34 now"), (309, "(929) 555-9999 again"), (310, "mail to tom@server please")]
    return rows


def test_pii_against_brute_force(spark):
    rows = pii_rows()
    got = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, rows)).collect()}
    for how in ({"max_broadcast": 0}, {"max_patterns": 0}):
        other = pii.find_personal_data(frame(spark, rows), **how).collect()
        assert {r["doc_id"]: (r["spans"], r["secrets"]) for r in other} == {i: (r["spans"], r["secrets"]) for i, r in got.items()}
    spans = brute_pii(rows)
    for i, t in rows:
        base = brute_base(t or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(b[0] == n for b in base) for n in range(4)]
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        found = [x for x in spans[i].split(",") if x]
        assert got[i]["spans"] == ",".join(x for x in found if not x.startswith("secret")), i
        assert got[i]["secrets"] == ",".join(x for x in found if x.startswith("secret")), i
        assert got[i]["n_discovered"] == got[i]["spans"].count(":") // 2 - len(base)


def test_pii_unrelated_rows_remove_nothing(spark):
    """Eight seeds are enough, however many seeds of other kinds and places the table has."""
    rng = random.Random(21)
    rows = [(i, f"please call mobile +1 (929) 555-{1000 + i} now") for i in range(8)] + [(50, "please call mobile (929) 555-9999 now")]
    noise = [(1000 + i, f"w{rng.randrange(10**6)} {rng.randrange(256)}.{i % 256}.{i // 256 % 256}.7 w{rng.randrange(10**6)}") for i in range(20_000)]
    few, many = ({r["doc_id"]: r["spans"] for r in pii.find_personal_data(frame(spark, x)).collect()} for x in (rows, rows + noise))
    assert few[50] == "phone:19:33" and {i: many[i] for i, _ in rows} == few


def test_pii_discovers_the_unseen_and_leaves_the_rest(spark):
    rows = dict(pii_rows())
    got = {r["doc_id"]: [rows[r["doc_id"]][int(s):int(e)] for _, s, e in (x.split(":") for x in f"{r['spans']},{r['secrets']}".split(",") if x)] for r in pii.find_personal_data(frame(spark, pii_rows())).collect()}
    assert got[300] == ["(929) 555-9999"] == got[309] and got[304] == ["live_9f3k-unseen7"] and got[307] == ["x77-1234"] and got[310] == ["tom@server"]
    assert got[301] == got[302] == got[303] == got[306] == []
    assert all(len(got[100 + i]) == 1 and len(got[100 + i][0]) == 40 for i in range(20))


def test_mixing_budgets_and_prefixes(spark):
    rows = [(i, " ".join(["w"] * (i % 9))) for i in range(300)] + [(500, None), (501, "")]
    df = frame(spark, rows)
    got = mixing.mix_sources(df, {"source": {"src0": 5}}, share=0.6, max_epochs=2).collect()
    assert len(got) == len(rows)
    leaves = {}
    for r in got:
        leaves.setdefault((r["domain"], r["lang"], r["source"]), []).append(r)
    total = sum(r["n_tokens"] for r in got)
    for leaf in leaves.values():
        taken = sum(r["n_tokens"] * r["copies"] for r in leaf)
        assert taken <= leaf[0]["budget"] < taken + 9 + 1
    assert abs(sum(leaf[0]["budget"] for leaf in leaves.values()) - int(total * 0.6)) <= 6
    assert mixing.take_mixed(df, {}, share=1.0).count() == len(rows)


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 2), (2.0, 2), (0.9, 1), (1.0, 1)])
def test_mixing_against_a_plain_walk(spark, share, epochs):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    weights = {"domain": {"d0": 4, "d1": 0}, "lang": {"en": 3}, "source": {"s2": 2}}
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30])), rng.choice(["d0", "d0", "d1", "d2"]), rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s3"])) for i in range(400)]
    rows += [(1000, None, "d3", "en", "s9"), (1001, "", "d0", "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string").repartition(3)
    got = sorted((tuple(r) for r in mixing.mix_sources(df, weights, share, epochs, domain=F.col("domain")).collect()), key=str)
    assert got == brute_mix(rows, weights, share, epochs)
    if epochs == 1:
        taken = sorted(r["doc_id"] for r in mixing.take_mixed(df, weights, share, domain=F.col("domain")).collect())
        assert taken == sorted(g[0] for g in got if g[-1])


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 100), ("b", "x", "s3", 100)], "domain string, lang string, source string, tokens long")
    budgets = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, {}, 0.5, 1).collect()}
    assert budgets == {"s1": 10, "s2": 42, "s3": 52}


def test_network_is_the_unigram_model_before_and_better_after_training():
    rng = random.Random(0)
    docs = [" ".join(rng.choice(lang) for _ in range(60)).encode() for lang in ([f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]) * 60]
    counts = {}
    for d in docs:
        for w in [*d.split(), END]:
            counts[w] = counts.get(w, 0) + 1
    s = Settings(head=128, per_class=16, hidden=8, first_lanes=8, lanes=8, lane_tokens=64, lookup=1000)
    words = Words(list(counts.items()), sum(counts.values()), len(counts), s)
    net = Network(words, s)
    encoded = [words.encode(d) for d in docs]
    unigram = sum(words.base[t].sum() for t, *_ in encoded)
    score = lambda: net.score([t for t, *_ in encoded], [i for _, i, _ in encoded])
    assert score().sum() == pytest.approx(unigram, rel=1e-3)
    net.fit(iter(docs * 4))
    assert score().sum() > unigram + 0.1 * len(docs) * 60
    alone = net.score([encoded[3][0]], [encoded[3][1]])[0]
    assert alone == pytest.approx(score()[3], abs=1e-3)


def test_every_token_is_trained():
    docs = [b"a b c d e"] * 2
    counts = {w: 2 for w in (b"a", b"b", b"c", b"d", b"e", END)}
    for n in (1, 2):
        s = Settings(head=8, per_class=4, hidden=4)
        net = Network(Words(list(counts.items()), 12, 6, s), s)
        assert net.fit(iter(docs[:n])) == 6 * n and net.updates == 1
        assert (net.p["vc"] != 0).any()


def test_lm_without_training_rows(spark):
    held = [i for i in range(60) if __import__("zlib").crc32(str(i).encode()) % 7 == 2]
    rows = [(i, "three words here") for i in held]
    for r in lm_scoring.score_documents(frame(spark, rows)).collect():
        assert r["held_out"] and (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (4, 0, 0, 0.0)


def test_lm_base_score(spark):
    import math
    import zlib

    rows = [(i, f"the cat {'sat' if i % 2 else 'ran'} on Mat{i % 5}") for i in range(40)] + [(100, None), (101, ""), (7, "dog"), (None, "the unseen")]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").lower().split(), "\n"]
    counts = {}
    for i, t in rows:
        if not held(i):
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for settings in (Settings(), Settings(lookup=4, head=2, per_class=2), Settings(longest_word=2)):
        got = sorted(map(tuple, lm_scoring.score_documents(frame(spark, rows), settings=settings).collect()), key=str)
        expected = []
        for i, t in rows:
            w = tokens(t)
            expected.append((i, held(i), len(w), sum(x in counts for x in w), n, sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)))
        expected.sort(key=str)
        assert [g[:5] for g in got] == [e[:5] for e in expected]
        assert [g[5] for g in got] == pytest.approx([e[5] for e in expected])
        assert all(g[6] < 0 for g in got)


@pytest.mark.parametrize("operator", [quality.quality_rules, pii.find_personal_data, sharding.shard_documents, lm_scoring.score_documents, lambda df: mixing.mix_sources(df, {})])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


def test_mentions_of_a_text_with_many_base_spans():
    rng = random.Random(4)
    parts = ["call +49 30 1234567", "mail joe (at) example dot com", "10.0.0.1", "a@b.example", "room 12", "030 1234 5678", "fe80:1:2:3:4:5:6:7", "word"]
    for n in (5, 900):
        text = " ".join(rng.choice(parts) for _ in range(n))
        base, found = pii.mentions(text)
        assert base == brute_base(text)
        taken = [(s, e) for _, s, e in base]
        free = lambda m: all(e <= m.start() or s >= m.end() for s, e in taken)
        want = [(k, s, e, True) for k, s, e in base]
        for kind, shape in pii.LOOSE.items():
            new = [m for m in shape.finditer(text) if pii._loose_fits(kind, m[0]) and free(m)]
            want += [(kind, m.start(), m.end(), False) for m in new]
            taken += [(m.start(), m.end()) for m in new]
        assert found == want
    assert len(base) > 200 and {m[0] for m in found if not m[3]} >= {0, 1, 3}


def test_evidence_is_of_whole_values_and_words():
    a, b = ("x" * 250 + f"@{c}.example" for c in "ab")
    assert pii._instance(0, a) != pii._instance(0, b)  # not one prefix

    def around(text):
        _, found = pii.mentions(text)
        names, places = pii.units(text, found)
        return pii.patterns_at(names, next(i for i, p in enumerate(places) if p[2] == 0))

    assert around("left" + " " * 90 + "near" + " " * 90 + "10.0.0.1" + " " * 90 + "Right, " + "y" * 99) == ("L near", "LL left near", "R right", "B near right")
    assert around("p" * 99 + " 10.0.0.1 " + "q" * 99) == (f"L {'p' * 99}", f"LL ^ {'p' * 99}", f"R {'q' * 99}", f"B {'p' * 99} {'q' * 99}")
    assert around("ip:10.0.0.1;port") == ("L ip", "LL ^ ip", "R port", "B ip port")
    assert around("a@b.example +49 30 1234567") == ("L ^", "LL ^ ^", "R <phone>", "B ^ <phone>")


def test_units_read_without_offsets_are_the_same():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("aB \n\t.,\"('éß=-#") for _ in range(60))
        names, _ = pii.units(text, [])
        assert names == [pii._short(x) for w in text.lower().translate(pii.BLANKS).split(" ") if (x := w.strip(pii.EDGE))]
