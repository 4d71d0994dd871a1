"""SentencePiece round trips, and the pipeline against a plain version of itself."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from brute import brute_kept, brute_mix, brute_near

from assayer.llm import queries, sentencepiece

pytestmark = pytest.mark.skipif(not os.path.exists(queries.PIECE_MODEL), reason="no model file")
TEXTS = ["", " ", "  a  b ", "\n\n x\n", "日本 語 ▁ ok", "Ünï cödé, thea.\tend ", "word " * 300, "x" * 3000, "\u0000\x7f", "👍🏽 fine"]


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece.Vocabulary.load(queries.PIECE_MODEL)


def test_without_dropout_equals_the_library(vocabulary):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    encoder = sentencepiece.Encoder(vocabulary, 0.0)
    for t in TEXTS:
        if "▁" not in t:  # the library takes the mark for a space
            assert encoder.encode(t).tolist() == model.encode(t), t


def test_dropout_is_lossless_seeded_and_varied(vocabulary):
    encoder = sentencepiece.Encoder(vocabulary, 0.3)
    other = sentencepiece.Encoder(vocabulary, 0.3, seed=99)
    for t in TEXTS:
        ids = encoder.encode(t, 5)
        assert encoder.decode(ids) == t
        assert ids.tolist() == sentencepiece.Encoder(vocabulary, 0.3).encode(t, 5).tolist()
    text = "segmentations differ from place to place " * 5
    assert encoder.encode(text, 1).tolist() != other.encode(text, 1).tolist()
    assert len({tuple(encoder.encode(text, d).tolist()) for d in range(8)}) > 1


def test_both_agendas_agree(vocabulary):
    encoder, rng = sentencepiece.Encoder(vocabulary, 0.2), random.Random(1)
    for _ in range(500):
        unit = "▁" + "".join(rng.choice("aeinstrthéçouxWk,.-") for _ in range(rng.randrange(1, 30)))
        key = rng.getrandbits(32)
        assert encoder._merge_list(unit, key) == encoder._merge_heap(unit, key)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_columns_equal_one_by_one(vocabulary, dropout):
    encoder, rng = sentencepiece.Encoder(vocabulary, dropout), random.Random(4)
    units, skips, keys = [], [], []
    for _ in range(1500):
        units.append("▁" + "".join(rng.choice("aeinstrthéçouxWk,.-1日\udc81👍\u0000") for _ in range(rng.randrange(1, sentencepiece.LONGEST))))
        keys.append(rng.getrandbits(64))
        skips.append(encoder._gap(keys[-1], 1))
    units += ["▁" * 48, "x" * 48, "the", "▁the"]
    keys += [1, 2, 3, 4]
    skips += [encoder._gap(k, 1) for k in (1, 2, 3, 4)]
    ids, popped = encoder._columns(units, np.array(keys, np.uint64), np.array(skips, np.int64))
    assert list(zip(ids, popped.tolist())) == [encoder._segment(*x) for x in zip(units, keys, skips)]


def test_many_texts_together_equal_each_alone(vocabulary, monkeypatch):
    rng = random.Random(5)
    texts = [*TEXTS, *(" ".join(rng.choice(["the", "tokens", "▁", "naïve", "x" * 70, "42,"]) for _ in range(rng.randrange(400))) for _ in range(12))]
    ids = list(range(len(texts)))
    alone = [sentencepiece.Encoder(vocabulary, 0.2).encode(t, i).tolist() for t, i in zip(texts, ids)]
    assert [x.tolist() for x in sentencepiece.Encoder(vocabulary, 0.2).encode_all(texts, ids)] == alone
    monkeypatch.setattr(sentencepiece, "TOGETHER", 50)
    monkeypatch.setattr(sentencepiece, "COLUMNS", 7)
    monkeypatch.setattr(sentencepiece, "CACHE_ENTRIES", 3)
    assert [x.tolist() for x in sentencepiece.Encoder(vocabulary, 0.2).encode_all(texts, ids)] == alone


def test_small_caches_change_nothing(vocabulary, monkeypatch):
    text = "many different words make the remembered ones go away, again and again"
    whole = sentencepiece.Encoder(vocabulary, 0.2).encode(text, 3).tolist()
    monkeypatch.setattr(sentencepiece, "CACHE_ENTRIES", 3)
    assert sentencepiece.Encoder(vocabulary, 0.2).encode(text, 3).tolist() == whole


def _independent_draws(rank, unit, dropout, rng):
    """Merge-dropout by the book: every pair of neighbours is skipped or merged by a draw of its own."""
    part, skipped = [(i, c) for i, c in enumerate(unit)], set()
    while True:
        pairs = [(rank[a + b], i, a, b) for (i, a), (_, b) in zip(part, part[1:]) if a + b in rank and (i, a, b) not in skipped]
        if not pairs:
            return tuple(p for _, p in part)
        _, i, a, b = min(pairs)
        if rng.random() < dropout:
            skipped.add((i, a, b))
        else:
            at = next(k for k, (j, _) in enumerate(part) if j == i)
            part[at : at + 2] = [(i, a + b)]


def test_every_occurrence_is_drawn_by_itself(vocabulary):
    n, rng = 4000, random.Random(2)
    for dropout in (0.1, 0.4):
        encoder = sentencepiece.Encoder(vocabulary, dropout)
        got = Counter(tuple(encoder.encode("international", d).tolist()) for d in range(n))
        want = Counter(_independent_draws(encoder.rank, "▁international", dropout, rng) for _ in range(n))
        want = Counter({tuple(encoder.by_rank[encoder.rank[p]] for p in parts): c for parts, c in want.items()})
        assert len(got) > 10  # a fixed set of segmentations has few
        assert all(abs(got[x] - want[x]) < 0.04 * n for x in got | want)
        line = encoder.encode("\n".join(["international"] * 200)).tolist()
        assert encoder.decode(line) == "\n".join(["international"] * 200)


def test_documents_encode_and_decode(spark, vocabulary):
    rows = [*enumerate(TEXTS), (50, None), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    encoded = sentencepiece.encode_documents(df, vocabulary)
    assert all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in encoded.collect())
    decoded = {r["doc_id"]: r["text"] for r in sentencepiece.decode_documents(encoded, vocabulary).collect()}
    assert decoded == {i: t or "" for i, t in rows}
    assert sentencepiece.encode_documents(df.limit(0), vocabulary).collect() == []


def test_pipeline_against_plain_python(spark, tmp_path, vocabulary):
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))

    def changed(t, n):
        w = t.split()
        for k in rng.sample(range(len(w)), n):
            w[k] = "changed"
        return " ".join(w)

    rows = [(i, text(rng.randrange(5, 90))) for i in range(60)] + [(70 + i, text(150)) for i in range(20)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(200 + i, rows[20 + i][1] + " tail") for i in range(10)] + [(300, "spam spam " * 50), (301, None)]
    rows += [(400 + i, changed(rows[60 + i][1], 1 + i % 3)) for i in range(20)] + [(500 + i, changed(rows[60 + i][1], 12)) for i in range(20)]
    full = [(i, t, ("en", "de")[i % 2], f"src{i % 5}", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    encoded = corpus_pipeline.run(spark, str(tmp_path))
    got = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}

    left = [r for r in full if brute_kept(r[1])]
    left = [r for r in left if r[0] == min(x[0] for x in left if x[1] == r[1])]
    groups = brute_near([r[:2] for r in left])
    left = [r for r, g in zip(left, groups, strict=True) if r[0] == g]
    domain = lambda source: f"d{int(source[3:]) % 4}"
    mixed = brute_mix([(i, t, domain(s), lang, s) for i, t, lang, s, _ in left], queries.MIX_WEIGHTS, queries.MIX_SHARE, 1)
    taken = {r[0] for r in mixed if r[-1]}
    texts = {r[0]: r[1] for r in left}
    assert set(got) == taken and 300 not in got and 0 < len(got) < len(left)
    encoder = sentencepiece.Encoder(vocabulary, 0.1, 11)
    assert all(encoder.decode(ids) == texts[i] and ids == encoder.encode(texts[i], i).tolist() for i, ids in got.items())
    assert sum(400 <= r[0] < 420 for r in left) < 3 and sum(500 <= r[0] for r in left) == 20
