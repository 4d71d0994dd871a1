"""Rows and columns at the edges, for every operator that carries tables through and for each stage."""

import pytest

from assayer.llm import exact_dedup, mixing, near_copies, pii, quality, sharding, simhash, substring_dedup

CLASHES = "h id t th node keep_id group_size collided l_id l_th row key bucket leaf copies upto domain n_tokens judged_text kept _row_h _stay_id _taken_id".split()
ROWS = [(1, "some words that are here for this test of ten words"), (1, "some words that are here for this test of ten words"), (2, None), (3, ""), (None, "other words that are here too for the test with more"), (None, None)]
ROWS += [(4, "an entirely different line of words that nobody has written before"), (5, " \n\t "), (6, "x" * 1_000_000), (7, "w " * 300_000 + "end")]


def frame(spark):
    rows = [(i, t, "en", "src1", None, *(f"{c}-{n}" for c in CLASHES)) for n, (i, t) in enumerate(ROWS)]
    schema = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{c}` string" for c in CLASHES)])
    return spark.createDataFrame(rows, schema).repartition(3)


CARRIERS = {
    "quality": quality.keep_good,
    "exact": exact_dedup.drop_copies,
    "exact, shuffled": lambda df: exact_dedup.drop_copies(df, small=0),
    "near": near_copies.drop_near_copies,
    "mix": lambda df: mixing.take_mixed(df, {}, share=0.9),
}


@pytest.mark.parametrize("name", CARRIERS)
def test_other_columns_come_through(spark, name):
    df = frame(spark)
    given = {tuple(r) for r in df.collect()}
    kept = CARRIERS[name](df)
    assert kept.columns == df.columns
    rows = [tuple(r) for r in kept.collect()]
    assert rows and set(rows) <= given
    assert CARRIERS[name](df.limit(0)).collect() == []


@pytest.mark.parametrize("operator", [quality.quality_rules, exact_dedup.exact_dedup, near_copies.near_groups, simhash.simhash_groups, substring_dedup.dedup_substrings, pii.find_personal_data, sharding.shard_documents, lambda df: mixing.mix_sources(df, {})])
def test_every_row_comes_out_once(spark, operator):
    df = frame(spark)
    assert sorted(str(r["doc_id"]) for r in operator(df).collect()) == sorted(str(i) for i, _ in ROWS)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import os

    import corpus_pipeline
    from assayer.llm import queries

    if not os.path.exists(queries.PIECE_MODEL):
        pytest.skip("no model file")
    frame(spark).select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
