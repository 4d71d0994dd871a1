"""Pivots, perturbed copies, arriving runs and whole evaluations."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayer import evaluate as ev
from assayer.operators import paraphrase as pp
from assayer.operators import perturb as pt
from assayer.streaming import measures as st


def test_pivots_against_a_plain_sum(spark):
    rng = random.Random(1)
    pairs = [(f"e{rng.randrange(8)}", f"f{min(rng.randrange(6), rng.randrange(6))}") for _ in range(300)]
    n = Counter(pairs)
    by_e, by_f = Counter(e for e, _ in pairs), Counter(f for _, f in pairs)
    table = pp.phrase_table(spark.createDataFrame(pairs, "e string, f string"))
    assert {(r["e"], r["f"]): (r["n"], r["p_fe"], r["p_ef"]) for r in table.collect()} == {k: (c, pytest.approx(c / by_e[k[0]]), pytest.approx(c / by_f[k[1]])) for k, c in n.items()}
    for least in (0.0001, 0.1):
        want = Counter()
        for (e, f), c in n.items():
            for (o, g), k in n.items():
                if f == g and e != o and c / by_e[e] >= least and k / by_f[f] >= least:
                    want[e, o] += c / by_e[e] * k / by_f[f]
        got = {(r["e"], r["other"]): r["p"] for r in pp.pivot_paraphrases(table, least).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert pp.pivot_paraphrases(table.limit(0)).collect() == []


def test_masks_are_keyed_and_never_touch(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(n))) for i, n in enumerate((0, 1, 2, 3, 7, 40, 200))] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r["m"] for r in df.select("id", pt.masked_spans(F.col("text"), F.lit(1)).alias("m")).collect()}
    again = {r["id"]: r["m"] for r in df.repartition(5).select("id", pt.masked_spans(F.col("text"), F.lit(1)).alias("m")).collect()}
    other = {r["id"]: r["m"] for r in df.select("id", pt.masked_spans(F.col("text"), F.lit(2)).alias("m")).collect()}
    assert got == again and got[6] != other[6] and got[0] == "" and got[1] == "w0" and got[2] == "w0 w1" and got[99] is None
    for i, t in rows[3:-1]:
        words, masked = t.split(), got[i].split()
        masks = masked.count("<mask>")
        assert masks == max(1, min(len(words) // 3, round(len(words) * 0.15 / 2 + 1e-9))) and len(masked) == len(words) - masks
        assert "<mask> <mask>" not in got[i] and [w for w in masked if w != "<mask>"] == [w for w in words if w in masked]


def test_results_are_computed_once(spark, tmp_path):
    folder, calls = str(tmp_path / "cache"), []

    def compute(misses):
        calls.append(misses.count())
        return misses.select("key", F.upper("text").alias("value"))

    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, text string")
    want = [(1, "A"), (2, "B"), (3, "A"), (4, None)]
    read = lambda df: sorted(map(tuple, df.select("id", "value").collect()))
    assert read(pt.cached(texts, "text", "upper", folder, compute)) == want and calls == [2]
    files = sorted(p.name for p in (tmp_path / "cache").iterdir())
    assert read(pt.cached(texts, "text", "upper", folder, compute)) == want and calls == [2]
    assert sorted(p.name for p in (tmp_path / "cache").iterdir()) == files
    more = texts.unionByName(spark.createDataFrame([(5, "c")], "id int, text string"))

    def failing(misses):
        return misses.select("key", F.raise_error(F.lit("stopped")).cast("string").alias("value"))

    with pytest.raises(Exception, match="stopped"):
        pt.cached(more, "text", "upper", folder, failing)
    assert read(pt.cached(more, "text", "upper", folder, compute)) == [*want, (5, "C")] and calls == [2, 1]
    assert read(pt.cached(texts, "text", "other", folder, compute)) == want and calls == [2, 1, 2]


def runs(n):
    rng = random.Random(n)
    truth = [(i, "ab"[i % 2], rng.randrange(2)) for i in range(n)]
    run = [(i, rng.choice([None, 0.5, 0.2, 0.9, 0.7])) for i in range(n + 3)]
    return truth, run


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    truth, run = runs(60)
    t = spark.createDataFrame(truth, "id long, grp string, y int")
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"id": i, "value": v}) for i, v in run[k * 20 : k * 20 + 20]))
    stream = lambda: spark.readStream.schema("id long, value double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    where = [str(tmp_path / x) for x in ("table", "state")]
    st.merge_run(stream(), t, *where).awaitTermination()
    plain = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    rows = lambda: plain(st.measures_so_far(st.merged_counts(spark, where[0])))
    first = rows()
    batch = spark.createDataFrame(run[:60], "id long, value double")
    counts = st.batch_counts(batch, t)
    assert first == plain(st.measures_so_far(counts))
    done = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    done.unlink()  # as if the last batch had failed behind its write
    (done.parent / f".{done.name}.crc").unlink(missing_ok=True)
    st.merge_run(stream(), t, *where).awaitTermination()
    assert rows() == first
    (tmp_path / "in" / "9.json").write_text("\n".join(json.dumps({"id": i, "value": v}) for i, v in run[60:]))
    st.merge_run(stream(), t, *where).awaitTermination()
    merged = {r["grp"]: r for r in st.merged_counts(spark, where[0]).collect()}
    assert merged[None]["missing"] == 3 and sum(r["n"] for r in merged.values()) == 60
    a = [(v if v is not None else 0.5, y) for (i, g, y), (_, v) in zip(truth, run, strict=False) if g == "a"]
    right, open_ = sum((p > 0.5) == (y == 1) and p != 0.5 for p, y in a), sum(p == 0.5 for p, _ in a)
    got = next(r for r in st.measures_so_far(st.merged_counts(spark, where[0])).collect() if r["grp"] == "a")
    assert got["c_at_1"] == pytest.approx((right + open_ * right / len(a)) / len(a)) and got["brier"] == pytest.approx(1 - sum((p - y) ** 2 for p, y in a) / len(a))


def measures(folder):
    text = "\n".join(p.read_text() for p in sorted((folder / "measures").glob("part-*")))
    keys = [line.split('"')[1] for line in text.splitlines() if "key:" in line]
    return dict(zip(keys, (float(line.split('"')[1]) for line in text.splitlines() if "value:" in line), strict=True))


def errors(folder):
    return sorted((json.loads(line).get("item"), json.loads(line)["error"]) for p in (folder / "errors").glob("part-*") for line in p.read_text().splitlines())


def test_verification_evaluation(spark, tmp_path):
    truth = [{"id": "1", "same": True}, {"id": "2", "same": False}, {"id": "3", "same": True}, {"id": "4", "same": False}]
    run = [{"id": "1", "value": 0.9}, {"id": "2", "value": 0.1}, {"id": "3", "value": 1.7}, {"id": "9", "value": 0.3}]
    (tmp_path / "truth").write_text("\n".join(map(json.dumps, truth)))
    (tmp_path / "run").write_text("\n".join(map(json.dumps, run)))
    ev.evaluate(spark, "verification", str(tmp_path / "truth"), str(tmp_path / "run"), str(tmp_path / "out"))
    got = measures(tmp_path / "out")
    assert got["auc"] == got["all/auc"] == 1.0 and got["c_at_1"] == pytest.approx((3 + 3 / 4) / 4) and got["brier"] == pytest.approx(1 - (0.01 + 0.01 + 0 + 0.25) / 4)
    assert errors(tmp_path / "out") == [("3", "OUT_OF_RANGE"), ("4", "MISSING_ID"), ("9", "UNKNOWN_ID")]


def test_a_failing_measure_stops_no_other(spark):
    good = spark.createDataFrame([("a", 1.0)], "key string, value double")
    parts = {"one": lambda: good, "two": lambda: good.select("key", F.raise_error(F.lit("broken")).cast("double").alias("value")), "three": lambda: 1 / 0}
    found, failed = ev.isolated(parts, spark)
    assert [tuple(r) for r in found.collect()] == [("a", 1.0)] and [r["item"] for r in failed.orderBy("item").collect()] == ["three", "two"]
    assert all(("broken" in r["error"]) == (r["item"] == "two") for r in failed.collect())


def test_alignment_ranking_and_attribution_evaluations(spark, tmp_path):
    def xml(folder, name, spans):
        (tmp_path / folder).mkdir(exist_ok=True)
        rows = "".join(f'<feature name="{name}" this_offset="{a}" this_length="{n}" source_reference="s.txt" source_offset="{a}" source_length="{n}"/>' for a, n in spans)
        (tmp_path / folder / "a.xml").write_text(f'<document reference="d.txt">{rows}</document>')

    xml("t1", "plagiarism", [(0, 100), (200, 100)])
    xml("r1", "detected-plagiarism", [(0, 100), (400, 0)])
    ev.evaluate(spark, "alignment", str(tmp_path / "t1"), str(tmp_path / "r1"), str(tmp_path / "o1"))
    assert measures(tmp_path / "o1")["macro_recall"] == 0.5 and errors(tmp_path / "o1") == [("d", "EMPTY_PASSAGE")]
    (tmp_path / "qrels").write_text("q1 0 d1 1\nq2 0 d2 1\n")
    (tmp_path / "trec").write_text("q1 Q0 d1 1 2.0 t\nq1 Q0 d3 2 1.0 t\nq9 Q0 d1 1 1.0 t\n")
    ev.evaluate(spark, "ranking", str(tmp_path / "qrels"), str(tmp_path / "trec"), str(tmp_path / "o2"))
    assert measures(tmp_path / "o2")["queries"] == 2 and measures(tmp_path / "o2")["rr"] == 0.5 and errors(tmp_path / "o2") == [("q9", "UNKNOWN_QUERY")]
    (tmp_path / "gold" / "p1").mkdir(parents=True)
    (tmp_path / "gold" / "p1" / "ground-truth.json").write_text(json.dumps({"ground_truth": [{"unknown-text": "u1", "true-author": "x"}, {"unknown-text": "u2", "true-author": "y"}]}))
    (tmp_path / "said").write_text(json.dumps({"problem": "p1", "unknown_text": "u1", "author": "x"}))
    ev.evaluate(spark, "attribution", str(tmp_path / "gold" / "*" / "*.json"), str(tmp_path / "said"), str(tmp_path / "o3"))
    assert measures(tmp_path / "o3")["p1/f1"] == 0.5 == measures(tmp_path / "o3")["mean_f1"] and errors(tmp_path / "o3") == [("p1/u2", "MISSING_ID")]
    assert ev.main(["verification"]) == 2


def test_each_masked_copy_has_results_of_its_own(spark, monkeypatch):
    """No copy reads what another has stored."""
    from pyspark.sql import functions as F

    from assayer.catalog import pairs

    seen = []
    monkeypatch.setattr(pairs.pt, "cached", lambda texts, text, parameters, folder, compute: (seen.append((parameters, folder)), texts.withColumn("value", F.col(text)))[1])
    pairs.pt_masked(spark, "/root/testdata/sf0.001")
    assert len({p for p, _ in seen}) == 3 and len({f for _, f in seen}) == 3
