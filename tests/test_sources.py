"""Readers, writers and streams on small files."""

from assayer import sources, streaming
from assayer.sources.writers import long_form, measure_lines


def test_annotations_round_trip(spark, tmp_path):
    xml = (
        '<document reference="susp1.txt"><feature name="about" severity="low"/>'
        '<feature name="artificial-plagiarism" this_offset="5" this_length="10" source_reference="src1.txt" source_offset="0" source_length="9" llm="m1"/>'
        '<feature name="artificial-plagiarism" this_offset="50" this_length="10"/></document>'
    )
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(xml)
    rows = sources.annotations(spark, str(tmp_path / "in"), "plagiarism")
    assert sorted(map(tuple, rows.collect())) == [("susp1", 5, 10, "src1", 0, 9, True), ("susp1", 50, 10, "", 0, 0, False)]
    assert sources.annotations(spark, str(tmp_path / "in"), "plagiarism", llm="m2").count() == 1
    assert sources.annotations(spark, str(tmp_path / "in"), "plagiarism", severity="high").count() == 0
    sources.write_annotations(rows, str(tmp_path / "out"), "detected-plagiarism")
    assert sorted(map(tuple, sources.annotations(spark, str(tmp_path / "out"), "plagiarism").collect())) == sorted(map(tuple, rows.collect()))


def test_text_and_json_readers(spark, tmp_path):
    (tmp_path / "pairs").write_text("a.txt b.txt\n\nc d\n")
    assert sources.pairs(spark, str(tmp_path / "pairs")).count() == 2
    (tmp_path / "qrels").write_text("q1 0 d1 2\nq1 0 d2 0\n")
    assert sources.qrels(spark, str(tmp_path / "qrels")).collect()[0]["rel"] == 2
    (tmp_path / "run").write_text("q1 Q0 d1 1 0.5 tag\n")
    assert sources.trec_run(spark, str(tmp_path / "run")).collect()[0]["score"] == 0.5
    (tmp_path / "truth").write_text("u1:::male:::18-24\n")
    assert tuple(sources.profiles(spark, str(tmp_path / "truth")).collect()[0]) == ("u1", "male", "18-24")
    (tmp_path / "a.jsonl").write_text('{"id": "1", "value": 0.7}\n{"id": "2", "same": true}\n{"id": "3", "is_human": [true, false]}\n')
    assert {r["id"]: r["value"] for r in sources.verification_answers(spark, str(tmp_path / "a.jsonl")).collect()} == {"1": 0.7, "2": 1.0, "3": 0.0}


def test_measure_lines(spark):
    one = spark.createDataFrame([(0.5, 3)], "auc double, n long")
    lines = [r["value"] for r in measure_lines(long_form(one)).collect()]
    assert lines[0] == 'measure{\n  key: "auc"\n  value: "0.5"\n}' and len(lines) == 2


def test_stream_of_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "1", "value": 0.7, "ts": "2024-01-01T00:00:00Z"}\n{"id": "2", "value": 7, "ts": "2024-01-01T00:10:00Z"}\n')
    errors = streaming.validate_stream(streaming.read_run(spark, str(tmp_path / "in")))
    query = errors.writeStream.format("memory").queryName("run_errors").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("run_errors").collect()] == [("2", "OUT_OF_RANGE")]
    truth = spark.createDataFrame([("1", 1), ("2", 0)], "id string, y int")
    counts = streaming.accumulate_counts(spark.read.schema("id string, value double, ts timestamp").json(str(tmp_path / "in")), truth)
    assert (counts.collect()[0]["tp"], counts.collect()[0]["fp"]) == (1, 1)


def test_tables_text_files_and_answers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\t1\nb\tx\n")
    rows = {r["id"]: (r["n"], r["_corrupt_record"]) for r in sources.delimited(spark, str(tmp_path / "t.tsv"), "id string, n int").collect()}
    assert rows == {"a": (1, None), "b": (None, "b\tx")}
    (tmp_path / "blank").write_text("q1 3\n")
    assert [tuple(r)[:2] for r in sources.delimited(spark, str(tmp_path / "blank"), "q string, n int", " ").collect()] == [("q1", 3)]
    for folder, name in (("p1", "known01.txt"), ("p1", "unknown.txt"), ("p2", "known02.txt")):
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / folder / name).write_text(f"{folder}\n{name}\n")
    files = sources.text_files(spark, str(tmp_path / "in"), r"known\d+\.txt")
    assert sorted(map(tuple, files.collect())) == [("p1", "known01.txt", "p1\nknown01.txt\n"), ("p2", "known02.txt", "p2\nknown02.txt\n")]
    answers = spark.createDataFrame([("1", 0.5), ("2", None)], "id string, value double")
    sources.write_answers(answers, str(tmp_path / "a"), "jsonl")
    assert sorted(map(tuple, sources.jsonl(spark, str(tmp_path / "a"), "id string, value double").select("id", "value").collect())) == [("1", 0.5), ("2", None)]
    sources.write_answers(answers, str(tmp_path / "b"), "tsv")
    assert sorted(map(tuple, sources.delimited(spark, str(tmp_path / "b"), "id string, value double", header=True).select("id", "value").collect())) == [("1", 0.5), ("2", None)]
