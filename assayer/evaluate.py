"""Whole evaluations: a truth, a run and an output folder in; a validation report and measures out.

``python -m assayer.evaluate TASK TRUTH RUN OUTPUT`` runs one from the command line. Every evaluation writes ``errors`` (item, error) as JSON lines and
``measures`` in the text form of ``write_measures``; a measure that fails has no value but an error row, and the others are still written.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import sources
from assayer.operators import classify, passages, retrieval, scores, validate
from assayer.plans import cut
from assayer.sources.writers import long_form, write_measures

Measures = dict[str, Callable[[], DataFrame]]


def isolated(parts: Measures, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(measures (key, value), errors (item, error)): each part is computed by itself; one that raises becomes an error row and stops no other."""
    found, failed = spark.createDataFrame([], "key string, value double"), []
    for name, part in parts.items():
        try:
            rows = cut(part().select("key", F.col("value").cast("double").alias("value")))
        except Exception as e:  # noqa: BLE001  whatever a measure raises is reported
            failed.append((name, " ".join(f"{type(e).__name__}: {e}".split())[:2000]))
        else:
            found = found.unionByName(rows)
    return found, spark.createDataFrame(failed, "item string, error string")


def _keyed(df: DataFrame, group: str) -> DataFrame:
    """A report of a row a group as (key, value), the keys ``group/measure``; without a group only the measure's name."""
    numbers = [c for c, kind in df.dtypes if c != group and kind in ("double", "bigint", "int", "float")]
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in numbers])
    rows = df.select(*([group] if group in df.columns else []), F.explode(pairs).alias("x"))
    key = F.concat_ws("/", F.col(group), "x.key") if group in df.columns else F.col("x.key")
    return rows.select(key.alias("key"), F.col("x.value").alias("value"))


def verification_errors(truth: DataFrame, run: DataFrame) -> DataFrame:
    """(item, error) of a table of answers (id, value): no id, no or non-finite value, a value outside [0, 1], repeated ids, ids that only one side has."""
    v = F.col("value")
    one = validate.errors(run, "id", {"MISSING_VALUE": v.isNull() | F.isnan(v), "OUT_OF_RANGE": F.coalesce(~F.isnan(v) & ((v < 0) | (v > 1)), F.lit(False))})
    nameless = run.filter("id IS NULL").select(F.lit(None).cast("string").alias("item"), F.lit("MISSING_ID_FIELD").alias("error"))
    named = run.filter("id IS NOT NULL")
    return one.unionByName(nameless).unionByName(validate.duplicates(named, "id")).unionByName(validate.id_sets(truth, named, "id"))


def verification(spark: SparkSession, truth: str, run: str, parts: Measures | None = None) -> tuple[DataFrame, DataFrame]:
    """Verification answers (JSON lines id, value) against a truth (JSON lines id, same, and optionally grp); missing answers count as 0.5."""
    gold = spark.read.schema("id string, same boolean, grp string").json(truth).select("id", F.coalesce("grp", F.lit("all")).alias("grp"), F.col("same").cast("int").alias("y"))
    answers = sources.verification_answers(spark, run)
    usable = answers.filter("id IS NOT NULL").groupBy("id").agg(F.first("value", ignorenulls=True).alias("value"))
    rows = cut(scores.align(gold, usable).withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl("p", F.lit(0.5))))))
    whole = lambda: _keyed(scores.report(rows.withColumn("grp", F.lit("all")), ["grp"]).drop("grp"), "grp")
    by_group = lambda: _keyed(scores.report(rows, ["grp"]), "grp")
    found, failed = isolated({"report": whole, "report by group": by_group, **(parts or {})}, spark)
    return found, verification_errors(gold, answers).unionByName(failed)


def passage_errors(run: DataFrame) -> DataFrame:
    """(item, error) of detections: no reference, negative offsets, lengths below one."""
    bad = {"MISSING_REFERENCE": F.col("ref").isNull(), "NEGATIVE_OFFSET": (F.col("off") < 0) | (F.col("soff") < 0), "EMPTY_PASSAGE": F.col("len") < 1}
    return validate.errors(run, "ref", bad)


def alignment(spark: SparkSession, truth: str, run: str) -> tuple[DataFrame, DataFrame]:
    """Detected passages (folders of XML annotations) against the true ones: recall, precision, granularity and plagdet, and the scores in whole cases."""
    cases, dets = sources.annotations(spark, truth, "plagiarism"), sources.annotations(spark, run, "detected-plagiarism")
    usable = dets.filter("ref IS NOT NULL AND off >= 0 AND soff >= 0 AND len >= 1")  # the others are in the report
    parts = {"passages": lambda: long_form(passages.measures(cases, usable)), "cases": lambda: long_form(passages.case_level(cases, usable)).withColumn("key", F.concat(F.lit("case_"), "key"))}
    found, failed = isolated(parts, spark)
    return found, passage_errors(dets).unionByName(failed)


def ranking(spark: SparkSession, truth: str, run: str) -> tuple[DataFrame, DataFrame]:
    """A ranked run (``qid Q0 docno rank score tag``) against judgements: means over the judged queries."""
    judged, ranked = sources.qrels(spark, truth), sources.trec_run(spark, run)

    def means() -> DataFrame:
        each = retrieval.rank_measures(ranked, judged)
        return long_form(each.agg(*[F.avg(c).alias(c) for c, kind in each.dtypes if kind == "double"], F.count(F.lit(1)).alias("queries")))

    found, failed = isolated({"means": means}, spark)
    unknown = ranked.select("qid").distinct().join(judged.select("qid"), "qid", "left_anti").select(F.col("qid").alias("item"), F.lit("UNKNOWN_QUERY").alias("error"))
    return found, unknown.unionByName(failed)


def attribution(spark: SparkSession, truth: str, run: str) -> tuple[DataFrame, DataFrame]:
    """Attribution answers (problem, unknown_text, author as JSON lines) against the ground-truth files of the problems: macro F1 by problem and its mean; no answer is ``<UNK>``."""
    gold = sources.attribution(spark, truth).select("problem", F.concat_ws("/", "problem", "unknown_text").alias("id"), F.col("author").alias("label"))
    said = spark.read.schema("problem string, unknown_text string, author string").json(run).select(F.concat_ws("/", "problem", "unknown_text").alias("id"), F.col("author").alias("label"))
    rows = cut(classify.answers_for(gold, said.groupBy("id").agg(F.first("label").alias("label"))))

    def by_problem() -> DataFrame:
        return classify.macro(classify.class_counts(rows, ["problem"]), ["problem"])

    parts = {"problems": lambda: _keyed(by_problem(), "problem"), "mean": lambda: long_form(by_problem().agg(*[F.avg(c).alias(f"mean_{c}") for c in ("precision", "recall", "f1")]))}
    found, failed = isolated(parts, spark)
    return found, validate.id_sets(gold, said, "id").unionByName(validate.duplicates(said, "id")).unionByName(failed)


TASKS = {"verification": verification, "alignment": alignment, "ranking": ranking, "attribution": attribution}


def evaluate(spark: SparkSession, task: str, truth: str, run: str, output: str) -> None:
    """Run one of ``TASKS`` and write ``output``/measures and ``output``/errors."""
    measures, errors = TASKS[task](spark, truth, run)
    write_measures(measures.orderBy("key"), f"{output}/measures")
    errors.write.mode("overwrite").json(f"{output}/errors")


def main(arguments: list[str]) -> int:
    if len(arguments) != 4 or arguments[0] not in TASKS:
        print(f"usage: python -m assayer.evaluate {{{','.join(TASKS)}}} TRUTH RUN OUTPUT", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("assayer-evaluate").getOrCreate()
    evaluate(spark, *arguments)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
