"""Queries of aligned pairs, pivots, topics, perturbed copies, and measures of runs that arrive in pieces."""

import uuid

from pyspark.sql import functions as F

from assayer.catalog.inputs import table, view, with_
from assayer.evaluate import verification_errors
from assayer.functions import text as tx
from assayer.operators import features as ft
from assayer.operators import linear as ln
from assayer.operators import locate as lo
from assayer.operators import meteor as mt
from assayer.operators import paraphrase as pp
from assayer.operators import perturb as pt
from assayer.operators import resample as rs
from assayer.operators import topics as tp
from assayer.plans import checkpoint_folder, cut
from assayer.registry import query
from assayer.streaming import measures as st

R = lambda c, name: F.round(c, 6).alias(name)
W = r"[\p{L}\p{N}_'']+"


@query("tx_meteor")
def tx_meteor(spark, d):
    """Each turn against the next one, aligned by words and stems."""
    pairs = view(spark, d, "pairs").select("conv_id", "turn", tx.words("ref").alias("r"), tx.words("hyp").alias("h"))
    counts = mt.alignment_counts(pairs, ["conv_id", "turn"], "r", "h", tx.STOP_WORDS)
    return counts.select("conv_id", "turn", "matched", "exact", "chunks", R(mt.meteor_score(counts), "meteor"))


PIVOT = f"""pa2 AS (SELECT z[1] AS e, z[2] AS f FROM (SELECT unnest(list_zip(regexp_extract_all(lower(hyp), '{W}'), regexp_extract_all(lower(ref), '{W}'), true)) AS z FROM pairs)),
    pt AS (SELECT e, f, count(*) AS n FROM pa2 GROUP BY ALL), pr AS (SELECT e, f, n / sum(n) OVER (PARTITION BY e)::DOUBLE AS p_fe, n / sum(n) OVER (PARTITION BY f)::DOUBLE AS p_ef FROM pt)"""


@query("pp_table", with_("pairs", more=PIVOT) + "SELECT e, f, n, round(p_fe, 6) AS p_fe, round(p_ef, 6) AS p_ef FROM pt JOIN pr USING (e, f)")
def pp_table(spark, d):
    """Words of a turn against the words at the same places of the next, as a phrase table."""
    return _phrases(spark, d).select("e", "f", "n", R(F.col("p_fe"), "p_fe"), R(F.col("p_ef"), "p_ef"))


def _phrases(spark, d):
    pairs = view(spark, d, "pairs").select(tx.words(F.lower("hyp")).alias("h"), tx.words(F.lower("ref")).alias("r"))
    least = F.least(F.size("h"), F.size("r"))
    return pp.phrase_table(pairs.select(F.explode(F.arrays_zip(F.slice("h", F.lit(1), least).alias("e"), F.slice("r", F.lit(1), least).alias("f"))).alias("z")).select("z.e", "z.f"))


@query("pp_pivot", with_("pairs", more=PIVOT) + """SELECT a.e, b.e AS other, round(sum(a.p_fe * b.p_ef), 6) AS p FROM pr a JOIN pr b ON a.f = b.f AND a.e <> b.e
    WHERE a.p_fe >= 0.05 AND b.p_ef >= 0.05 GROUP BY ALL""")
def pp_pivot(spark, d):
    return pp.pivot_paraphrases(_phrases(spark, d), least=0.05).select("e", "other", R(F.col("p"), "p"))


TOPICS = 6


def _topics(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tx.words(F.lower("text")).alias("tokens"))
    totals = cut(tp.chunk_terms(docs, "tokens", 300))
    chunks = totals.filter("gram IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0))).collect()[0][0]
    vocabulary = tp.frequent_terms(totals, chunks, 5, 0.5, 2000)
    rows = tp.chunk_rows(docs, "doc_id", "tokens", 300, vocabulary, chunks).withColumn("key", F.concat_ws(":", "doc_id", "chunk")).drop("chunk")
    found = tp.factorise(rows, "key", vocabulary.count(), TOPICS, rounds=12)
    return tp.mean_mixture(found.mixtures, "doc_id", TOPICS)


@query("tp_mixtures")
def tp_mixtures(spark, d):
    """The weight of each topic in each document, as the mean over its chunks of 300 words."""
    return _topics(spark, d).select("doc_id", *[F.round(F.col("w")[t], 4).alias(f"topic{t}") for t in range(TOPICS)])


@query("tp_cosine")
def tp_cosine(spark, d):
    """The cosine of the topics of each document and the next one by id."""
    mixtures = cut(_topics(spark, d))
    other = mixtures.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return tp.mixture_cosine(mixtures.join(other, "doc_id"), "w", "v").select("doc_id", F.round("cosine", 4).alias("cosine"))


@query("pt_masked")
def pt_masked(spark, d):
    """Three masked copies of every document, through a table of results by content for each copy, so that no copy reads the others' results; equal texts are masked once."""
    folder = f"{checkpoint_folder(spark)}/masked-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = None
    for copy in range(3):
        name = f"mask share=0.15 span=2 seed=7 copy={copy}"
        rows = pt.cached(docs, "text", name, f"{folder}/{copy}", lambda m, copy=copy: m.select("key", pt.masked_spans(F.col("text"), F.lit(copy)).alias("value")))
        rows = rows.select("doc_id", F.lit(copy).alias("copy"), F.sha2("value", 256).alias("value_sha256"), (F.size(F.split("value", "<mask>")) - 1).cast("long").alias("masks"))
        found = rows if found is None else found.unionByName(rows)
    return found


ODD_RUN = """ru AS (SELECT CASE WHEN doc_id % 31 = 0 THEN NULL ELSE doc_id END AS id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 1.5e0 ELSE (doc_id % 10) / 10e0 END AS value FROM labels WHERE doc_id % 5 <> 0
      UNION ALL SELECT doc_id AS id, 0.5e0 AS value FROM labels WHERE doc_id % 13 = 0 UNION ALL SELECT -1 AS id, 0.5e0 AS value)"""


@query("va_verification", f"""WITH {ODD_RUN}, tr AS (SELECT doc_id AS id FROM labels)
    SELECT id::VARCHAR AS item, 'MISSING_VALUE' AS error FROM ru WHERE value IS NULL UNION ALL SELECT id::VARCHAR, 'OUT_OF_RANGE' FROM ru WHERE value < 0 OR value > 1
    UNION ALL SELECT NULL, 'MISSING_ID_FIELD' FROM ru WHERE id IS NULL UNION ALL SELECT id::VARCHAR, 'DUPLICATE_ID' FROM ru WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT id::VARCHAR, 'MISSING_ID' FROM tr WHERE id NOT IN (SELECT id FROM ru WHERE id IS NOT NULL) UNION ALL SELECT id::VARCHAR, 'UNKNOWN_ID' FROM ru WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM tr)""")
def va_verification(spark, d):
    table(spark, d, "labels").createOrReplaceTempView("labels")
    return verification_errors(spark.sql("SELECT doc_id AS id FROM labels"), spark.sql(f"WITH {ODD_RUN} SELECT id, value FROM ru"))


@query("st_run_measures")
def st_run_measures(spark, d):
    """Measures per language of a run that arrives as files: a streaming query merges the counts of its batches into a table."""
    folder = f"{checkpoint_folder(spark)}/run-{uuid.uuid4().hex}"
    run = view(spark, d, "run")
    run.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(4))).repartition(4, "part").drop("part").write.parquet(f"{folder}/run")
    stream = spark.readStream.schema(run.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/run")
    truth = cut(view(spark, d, "truth").select("id", "grp", "y"))
    st.merge_run(stream, truth, f"{folder}/counts", f"{folder}/state").awaitTermination()
    found = st.measures_so_far(st.merged_counts(spark, f"{folder}/counts"))
    return found.select("grp", "n", "missing", *[R(F.col(c), c) for c in ("accuracy", "c_at_1", "f1", "brier")])


@query("rs_strategies")
def rs_strategies(spark, d):
    """How often each document is taken to balance three labels of its own (language, toxic, a long text), by three of the strategies."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    labels = F.array_compact(F.array(F.col("lang"), F.when(F.col("toxic") == 1, F.lit("toxic")), F.when(F.length("text") > 5000, F.lit("long"))))
    rows = cut(docs.select("doc_id", labels.alias("labels")))
    found = None
    for name in ("ruos_m", "ruos_ends", "rus_q"):
        taken = rs.sample_classes(rows, "doc_id", "labels", rs.STRATEGIES[name]).select(F.lit(name).alias("strategy"), "doc_id", "times")
        found = taken if found is None else found.unionByName(taken)
    return found


@query("txt_locate_near")
def txt_locate_near(spark, d):
    """Where each turn without one of its last words stands in the turn itself: the longest block, if it is most of the piece."""
    words = F.split("text", " ")
    gap = F.size(words) - 1 - F.pmod("turn", F.lit(3))
    piece = F.array_join(F.filter(words, lambda w, i: i != gap), " ")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", piece.alias("piece"))
    return lo.near_offsets(rows, ["conv_id", "turn"], "text", "piece")
