"""Queries of trained baselines: linear classifiers, boosted trees, calibrated regressions. Rows held out by a checksum of the id are predicted."""

from pyspark.sql import functions as F

from assayer.catalog.features import chars, grams, ppm
from assayer.catalog.inputs import table
from assayer.functions import text as tx
from assayer.operators import alignment as al
from assayer.operators import classify as cl
from assayer.operators import entropy as en
from assayer.operators import features as ft
from assayer.operators import linear as ln
from assayer.operators import trees as tr
from assayer.operators import unmasking as un
from assayer.plans import cut
from assayer.registry import query

R = lambda c, name: F.round(c, 6).alias(name)
HELD_OUT = "doc_id % 5 = 2"


def _tasks(spark):
    """Parts for work in place: texts come in few files, and adaptive execution makes few parts of small tables that take long to work out."""
    return 4 * spark.sparkContext.defaultParallelism


@query("ta_greedy")
def ta_greedy(spark, d):
    """Passages of benchmark items in documents by the greedy walk over seeds of 50 characters, on whole texts."""
    return al.greedy_alignment(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", length=50)


GRAM_VALUES = f"""WITH c AS {grams(3, 'documents', 'doc_id, lang')}, v AS (SELECT gram FROM c WHERE NOT {HELD_OUT} GROUP BY gram HAVING sum(n) >= 5 ORDER BY sum(n) DESC, gram LIMIT 20000),
    f AS (SELECT doc_id, gram, n / length(text)::DOUBLE AS f FROM c JOIN v USING (gram) JOIN documents USING (doc_id)),
    t AS (SELECT gram, max(f) AS top FROM f WHERE NOT {HELD_OUT} GROUP BY gram)"""


def _gram_rows(spark, d):
    """(rows (doc_id, lang, held, idx, val), vocabulary (gram, idx)): character 3-grams of the training texts, relative to the text and to the gram's largest."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text", F.expr(HELD_OUT).alias("held"))
    vocabulary = ln.ordered_vocabulary(ft.char_gram_counts(docs.filter(~F.col("held")), [], "text", [3]), 5, 20_000)
    rows = cut(ln.char_rows(docs, "text", 3, vocabulary))
    return ln.largest_scaled(rows, ~F.col("held"), vocabulary.count()), vocabulary


@query("ml_gram_values", GRAM_VALUES + f" SELECT doc_id, gram, round(f / top, 6) AS value FROM f JOIN t USING (gram) WHERE {HELD_OUT}")
def ml_gram_values(spark, d):
    """The features of the held-out texts that the linear classifier is given."""
    rows, vocabulary = _gram_rows(spark, d)
    values = rows.filter("held").select("doc_id", F.explode(F.arrays_zip("idx", "val")).alias("x")).select("doc_id", "x.idx", "x.val")
    return values.join(F.broadcast(vocabulary), "idx").select("doc_id", "gram", R(F.col("val"), "value"))  # 20,000 rows at most


def _svm(spark, d):
    rows, vocabulary = _gram_rows(spark, d)
    model = ln.fit_linear(rows.filter(~F.col("held")), "lang", vocabulary.count(), c=1.0, tolerance=1e-3)
    return ln.class_scores(rows.filter("held"), "doc_id", model)


@query("ml_svm_margins")
def ml_svm_margins(spark, d):
    """Margins of each held-out text for each language, one against the rest."""
    return _svm(spark, d).select("doc_id", "author", F.round("score", 3).alias("margin"))


@query("ml_svm_answers")
def ml_svm_answers(spark, d):
    """The language with the largest margin, or ``<UNK>`` if the second is within 0.1."""
    return ln.answers(_svm(spark, d), "doc_id", 0.1).select("doc_id", "answer")


@query("ml_svm_scores")
def ml_svm_scores(spark, d):
    """Macro precision, recall and F1 of the answers of held-out texts, and the share left open."""
    found = ln.answers(_svm(spark, d), "doc_id", 0.1).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    counts = cl.class_counts(found.select("doc_id", F.col("lang").alias("label"), F.col("answer").alias("pred")), [])
    open_share = found.agg(F.avg((F.col("answer") == "<UNK>").cast("double")).alias("open_share"))
    return cl.macro(counts, [], exclude=("<UNK>",)).crossJoin(F.broadcast(open_share))  # one row each


TOXIC = f"""l AS (SELECT doc_id, toxic, lower(text) AS text FROM labels JOIN documents USING (doc_id)), w AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_'']+') AS ws FROM l),
    g AS (SELECT doc_id, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, ws, k, unnest(range(1, greatest(len(ws) - k + 2, 1))) AS i FROM w, range(1, 5) r(k))),
    c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL), v AS (SELECT gram FROM c WHERE NOT {HELD_OUT} GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT 1000),
    k AS (SELECT * FROM c JOIN v USING (gram)), x AS (SELECT gram, ln((1 + (SELECT count(*) FROM l WHERE NOT {HELD_OUT})) / (1 + count(*))::DOUBLE) + 1 AS idf FROM k WHERE NOT {HELD_OUT} GROUP BY gram),
    y AS (SELECT doc_id, gram, n * idf AS w FROM k JOIN x USING (gram))"""


GRAM_WORDS = 4


def _word_texts(spark, d):
    """(texts (doc_id, quality, toxic, held), the same with ws, their words): the labelled documents."""
    docs = table(spark, d, "labels").select("doc_id", "quality", "toxic").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").withColumn("held", F.expr(HELD_OUT))
    tokens = cut(docs.select("doc_id", "quality", "toxic", "held", tx.words(F.lower("text")).alias("ws")).repartition(_tasks(spark)))
    return tokens.drop("ws"), tokens


def _word_rows(spark, d):
    docs, tokens = _word_texts(spark, d)
    vocabulary = ln.ordered_vocabulary(ft.most_frequent_grams(tokens.filter("NOT held"), F.col("ws"), GRAM_WORDS, 1000), 1, 1000)
    counts = cut(ft.listed_gram_counts(tokens, ["doc_id"], F.col("ws"), GRAM_WORDS, vocabulary.select("gram")))
    values = ln.tf_idf_values(counts, "doc_id", vocabulary, docs.filter("NOT held"))
    return docs, values, vocabulary.count()


@query("ml_word_values", "WITH " + TOXIC + f" SELECT doc_id, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS value FROM y QUALIFY {HELD_OUT}")
def ml_word_values(spark, d):
    """tf-idf of the 1,000 most frequent n-grams of one to four words, for the held-out texts."""
    return _word_rows(spark, d)[1].filter(HELD_OUT).select("doc_id", "gram", R(F.col("value"), "value"))


@query("ga_tfidf_svm")
def ga_tfidf_svm(spark, d):
    """A toxicity score of held-out texts: the logistic of the margin of a classifier over word n-grams; 0.5 leaves it open."""
    docs, values, size = _word_rows(spark, d)
    rows = cut(ln.sparse_rows(values, "doc_id", docs))
    model = ln.fit_linear(rows.filter(~F.col("held")), "toxic", size, tolerance=1e-3)
    margin = ln.class_scores(rows.filter("held"), "doc_id", model).filter("author = '1'")
    return margin.select("doc_id", F.round(1 / (1 + F.exp(-F.col("score"))), 3).alias("value"))


DEPTHS, RATES, FOLDS, SELECTED, BINS = [2, 3], [0.25, 0.5], 3, 200, 8


def _selected(spark, d):
    """(rows (doc_id, y, fold, idx, val), texts): the 200 grams of one to four words that depend most on the quality label by chi2, in bins."""
    docs, tokens = _word_texts(spark, d)
    best = tr.best_grams(ft.most_dependent_grams(tokens, "quality", F.col("ws"), GRAM_WORDS, 5, SELECTED), SELECTED)
    counts = cut(ft.listed_gram_counts(tokens, ["doc_id"], F.col("ws"), GRAM_WORDS, best))
    values = tr.binned(counts.select("doc_id", "idx", F.col("n").cast("double").alias("value")), "doc_id", BINS)
    texts = docs.select("doc_id", F.array("quality", "toxic").alias("y"), tr.folds(F.col("doc_id"), FOLDS).alias("fold"))
    return cut(ln.sparse_rows(values, "doc_id", texts)), texts


@query("ml_trees_cv")
def ml_trees_cv(spark, d):
    """Boosted trees for both labels over a grid of depths and rates: trees used, F1 of either class and their mean over the texts of the folds left out, and whether it is the best."""
    rows, texts = _selected(spark, d)
    forest, chances = tr.cross_validate(rows, "doc_id", SELECTED, 2, FOLDS, DEPTHS, RATES, bins=BINS, trees=12, patience=4)
    told = [(m, ["quality", "toxic"][s.label], s.label, s.depth, s.rate, n) for m, (s, n) in enumerate(zip(forest.settings, forest.sizes, strict=True))]
    told = F.broadcast(spark.createDataFrame(told, "setting int, label string, place int, depth int, rate double, trees int"))  # a row a setting
    judged = chances.join(told, "setting").join(texts.select("doc_id", "y"), "doc_id").withColumn("y", F.get("y", F.col("place")))
    found = judged.groupBy("label", "depth", "rate").agg(
        *[F.count_if(c).alias(n) for n, c in (("tp", (F.col("p") >= 0.5) & (F.col("y") == 1)), ("fp", (F.col("p") >= 0.5) & (F.col("y") == 0)), ("fn", (F.col("p") < 0.5) & (F.col("y") == 1)), ("tn", (F.col("p") < 0.5) & (F.col("y") == 0)))]
    )
    used = told.groupBy("label", "depth", "rate").agg(F.sum("trees").alias("trees"))
    f1 = lambda a: F.coalesce(F.try_divide(2 * F.col(a), 2 * F.col(a) + F.col("fp") + F.col("fn")), F.lit(0.0))
    scored = found.join(used, ["label", "depth", "rate"]).withColumns({"f1": f1("tp"), "f1_other": f1("tn")}).withColumn("f1_macro", (F.col("f1") + F.col("f1_other")) / 2)
    best = scored.groupBy("label").agg(F.max_by(F.struct("depth", "rate"), F.struct("f1_macro", -F.col("depth"), -F.col("rate"))).alias("best"))
    chosen = (F.col("depth") == F.col("best.depth")) & (F.col("rate") == F.col("best.rate"))
    return scored.join(best, "label").select("label", "depth", "rate", "trees", *[R(F.col(c), c) for c in ("f1", "f1_other", "f1_macro")], chosen.alias("chosen"))


#: Each turn against the next two of its conversation; the same author if the roles are equal.
TURNS = """SELECT conv_id, turn, step, a, b, role = other AS same FROM (
      SELECT conv_id, turn, 1 AS step, text AS a, role, lead(text, 1) OVER w AS b, lead(role, 1) OVER w AS other FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
      UNION ALL SELECT conv_id, turn, 2 AS step, text AS a, role, lead(text, 2) OVER w AS b, lead(role, 2) OVER w AS other FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) t
    WHERE b IS NOT NULL AND a IS NOT NULL"""


def _turn_pairs(spark, d):
    table(spark, d, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(TURNS).repartition(_tasks(spark))


def _model(text: str) -> str:
    rows = ppm(f"(SELECT conv_id, turn, step, {text} AS text FROM pa)", "conv_id, turn, step")
    return f"(SELECT *, n / sum(n) OVER (PARTITION BY conv_id, turn, step, ord, ctx)::DOUBLE AS p FROM {rows})"


def _entropy_side(text: str, model: str) -> str:
    keys = "conv_id, turn, step"
    on = lambda o, c: f"m{o}.conv_id = t.conv_id AND m{o}.turn = t.turn AND m{o}.step = t.step AND m{o}.ch = t.ch AND m{o}.ord = {o} AND m{o}.ctx = {c}"
    return f"""(SELECT t.conv_id, t.turn, t.step, sum(-log2(coalesce(m2.p, m1.p, m0.p, 1 / 256::DOUBLE)) * times) / sum(times) AS h
      FROM (SELECT {keys}, coalesce(p2, '') || coalesce(p1, '') AS ctx, ch, count(*) AS times FROM {chars('pa', keys, text)} GROUP BY ALL) t
      LEFT JOIN {model} m2 ON {on(2, 't.ctx')} AND length(t.ctx) = 2 LEFT JOIN {model} m1 ON {on(1, "right(t.ctx, 1)")} AND length(t.ctx) >= 1 LEFT JOIN {model} m0 ON {on(0, "''")}
      GROUP BY ALL)"""


ENTROPIES = f"""WITH pa AS ({TURNS}), ma AS MATERIALIZED {_model('a')}, mb AS MATERIALIZED {_model('b')}
    SELECT pa.conv_id, pa.turn, pa.step, round(x.h, 4) AS h12, round(y.h, 4) AS h21
    FROM pa LEFT JOIN {_entropy_side('b', 'ma')} x USING (conv_id, turn, step) LEFT JOIN {_entropy_side('a', 'mb')} y USING (conv_id, turn, step)"""


@query("ppm_pair_entropies", ENTROPIES)
def ppm_pair_entropies(spark, d):
    """Cross-entropies of two turns, each under the other's context model of order 2."""
    found = en.pair_entropies(_turn_pairs(spark, d), ["conv_id", "turn", "step"], "a", "b", 2)
    return found.select("conv_id", "turn", "step", F.round("h12", 4).alias("h12"), F.round("h21", 4).alias("h21"))


@query("ppm_pair_probability")
def ppm_pair_probability(spark, d):
    """The chance that two turns of a held-out conversation are of one author, by a regression on both cross-entropies; within 0.05 of a half it is left open."""
    pairs = _turn_pairs(spark, d).withColumn("key", F.concat_ws(":", "conv_id", "turn", "step"))
    found = en.pair_entropies(pairs, ["key", "conv_id", "same"], "a", "b", 5).filter("h12 IS NOT NULL AND h21 IS NOT NULL")
    rows = cut(found.select("key", "conv_id", F.col("same").cast("string").alias("same"), F.array(F.lit(0), F.lit(1)).alias("idx"), F.array(F.round("h12", 4), F.round("h21", 4)).alias("val")))
    held = F.col("conv_id") % 5 == 2
    model = ln.fit_linear(rows.filter(~held), "same", 2, loss="log")
    p = ln.class_scores(rows.filter(held), "key", model).filter("author = 'true'")
    part = lambda k: F.split("key", ":")[k]
    return p.select(part(0).cast("long").alias("conv_id"), part(1).cast("int").alias("turn"), part(2).cast("int").alias("step"), F.round(ln.answered_half(F.col("score"), 0.05), 3).alias("value"))


@query("ga_unmasking")
def ga_unmasking(spark, d):
    """How much each document's two halves look alike once the features that tell them apart are gone; small settings, whole texts."""
    settings = un.Settings(rounds=8, features=60, taken=4, folds=4, chunks=16, size=200)
    found = un.unmask(table(spark, d, "documents"), "doc_id", "text", settings)
    return found.select("doc_id", F.round("value", 4).alias("value"), F.size("curve").cast("long").alias("points"))
