"""Classification, multi-label and style-change queries."""

from pyspark.sql import functions as F

from assayer.catalog.inputs import table, view, with_
from assayer.functions import measures as m
from assayer.operators import classify, scores
from assayer.registry import query

R = lambda c, name: F.round(c, 6).alias(name)
PRF = ("precision", "recall", "f1")
ROUND_SQL = """round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1"""


def _rounded():
    return [R(F.col(c), c) for c in PRF]


def counts_sql(rows: str, groups: str, truth: str = "label", pred: str = "pred", hit: str | None = None) -> str:
    """CTEs: ``cc`` with tp, fp, fn per class, ``pr`` with precision, recall, f1."""
    hit = hit or f"{truth} = {pred}"
    g = f"{groups}, " if groups else ""
    return f"""cc AS (SELECT {g}cls, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (
            SELECT {g}{truth} AS cls, ({hit})::INT AS tp, 0 AS fp, (NOT ({hit}))::INT AS fn FROM {rows}
            UNION ALL SELECT {g}{pred}, 0, (NOT ({hit}))::INT, 0 FROM {rows}) GROUP BY {g}cls),
        pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS "precision", coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
                      coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM cc)"""


JOINED = "j AS (SELECT g.id, g.problem, g.label, g.source, coalesce(a.label, '<UNK>') AS pred FROM gold g LEFT JOIN answers a ON g.id = a.id)"
GA = with_("gold", "answers", more=JOINED + ", " + counts_sql("j", "problem"))
ALL = with_("gold", "answers", more=JOINED + ", " + counts_sql("j", ""))


def _joined(spark, d):
    return classify.answers_for(view(spark, d, "gold"), view(spark, d, "answers"))


@query("ap_accuracy", with_("gold", "answers", more=JOINED) + """SELECT round(avg((upper(label) = upper(pred))::INT), 6) AS gender, round(avg((source = 'src' || (id % 20))::INT), 6) AS age,
    round(avg((upper(label) = upper(pred) AND source = 'src' || (id % 20))::INT), 6) AS joint FROM j""")
def ap_accuracy(spark, d):
    rows = _joined(spark, d)
    g, a = F.upper("label") == F.upper("pred"), F.col("source") == F.concat(F.lit("src"), F.col("id") % 20)
    return rows.agg(*[R(F.avg(c.cast("int")), n) for c, n in ((g, "gender"), (a, "age"), (g & a, "joint"))])


@query("aa_macro", GA + f"SELECT problem, {ROUND_SQL} FROM (SELECT problem, avg(\"precision\") AS \"precision\", avg(recall) AS recall, avg(f1) AS f1 FROM pr WHERE tp + fn > 0 GROUP BY problem)")
def aa_macro(spark, d):
    return classify.macro(classify.class_counts(_joined(spark, d), ["problem"]), ["problem"]).select("problem", *_rounded())


@query("aa_macro_open", GA + f"SELECT problem, {ROUND_SQL} FROM (SELECT problem, avg(\"precision\") AS \"precision\", avg(recall) AS recall, avg(f1) AS f1 FROM pr WHERE tp + fn > 0 AND cls <> 'es' GROUP BY problem)")
def aa_macro_open(spark, d):
    return classify.macro(classify.class_counts(_joined(spark, d), ["problem"]), ["problem"], exclude=("es",)).select("problem", *_rounded())


@query("aa_overall", GA + "SELECT round(avg(f), 3) AS f1, count(*) AS problems FROM (SELECT avg(f1) AS f FROM pr WHERE tp + fn > 0 GROUP BY problem)")
def aa_overall(spark, d):
    each = classify.macro(classify.class_counts(_joined(spark, d), ["problem"]), ["problem"])
    return each.agg(F.round(F.avg("f1"), 3).alias("f1"), F.count(F.lit(1)).alias("problems"))


@query("aa15_macro", GA + """SELECT problem, round(p, 6) AS "precision", round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM
    (SELECT problem, avg(tp / nullif(tp + fp, 0)::DOUBLE) AS p, avg(tp / nullif(tp + fn, 0)::DOUBLE) AS r FROM cc GROUP BY problem)""")
def aa15_macro(spark, d):
    return classify.macro_of_means(classify.class_counts(_joined(spark, d), ["problem"]), ["problem"]).select("problem", *_rounded())


@query("cp_prec_rec", ALL + "SELECT cls, round(\"precision\", 6) AS \"precision\", round(recall, 6) AS recall FROM pr WHERE tp + fn > 0")
def cp_prec_rec(spark, d):
    return classify.with_prf(classify.class_counts(_joined(spark, d), [])).filter("tp + fn > 0").select("cls", *_rounded()[:2])


AGES = "ages AS (SELECT doc_id AS id, (1930 + doc_id % 80)::BIGINT AS label, (1930 + doc_id % 80 + doc_id % 23 - 11)::BIGINT AS pred FROM documents)"
AGE_HIT = "(pred BETWEEN trunc(label - (-0.1::DOUBLE * label + 202.8)) AND trunc(label + (-0.1::DOUBLE * label + 202.8)))"


def _ages(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(i.alias("id"), (1930 + i % 80).alias("label"), (1930 + i % 80 + i % 23 - 11).alias("pred"))


@query("cp_age", "WITH " + AGES + ", " + counts_sql("ages", "", hit=AGE_HIT) + "SELECT cls, tp, fp, fn, round(\"precision\", 6) AS \"precision\", round(recall, 6) AS recall FROM pr WHERE tp + fn > 0")
def cp_age(spark, d):
    counts = classify.class_counts(_ages(spark, d), [], hit=classify.age_hit(F.col("label"), F.col("pred")))
    return classify.with_prf(counts).filter("tp + fn > 0").select("cls", "tp", "fp", "fn", *_rounded()[:2])


@query("cp_crank", with_("gold", "answers", more=JOINED + ", " + AGES + f""", t AS (
        SELECT 'lang' AS task, label AS label, pred AS pred, label = pred AS hit FROM j
        UNION ALL SELECT 'parity', 'p' || (id % 3), 'p' || ((id + (id % 5 = 0)::INT) % 3), id % 3 = (id + (id % 5 = 0)::INT) % 3 FROM j
        UNION ALL SELECT 'age', label::VARCHAR, pred::VARCHAR, {AGE_HIT} FROM ages), """ + counts_sql("t", "task", hit="hit")) + """
    SELECT round(count(*) / sum(1 / f), 6) AS crank FROM (SELECT task, 2 * avg("precision") * avg(recall) / (avg("precision") + avg(recall)) AS f FROM pr WHERE tp + fn > 0 GROUP BY task)""")
def cp_crank(spark, d):
    j, i = _joined(spark, d), F.col("id")
    lang = j.select(F.lit("lang").alias("task"), "label", "pred", (F.col("label") == F.col("pred")).alias("hit"))
    a, b = F.concat(F.lit("p"), i % 3), F.concat(F.lit("p"), (i + (i % 5 == 0).cast("int")) % 3)
    parity = j.select(F.lit("parity").alias("task"), a.alias("label"), b.alias("pred"), (a == b).alias("hit"))
    ages = _ages(spark, d).select(F.lit("age").alias("task"), F.col("label").cast("string"), F.col("pred").cast("string"), classify.age_hit(F.col("label"), F.col("pred")).alias("hit"))
    counts = classify.class_counts(lang.unionByName(parity).unionByName(ages), ["task"], hit=F.col("hit"))
    means = classify.macro(counts, ["task"]).withColumn("f", m.f_beta(F.col("precision"), F.col("recall")))
    return means.agg(R(m.harmonic_mean(F.col("f")), "crank"))


BIN = """b AS (SELECT t.grp, t.src, t.id, t.y, coalesce((r.value > 0.5)::INT, 0) AS yhat FROM truth t LEFT JOIN run r ON t.id = r.id),
    bc AS (SELECT grp, sum((y = 1 AND yhat = 1)::INT)::BIGINT AS tp, sum((y = 0 AND yhat = 1)::INT)::BIGINT AS fp, sum((y = 1 AND yhat = 0)::INT)::BIGINT AS fn,
                  sum((y = 0 AND yhat = 0)::INT)::BIGINT AS tn FROM b GROUP BY grp)"""


def _binary(spark, d):
    joined = view(spark, d, "truth").join(view(spark, d, "run"), "id", "left")
    return joined.withColumn("yhat", F.coalesce((F.col("value") > 0.5).cast("int"), F.lit(0)))


@query("hp_prf", with_("truth", "run", more=BIN) + """SELECT grp, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS "precision",
    round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM bc""")
def hp_prf(spark, d):
    return classify.binary_report(_binary(spark, d), ["grp"]).select("grp", R(F.col("accuracy"), "accuracy"), *_rounded())


@query("ot_mcc", with_("truth", "run", more=BIN) + """SELECT grp, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc, round(f, 6) AS f1, round(g, 6) AS f1_negative, round((f + g) / 2, 6) AS f1_macro
    FROM (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE, 0) AS g FROM bc)""")
def ot_mcc(spark, d):
    return classify.binary_report(_binary(spark, d), ["grp"]).select("grp", *[R(F.col(c), c) for c in ("mcc", "f1", "f1_negative", "f1_macro")])


@query("cb_balanced_acc", ALL + "SELECT round(avg(recall), 6) AS balanced_accuracy FROM pr WHERE tp + fn > 0")
def cb_balanced_acc(spark, d):
    return classify.macro(classify.class_counts(_joined(spark, d), []), []).select(R(F.col("recall"), "balanced_accuracy"))


@query("cb_prf_on", ALL + f"SELECT cls, tp + fp + fn AS relevant, {ROUND_SQL} FROM pr")
def cb_prf_on(spark, d):
    return classify.with_prf(classify.class_counts(_joined(spark, d), [])).select("cls", (F.col("tp") + F.col("fp") + F.col("fn")).alias("relevant"), *_rounded())


ML = """lc AS (SELECT label, sum(y * yhat)::BIGINT AS tp, sum((1 - y) * yhat)::BIGINT AS fp, sum(y * (1 - yhat))::BIGINT AS fn FROM multi GROUP BY label),
    lp AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f FROM lc)"""


@query("td_micro", with_("multi", more=ML) + """SELECT round(sum(tp) / sum(tp + fp)::DOUBLE, 4) AS micro_precision, round(sum(tp) / sum(tp + fn)::DOUBLE, 4) AS micro_recall, round(2 * sum(tp) / sum(2 * tp + fp + fn)::DOUBLE, 4) AS micro_f1 FROM lp""")
def td_micro(spark, d):
    return classify.multilabel(view(spark, d, "multi"), []).select(*[F.round(c, 4).alias(c) for c in ("micro_precision", "micro_recall", "micro_f1")])


@query("td_macro", with_("multi", more=ML) + "SELECT round(avg(p), 4) AS macro_precision, round(avg(r), 4) AS macro_recall, round(avg(f), 4) AS macro_f1 FROM lp")
def td_macro(spark, d):
    return classify.multilabel(view(spark, d, "multi"), []).select(*[F.round(c, 4).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1")])


@query("td_subset_acc", with_("multi") + "SELECT round(avg(same::INT), 6) AS subset_accuracy FROM (SELECT bool_and(y = yhat) AS same FROM multi GROUP BY id)")
def td_subset_acc(spark, d):
    return classify.subset_accuracy(view(spark, d, "multi"), []).select(R(F.col("subset_accuracy"), "subset_accuracy"))


@query("td_slices", with_("multi", more=ML) + """SELECT CASE WHEN label = 'quality' THEN 'top' ELSE 'rest' END AS slice, round(2 * sum(tp) / sum(2 * tp + fp + fn)::DOUBLE, 4) AS micro_f1, round(avg(f), 4) AS macro_f1 FROM lp GROUP BY 1""")
def td_slices(spark, d):
    rows = view(spark, d, "multi").withColumn("slice", F.when(F.col("label") == "quality", "top").otherwise("rest"))
    return classify.multilabel(rows, ["slice"]).select("slice", F.round("micro_f1", 4).alias("micro_f1"), F.round("macro_f1", 4).alias("macro_f1"))


@query("td_auc_macro", with_("multi") + """SELECT round(avg(a), 6) AS auc FROM (SELECT label, (avg(CASE WHEN y = 1 THEN yhat END) + 1 - avg(CASE WHEN y = 0 THEN yhat END)) / 2 AS a FROM multi GROUP BY label)""")
def td_auc_macro(spark, d):
    return scores.auc(view(spark, d, "multi"), ["label"], "y", "yhat").agg(R(F.avg("auc"), "auc"))


@query("td_vector", "SELECT doc_id, [quality, toxic]::BIGINT[] AS vector, list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS names FROM labels")
def td_vector(spark, d):
    names = F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    vector = F.transform(F.array(F.lit("quality"), F.lit("toxic")), lambda label: F.array_contains("names", label).cast("long"))
    return table(spark, d, "labels").withColumn("names", names).select("doc_id", vector.alias("vector"), "names")


@query("ci_report", ALL + """SELECT cls, round(100 * "precision", 4) AS "precision", round(100 * recall, 4) AS recall, round(100 * f1, 4) AS f1, round(100 * avg(f1) OVER (), 4) AS macro_f1,
    round(100 * (SELECT avg((label = pred)::INT) FROM j), 4) AS accuracy FROM pr""")
def ci_report(spark, d):
    j = _joined(spark, d)
    per = classify.with_prf(classify.class_counts(j, []))
    all_ = per.agg(F.avg("f1").alias("macro_f1")).crossJoin(j.agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy")))
    return per.crossJoin(all_).select("cls", *[F.round(100 * F.col(c), 4).alias(c) for c in (*PRF, "macro_f1", "accuracy")])


@query("sc18_accuracy", with_("truth", "run") + """SELECT t.grp, round(sum(coalesce((value > 0.5) = (y = 1), false)::INT) / count(*)::DOUBLE, 6) AS accuracy_all,
    round(sum(coalesce((value > 0.5) = (y = 1), false)::INT) / count(value)::DOUBLE, 6) AS accuracy_solved FROM truth t LEFT JOIN run r ON t.id = r.id GROUP BY t.grp""")
def sc18_accuracy(spark, d):
    rows = view(spark, d, "truth").join(view(spark, d, "run"), "id", "left")
    right = m.count_if(F.coalesce((F.col("value") > 0.5) == (F.col("y") == 1), F.lit(False)))
    return rows.groupBy("grp").agg(R(m.ratio(right, F.count(F.lit(1))), "accuracy_all"), R(m.ratio(right, F.count("value")), "accuracy_solved"))


@query("sc19_oci")
def sc19_oci(spark, d):
    rows = view(spark, d, "seq").withColumn("task", F.col("problem") % 3)
    return classify.ordinal_index(rows, ["task"], "author", "guess").select("task", R(F.col("oci"), "oci"))


@query("sc19_rank")
def sc19_rank(spark, d):
    rows = view(spark, d, "seq").withColumn("task", F.col("problem") % 3)
    accuracy = rows.groupBy("task").agg(F.avg(((F.col("author") > 1) == (F.col("guess") > 1)).cast("double")).alias("accuracy"))
    both = accuracy.join(classify.ordinal_index(rows.filter("author > 1"), ["task"], "author", "guess"), "task")
    return both.select("task", R(F.col("accuracy"), "accuracy"), R(F.col("oci"), "oci"), R((F.col("accuracy") + 1 - F.col("oci")) / 2, "rank"))


F1_SEQ = "(coalesce(2 * sum(y * yhat) / nullif(sum(y + yhat), 0)::DOUBLE, 0) + coalesce(2 * sum((1 - y) * (1 - yhat)) / nullif(sum(2 - y - yhat), 0)::DOUBLE, 0)) / 2"


@query("ma_macro_f1", with_("seq") + f"SELECT round({F1_SEQ}, 6) AS macro_f1 FROM seq")
def ma_macro_f1(spark, d):
    return classify.binary_report(view(spark, d, "seq"), []).select(R(F.col("f1_macro"), "macro_f1"))


@query("sc20_micro_f1", with_("seq") + "SELECT round(avg((y = yhat)::INT), 6) AS micro_f1 FROM seq")
def sc20_micro_f1(spark, d):
    counts = classify.class_counts(view(spark, d, "seq"), [], "y", "yhat")
    return counts.agg(R(m.f1_from_counts(F.sum("tp"), F.sum("fp"), F.sum("fn")), "micro_f1"))


@query("ma_by_difficulty", with_("seq") + f"SELECT CASE problem % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS task, round({F1_SEQ}, 6) AS macro_f1 FROM seq GROUP BY 1")
def ma_by_difficulty(spark, d):
    task = F.when(F.col("problem") % 3 == 0, "easy").when(F.col("problem") % 3 == 1, "medium").otherwise("hard")
    return classify.binary_report(view(spark, d, "seq").withColumn("task", task), ["task"]).select("task", R(F.col("f1_macro"), "macro_f1"))


@query("sc22_relabel", with_("seq") + "SELECT problem, pos, author, dense_rank() OVER (PARTITION BY problem ORDER BY author) - 1 AS ref FROM seq")
def sc22_relabel(spark, d):
    return classify.relabel(view(spark, d, "seq"), ["problem"], "author", "ref").select("problem", "pos", "author", "ref")


DENSE = "de AS (SELECT problem, dense_rank() OVER (PARTITION BY problem ORDER BY author) - 1 AS ref, dense_rank() OVER (PARTITION BY problem ORDER BY guess) - 1 AS sys FROM seq)"
PERMS = """, p4 AS (SELECT row_number() OVER (ORDER BY a, b, c, e) AS k, [a, b, c, e] AS p FROM range(4) x(a), range(4) y(b), range(4) z(c), range(4) w(e) WHERE a <> b AND a <> c AND a <> e AND b <> c AND b <> e AND c <> e),
    ct AS (SELECT problem, ref, sys, count(*) AS n FROM de GROUP BY ALL),
    su AS (SELECT problem, k, sum(n)::BIGINT AS n FROM ct JOIN p4 ON p[ref + 1] = sys GROUP BY ALL),
    be AS (SELECT problem, arg_max(k, n * 1000 - k) AS k, max(n) AS matched FROM su GROUP BY problem),
    asg AS (SELECT problem, i AS ref, p[i + 1] AS sys FROM be JOIN p4 USING (k), range(4) r(i))"""


def _dense(spark, d):
    rows = classify.relabel(view(spark, d, "seq"), ["problem"], "author", "ref")
    return classify.relabel(rows, ["problem"], "guess", "sys")


@query("sc22_contingency", with_("seq", more=DENSE) + "SELECT problem, ref, sys, count(*) AS n FROM de GROUP BY ALL")
def sc22_contingency(spark, d):
    return classify.contingency(_dense(spark, d), ["problem"])


@query("sc22_assign", with_("seq", more=DENSE) + PERMS + "SELECT problem, ref, sys FROM asg")
def sc22_assign(spark, d):
    return classify.best_assignment(_dense(spark, d), ["problem"], size=4).select("problem", "ref", "sys")


ERRORS = with_("seq", more=DENSE) + PERMS + """, rf AS (SELECT problem, ref, sum(n) AS nr FROM ct GROUP BY ALL), sy AS (SELECT problem, sys, sum(n) AS ns FROM ct GROUP BY ALL),
    er AS (SELECT rf.problem, nr, coalesce(ct.n, 0) AS n, 1 - coalesce(ct.n, 0) / (nr + coalesce(ns, 0) - coalesce(ct.n, 0))::DOUBLE AS e FROM rf JOIN asg USING (problem, ref)
           LEFT JOIN sy USING (problem, sys) LEFT JOIN ct ON ct.problem = rf.problem AND ct.ref = rf.ref AND ct.sys = asg.sys)"""


@query("sc22_der", ERRORS + "SELECT problem, round((sum(nr) - sum(n)) / sum(nr)::DOUBLE, 6) AS der FROM er GROUP BY problem")
def sc22_der(spark, d):
    return classify.diarization(_dense(spark, d), ["problem"], size=4).select("problem", R(F.col("der"), "der"))


@query("sc22_jer", ERRORS + "SELECT problem, round(avg(e), 6) AS jer FROM er GROUP BY problem")
def sc22_jer(spark, d):
    return classify.diarization(_dense(spark, d), ["problem"], size=4).select("problem", R(F.col("jer"), "jer"))
