"""Meta-analysis over the runs of many systems."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.catalog.inputs import table, view, with_
from assayer.catalog.verification import BRIER, C_AT_1, F05U, F1, auc_sql
from assayer.functions import measures as m
from assayer.operators import scores
from assayer.registry import query

R = lambda c, name: F.round(c, 6).alias(name)


@query("mt_pivot", with_("systems") + "SELECT id, max(CASE WHEN system = 's1' THEN p END) AS s1, max(CASE WHEN system = 's2' THEN p END) AS s2, max(CASE WHEN system = 's3' THEN p END) AS s3, max(CASE WHEN system = 's4' THEN p END) AS s4 FROM systems GROUP BY id")
def mt_pivot(spark, d):
    return view(spark, d, "systems").groupBy("id").pivot("system", ["s1", "s2", "s3", "s4"]).agg(F.max("p"))


@query("mt_leaderboard", with_("systems", more=auc_sql("system", "systems")) + f"""SELECT *, rank() OVER (ORDER BY overall DESC) AS place FROM (SELECT system, round((auc + c + f + u + b) / 5, 6) AS overall, round(auc, 6) AS auc
    FROM (SELECT system, {C_AT_1} AS c, {F1} AS f, {F05U} AS u, {BRIER} AS b FROM systems GROUP BY system) JOIN auc_ USING (system))""")
def mt_leaderboard(spark, d):
    board = scores.report(view(spark, d, "systems"), ["system"]).select("system", R(F.col("overall"), "overall"), R(F.col("auc"), "auc"))
    return board.withColumn("place", F.rank().over(Window.orderBy(F.col("overall").desc())).cast("long"))  # a row per system


@query("mt_nonanswers", with_("systems") + "SELECT system, sum((p = 0.5)::INT)::BIGINT AS n FROM systems GROUP BY system")
def mt_nonanswers(spark, d):
    return view(spark, d, "systems").groupBy("system").agg(m.count_if(F.col("p") == 0.5).alias("n"))


@query("mt_answered_only", with_("systems") + f"SELECT system, count(*) AS n, round({C_AT_1}, 6) AS c_at_1, round({BRIER}, 6) AS brier FROM systems WHERE p <> 0.5 GROUP BY system")
def mt_answered_only(spark, d):
    y, p = F.col("y"), F.col("p")
    return view(spark, d, "systems").filter("p <> 0.5").groupBy("system").agg(F.count(F.lit(1)).alias("n"), R(m.c_at_1(y, p), "c_at_1"), R(m.brier(y, p), "brier"))


@query("mt_ensemble", with_("systems") + "SELECT grp, round(avg(((s > 0.5) = (y = 1))::INT), 6) AS accuracy FROM (SELECT id, grp, max(y) AS y, round(avg(p), 9) AS s FROM systems GROUP BY id, grp) GROUP BY grp")
def mt_ensemble(spark, d):
    each = view(spark, d, "systems").groupBy("id", "grp").agg(F.max("y").alias("y"), F.round(F.avg("p"), 9).alias("s"))
    return each.groupBy("grp").agg(R(F.avg(((F.col("s") > 0.5) == (F.col("y") == 1)).cast("double")), "accuracy"))


@query("mt_regression", with_("systems") + "SELECT system, (p > 0.5) = (y = 1) AS correct, count(*) AS n, round(regr_slope(p, (id % 50)::DOUBLE), 6) AS slope, round(regr_intercept(p, (id % 50)::DOUBLE), 6) AS intercept, round(regr_r2(p, (id % 50)::DOUBLE), 6) AS r2 FROM systems GROUP BY ALL")
def mt_regression(spark, d):
    x, p = (F.col("id") % 50).cast("double"), F.col("p")
    rows = view(spark, d, "systems").groupBy("system", ((p > 0.5) == (F.col("y") == 1)).alias("correct"))
    return rows.agg(F.count(F.lit(1)).alias("n"), R(F.regr_slope(p, x), "slope"), R(F.regr_intercept(p, x), "intercept"), R(F.regr_r2(p, x), "r2"))


@query("mt_pr_curve", with_("systems") + """SELECT system, p, round(sum(sum(y)) OVER w / sum(count(*)) OVER w::DOUBLE, 6) AS "precision", round(sum(sum(y)) OVER w / sum(sum(y)) OVER g::DOUBLE, 6) AS recall
    FROM systems GROUP BY system, p WINDOW w AS (PARTITION BY system ORDER BY p DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY system)""")
def mt_pr_curve(spark, d):
    points = scores.score_points(view(spark, d, "systems"), ["system"])
    total = F.sum("pos").over(Window.partitionBy("system"))
    return points.select("system", "p", R(F.col("tp") / (F.col("tp") + F.col("fp")), "precision"), R(F.col("tp") / total, "recall"))


@query("mt_threshold_agreement", with_("systems") + """SELECT system, k / 10::DOUBLE AS threshold, round(avg(((p >= k / 10::DOUBLE) = (y = 1))::INT), 6) AS accuracy, sum((p >= k / 10::DOUBLE AND y = 0)::INT)::BIGINT AS fp, sum((p < k / 10::DOUBLE AND y = 1)::INT)::BIGINT AS fn
    FROM systems, range(1, 10) t(k) GROUP BY ALL""")
def mt_threshold_agreement(spark, d):
    ks = F.broadcast(spark.range(1, 10).select((F.col("id") / 10).alias("threshold")))
    cell = scores.threshold_cells(F.col("p"), lambda k: (k + 1) / 10, F.col("p") * 10 - 1, 9)
    counts = view(spark, d, "systems").groupBy("system", cell.alias("cell")).agg(F.min("p").alias("p"), m.count_if(F.col("y") == 1).alias("pos"), m.count_if(F.col("y") == 0).alias("neg"))
    over = F.col("p") >= F.col("threshold")
    right = F.sum(F.when(over, F.col("pos")).otherwise(F.col("neg")))
    sums = counts.crossJoin(ks).groupBy("system", "threshold")
    return sums.agg(R(right / F.sum(F.col("pos") + F.col("neg")), "accuracy"), F.sum(F.when(over, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(over, F.lit(0)).otherwise(F.col("pos"))).alias("fn"))


@query("mt_tag_threshold", with_("scored") + "SELECT id, grp, p >= CASE grp WHEN 'en' THEN 0.6 WHEN 'de' THEN 0.4 ELSE 0.5 END AS accepted FROM scored")
def mt_tag_threshold(spark, d):
    limit = F.when(F.col("grp") == "en", 0.6).when(F.col("grp") == "de", 0.4).otherwise(0.5)
    return view(spark, d, "scored").select("id", "grp", (F.col("p") >= limit).alias("accepted"))


@query("cb_project", "SELECT doc_id, lang, n_chars FROM documents")
def cb_project(spark, d):
    return table(spark, d, "documents").drop("text", "source")
