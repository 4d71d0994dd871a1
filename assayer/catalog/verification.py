"""Verification queries: calibrated scores against 0/1 truth."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.catalog.inputs import view, with_
from assayer.functions import measures as m
from assayer.operators import scores
from assayer.registry import query

R = lambda c, name: F.round(c, 6).alias(name)

#: SQL of the measures over columns y and p.
C_AT_1 = "(sum((p <> 0.5 AND (p > 0.5) = (y = 1))::INT) * (1 + sum((p = 0.5)::INT) / count(*)::DOUBLE)) / count(*)::DOUBLE"
TP, FP, FN, OPEN = "sum((p > 0.5 AND y = 1)::INT)", "sum((p > 0.5 AND y = 0)::INT)", "sum((p < 0.5 AND y = 1)::INT)", "sum((p = 0.5)::INT)"
F1 = f"coalesce(2 * {TP} / nullif((2 * {TP} + {FP} + {FN})::DOUBLE, 0), 0)"
F05U = f"coalesce(1.25::DOUBLE * {TP} / nullif((1.25 * {TP} + 0.25 * ({FN} + {OPEN}) + {FP})::DOUBLE, 0), 0)"
BRIER = "1 - avg((p - y) * (p - y))"


def auc_sql(groups: str, rows: str = "scored") -> str:
    """CTE text: ``auc_`` by the rank-sum formula."""
    part = f"PARTITION BY {groups}" if groups else ""
    keys = f"{groups}, " if groups else ""
    return f"""auc_r AS (SELECT {keys}y, rank() OVER ({part} ORDER BY p) + (count(*) OVER (PARTITION BY {keys}p) - 1) / 2.0::DOUBLE AS r FROM {rows}),
        auc_ AS (SELECT {keys}coalesce((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif((sum(y) * (count(*) - sum(y)))::DOUBLE, 0), 0) AS auc
                 FROM auc_r {f"GROUP BY {groups}" if groups else ""})"""


@query("av_report", with_("scored", more=auc_sql("grp")) + f"""
    , parts AS (SELECT grp, count(*) AS n, {C_AT_1} AS c, {F1} AS f, {F05U} AS u, {BRIER} AS b FROM scored GROUP BY grp)
    SELECT grp, n, round(auc, 6) AS auc, round(c, 6) AS c_at_1, round(f, 6) AS f1, round(u, 6) AS f05u, round(b, 6) AS brier, round((auc + c + f + u + b) / 5, 6) AS overall
    FROM parts JOIN auc_ USING (grp)""")
def av_report(spark, d):
    rows = scores.align(view(spark, d, "truth"), view(spark, d, "run"))
    return scores.report(rows, ["grp"]).select("grp", "n", *[R(F.col(c), c) for c in ("auc", "c_at_1", "f1", "f05u", "brier", "overall")])


@query("av_auc", with_("scored", more=auc_sql("grp")) + "SELECT grp, round(auc, 6) AS auc FROM auc_")
def av_auc(spark, d):
    return scores.auc(view(spark, d, "scored"), ["grp"]).select("grp", R(F.col("auc"), "auc"))


@query("av_roc_points", with_("scored") + """
    SELECT grp, p, round(sum(sum(y)) OVER w / sum(sum(y)) OVER g::DOUBLE, 6) AS tpr, round(sum(sum(1 - y)) OVER w / sum(sum(1 - y)) OVER g::DOUBLE, 6) AS fpr
    FROM scored GROUP BY grp, p WINDOW w AS (PARTITION BY grp ORDER BY p DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY grp)""")
def av_roc_points(spark, d):
    points = scores.score_points(view(spark, d, "scored"), ["grp"])
    whole = Window.partitionBy("grp")
    return points.select("grp", "p", R(F.col("tp") / F.sum("pos").over(whole), "tpr"), R(F.col("fp") / F.sum("neg").over(whole), "fpr"))


ROC13 = with_("truth", "run", more="""
    a AS (SELECT t.grp, t.y, r.value AS p FROM truth t LEFT JOIN run r ON t.id = r.id),
    tot AS (SELECT grp, greatest(sum(y), 1)::DOUBLE AS np, greatest(sum(1 - y), 1)::DOUBLE AS nn, sum(CASE WHEN p IS NULL THEN 1 - y ELSE 0 END) AS o FROM a GROUP BY grp),
    c AS (SELECT grp, p, sum(sum(y)) OVER w AS tp, sum(sum(1 - y)) OVER w AS fp FROM a WHERE p IS NOT NULL GROUP BY grp, p WINDOW w AS (PARTITION BY grp ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
    pts AS (SELECT grp, tp AS k, tp / np AS tpr, (fp + o) / nn AS fpr FROM c JOIN tot USING (grp)
            UNION ALL SELECT grp, -1, 0, o / nn FROM tot UNION ALL SELECT grp, np + 1, 1, 1 FROM tot)""")


def _open(spark, d):
    return view(spark, d, "truth").join(view(spark, d, "run").withColumnRenamed("value", "p"), "id", "left")


@query("av13_roc", ROC13 + "SELECT grp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM pts")
def av13_roc(spark, d):
    return scores.roc_with_gaps(_open(spark, d), ["grp"]).select("grp", R(F.col("tpr"), "tpr"), R(F.col("fpr"), "fpr"))


@query("av13_auc", ROC13 + """SELECT grp, round(coalesce(sum((fpr - px) * (tpr + py) / 2), 0), 6) AS auc FROM
    (SELECT *, lag(fpr) OVER w AS px, lag(tpr) OVER w AS py FROM pts WINDOW w AS (PARTITION BY grp ORDER BY fpr, tpr, k)) GROUP BY grp""")
def av13_auc(spark, d):
    return scores.trapezoid(scores.roc_with_gaps(_open(spark, d), ["grp"]), ["grp"]).select("grp", R(F.col("auc"), "auc"))


def _measure(name, expression, sql):
    @query(name, with_("scored") + f"SELECT grp, round({sql}, 6) AS {name} FROM scored GROUP BY grp")
    def run(spark, d):
        return view(spark, d, "scored").groupBy("grp").agg(R(expression(F.col("y"), F.col("p")), name))


_measure("av_c_at_1", m.c_at_1, C_AT_1)
_measure("av_f1_answered", m.f1_answered, F1)
_measure("ga_f1", m.f1_all, f"coalesce(2 * {TP} / nullif((2 * {TP} + {FP} + sum((p <= 0.5 AND y = 1)::INT))::DOUBLE, 0), 0)")
_measure("av_f05u", m.f05u, F05U)
_measure("av_brier", m.brier, BRIER)


@query("av_binarize", with_("scored") + "SELECT id, CASE WHEN p >= 0.6 THEN 1.0::DOUBLE ELSE 0.0 END AS two, CASE WHEN p = 0.5 THEN 0.5::DOUBLE WHEN p >= 0.6 THEN 1.0 ELSE 0.0 END AS three FROM scored")
def av_binarize(spark, d):
    return view(spark, d, "scored").select("id", m.binarize(F.col("p"), 0.6).alias("two"), m.binarize(F.col("p"), 0.6, triple=True).alias("three"))


@query("cls_confusion", with_("scored") + "SELECT grp, y::BIGINT AS y, (p >= 0.5)::BIGINT AS yhat, count(*) AS n FROM scored GROUP BY ALL")
def cls_confusion(spark, d):
    return view(spark, d, "scored").groupBy("grp", F.col("y").cast("long").alias("y"), (F.col("p") >= 0.5).cast("long").alias("yhat")).agg(F.count(F.lit(1)).alias("n"))


@query("av_overall", with_("scored", more=auc_sql("")) + f""", parts AS (SELECT {C_AT_1} AS c, {F1} AS f, {F05U} AS u, {BRIER} AS b FROM scored)
    SELECT round((auc + c + f + u + b) / 5, 6) AS overall, round(auc, 3) AS auc, round(c, 3) AS c_at_1, round(f, 3) AS f1, round(u, 3) AS f05u, round(b, 3) AS brier FROM parts, auc_""")
def av_overall(spark, d):
    one = scores.report(view(spark, d, "scored"), [])
    return one.select(R(F.col("overall"), "overall"), *[F.round(c, 3).alias(c) for c in ("auc", "c_at_1", "f1", "f05u", "brier")])


@query("av_align", with_("truth", "run") + """SELECT t.id, t.y::BIGINT AS y, coalesce(r.value, 0.5) AS p, r.id IS NULL AS imputed FROM truth t LEFT JOIN run r ON t.id = r.id""")
def av_align(spark, d):
    run = view(spark, d, "run")
    both = scores.align(view(spark, d, "truth"), run).join(run.select("id", F.lit(False).alias("imputed")), "id", "left")
    return both.select("id", F.col("y").cast("long").alias("y"), "p", F.coalesce("imputed", F.lit(True)).alias("imputed"))


@query("ga_by_group", with_("scored") + f"""SELECT grp, src, count(*) AS n, round({C_AT_1}, 6) AS c_at_1, round({F05U}, 6) AS f05u, round({BRIER}, 6) AS brier
    FROM scored GROUP BY GROUPING SETS ((grp), (src), ())""")
def ga_by_group(spark, d):
    y, p = F.col("y"), F.col("p")
    grp, src = F.col("grp"), F.col("src")
    return view(spark, d, "scored").groupingSets([[grp], [src], []], grp, src).agg(
        F.count(F.lit(1)).alias("n"), R(m.c_at_1(y, p), "c_at_1"), R(m.f05u(y, p), "f05u"), R(m.brier(y, p), "brier")
    )


@query("ga_best_offset", with_("scored", more="""
    o AS (SELECT k, k * 2 / 1000::DOUBLE - 1 AS offset_ FROM range(1000) AS r(k)),
    v AS (SELECT k, offset_, round(sum(((greatest(0.0, least(1.0, p + offset_)) > 0.5) = (y = 1))::INT) / count(*)::DOUBLE, 9) AS value FROM scored, o GROUP BY ALL),
    w AS (SELECT *, max(value) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS best, first_value(value) OVER (ORDER BY k) AS first FROM v),
    s AS (SELECT *, (SELECT min(k) FROM w WHERE best > first AND value < best - 0.01) AS stop FROM w)""") + """
    SELECT round(arg_max(offset_, value * 1e6 - k * 1e-6), 6) AS "offset", round(max(value), 6) AS value FROM s WHERE stop IS NULL OR k <= stop""")
def ga_best_offset(spark, d):
    right = F.sum(F.when((F.col("q") > 0.5) == (F.col("y") == 1), F.col("w")).otherwise(0)) / F.sum("w")
    return scores.best_offset(view(spark, d, "scored"), F.round(right, 9)).select(R(F.col("offset"), "offset"), R(F.col("value"), "value"))


@query("av13_pr", with_("truth", "run") + """
    SELECT grp, round(sum(ok) / nullif(sum(answered), 0)::DOUBLE, 3) AS "precision", round(sum(ok) / count(*)::DOUBLE, 3) AS recall FROM (
      SELECT t.grp, (value IS NOT NULL AND value <> 0.5)::INT AS answered, coalesce(value <> 0.5 AND (value > 0.5) = (y = 1), false)::INT AS ok FROM truth t LEFT JOIN run r ON t.id = r.id)
    GROUP BY ROLLUP (grp)""")
def av13_pr(spark, d):
    rows = _open(spark, d).select("grp", F.coalesce(F.col("p") != 0.5, F.lit(False)).alias("a"), F.coalesce((F.col("p") != 0.5) & ((F.col("p") > 0.5) == (F.col("y") == 1)), F.lit(False)).alias("ok"))
    return rows.rollup("grp").agg(F.round(m.ratio(m.count_if(F.col("ok")), m.count_if(F.col("a")), None), 3).alias("precision"), F.round(F.avg(F.col("ok").cast("double")), 3).alias("recall"))


@query("av14_final", with_("scored", more=auc_sql("grp") + ", both_ AS (SELECT *, 1 AS one FROM scored), " + auc_sql("one", "both_").replace("auc_r", "all_r").replace("auc_", "all_")) + f"""
    SELECT grp, round(auc * c, 6) AS final FROM (SELECT grp, {C_AT_1} AS c FROM scored GROUP BY grp) JOIN auc_ USING (grp)
    UNION ALL SELECT 'all', round(auc * c, 6) FROM (SELECT {C_AT_1} AS c FROM scored), all_""")
def av14_final(spark, d):
    rows = view(spark, d, "scored")
    each = rows.unionByName(rows.withColumn("grp", F.lit("all")))
    return scores.report(each, ["grp"]).select("grp", R(F.col("auc") * F.col("c_at_1"), "final"))
