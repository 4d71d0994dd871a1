"""Queries on generated texts."""

from pyspark.sql import functions as F

from assayer.catalog.inputs import table, view, with_
from assayer.functions import measures as m
from assayer.functions import text as tx
from assayer.operators import similarity as sim
from assayer.registry import query

R = lambda c, name: F.round(c, 6).alias(name)
W = r"[\p{L}\p{N}_'']+"
STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def _pairs(spark, d, stop=False):
    rows = view(spark, d, "pairs")
    clean = (lambda c: F.transform(F.filter(c, lambda t: ~t.isin(*tx.STOP_WORDS)), lambda t: F.lower(t))) if stop else (lambda c: c)
    return rows.select("conv_id", "turn", clean(tx.words(F.col("hyp"))).alias("h"), clean(tx.words(F.col("ref"))).alias("r"))


def grams(keys: str, orders: int, rows: str = "tk") -> str:
    """CTEs: ``mt``: per keys and n the clipped matches and counts of token arrays h and r."""
    k = keys
    return f"""gh AS (SELECT {k}, n, array_to_string(h[i:i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT {k}, h, n, unnest(range(1, greatest(len(h) - n + 2, 1))) AS i FROM {rows}, range(1, {orders + 1}) o(n)) GROUP BY ALL),
    gr AS (SELECT {k}, n, array_to_string(r[i:i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT {k}, r, n, unnest(range(1, greatest(len(r) - n + 2, 1))) AS i FROM {rows}, range(1, {orders + 1}) o(n)) GROUP BY ALL),
    bo AS (SELECT {k}, n, g, coalesce(gh.c, 0) AS ch, coalesce(gr.c, 0) AS cr FROM gh FULL JOIN gr USING ({k}, n, g)),
    mt AS (SELECT {k}, n, sum(least(ch, cr))::DOUBLE AS m, sum(ch) AS nh, sum(cr) AS nr FROM bo GROUP BY ALL)"""


TK = f"tk AS (SELECT conv_id, turn, regexp_extract_all(hyp, '{W}') AS h, regexp_extract_all(ref, '{W}') AS r FROM pairs)"
TS = f"""tk AS (SELECT conv_id, turn, list_transform(list_filter(regexp_extract_all(hyp, '{W}'), lambda t: t NOT IN ({STOP})), lambda t: lower(t)) AS h,
    list_transform(list_filter(regexp_extract_all(ref, '{W}'), lambda t: t NOT IN ({STOP})), lambda t: lower(t)) AS r FROM pairs)"""
BP = "CASE WHEN lh >= lr THEN 1 WHEN lh = 0 THEN 0 ELSE exp(1 - lr / lh::DOUBLE) END"


@query("tx_bleu", with_("pairs", more=TS + ", " + grams("conv_id, turn", 4) + f""", le AS (SELECT conv_id, turn, len(h) AS lh, len(r) AS lr, least(4, greatest(1, least(len(h), len(r)))) AS o FROM tk),
    sc AS (SELECT conv_id, turn, sum(CASE WHEN n <= o THEN ln(nullif(m, 0) / nh) END) AS s, count(*) FILTER (n <= o AND m > 0) AS good FROM le JOIN mt USING (conv_id, turn) GROUP BY ALL)""") + f"""
    SELECT conv_id, turn, round(CASE WHEN coalesce(good, 0) < o THEN 0 ELSE ({BP}) * exp(s / o) END, 6) AS bleu FROM le LEFT JOIN sc USING (conv_id, turn)""")
def tx_bleu(spark, d):
    return sim.sentence_bleu(_pairs(spark, d, stop=True), ["conv_id", "turn"], "h", "r", adaptive=True).select("conv_id", "turn", R(F.col("bleu"), "bleu"))


SPLIT = "list_filter(list_transform(regexp_split_to_array({c}, '[.!?]+[ \\n]*'), lambda s: trim(s)), lambda s: s <> '')"
TSENT = f"""ss AS (SELECT conv_id, turn, {SPLIT.format(c='hyp')} AS hs, {SPLIT.format(c='ref')} AS rs FROM pairs),
    tk AS (SELECT conv_id, turn, sent, regexp_extract_all(hs[sent], '{W}') AS h, regexp_extract_all(rs[sent], '{W}') AS r FROM (SELECT *, unnest(range(1, least(len(hs), len(rs)) + 1)) AS sent FROM ss))"""


@query("tx_bleu_sent", with_("pairs", more=TSENT + ", " + grams("conv_id, turn, sent", 4) + f""", le AS (SELECT conv_id, turn, sent, len(h) AS lh, len(r) AS lr FROM tk),
    p AS (SELECT conv_id, turn, sent, n, coalesce(m, 0) AS m, coalesce(nh, 0) AS nh FROM (SELECT * FROM le, range(1, 5) o(n)) LEFT JOIN mt USING (conv_id, turn, sent, n)),
    sc AS (SELECT conv_id, turn, sent, sum(ln(CASE WHEN m > 0 THEN m ELSE 0.1 END / greatest(nh, 1))) AS s, max(CASE WHEN n = 1 THEN m END) AS m1 FROM p GROUP BY ALL)""") + f"""
    SELECT round(avg(b), 6) AS bleu FROM (SELECT conv_id, turn, avg(CASE WHEN m1 = 0 THEN 0 ELSE ({BP}) * exp(s / 4) END) AS b FROM le JOIN sc USING (conv_id, turn, sent) GROUP BY ALL)""")
def tx_bleu_sent(spark, d):
    rows = view(spark, d, "pairs").select("conv_id", "turn", F.posexplode(F.arrays_zip(tx.sentences(F.col("hyp")).alias("h"), tx.sentences(F.col("ref")).alias("r"))).alias("i", "x"))
    rows = rows.filter("x.h is not null and x.r is not null").select("conv_id", "turn", "i", tx.words(F.col("x.h")).alias("h"), tx.words(F.col("x.r")).alias("r"))
    each = sim.sentence_bleu(rows, ["conv_id", "turn", "i"], "h", "r", epsilon=0.1)
    return each.groupBy("conv_id", "turn").agg(F.avg("bleu").alias("b")).agg(R(F.avg("b"), "bleu"))


@query("tx_corpus_bleu", with_("pairs", more=TK.replace("turn, regexp", "turn, turn % 2 AS part, regexp", 1) + ", " + grams("conv_id, turn, part", 4)) + f"""
    SELECT part, round(({BP}) * exp(s / 4), 6) AS bleu FROM (SELECT part, sum(ln(m / nh)) AS s FROM (SELECT part, n, sum(m) AS m, sum(nh) AS nh FROM mt GROUP BY ALL) GROUP BY part)
    JOIN (SELECT part, sum(len(h)) AS lh, sum(len(r)) AS lr FROM tk GROUP BY part) USING (part)""")
def tx_corpus_bleu(spark, d):
    rows = _pairs(spark, d).withColumn("part", F.col("turn") % 2)
    return sim.corpus_bleu(rows, ["conv_id", "turn"], ["part"], "h", "r").select("part", R(F.col("bleu"), "bleu"))


@query("tx_nist", with_("pairs", more=TK.replace("turn, regexp", "turn, turn % 2 AS part, regexp", 1) + ", " + grams("conv_id, turn, part", 5)) + """,
    gs AS (SELECT part, n, g, sum(least(ch, cr)) AS m, sum(ch) AS h, sum(cr) AS r FROM bo GROUP BY ALL), le AS (SELECT part, sum(len(h))::DOUBLE AS lh, sum(len(r))::DOUBLE AS lr FROM tk GROUP BY part),
    ino AS (SELECT a.part, a.n, sum(CASE WHEN a.m > 0 THEN a.m * log2(CASE WHEN a.n = 1 THEN lr ELSE b.r END / a.r) ELSE 0 END) AS i, sum(a.h) AS h FROM gs a JOIN le ON le.part = a.part
        LEFT JOIN gs b ON b.part = a.part AND b.n = a.n - 1 AND b.g = regexp_replace(a.g, ' [^ ]*$', '') GROUP BY ALL)
    SELECT part, round(sum(coalesce(i / nullif(h, 0), 0)) * max(exp(ln(0.5) / pow(ln(1.5), 2) * pow(ln(least(1, lh / lr)), 2))), 6) AS nist FROM ino JOIN le USING (part) GROUP BY part""")
def tx_nist(spark, d):
    rows = _pairs(spark, d).withColumn("part", F.col("turn") % 2)
    return sim.corpus_nist(rows, ["conv_id", "turn"], ["part"], "h", "r").select("part", R(F.col("nist"), "nist"))


@query("tx_chrf", with_("pairs", more="tk AS (SELECT conv_id, turn, string_split(regexp_replace(hyp, '[ \\t\\n]+', '', 'g'), '') AS h, string_split(regexp_replace(ref, '[ \\t\\n]+', '', 'g'), '') AS r FROM pairs), " + grams("conv_id, turn", 6)) + """
    SELECT conv_id, turn, round(coalesce(5 * p * q / nullif(4 * p + q, 0), 0), 6) AS chrf FROM tk LEFT JOIN (SELECT conv_id, turn, avg(m / nh) AS p, avg(m / nr) AS q FROM mt WHERE nh > 0 AND nr > 0 GROUP BY ALL) USING (conv_id, turn)""")
def tx_chrf(spark, d):
    return sim.chrf(view(spark, d, "pairs"), ["conv_id", "turn"], "hyp", "ref").select("conv_id", "turn", R(F.col("chrf"), "chrf"))


METEOR_SQL = """SELECT id, round(coalesce(1 / (0.85 / nullif(p, 0) + 0.15 / nullif(r, 0)), 0) * (1 - 0.6 * pow(CASE WHEN id % 10 = 0 THEN 0 ELSE chunks / matched END, 0.2)), 6) AS meteor FROM (
    SELECT doc_id AS id, (0.75::DOUBLE * (doc_id % 5) + 0.25 * (doc_id % 3)) / (0.75 * 6 + 0.25 * 4) AS p, (0.75::DOUBLE * (doc_id % 5) + 0.25 * (doc_id % 3)) / (0.75 * 7 + 0.25 * 3) AS r,
           (doc_id % 4 + 1)::DOUBLE AS chunks, (doc_id % 6 + 4)::DOUBLE AS matched FROM documents)"""


@query("tx_meteor_formula", METEOR_SQL)
def tx_meteor_formula(spark, d):
    i = F.col("doc_id")
    p = sim.weighted_share(i % 5, i % 3, F.lit(6), F.lit(4))
    r = sim.weighted_share(i % 5, i % 3, F.lit(7), F.lit(3))
    score = sim.meteor(p, r, (i % 4 + 1).cast("double"), (i % 6 + 4).cast("double"), i % 10 == 0)
    return table(spark, d, "documents").select(i.alias("id"), R(score, "meteor"))


STA = "greatest((t_out + (t_in <= t_out)::INT) / 2, (t_ref <= t_out)::INT)"


@query("dx_sim", with_("detox") + "SELECT id, round(0.4 * sim_orig + 0.6 * sim_ref, 6) AS sim FROM detox")
def dx_sim(spark, d):
    return view(spark, d, "detox").select("id", R(sim.detox_similarity(F.col("sim_orig"), F.col("sim_ref")), "sim"))


@query("dx_sta", with_("detox") + f"SELECT id, round({STA}, 6) AS sta FROM detox")
def dx_sta(spark, d):
    return view(spark, d, "detox").select("id", R(sim.detox_neutrality(F.col("t_in"), F.col("t_out"), F.col("t_ref")), "sta"))


@query("dx_joint", with_("detox") + f"SELECT lang, round(avg({STA}), 6) AS sta, round(avg(0.4 * sim_orig + 0.6 * sim_ref), 6) AS sim, round(avg({STA} * (0.4 * sim_orig + 0.6 * sim_ref) * fluency), 6) AS j FROM detox GROUP BY lang")
def dx_joint(spark, d):
    sta, s = sim.detox_neutrality(F.col("t_in"), F.col("t_out"), F.col("t_ref")), sim.detox_similarity(F.col("sim_orig"), F.col("sim_ref"))
    return view(spark, d, "detox").groupBy("lang").agg(R(F.avg(sta), "sta"), R(F.avg(s), "sim"), R(F.avg(sta * s * F.col("fluency")), "j"))


@query("wm_rates", with_("marks") + """SELECT type, round(avg((truth = 1 AND label = 1)::INT), 6) AS tp, round(avg((truth = 0 AND label = 0)::INT), 6) AS tn, round(avg((truth = 0 AND label = 1)::INT), 6) AS fp,
    round(avg((truth = 1 AND label = 0)::INT), 6) AS fn FROM marks GROUP BY type""")
def wm_rates(spark, d):
    t, p = F.col("truth") == 1, F.col("label") == 1
    share = lambda c, name: R(F.avg(c.cast("double")), name)
    return view(spark, d, "marks").groupBy("type").agg(share(t & p, "tp"), share(~t & ~p, "tn"), share(~t & p, "fp"), share(t & ~p, "fn"))


BA = "(coalesce(avg(CASE WHEN truth = 1 THEN label END), 0) + coalesce(avg(CASE WHEN truth = 0 THEN 1 - label END), 0)) / (count(DISTINCT truth))"


@query("wm_twf", with_("marks") + f"SELECT round(avg(twf), 6) AS mean_twf, round((SELECT {BA} * greatest(avg(bleu), avg(bert)) FROM marks), 6) AS overall_twf FROM (SELECT id, type, greatest(max(bleu), max(bert)) * {BA} AS twf FROM marks GROUP BY id, type)")
def wm_twf(spark, d):
    marks = view(spark, d, "marks")
    recall = lambda v: F.avg(F.when(F.col("truth") == v, (F.col("label") == v).cast("double")))
    balanced = (F.coalesce(recall(1), F.lit(0.0)) + F.coalesce(recall(0), F.lit(0.0))) / F.size(F.collect_set("truth"))
    each = marks.groupBy("id", "type").agg((F.greatest(F.max("bleu"), F.max("bert")) * balanced).alias("twf"))
    overall = marks.agg(R(balanced * F.greatest(F.avg("bleu"), F.avg("bert")), "overall_twf"))
    return each.agg(R(F.avg("twf"), "mean_twf")).crossJoin(overall)


@query("ga_length", with_("pairs") + "SELECT conv_id, turn, (length(hyp) > length(ref))::DOUBLE AS score FROM pairs")
def ga_length(spark, d):
    return view(spark, d, "pairs").select("conv_id", "turn", (F.length("hyp") > F.length("ref")).cast("double").alias("score"))


@query("ga_comparative", with_("detox") + """SELECT id, round(CASE WHEN t_in > t_out + 0.001 THEN (1 - t_out) / 2 + 0.5 WHEN t_out > t_in + 0.001 THEN t_in / 2 ELSE 0.5 END, 6) AS score FROM detox""")
def ga_comparative(spark, d):
    return view(spark, d, "detox").select("id", R(sim.comparative(F.col("t_in"), F.col("t_out")), "score"))


@query("ga_band", with_("detox") + "SELECT id, round(CASE WHEN abs(t_in - 0.5) < 0.1 THEN 0.5 ELSE t_in END, 6) AS score FROM detox")
def ga_band(spark, d):
    return view(spark, d, "detox").select("id", R(F.when(F.abs(F.col("t_in") - 0.5) < 0.1, 0.5).otherwise(F.col("t_in")), "score"))


@query("lm_ratio", with_("detox") + "SELECT id, round(1 / (1 + exp(10 * 0.9015 * ((t_in + 0.1) / (t_out + 0.1) - 0.9015))), 6) AS binoculars, round(1 / (1 + exp(-10 * ((t_in + 0.1) / (t_ref + 0.1) - 2))), 6) AS lrr FROM detox")
def lm_ratio(spark, d):
    s, lrr = (F.col("t_in") + 0.1) / (F.col("t_out") + 0.1), (F.col("t_in") + 0.1) / (F.col("t_ref") + 0.1)
    theta = 0.9015
    return view(spark, d, "detox").select("id", R(m.sigmoid(-10 * theta * (s - theta)), "binoculars"), R(m.sigmoid(10 * (lrr - 2)), "lrr"))


@query("lm_curvature", with_("detox") + """SELECT lang, round(1 / (1 + exp(-2 * (z - 2.1))), 6) AS detectgpt, round(1 / (1 + exp(-(z * 40 - 70) / 25)), 6) AS fast FROM
    (SELECT lang, (avg(t_in) - avg(t_out)) / stddev_pop(t_out) AS z FROM detox GROUP BY lang)""")
def lm_curvature(spark, d):
    z = view(spark, d, "detox").groupBy("lang").agg(((F.avg("t_in") - F.avg("t_out")) / F.stddev_pop("t_out")).alias("z"))
    return z.select("lang", R(m.sigmoid(2 * (F.col("z") - 2.1)), "detectgpt"), R(m.sigmoid((F.col("z") * 40 - 70) / 25), "fast"))
