"""Clustering, segmentation and span queries."""

from pyspark.sql import functions as F

from assayer.catalog.inputs import table, view, with_
from assayer.operators import clusters, intervals
from assayer.registry import query

R = lambda c, name: F.round(c, 6).alias(name)


def _rounded(last="f"):
    return [R(F.col(c), c) for c in ("precision", "recall", last)]


BC = """tn AS (SELECT problem, cluster, count(*) AS n FROM tclu GROUP BY ALL), an AS (SELECT problem, cluster, count(*) AS n FROM aclu GROUP BY ALL),
    x AS (SELECT t.problem, t.doc, t.cluster AS tc, a.cluster AS ac, tn.n AS nt, coalesce(an.n, 1) AS na,
                 CASE WHEN a.cluster IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY t.problem, t.cluster, a.cluster) END AS nb
          FROM tclu t LEFT JOIN aclu a ON t.problem = a.problem AND t.doc = a.doc JOIN tn ON tn.problem = t.problem AND tn.cluster = t.cluster
          LEFT JOIN an ON an.problem = a.problem AND an.cluster = a.cluster),
    bc AS (SELECT problem, avg(nb / na::DOUBLE) AS p, avg(nb / nt::DOUBLE) AS r FROM x GROUP BY problem)"""
F_SQL = "coalesce(2 * p * r / nullif(p + r, 0), 0)"


@query("cl_bcubed", with_("tclu", "aclu", more=BC) + f"SELECT problem, round(p, 6) AS \"precision\", round(r, 6) AS recall, round({F_SQL}, 6) AS f FROM bc")
def cl_bcubed(spark, d):
    return clusters.bcubed(view(spark, d, "tclu"), view(spark, d, "aclu"), ["problem"]).select("problem", *_rounded())


LINKS = """l AS (SELECT l_suppkey % 20 AS problem, l_partkey AS u, l_suppkey + 100000000 AS v, l_orderkey * 10 + l_linenumber AS ord, ((l_orderkey * 37) % 1009) / 1009::DOUBLE AS score FROM lineitem),
    tl AS (SELECT DISTINCT problem, u, v FROM l WHERE u % 2 = 0 AND ord % 3 <> 0),
    rk AS (SELECT problem, u, v, arg_min(score, ord) AS score FROM l WHERE u % 3 <> 1 GROUP BY ALL),
    h AS (SELECT rk.*, tl.u IS NOT NULL AS hit, row_number() OVER w AS k, sum((tl.u IS NOT NULL)::INT) OVER w AS hits FROM rk LEFT JOIN tl USING (problem, u, v)
          WINDOW w AS (PARTITION BY problem ORDER BY score DESC, u, v)),
    ap AS (SELECT problem, coalesce(s, 0) / n AS ap FROM (SELECT problem, count(*) AS n FROM tl GROUP BY problem) LEFT JOIN (SELECT problem, sum(hits / k::DOUBLE) AS s FROM h WHERE hit GROUP BY problem) USING (problem))"""


def _links(spark, d):
    item = table(spark, d, "lineitem")
    both = item.select((F.col("l_suppkey") % 20).alias("problem"), F.col("l_partkey").alias("u"), (F.col("l_suppkey") + 100000000).alias("v"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), ((F.col("l_orderkey") * 37 % 1009) / 1009).alias("score"))
    swap = F.col("ord") % 2 == 0
    links = both.withColumns({"a": F.when(swap, F.col("v")).otherwise(F.col("u")), "b": F.when(swap, F.col("u")).otherwise(F.col("v"))})
    return links.filter("u % 2 = 0 and ord % 3 <> 0"), links.filter("u % 3 <> 1")


@query("cl_map", "WITH " + LINKS + "SELECT problem, round(ap, 6) AS ap FROM ap")
def cl_map(spark, d):
    return clusters.link_average_precision(*_links(spark, d), ["problem"], "ord").select("problem", R(F.col("ap"), "ap"))


@query("cl_overall", with_("tclu", "aclu", more=BC + ", " + LINKS) + f"SELECT round((SELECT avg({F_SQL}) FROM bc), 6) AS f, round((SELECT avg(ap) FROM ap), 6) AS map")
def cl_overall(spark, d):
    f = clusters.bcubed(view(spark, d, "tclu"), view(spark, d, "aclu"), ["problem"]).agg(R(F.avg("f"), "f"))
    return f.crossJoin(clusters.link_average_precision(*_links(spark, d), ["problem"], "ord").agg(R(F.avg("ap"), "map")))


DZ = """tp AS (SELECT problem, cluster, unnest(range(s, e + 1)) AS x FROM dz_truth), ap AS (SELECT problem, cluster, unnest(range(s, e + 1)) AS x FROM dz_run),
    ts AS (SELECT problem, cluster, count(*) AS n FROM tp GROUP BY ALL), as_ AS (SELECT problem, cluster, count(*) AS n FROM ap GROUP BY ALL),
    ov AS (SELECT tp.problem, tp.cluster AS t, ap.cluster AS a, count(*)::DOUBLE AS n FROM tp JOIN ap ON tp.problem = ap.problem AND tp.x = ap.x GROUP BY ALL),
    top AS (SELECT ov.problem, sum(ov.n * ov.n / as_.n) AS p, sum(ov.n * ov.n / ts.n) AS r FROM ov JOIN ts ON ts.problem = ov.problem AND ts.cluster = ov.t JOIN as_ ON as_.problem = ov.problem AND as_.cluster = ov.a GROUP BY 1),
    dz AS (SELECT t.problem, coalesce(top.p / a.n, 0) AS p, coalesce(top.r / t.n, 0) AS r FROM (SELECT problem, sum(n) AS n FROM ts GROUP BY 1) t LEFT JOIN (SELECT problem, sum(n) AS n FROM as_ GROUP BY 1) a USING (problem) LEFT JOIN top USING (problem))"""


@query("dz_bcubed", with_("dz_truth", "dz_run", more=DZ) + f"SELECT problem, round(p, 6) AS \"precision\", round(r, 6) AS recall, round({F_SQL}, 6) AS f FROM dz")
def dz_bcubed(spark, d):
    return clusters.char_bcubed(view(spark, d, "dz_truth"), view(spark, d, "dz_run"), ["problem"]).select("problem", *_rounded())


@query("dz_cases", with_("dz_truth", more="z AS (SELECT problem, cluster, row_number() OVER (PARTITION BY problem ORDER BY sum(e - s) DESC, cluster) AS k FROM dz_truth GROUP BY problem, cluster)")
    + "SELECT problem, cluster, s AS off, e - s AS len FROM dz_truth JOIN z USING (problem, cluster) WHERE k > 1")
def dz_cases(spark, d):
    return clusters.minor_authors(view(spark, d, "dz_truth"), ["problem"])


@query("dz_overall", with_("dz_truth", "dz_run", more=DZ) + f"SELECT round(avg(p), 6) AS \"precision\", round(avg(r), 6) AS recall, round(avg({F_SQL}), 6) AS f FROM dz")
def dz_overall(spark, d):
    each = clusters.char_bcubed(view(spark, d, "dz_truth"), view(spark, d, "dz_run"), ["problem"])
    return each.agg(*[R(F.avg(c), c) for c in ("precision", "recall", "f")])


WIN = """w AS (SELECT problem, row_number() OVER (PARTITION BY problem ORDER BY pos) AS k, sum(y) OVER v AS g, sum(yhat) OVER v AS h FROM seq
    WINDOW v AS (PARTITION BY problem ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


@query("sb_windowdiff", with_("seq", more=WIN) + "SELECT problem, round(avg((g <> h)::INT), 6) AS windowdiff FROM w WHERE k >= 5 GROUP BY problem")
def sb_windowdiff(spark, d):
    return clusters.window_measures(view(spark, d, "seq"), ["problem"], 5).select("problem", R(F.col("windowdiff"), "windowdiff"))


@query("sb_winpr", with_("seq", more=WIN) + f"""SELECT problem, round(p, 6) AS win_precision, round(r, 6) AS win_recall, round({F_SQL}, 6) AS win_f FROM (
    SELECT problem, coalesce(sum(least(g, h)) / nullif(sum(h), 0)::DOUBLE, 0) AS p, coalesce(sum(least(g, h)) / nullif(sum(g), 0)::DOUBLE, 0) AS r FROM w WHERE k >= 5 GROUP BY problem)""")
def sb_winpr(spark, d):
    return clusters.window_measures(view(spark, d, "seq"), ["problem"], 5).select("problem", *[R(F.col(c), c) for c in ("win_precision", "win_recall", "win_f")])


@query("sb_positions", """WITH b AS (SELECT doc_id AS id, text, list_filter([(n_chars // 5)::BIGINT, (n_chars // 2)::BIGINT, (n_chars - 1)::BIGINT], lambda x: x >= 1 AND x < length(text) - 1) AS bs FROM documents),
    p AS (SELECT id, text, list_transform(bs, lambda x: len(regexp_extract_all(text[1:x + 1], '[^ ] '))) AS positions, len(regexp_extract_all(text[1:greatest(length(text) - 1, 1)], '[^ ] ')) + 1 AS words FROM b)
    SELECT id, positions, words, round_even(words / (len(positions) + 1)::DOUBLE / 2, 0)::BIGINT AS k FROM p""")
def sb_positions(spark, d):
    n = F.col("n_chars")
    borders = F.array((n / 5).cast("long"), (n / 2).cast("long"), n - 1)
    return clusters.border_positions(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", borders.alias("borders")))


SP = """g AS (SELECT id, label, s, e + 1 AS e FROM gold_spans WHERE label <> 'X' AND e >= s), r AS (SELECT id, label, s, e + 1 AS e FROM run_spans WHERE label <> 'X' AND e >= s),
    o AS (SELECT g.id, g.label, (least(g.e, r.e) - greatest(g.s, r.s)) / (r.e - r.s)::DOUBLE AS p, (least(g.e, r.e) - greatest(g.s, r.s)) / (g.e - g.s)::DOUBLE AS q
          FROM g JOIN r ON g.id = r.id AND g.label = r.label AND g.s < r.e AND r.s < g.e)"""


def _spans(spark, d):
    return clusters.clean_spans(view(spark, d, "gold_spans")), clusters.clean_spans(view(spark, d, "run_spans"))


F_PR = "coalesce(2 * p * r / nullif(p + r, 0), 0)"


@query("sp_micro", with_("gold_spans", "run_spans", more=SP) + f"""SELECT round(p, 6) AS "precision", round(r, 6) AS recall, round({F_PR}, 6) AS f1 FROM
    (SELECT sum(p) / (SELECT count(*) FROM r) AS p, sum(q) / (SELECT count(*) FROM g) AS r FROM o)""")
def sp_micro(spark, d):
    return clusters.span_scores(*_spans(spark, d), ["id", "label"]).select(*_rounded("f1"))


LABELS = """(SELECT label, coalesce(coalesce(op, 0) / nr, 0) AS p, coalesce(coalesce({q}, 0) / ng, 0) AS r FROM (SELECT label, count(*) AS ng FROM g GROUP BY 1) FULL JOIN (SELECT label, count(*) AS nr FROM r GROUP BY 1) USING (label)
    LEFT JOIN (SELECT label, sum(p) AS op, sum(q) AS oq FROM o GROUP BY 1) USING (label))"""


@query("sp_label", with_("gold_spans", "run_spans", more=SP) + f"SELECT label, round(p, 6) AS \"precision\", round(r, 6) AS recall, round({F_PR}, 6) AS f1 FROM " + LABELS.format(q="oq"))
def sp_label(spark, d):
    return clusters.span_scores(*_spans(spark, d), ["id", "label"], ["label"]).select("label", *_rounded("f1"))


@query("sp_macro", with_("gold_spans", "run_spans", more=SP) + f"SELECT round(avg(p), 6) AS \"precision\", round(avg(r), 6) AS recall, round(avg({F_PR}), 6) AS f1 FROM " + LABELS.format(q="op"))
def sp_macro(spark, d):
    each = clusters.span_scores(*_spans(spark, d), ["id", "label"], ["label"], compat=True)
    return each.agg(*[R(F.avg(c), c) for c in ("precision", "recall", "f1")])


@query("sp_clean", with_("run_spans") + "SELECT id, label, s, e + 1 AS e FROM run_spans WHERE label <> 'X' AND e >= s")
def sp_clean(spark, d):
    return clusters.clean_spans(view(spark, d, "run_spans")).select("id", "label", "s", "e")


@query("cb_spoiler_from_pos", """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents),
    q AS (SELECT doc_id, ps, len(ps) // 2 AS p1, len(ps) - 1 AS p2 FROM p)
    SELECT doc_id, array_to_string(list_transform(range(p1, p2 + 1), lambda i: CASE WHEN p1 = p2 THEN ps[i + 1][6:25] WHEN i = p1 THEN ps[i + 1][6:] WHEN i = p2 THEN ps[i + 1][1:25] ELSE ps[i + 1] END), ' ') AS spoiler FROM q""")
def cb_spoiler_from_pos(spark, d):
    parts = F.split("text", "\n")
    rows = table(spark, d, "documents").select("doc_id", parts.alias("parts"), F.floor(F.size(parts) / 2).cast("int").alias("p1"), (F.size(parts) - 1).alias("p2"))
    return rows.select("doc_id", spoiler_text(F.col("parts"), F.col("p1"), F.lit(5), F.col("p2"), F.lit(25)).alias("spoiler"))


def spoiler_text(parts, p1, o1, p2, o2):
    """The text from character ``o1`` of part ``p1`` up to ``o2`` of part ``p2``; parts are joined by a blank."""

    def piece(i):
        text = F.element_at(parts, i + 1)
        start, end = F.when(i == p1, o1).otherwise(0), F.when(i == p2, o2).otherwise(F.length(text))
        return F.substring(text, start + 1, F.greatest(F.lit(0), end - start))

    return F.array_join(F.transform(F.sequence(p1, p2), piece), " ")
