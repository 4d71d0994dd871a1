"""Passage-detection queries."""

from pyspark.sql import functions as F

from assayer.catalog.inputs import view, with_
from assayer.functions import measures as m
from assayer.operators import intervals, passages
from assayer.registry import query

R = lambda c, name: F.round(c, 6).alias(name)
COLS = "ref off len sref soff slen ext".split()
C, D = [f"c_{c}" for c in COLS], [f"d_{c}" for c in COLS]

#: Every position of every side of a passage set, for brute-force covers.
PAIRS = """
    pr AS (SELECT c.ref AS c_ref, c.off AS c_off, c.len AS c_len, c.sref AS c_sref, c.soff AS c_soff, c.slen AS c_slen, c.ext AS c_ext,
                  d.ref AS d_ref, d.off AS d_off, d.len AS d_len, d.sref AS d_sref, d.soff AS d_soff, d.slen AS d_slen, d.ext AS d_ext
           FROM cases c JOIN dets d ON c.ref = d.ref AND d.off + d.len > c.off AND d.off < c.off + c.len
             AND (NOT (c.ext AND d.ext) OR (c.sref = d.sref AND d.soff + d.slen > c.soff AND d.soff < c.soff + c.slen))),
    cl AS (SELECT *, c_ref AS ref, greatest(c_off, d_off) AS off, least(c_off + c_len, d_off + d_len) - greatest(c_off, d_off) AS len,
                  CASE WHEN c_ext AND d_ext THEN c_sref ELSE '' END AS sref, CASE WHEN c_ext AND d_ext THEN greatest(c_soff, d_soff) ELSE 0 END AS soff,
                  CASE WHEN c_ext AND d_ext THEN least(c_soff + c_slen, d_soff + d_slen) - greatest(c_soff, d_soff) ELSE 0 END AS slen, c_ext AND d_ext AS ext FROM pr)"""


def points(rows: str, keys: str = "") -> str:
    """A subquery of the distinct (keys, side, doc, position) that ``rows`` covers."""
    k = f"{keys}, " if keys else ""
    return f"""(SELECT DISTINCT {k}1 AS side, ref AS doc, unnest(range(off, off + len)) AS x FROM {rows}
        UNION SELECT DISTINCT {k}2, sref, unnest(range(soff, soff + slen)) FROM {rows})"""


CK, DK = ", ".join(C), ", ".join(D)
RECALLS = PAIRS + f""",
    hc AS (SELECT {CK}, count(*) AS hit FROM {points('cl', CK)} GROUP BY {CK}),
    nc AS (SELECT {CK}, count(*) AS detections FROM cl GROUP BY {CK}),
    rc AS (SELECT {', '.join(f'c.{x} AS c_{x}' for x in COLS)}, coalesce(hit, 0) AS hit, coalesce(detections, 0) AS detections, coalesce(hit, 0) / (c.len + c.slen)::DOUBLE AS recall
           FROM cases c LEFT JOIN hc ON ({', '.join(f'c.{x}' for x in COLS)}) = ({', '.join(f'hc.c_{x}' for x in COLS)})
           LEFT JOIN nc ON ({', '.join(f'c.{x}' for x in COLS)}) = ({', '.join(f'nc.c_{x}' for x in COLS)})),
    hd AS (SELECT {DK}, count(*) AS hit FROM {points('cl', DK)} GROUP BY {DK}),
    rd AS (SELECT {', '.join(f'd.{x} AS d_{x}' for x in COLS)}, coalesce(hit, 0) / (d.len + d.slen)::DOUBLE AS recall
           FROM dets d LEFT JOIN hd ON ({', '.join(f'd.{x}' for x in COLS)}) = ({', '.join(f'hd.d_{x}' for x in COLS)})),
    al AS (SELECT (SELECT avg(recall) FROM rc) AS mr, (SELECT avg(recall) FROM rd) AS mp,
                  coalesce((SELECT avg(detections) FROM rc WHERE detections > 0), 1) AS g,
                  (SELECT count(*) FROM {points('cl')})::DOUBLE AS t, (SELECT count(*) FROM {points('cases')}) AS cc, (SELECT count(*) FROM {points('dets')}) AS dc)"""
BOTH = with_("cases", "dets", more=RECALLS)


def _both(spark, d):
    return view(spark, d, "cases"), view(spark, d, "dets")


@query("pd_overlap_pairs", with_("cases", "dets", more=PAIRS) + "SELECT * FROM pr")
def pd_overlap_pairs(spark, d):
    return passages.overlap_pairs(*_both(spark, d))


@query("pd_overlap_len", with_("cases", "dets", more=PAIRS) + "SELECT c_ref, c_off, d_off, count(*) AS n, sum(len)::BIGINT AS len, sum(slen)::BIGINT AS slen FROM cl GROUP BY ALL")
def pd_overlap_len(spark, d):
    clipped = passages.clip(passages.overlap_pairs(*_both(spark, d)))
    return clipped.groupBy("c_ref", "c_off", "d_off").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len"), F.sum("slen").alias("slen"))


@query("pd_true_detections", with_("cases", "dets", more=PAIRS) + "SELECT ref, off, len, sref, soff, slen, ext FROM cl")
def pd_true_detections(spark, d):
    return passages.clip(passages.overlap_pairs(*_both(spark, d))).select(*COLS)


@query("pd_covered_chars", with_("cases") + f"SELECT ref, count(*) AS covered FROM (SELECT DISTINCT ref, 1 AS side, ref AS doc, unnest(range(off, off + len)) AS x FROM cases UNION SELECT DISTINCT ref, 2, sref, unnest(range(soff, soff + slen)) FROM cases) GROUP BY ref")
def pd_covered_chars(spark, d):
    rows = view(spark, d, "cases").withColumn("at", F.col("ref"))
    return passages.covered_chars(rows, ["at"]).withColumnRenamed("at", "ref")


@query("pd_case_overlap", BOTH + f"SELECT {CK}, hit::BIGINT AS hit, detections FROM rc")
def pd_case_overlap(spark, d):
    return passages.case_recall(*_both(spark, d)).select(*C, F.col("hit").cast("long").alias("hit"), "detections")


@query("pd_case_recall", BOTH + f"SELECT {CK}, round(recall, 6) AS recall FROM rc")
def pd_case_recall(spark, d):
    return passages.case_recall(*_both(spark, d)).select(*C, R(F.col("recall"), "recall"))


PLAG = "CASE WHEN p = 0 AND r = 0 THEN 0 ELSE 2 * p * r / (p + r) / log2(1 + g) END"
for _name, _columns, _sql in (
    ("pd_macro_recall", ["macro_recall"], "round(mr, 6) AS macro_recall"),
    ("pd_macro_precision", ["macro_precision"], "round(mp, 6) AS macro_precision"),
    ("pd_micro", ["micro_recall", "micro_precision"], "round(t / cc, 6) AS micro_recall, round(t / dc, 6) AS micro_precision"),
    ("pd_granularity", ["granularity"], "round(g, 6) AS granularity"),
    ("pd_plagdet", ["macro_plagdet"], f"(SELECT round({PLAG}, 6) FROM (SELECT mr AS r, mp AS p)) AS macro_plagdet"),
    (
        "pd_all",
        ["macro_recall", "macro_precision", "micro_recall", "micro_precision", "granularity", "macro_plagdet", "micro_plagdet"],
        f"""round(mr, 6) AS macro_recall, round(mp, 6) AS macro_precision, round(t / cc, 6) AS micro_recall, round(t / dc, 6) AS micro_precision, round(g, 6) AS granularity,
        (SELECT round({PLAG}, 6) FROM (SELECT mr AS r, mp AS p)) AS macro_plagdet, (SELECT round({PLAG}, 6) FROM (SELECT t / cc AS r, t / dc AS p)) AS micro_plagdet""",
    ),
):

    @query(_name, BOTH + f"SELECT {_sql} FROM al")
    def _one(spark, d, columns=_columns):
        return passages.measures(*_both(spark, d)).select(*[R(F.col(c), c) for c in columns])


@query("pd_pairs_filter", with_("cases", "dets") + "SELECT d.* FROM dets d WHERE (ref, sref) IN (SELECT (ref, sref) FROM cases WHERE off % 120 = 0)")
def pd_pairs_filter(spark, d):
    cases, dets = _both(spark, d)
    return passages.restrict_to_pairs(dets, cases.filter(F.col("off") % 120 == 0)).select(*COLS)


@query("pd_runtime_avg", "SELECT c_mktsegment AS run, count(DISTINCT c_custkey) AS files, round(avg(c_acctbal), 4) AS seconds FROM customer GROUP BY 1")
def pd_runtime_avg(spark, d):
    customer = spark.read.parquet(f"{d}/customer.parquet")
    return customer.groupBy(F.col("c_mktsegment").alias("run")).agg(F.countDistinct("c_custkey").alias("files"), F.round(F.avg("c_acctbal"), 4).alias("seconds"))


SLICED = """SELECT * FROM cases WHERE (sref = '' OR sref = 'src3') AND ref NOT IN (SELECT ref FROM cases WHERE off = 540 AND len % 7 = 0)"""


@query("pd_sliced", with_("cases") + SLICED)
def pd_sliced(spark, d):
    cases = view(spark, d, "cases")
    barred = cases.filter((F.col("off") == 540) & (F.col("len") % 7 == 0)).select("ref")
    return cases.filter((F.col("sref") == "") | (F.col("sref") == "src3")).join(barred, "ref", "left_anti").select(*COLS)


@query("pd_grid", BOTH + """SELECT c_sref AS source, c_ext AS external, count(*) AS n, round(avg(recall), 6) AS recall,
    round(coalesce(avg(CASE WHEN detections > 0 THEN detections END), 1), 6) AS granularity FROM rc GROUP BY CUBE (c_sref, c_ext)""")
def pd_grid(spark, d):
    by_case = passages.case_recall(*_both(spark, d))
    found = F.avg(F.when(F.col("detections") > 0, F.col("detections")))
    return by_case.cube(F.col("c_sref").alias("source"), F.col("c_ext").alias("external")).agg(
        F.count(F.lit(1)).alias("n"), R(F.avg("recall"), "recall"), R(F.coalesce(found, F.lit(1.0)), "granularity")
    )


PASS = BOTH.rstrip() + f""",
    gc AS (SELECT {CK} FROM rc WHERE recall >= 0.4), gd AS (SELECT {DK} FROM rd WHERE recall >= 0.4),
    fo AS (SELECT DISTINCT {CK} FROM cl SEMI JOIN gd USING ({DK}) SEMI JOIN gc USING ({CK})),
    ri AS (SELECT DISTINCT {DK} FROM cl SEMI JOIN gd USING ({DK}) WHERE (len + slen) / (c_len + c_slen)::DOUBLE >= 0.4)"""
PRF = """SELECT found::BIGINT AS found, right_::BIGINT AS "right", round(found / nullif(n_cases, 0)::DOUBLE, 6) AS recall, round(right_ / nullif(n_dets, 0)::DOUBLE, 6) AS "precision" FROM """


def _prf(row):
    return row.select("found", "right", R(F.col("recall"), "recall"), R(F.col("precision"), "precision"))


@query("pd_case_level", PASS + PRF + "(SELECT (SELECT count(*) FROM fo) AS found, (SELECT count(*) FROM ri) AS right_, (SELECT count(*) FROM cases) AS n_cases, (SELECT count(*) FROM dets) AS n_dets)")
def pd_case_level(spark, d):
    return _prf(passages.case_level(*_both(spark, d), 0.4, 0.4))


@query("pd_doc_level", PASS + ", li AS (SELECT DISTINCT ref, sref FROM cases WHERE off % 120 = 0) " + PRF + """(
    SELECT (SELECT count(*) FROM (SELECT DISTINCT c_ref AS ref, c_sref AS sref FROM fo) SEMI JOIN li USING (ref, sref)) AS found,
           (SELECT count(*) FROM (SELECT DISTINCT d_ref AS ref, d_sref AS sref FROM ri) SEMI JOIN li USING (ref, sref)) AS right_,
           (SELECT count(*) FROM (SELECT DISTINCT ref, sref FROM cases)) AS n_cases, (SELECT count(*) FROM (SELECT DISTINCT ref, sref FROM dets)) AS n_dets)""")
def pd_doc_level(spark, d):
    cases, dets = _both(spark, d)
    return _prf(passages.document_level(cases, dets, cases.filter(F.col("off") % 120 == 0), 0.4, 0.4))


@query("fbeta", with_("scored") + """SELECT grp, round(coalesce(1.25 * p * r / nullif(0.25 * p + r, 0), 0), 6) AS f05, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM (
    SELECT grp, sum((p > 0.5 AND y = 1)::INT) / nullif(sum((p > 0.5)::INT), 0)::DOUBLE AS p, sum((p > 0.5 AND y = 1)::INT) / nullif(sum(y), 0)::DOUBLE AS r FROM scored GROUP BY grp)""")
def fbeta(spark, d):
    y, p = F.col("y"), F.col("p")
    pr = view(spark, d, "scored").groupBy("grp").agg(
        m.ratio(m.count_if((p > 0.5) & (y == 1)), m.count_if(p > 0.5)).alias("p"), m.ratio(m.count_if((p > 0.5) & (y == 1)), m.count_if(y == 1)).alias("r")
    )
    return pr.select("grp", R(m.f_beta(F.col("p"), F.col("r"), 0.5), "f05"), R(m.f_beta(F.col("p"), F.col("r")), "f1"))


@query("sp_flatten", with_("run_spans") + """, r AS (SELECT id, label, s, e + 1 AS e, max(e + 1) OVER (PARTITION BY id, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM run_spans WHERE label <> 'X' AND e >= s),
    g AS (SELECT *, sum((reach IS NULL OR s > reach)::INT) OVER (PARTITION BY id, label ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM r)
    SELECT id, label, min(s) AS s, max(e) AS e, count(*) AS parts FROM g GROUP BY id, label, k""")
def sp_flatten(spark, d):
    rows = view(spark, d, "run_spans").filter((F.col("label") != "X") & (F.col("e") >= F.col("s"))).withColumn("e", F.col("e") + 1)
    return intervals.islands(rows, ["id", "label"])
