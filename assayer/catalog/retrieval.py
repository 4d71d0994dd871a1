"""Passage alignment, retrieval and embedding queries."""

from pyspark.sql import functions as F

from assayer.catalog.inputs import table, view, with_
from assayer.functions import text as tx
from assayer.operators import retrieval as rt
from assayer.registry import query

R = lambda c, name: F.round(c, 6).alias(name)
W = r"[\p{L}\p{N}_'']+"
IGN = rt.IGNORED
N = 50


def plain(rows: str, key: str) -> str:
    """A subquery of n-grams of kept characters with their place, over a list of characters."""
    return f"""(SELECT {key}, i - 1 AS pos, array_to_string(cs[i:i + {N - 1}], '') AS gram FROM (SELECT {key}, cs, unnest(range(1, greatest(len(cs) - {N - 2}, 1))) AS i FROM
        (SELECT {key}, string_split(lower(regexp_replace(text, '{IGN}', '', 'g')), '') AS cs FROM {rows})))"""


@query("ta_char_ngrams", f"""WITH c AS (SELECT item_id, i - 1 AS i, cs[i] AS ch FROM (SELECT item_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM (SELECT item_id, string_split(text, '') AS cs FROM benchmark))),
    k AS (SELECT item_id, i, row_number() OVER w - 1 AS pos, lead(i, {N - 1}) OVER w AS last FROM c WHERE NOT regexp_matches(ch, '^{IGN}$') WINDOW w AS (PARTITION BY item_id ORDER BY i))
    SELECT item_id, pos, i AS start, last + 1 AS "end", gram FROM k JOIN {plain('benchmark', 'item_id')} g USING (item_id, pos) WHERE last IS NOT NULL""")
def ta_char_ngrams(spark, d):
    grams = rt.char_grams_at(table(spark, d, "benchmark"), "item_id", "text", N)
    return grams.select("item_id", *[F.col(c).cast("long").alias(c) for c in ("pos", "start", "end")], "gram")


def _seeds(spark, d):
    return rt.seed_matches(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", "text", N)


@query("ta_seed_matches")
def ta_seed_matches(spark, d):
    return _seeds(spark, d).select("doc_id", "item_id", F.col("left_pos").cast("long").alias("left_pos"), F.col("right_pos").cast("long").alias("right_pos"))


@query("ta_islands")
def ta_islands(spark, d):
    runs = rt.diagonal_islands(_seeds(spark, d), ["doc_id", "item_id"], N)
    return runs.select("doc_id", "item_id", *[F.col(c).cast("long").alias(c) for c in ("left_start", "left_end", "right_start")])


@query("tok_words", f"SELECT conv_id, turn, regexp_extract_all(text, '{W}') AS words FROM conversations")
def tok_words(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.words(F.col("text")).alias("words"))


@query("sr_queries", f"""WITH t AS (SELECT doc_id, w FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{W}'))) AS w FROM documents)),
    r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY md5(w), w) - 1 AS k FROM t)
    SELECT doc_id, k // 3 AS q, string_agg(w, ' ' ORDER BY k) AS query FROM r WHERE k < 6 GROUP BY ALL""")
def sr_queries(spark, d):
    """Two queries of three words each, drawn by a hash of the word."""
    ordered = F.array_sort(F.transform(F.array_distinct(tx.words(F.col("text"))), lambda w: F.struct(F.md5(w).alias("h"), w.alias("w"))))
    drawn = table(spark, d, "documents").select("doc_id", ordered.alias("o")).select("doc_id", F.posexplode(F.array(F.slice("o", 1, 3), F.slice("o", 4, 3))).alias("q", "t"))
    return drawn.filter(F.size("t") > 0).select("doc_id", F.col("q").cast("long").alias("q"), F.array_join(F.transform("t", lambda x: x["w"]), " ").alias("query"))


@query("sr_until_first", """WITH l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, value > 15 AS hit FROM events),
    f AS (SELECT *, min(CASE WHEN hit THEN place END) OVER (PARTITION BY user_id) AS first FROM l)
    SELECT user_id, sum((event_type = 'search')::INT)::BIGINT AS queries, sum((event_type <> 'search')::INT)::BIGINT AS downloads, coalesce(sum((event_type = 'search' AND place <= first)::INT), 0)::BIGINT AS queries_until,
           coalesce(sum((event_type <> 'search' AND place <= first)::INT), 0)::BIGINT AS downloads_until, max(first) IS NOT NULL AS found FROM f GROUP BY user_id""")
def sr_until_first(spark, d):
    return rt.until_first(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", "search", F.col("value") > 15)


PARA = "p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS para, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"


@query("txt_paragraphs", "WITH " + PARA + " SELECT doc_id, i, para FROM p WHERE trim(para) <> ''")
def txt_paragraphs(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "para"))
    return rows.filter(F.trim("para") != "").select("doc_id", F.col("i").cast("long").alias("i"), "para")


@query("txt_offset_para", "WITH " + PARA + " SELECT doc_id, i, coalesce(sum(length(para) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p")
def txt_offset_para(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "para"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.coalesce(F.sum(F.length("para") + 1).over(before), F.lit(0)).cast("long").alias("start"))


EMB = """m AS (SELECT a.vec_id // 20 AS pair, a.vec_id AS i, b.vec_id AS j, a.label = b.label AS positive,
    list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS sim
    FROM embeddings a JOIN embeddings b ON a.vec_id // 20 = b.vec_id // 20 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"""


def _sims(spark, d):
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("pair"), "vec_id", "label", F.col("embedding").alias("vector"))
    left = e.filter("vec_id % 2 = 0").select("pair", F.col("vec_id").alias("i"), "vector")
    right = e.filter("vec_id % 2 = 1").select("pair", F.col("vec_id").alias("j"), "vector")
    sims = rt.cosine_matrix(left, right, ["pair"])
    labels = e.select("vec_id", "label")
    sims = sims.join(labels.select(F.col("vec_id").alias("i"), F.col("label").alias("li")), "i").join(labels.select(F.col("vec_id").alias("j"), F.col("label").alias("lj")), "j")
    return sims.select("pair", "i", "j", "sim", (F.col("li") == F.col("lj")).alias("positive"))


@query("emb_cosine_matrix", "WITH " + EMB + " SELECT pair, i, j, round(sim, 5) AS sim FROM m")
def emb_cosine_matrix(spark, d):
    return _sims(spark, d).select("pair", "i", "j", F.round("sim", 5).alias("sim"))


@query("emb_sim_split", "WITH " + EMB + " SELECT positive, count(*) AS n, round(avg(sim), 6) AS mean FROM m GROUP BY positive")
def emb_sim_split(spark, d):
    return _sims(spark, d).groupBy("positive").agg(F.count(F.lit(1)).alias("n"), R(F.avg("sim"), "mean"))


@query("emb_best_threshold", "WITH " + EMB + """, r AS (SELECT positive, CASE WHEN sim < 0 THEN -1 ELSE floor(sim * 99 + 1e-9) END AS s FROM m),
    v AS (SELECT k, round(avg(CASE WHEN positive THEN (s >= k)::INT END) + avg(CASE WHEN NOT positive THEN (s < k)::INT END), 9) AS value FROM r, range(100) t(k) GROUP BY k)
    SELECT round(k / 99::DOUBLE, 6) AS threshold, round(value, 6) AS value FROM v ORDER BY v.value DESC, k LIMIT 1""")
def emb_best_threshold(spark, d):
    return rt.best_threshold(_sims(spark, d)).select(R(F.col("threshold"), "threshold"), R(F.col("value"), "value"))


@query("emb_top1", "WITH " + EMB + " SELECT pair, i, j, round(sim, 5) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM m) WHERE r = 1 AND sim >= 0.1")
def emb_top1(spark, d):
    return rt.top_match(_sims(spark, d), ["pair"], 0.1).select("pair", "i", "j", F.round("sim", 5).alias("sim"))


@query("txt_locate", r"""SELECT item_id, k, CASE WHEN strpos(text, piece) > 0 THEN strpos(text, piece) - 1
    WHEN strpos(trim(regexp_replace(text, '[ \t\n]+', ' ', 'g')), trim(regexp_replace(piece, '[ \t\n]+', ' ', 'g'))) > 0 THEN strpos(trim(regexp_replace(text, '[ \t\n]+', ' ', 'g')), trim(regexp_replace(piece, '[ \t\n]+', ' ', 'g'))) - 1 ELSE -1 END AS at_
    FROM (SELECT item_id, text, k, CASE k WHEN 0 THEN text[11:40] WHEN 1 THEN replace(text[11:40], ' ', '  ') ELSE text[11:40] || '#' END AS piece FROM benchmark, range(3) r(k))""")
def txt_locate(spark, d):
    cut = F.substring("text", 11, 30)
    pieces = F.posexplode(F.array(cut, F.replace(cut, F.lit(" "), F.lit("  ")), F.concat(cut, F.lit("#")))).alias("k", "piece")
    return table(spark, d, "benchmark").select("item_id", "text", pieces).select("item_id", F.col("k").cast("long").alias("k"), rt.locate(F.col("text"), F.col("piece")).cast("long").alias("at_"))


@query("doc_flatten", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def doc_flatten(spark, d):
    """Title, then each section's heading and body, on lines of their own."""
    doc = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("sections"))
    return doc.select("conv_id", F.array_join(F.transform("sections", lambda s: F.concat(s["role"], F.lit(": "), s["text"])), "\n").alias("text"))


@query("ir_bm25", f"""WITH dt AS (SELECT doc_id AS docno, unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM documents), qt AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM benchmark),
    tf AS (SELECT docno, token, count(*) AS tf FROM dt GROUP BY ALL), dl AS (SELECT docno, count(*) AS dl FROM dt GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
    qf AS (SELECT qid, token, count(*) AS qf FROM qt GROUP BY ALL),
    sc AS (SELECT qid, docno, round(sum(qf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * dl / a))), 6) AS score FROM qf JOIN df USING (token) JOIN tf USING (token) JOIN dl USING (docno), st GROUP BY ALL)
    SELECT qid, docno, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno) AS r FROM sc) WHERE r <= 10""")
def ir_bm25(spark, d):
    tokens = lambda t, key, name: table(spark, d, t).select(F.col(key).alias(name), tx.words(F.lower("text")).alias("tokens"))
    asked = tokens("benchmark", "item_id", "qid").select("qid", F.explode("tokens").alias("token"))
    return rt.bm25(asked, tokens("documents", "doc_id", "docno"), top=10).select("qid", "docno", F.round("score", 4).alias("score"))


IR = """ju AS (SELECT r.qid, r.docno, coalesce(q.rel, 0) AS rel, row_number() OVER (PARTITION BY r.qid ORDER BY score DESC, r.docno) AS k FROM ranked r LEFT JOIN qrels q ON q.qid = r.qid AND q.docno = r.docno),
    jh AS (SELECT *, sum((rel > 0)::INT) OVER (PARTITION BY qid ORDER BY k ROWS UNBOUNDED PRECEDING) AS hits FROM ju),
    id AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docno) AS k FROM qrels),
    be AS (SELECT qid, sum(CASE WHEN k <= 10 THEN rel / log2(k + 1) ELSE 0 END) AS ideal, sum((rel > 0)::INT) AS nrel FROM id GROUP BY qid),
    go AS (SELECT qid, sum(CASE WHEN k <= 10 THEN rel / log2(k + 1) ELSE 0 END) AS dcg, min(CASE WHEN rel > 0 THEN k END) AS first, sum((k <= 10 AND rel > 0)::INT) / 10::DOUBLE AS p, sum(CASE WHEN rel > 0 THEN hits / k::DOUBLE ELSE 0 END) AS s FROM jh GROUP BY qid)"""

for _name, _column, _sql in (
    ("ir_ndcg10", "ndcg", "dcg / nullif(ideal, 0)"),
    ("ir_rr", "rr", "1 / first::DOUBLE"),
    ("ir_precision_at_k", "precision", "p"),
    ("ir_map", "ap", "s / nullif(nrel, 0)::DOUBLE"),
):

    @query(_name, with_("qrels", "ranked", more=IR) + f"SELECT qid, round(coalesce({_sql}, 0), 6) AS {_name} FROM be LEFT JOIN go USING (qid)")
    def _rank(spark, d, name=_name, column=_column):
        return rt.rank_measures(view(spark, d, "ranked"), view(spark, d, "qrels")).select("qid", R(F.col(column), name))


@query("soco_prf", with_("gold_pairs", "run_pairs") + """, g AS (SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM gold_pairs), r AS (SELECT least(a, b) AS x, greatest(a, b) AS y FROM run_pairs),
    h AS (SELECT count(*)::DOUBLE AS h FROM (SELECT DISTINCT x, y FROM r) SEMI JOIN g USING (x, y)), v AS (SELECT h / (SELECT count(*) FROM r) AS p, h / (SELECT count(*) FROM g) AS q FROM h)
    SELECT round(p, 6) AS "precision", round(q, 6) AS recall, round(2 * p * q / (p + q), 6) AS f1 FROM v""")
def soco_prf(spark, d):
    return rt.pair_prf(view(spark, d, "gold_pairs"), view(spark, d, "run_pairs")).select(*[R(F.col(c), c) for c in ("precision", "recall", "f1")])


@query("ds_half_split", "SELECT doc_id, lang, ntile(2) OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR)) AS half FROM documents")
def ds_half_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang")
    return rt.half_split(rows, ["lang"], F.md5(F.col("doc_id").cast("string"))).select("doc_id", "lang", F.col("half").cast("long").alias("half"))
