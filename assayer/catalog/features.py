"""Feature and baseline queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.catalog.inputs import table, view, with_
from assayer.functions import measures as m
from assayer.functions import text as tx
from assayer.operators import features as ft
from assayer.operators import scores
from assayer.plans import cut, join_counted
from assayer.registry import query

R = lambda c, name: F.round(c, 6).alias(name)


def chars(rows: str, keys: str, text: str = "text") -> str:
    """A subquery of the characters of each text with the next three and the two before."""
    return f"""(SELECT {keys}, rid, i, ch, lead(ch, 1) OVER w AS l1, lead(ch, 2) OVER w AS l2, lead(ch, 3) OVER w AS l3, lag(ch, 1) OVER w AS p1, lag(ch, 2) OVER w AS p2
        FROM (SELECT {keys}, rid, unnest(cs) AS ch, unnest(range(1, len(cs) + 1)) AS i FROM (SELECT {keys}, row_number() OVER () AS rid, string_split({text}, '') AS cs FROM {rows}))
        WHERE ch <> '' WINDOW w AS (PARTITION BY rid ORDER BY i))"""


def grams(n: int, rows: str, keys: str, text: str = "text") -> str:
    """A subquery of counts of character n-grams."""
    gram = " || ".join(["ch", *(f"l{k}" for k in range(1, n))])
    return f"(SELECT {keys}, {gram} AS gram, count(*) AS n FROM {chars(rows, keys, text)} WHERE {gram} IS NOT NULL GROUP BY ALL)"


def _docs(spark, d):
    return table(spark, d, "documents")


def _grams(rows, keys, length):
    return ft.char_gram_counts(rows, keys, "text", [length]).drop("length")


def _talk(spark, d):
    return table(spark, d, "conversations")


@query("ng_char_counts", f"SELECT * FROM {grams(3, 'documents', 'lang')}")
def ng_char_counts(spark, d):
    return _grams(_docs(spark, d), ["lang"], 3)


@query("ng_vocab", f"SELECT gram, sum(n)::BIGINT AS n FROM {grams(3, 'documents', 'lang')} GROUP BY gram HAVING sum(n) >= 5")
def ng_vocab(spark, d):
    return ft.vocabulary(_grams(_docs(spark, d), ["lang"], 3), 5)


@query("ng_maxabs", f"WITH c AS {grams(3, 'documents', 'lang')}, f AS (SELECT lang, gram, n / sum(n) OVER (PARTITION BY lang)::DOUBLE AS f FROM c) SELECT lang, gram, round(f / max(f) OVER (PARTITION BY gram), 6) AS value FROM f")
def ng_maxabs(spark, d):
    counts = _grams(_docs(spark, d), ["lang"], 3)
    return ft.max_abs_scaled(counts, ["lang"]).select("lang", "gram", R(F.col("value"), "value"))


PROFILE = "SELECT {k}, gram, n / a::DOUBLE AS f FROM (SELECT *, sum(n) OVER (PARTITION BY {k}) AS a, row_number() OVER (PARTITION BY {k} ORDER BY n DESC, gram) AS r FROM {c}) WHERE r <= {n}"


@query("ng_profile", "SELECT lang, gram, round(f, 6) AS f FROM (" + PROFILE.format(k="lang", c=grams(3, "documents", "lang"), n=500) + ")")
def ng_profile(spark, d):
    counts = _grams(_docs(spark, d), ["lang"], 3)
    return ft.profile(counts, ["lang"], 500).select("lang", "gram", R(F.col("f"), "f"))


@query("cng_distance", "WITH k AS (" + PROFILE.format(k="lang", c=grams(3, "documents", "lang"), n=1000) + "), u AS (" + PROFILE.format(k="conv_id", c=grams(3, "conversations", "conv_id"), n=200) + """)
    SELECT conv_id, lang, round((coalesce(s, 0) + 4 * (size - coalesce(c, 0))) / (4 * size)::DOUBLE, 6) AS distance FROM (SELECT * FROM (SELECT conv_id, count(*) AS size FROM u GROUP BY 1), (SELECT DISTINCT lang FROM k))
    LEFT JOIN (SELECT conv_id, lang, sum(pow(2 * (u.f - k.f) / (u.f + k.f), 2)) AS s, count(*) AS c FROM u JOIN k USING (gram) GROUP BY ALL) USING (conv_id, lang)""")
def cng_distance(spark, d):
    known = ft.profile(_grams(_docs(spark, d), ["lang"], 3), ["lang"], 1000)
    unknown = ft.profile(_grams(_talk(spark, d), ["conv_id"], 3), ["conv_id"], 200)
    return ft.cng_distance(unknown, known, "conv_id", "lang").select("conv_id", "lang", R(F.col("distance"), "distance"))


SIDES = "sides AS (SELECT conv_id, turn, 0 AS side, hyp AS text FROM pairs UNION ALL SELECT conv_id, turn, 1, ref FROM pairs), sc AS " + grams(4, "sides", "conv_id, turn, side")
TFIDF = SIDES + """, dfs AS (SELECT gram, count(*) AS df FROM sc GROUP BY 1), nn AS (SELECT count(*) AS n_all FROM sides),
    wt AS (SELECT conv_id, turn, side, gram, n * (ln((1 + n_all) / (1 + df)::DOUBLE) + 1) AS w FROM sc JOIN dfs USING (gram), nn)"""
COSINE = """SELECT conv_id, turn, {x} round(coalesce(sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0), 0), 6) AS cosine FROM (
    SELECT conv_id, turn, {x} gram, sum(CASE WHEN side = 0 THEN w ELSE 0 END) AS a, sum(CASE WHEN side = 1 THEN w ELSE 0 END) AS b FROM {r} GROUP BY ALL) GROUP BY ALL"""


def _pair_texts(spark, d, rows=None):
    """conv_id, turn, hyp, ref (arrays of texts: one, unless rows repeat) and how many rows they are of."""
    pairs = view(spark, d, "pairs")
    pairs = pairs if rows is None else pairs.filter(rows)
    grouped = pairs.groupBy("conv_id", "turn").agg(F.collect_list("hyp").alias("hyp"), F.collect_list("ref").alias("ref"), F.count(F.lit(1)).alias("rows"))  # repeats of one turn
    return cut(grouped.repartition(4 * spark.sparkContext.defaultParallelism))


def _weighted_pairs(spark, d, *more):
    """conv_id, turn, gram, a, b: tf-idf weights of 4-grams in both texts of a pair, and columns ``more`` worked out once for each distinct 4-gram."""
    pairs = _pair_texts(spark, d)
    counts = ft.pair_gram_counts(pairs, ["conv_id", "turn"], "hyp", "ref", 4)
    dfs = counts.groupBy("gram").agg(F.sum((F.col("a") > 0).cast("long") + (F.col("b") > 0).cast("long")).alias("df"))
    texts = 2 * (pairs.agg(F.sum("rows")).collect()[0][0] or 0)
    dfs = cut(dfs.select("gram", "df", (F.log((1 + F.lit(texts)) / (1 + F.col("df"))) + 1).alias("idf"), *more))
    names = dfs.columns[3:]
    weighted = join_counted(counts, dfs, "gram", "df", small=500_000)
    return weighted.select("conv_id", "turn", "gram", (F.col("a") * F.col("idf")).alias("a"), (F.col("b") * F.col("idf")).alias("b"), *names)


@query("av_tfidf_cosine", with_("pairs", more=TFIDF) + COSINE.format(x="", r="wt"))
def av_tfidf_cosine(spark, d):
    return ft.pair_cosine(_weighted_pairs(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", R(F.col("cosine"), "cosine"))


@query("av_subset_cosine", with_("pairs", more=TFIDF + ", sub AS (SELECT wt.*, k FROM wt, range(3) r(k) WHERE ascii(substr(md5(gram || k), 1, 1)) % 2 = 0)")
    + "SELECT conv_id, turn, round(sum(cosine) / 3, 6) AS cosine FROM (" + COSINE.format(x="k,", r="sub").replace("round(coalesce", "(coalesce").replace(", 0), 6) AS cosine", ", 0)) AS cosine") + ") GROUP BY ALL")
def av_subset_cosine(spark, d):
    drawn = F.filter(F.sequence(F.lit(0), F.lit(2)), lambda k: F.ascii(F.substring(F.md5(F.concat("gram", k)), 1, 1)) % 2 == 0)
    subset = _weighted_pairs(spark, d, drawn.alias("ks")).withColumn("k", F.explode("ks"))
    each = ft.pair_cosine(subset, ["conv_id", "turn", "k"])
    return each.groupBy("conv_id", "turn").agg(R(F.sum("cosine") / 3, "cosine"))


@query("av_correct_scores", with_("scored") + "SELECT id, round(CASE WHEN p <= 0.4 THEN 0.49 * p / 0.4 WHEN p < 0.6 THEN 0.5 ELSE 0.51 + 0.49 * (p - 0.6) / 0.4 END, 6) AS score FROM scored")
def av_correct_scores(spark, d):
    return view(spark, d, "scored").select("id", R(scores.correct_scores(F.col("p"), 0.4, 0.6), "score"))


@query("av_grid", with_("scored") + """, th AS (SELECT a.k AS i, b.k AS j FROM range(1, 99) a(k), range(1, 99) b(k) WHERE a.k < b.k),
    c AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p), q AS (SELECT i, j, pos, neg, CASE WHEN p <= i / 100::DOUBLE THEN -1 WHEN p < j / 100::DOUBLE THEN 0 ELSE 1 END AS s FROM c, th),
    x AS (SELECT i, j, sum(CASE WHEN s = 1 THEN pos ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN s = 1 THEN neg ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN s = -1 THEN pos ELSE 0 END)::DOUBLE AS fn,
          sum(CASE WHEN s = -1 THEN neg ELSE 0 END)::DOUBLE AS tn, sum(CASE WHEN s = 0 THEN pos + neg ELSE 0 END)::DOUBLE AS u FROM q GROUP BY ALL),
    v AS (SELECT i, j, round((tp + tn + u * (tp + tn) / (tp + tn + fp + fn + u)) / (tp + tn + fp + fn + u) + coalesce(1.25 * tp / nullif(1.25 * tp + 0.25 * (fn + u) + fp, 0), 0), 9) AS value FROM x)
    SELECT i / 100::DOUBLE AS p1, j / 100::DOUBLE AS p2, round(value, 6) AS value FROM v ORDER BY v.value DESC, i, j LIMIT 1""")
def av_grid(spark, d):
    return scores.threshold_grid(view(spark, d, "scored")).select("p1", "p2", R(F.col("value"), "value"))


@query("av_sweep", with_("scored") + """, th AS (SELECT k * (0.5::DOUBLE / 1000) + 0.25::DOUBLE AS threshold FROM range(1000) r(k)),
    x AS (SELECT threshold, sum((p >= threshold AND y = 1)::INT) AS tp, sum((p >= threshold AND y = 0)::INT) AS fp, sum((p < threshold AND y = 1)::INT) AS fn FROM scored, th GROUP BY ALL)
    SELECT round(threshold, 6) AS threshold, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM x""")
def av_sweep(spark, d):
    swept = scores.sweep(view(spark, d, "scored"), 0.25, 0.75, 1000)
    return swept.select(*[R(F.col(c), c) for c in ("threshold", "precision", "recall", "f1")])


@query("ml_reject", with_("systems") + """SELECT id, CASE WHEN p1 - coalesce(p2, 0) < 0.1 THEN '<UNK>' ELSE best END AS label FROM (
    SELECT id, max(CASE WHEN r = 1 THEN system END) AS best, max(CASE WHEN r = 1 THEN p END) AS p1, max(CASE WHEN r = 2 THEN p END) AS p2 FROM (
      SELECT id, system, p, row_number() OVER (PARTITION BY id ORDER BY p DESC, system) AS r FROM systems) GROUP BY id)""")
def ml_reject(spark, d):
    return reject_close(view(spark, d, "systems"), "id", "system", "p", 0.1)


def reject_close(df, key, label, p, gap):
    """The label with the best score, or ``<UNK>`` if the second is nearer than ``gap``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(p).desc(), label))
    top = df.withColumn("r", rank).filter("r <= 2").groupBy(key).agg(F.min_by(label, "r").alias("best"), F.max(F.when(F.col("r") == 1, F.col(p))).alias("p1"), F.max(F.when(F.col("r") == 2, F.col(p))).alias("p2"))
    return top.select(key, F.when(F.col("p1") - F.coalesce("p2", F.lit(0.0)) < gap, "<UNK>").otherwise(F.col("best")).alias("label"))


def ppm(rows: str, keys: str) -> str:
    return f"""(SELECT {keys}, o AS ord, CASE o WHEN 0 THEN '' WHEN 1 THEN p1 ELSE p2 || p1 END AS ctx, ch, count(*) AS n FROM {chars(rows, keys)}, range(3) r(o)
        WHERE CASE o WHEN 0 THEN '' WHEN 1 THEN p1 ELSE p2 || p1 END IS NOT NULL GROUP BY ALL)"""


PPM = "mo AS " + ppm("documents", "lang")


@query("ppm_counts", "WITH " + PPM + " SELECT * FROM mo")
def ppm_counts(spark, d):
    return ft.context_counts(_docs(spark, d), ["lang"], "text", 2)


@query("ppm_merge", "WITH mo AS " + ppm("(SELECT 'all' AS lang, text FROM documents WHERE source <> 'src1')", "lang") + " SELECT ord, ctx, ch, n FROM mo")
def ppm_merge(spark, d):
    docs = _docs(spark, d)
    model = lambda rows: ft.context_counts(rows, [], "text", 2)
    whole = ft.merge_models(model(docs.filter("source < 'src15'")), model(docs.filter("source >= 'src15'")), keys=[])
    return ft.subtract_model(whole, model(docs.filter("source = 'src1'")), keys=[])


def entropy_sql(k: str, rows: str) -> str:
    return PPM + f""", pr AS (SELECT lang, ord, ctx, ch, n / sum(n) OVER (PARTITION BY lang, ord, ctx)::DOUBLE AS p FROM mo),
    te AS (SELECT {k}, coalesce(p2, '') || coalesce(p1, '') AS ctx, ch, count(*) AS times FROM {chars(rows, k)} GROUP BY ALL),
    en AS (SELECT {k}, l.lang, sum(-log2(coalesce(p2.p, p1.p, p0.p, 1 / 256::DOUBLE)) * times) / sum(times) AS h FROM te CROSS JOIN (SELECT DISTINCT lang FROM mo) l
      LEFT JOIN pr p2 ON p2.ord = 2 AND p2.lang = l.lang AND p2.ctx = te.ctx AND p2.ch = te.ch AND length(te.ctx) = 2
      LEFT JOIN pr p1 ON p1.ord = 1 AND p1.lang = l.lang AND p1.ctx = right(te.ctx, 1) AND p1.ch = te.ch AND length(te.ctx) >= 1
      LEFT JOIN pr p0 ON p0.ord = 0 AND p0.lang = l.lang AND p0.ch = te.ch GROUP BY ALL)"""


def _entropy(spark, d, rows, key, text):
    model = ft.context_counts(_docs(spark, d), ["lang"], "text", 2)
    return ft.cross_entropy(rows, key, text, model, "lang", 2)


@query("ppm_entropy", "WITH " + entropy_sql("conv_id", "conversations") + " SELECT conv_id, lang, round(h, 6) AS entropy FROM en")
def ppm_entropy(spark, d):
    return _entropy(spark, d, _talk(spark, d), "conv_id", "text").select("conv_id", "lang", R(F.col("entropy"), "entropy"))


@query("ppm_attribution", "WITH " + entropy_sql("conv_id", "conversations") + """ SELECT conv_id, CASE WHEN (h2 - h1) / h1 < 0.01 THEN '<UNK>' ELSE best END AS author FROM (
    SELECT conv_id, arg_min(lang, h) AS best, min(h) AS h1, list_sort(list(h))[2] AS h2 FROM en GROUP BY conv_id)""")
def ppm_attribution(spark, d):
    entropy = _entropy(spark, d, _talk(spark, d), "conv_id", "text")
    sorted_ = F.array_sort(F.collect_list(F.struct("entropy", "lang")))
    top = entropy.groupBy("conv_id").agg(sorted_.alias("s"))  # one entry per author
    gap = (F.get("s", F.lit(1))["entropy"] - F.col("s")[0]["entropy"]) / F.col("s")[0]["entropy"]
    return top.select("conv_id", F.when(gap < 0.01, "<UNK>").otherwise(F.col("s")[0]["lang"]).alias("author"))


@query("ppm_pair", "WITH " + entropy_sql("conv_id, role", "conversations") + """ SELECT conv_id, lang, round(abs(coalesce(max(CASE WHEN role = 'user' THEN h END), 0) - coalesce(max(CASE WHEN role = 'assistant' THEN h END), 0)), 4) AS difference FROM en GROUP BY ALL""")
def ppm_pair(spark, d):
    rows = _talk(spark, d).withColumn("key", F.concat_ws(":", "conv_id", "role"))
    entropy = _entropy(spark, d, rows, "key", "text")
    role, conv = F.split("key", ":")[1], F.split("key", ":")[0].cast("long")
    of = lambda r: F.coalesce(F.max(F.when(role == r, F.col("entropy"))), F.lit(0.0))
    return entropy.groupBy(conv.alias("conv_id"), "lang").agg(F.round(F.abs(of("user") - of("assistant")), 4).alias("difference"))


MINMAX = SIDES.replace(grams(4, "sides", "conv_id, turn, side"), grams(3, "sides", "conv_id, turn, side")).replace("sc AS", "s0 AS") + """, sc AS (SELECT *, n / sum(n) OVER (PARTITION BY conv_id, turn, side)::DOUBLE AS f FROM s0),
    ab AS (SELECT conv_id, turn, gram, sum(CASE WHEN side = 0 THEN f ELSE 0 END) AS a, sum(CASE WHEN side = 1 THEN f ELSE 0 END) AS b FROM sc GROUP BY ALL)"""


def _frequencies(spark, d, rows=None):
    """conv_id, turn, gram, a, b: shares of 3-grams among those of either text of a pair."""
    counts = ft.pair_gram_counts(_pair_texts(spark, d, rows), ["conv_id", "turn"], "hyp", "ref", 3)
    share = lambda side: F.coalesce(F.try_divide(F.col(side), F.col(f"all_{side}")), F.lit(0.0)).alias(side)
    return counts.select("conv_id", "turn", "gram", share("a"), share("b"))


@query("imp_minmax", with_("pairs", more=MINMAX) + "SELECT conv_id, turn, round(1 - sum(least(a, b)) / (sum(greatest(a, b)) + 1e-6), 6) AS distance FROM ab GROUP BY ALL")
def imp_minmax(spark, d):
    return ft.min_max_distance(_frequencies(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", R(F.col("distance"), "distance"))


HALF = "ascii(substr(md5(gram || k), 1, 1)) % 2 = 0"


@query("imp_proba", with_("pairs", more=MINMAX) + f""", un AS (SELECT conv_id, gram, f, k FROM sc, range(4) r(k) WHERE side = 0 AND turn = 0 AND {HALF}), ca AS (SELECT conv_id, gram, f, k FROM sc, range(4) r(k) WHERE side = 1 AND turn = 0 AND {HALF}),
    cand AS (SELECT DISTINCT u.conv_id, c.conv_id AS other FROM un u JOIN ca c ON c.conv_id BETWEEN u.conv_id AND u.conv_id + 3),
    su AS (SELECT conv_id, k, sum(f) AS s FROM un GROUP BY ALL), sv AS (SELECT conv_id, k, sum(f) AS s FROM ca GROUP BY ALL),
    mi AS (SELECT u.conv_id, c.conv_id AS other, u.k, sum(least(u.f, c.f)) AS mn FROM un u JOIN ca c ON u.gram = c.gram AND u.k = c.k AND c.conv_id BETWEEN u.conv_id AND u.conv_id + 3 GROUP BY ALL),
    di AS (SELECT cand.conv_id, cand.other, su.k, round(1 - coalesce(mn, 0) / (su.s + sv.s - coalesce(mn, 0) + 1e-6), 9) AS dist FROM cand JOIN su ON su.conv_id = cand.conv_id JOIN sv ON sv.conv_id = cand.other AND sv.k = su.k
      LEFT JOIN mi ON mi.conv_id = cand.conv_id AND mi.other = cand.other AND mi.k = su.k)
    SELECT conv_id, round(avg(win), 6) AS share FROM (SELECT conv_id, k, (max(CASE WHEN other = conv_id THEN dist END) <= coalesce(min(CASE WHEN other <> conv_id THEN dist END), 1))::INT AS win FROM di GROUP BY ALL HAVING max(CASE WHEN other = conv_id THEN dist END) IS NOT NULL) GROUP BY conv_id""")
def imp_proba(spark, d):
    """Share of iterations, each on a random half of the features, in which the candidate is no farther than the nearest impostor.

    The unknown text is a conversation's first turn, the candidate the turn after it; impostors are the same turn of the next three conversations."""
    ks = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: F.ascii(F.substring(F.md5(F.concat("gram", k)), 1, 1)) % 2 == 0)
    rows = cut(_frequencies(spark, d, "turn = 0").withColumn("ks", ks).filter(F.size("ks") > 0).drop("turn"))
    unknown = rows.filter("a > 0").select("conv_id", "gram", F.col("a").alias("f"), "ks").withColumn("other", F.explode(F.sequence(F.col("conv_id"), F.col("conv_id") + 3)))
    known = rows.filter("b > 0").select(F.col("conv_id").alias("other"), "gram", F.col("b").alias("g"))
    shared = unknown.join(known, ["other", "gram"]).select("conv_id", "other", F.least("f", "g").alias("mn"), F.explode("ks").alias("k")).groupBy("conv_id", "other", "k").agg(F.sum("mn").alias("mn"))
    of = lambda side: rows.filter(F.col(side) > 0).select("conv_id", side, F.explode("ks").alias("k")).groupBy("conv_id", "k")
    of_u = of("a").agg(F.sum("a").alias("su")).withColumn("other", F.explode(F.sequence(F.col("conv_id"), F.col("conv_id") + 3)))
    of_k = of("b").agg(F.sum("b").alias("sv")).withColumnRenamed("conv_id", "other")
    mn = F.coalesce("mn", F.lit(0.0))
    dist = of_u.join(of_k, ["other", "k"]).join(shared, ["conv_id", "other", "k"], "left").withColumn("dist", F.round(1 - mn / (F.col("su") + F.col("sv") - mn + F.lit(1e-6)), 9))
    own = F.col("other") == F.col("conv_id")
    won = dist.groupBy("conv_id", "k").agg(F.max(F.when(own, F.col("dist"))).alias("own"), F.coalesce(F.min(F.when(~own, F.col("dist"))), F.lit(1.0)).alias("near")).filter("own is not null")
    return won.groupBy("conv_id").agg(R(F.avg((F.col("own") <= F.col("near")).cast("double")), "share"))


CHI = """wc AS (SELECT lang, lower(w) AS gram, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_'']+')) AS w FROM documents) GROUP BY ALL),
    sh AS (SELECT lang, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM documents GROUP BY lang), tt AS (SELECT gram, sum(n) AS total FROM wc GROUP BY 1 HAVING sum(n) >= 5),
    ch AS (SELECT gram, sum(pow(coalesce(n, 0) - total * share, 2) / (total * share)) AS chi2 FROM tt CROSS JOIN sh LEFT JOIN wc USING (gram, lang) GROUP BY gram)"""


def _chi(spark, d):
    docs = _docs(spark, d)
    words = ft.word_counts(docs, ["lang"], "text")
    often = ft.vocabulary(words, 5).select("gram")
    grams_ = words.join(often, "gram").select("lang", "gram", "n", F.lit(0).cast("long").alias("docs"))
    classes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).select("lang", F.lit(None).cast("string").alias("gram"), F.lit(0).cast("long").alias("n"), "docs")
    return ft.chi_square(grams_.unionByName(classes), "lang")


@query("fs_chi2", "WITH " + CHI + " SELECT gram, round(chi2, 4) AS chi2 FROM ch")
def fs_chi2(spark, d):
    return _chi(spark, d).select("gram", F.round("chi2", 4).alias("chi2"))


@query("fs_percentile", "WITH " + CHI + " SELECT gram FROM (SELECT gram, percent_rank() OVER (ORDER BY round(chi2, 6)) AS r FROM ch) WHERE r >= 0.9")
def fs_percentile(spark, d):
    """The best tenth; the cut is found from counts per distinct value, so no window sees all rows."""
    chi = _chi(spark, d).withColumn("v", F.round("chi2", 6))
    values = chi.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    below = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("c").over(Window.partitionBy(F.lit(0)))
    good = values.withColumn("r", F.coalesce(below, F.lit(0)) / (total - 1)).filter("r >= 0.9").select("v")
    return chi.join(good, "v", "left_semi").select("gram")


@query("txt_html_clean", r"""SELECT page_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
    '&[a-zA-Z#0-9]+;', ' ', 'g')), '[^\p{L}\p{N}_ \n\t]', '', 'g'), '[ \n\t]+', ' ', 'g')) AS text FROM pages""")
def txt_html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


CLASS_ORDER = "co AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS place, count(*) OVER () AS classes FROM documents GROUP BY source)"


def class_order(df, cls):
    """Classes by falling size: cls, n, place, classes. One row per class."""
    sizes = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumns({"place": F.row_number().over(Window.orderBy(F.col("n").desc(), cls)) - 1, "classes": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})


@query("rs_class_order", "WITH " + CLASS_ORDER + " SELECT source, n, place FROM co")
def rs_class_order(spark, d):
    return class_order(_docs(spark, d), "source").select("source", "n", F.col("place").cast("long").alias("place"))


STEPS = ("median", 1 / 2), ("quarter", 1 / 4), ("three_quarters", 3 / 4), ("step1", 1 / 6), ("step2", 3 / 6), ("step3", 5 / 6)


@query("rs_targets", "WITH " + CLASS_ORDER + " " + " UNION ALL ".join(f"SELECT '{n}' AS target, n FROM co WHERE place = round_even(classes * {x!r}::DOUBLE, 0)" for n, x in STEPS))
def rs_targets(spark, d):
    order = class_order(_docs(spark, d), "source")
    steps = F.explode(F.array(*[F.struct(F.lit(n).alias("target"), F.lit(x).alias("x")) for n, x in STEPS]))
    return order.select("n", "place", "classes", steps.alias("s")).filter(F.col("place") == F.bround(F.col("classes") * F.col("s.x"))).select("s.target", "n")


@query("rs_undersample", "WITH " + CLASS_ORDER + """, t AS (SELECT n FROM co WHERE place = round_even(classes / 2::DOUBLE, 0))
    SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)) AS r FROM documents) WHERE r <= (SELECT n FROM t)""")
def rs_undersample(spark, d):
    docs = _docs(spark, d).select("doc_id", "source")
    order = class_order(docs, "source")
    target = order.filter(F.col("place") == F.bround(F.col("classes") / 2)).select(F.col("n").alias("target"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.md5(F.col("doc_id").cast("string"))))
    return docs.withColumn("r", rank).crossJoin(F.broadcast(target)).filter("r <= target").select("doc_id", "source")  # target: one row


def _nested(steps, text):
    for pattern, put in steps:
        pattern = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return text


@query("txt_tweet_norm", "SELECT conv_id, turn, trim(" + _nested(tx.TWEET_STEPS, "lower(text || ' http://a.example/x :) #b @c 12:30 7')") + ") AS text FROM conversations")
def txt_tweet_norm(spark, d):
    text = F.concat("text", F.lit(" http://a.example/x :) #b @c 12:30 7"))
    return _talk(spark, d).select("conv_id", "turn", tx.normalise_tweet(text).alias("text"))


@query("txt_concat_feed", "SELECT conv_id, string_agg(text, ' <SEP> ' ORDER BY turn) AS text FROM conversations WHERE turn < 3 GROUP BY conv_id")
def txt_concat_feed(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return _talk(spark, d).filter("turn < 3").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), " <SEP> ").alias("text"))


@query("bin_age", "SELECT doc_id, CASE WHEN y BETWEEN 1940 AND 1955 THEN 1947 WHEN y BETWEEN 1956 AND 1969 THEN 1963 WHEN y BETWEEN 1970 AND 1980 THEN 1975 WHEN y BETWEEN 1981 AND 1989 THEN 1985 WHEN y BETWEEN 1990 AND 1999 THEN 1994 END AS age FROM (SELECT doc_id, 1930 + doc_id % 80 AS y FROM documents)")
def bin_age(spark, d):
    """Fixed ranges of birth years and the year each is represented by."""
    y = 1930 + F.col("doc_id") % 80
    ranges = ((1940, 1955, 1947), (1956, 1969, 1963), (1970, 1980, 1975), (1981, 1989, 1985), (1990, 1999, 1994))
    binned = F.coalesce(*[F.when(y.between(a, b), c) for a, b, c in ranges])
    return _docs(spark, d).select("doc_id", binned.alias("age"))


@query("txt_chunks", "SELECT doc_id, c AS chunk, len(t[c * 300 + 1:c * 300 + 300]) AS n, md5(array_to_string(t[c * 300 + 1:c * 300 + 300], ' ')) AS digest FROM (SELECT doc_id, t, unnest(range((len(t) + 299) // 300)) AS c FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_'']+') AS t FROM documents))")
def txt_chunks(spark, d):
    pieces = ft.chunks(_docs(spark, d), ["doc_id"], tx.words(F.col("text")), 300)
    return pieces.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("tf_extract", "SELECT conv_id, turn, gram, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' ')) AS gram FROM conversations) WHERE gram <> '' GROUP BY ALL")
def tf_extract(spark, d):
    return ft.term_frequencies(_talk(spark, d), ["conv_id", "turn"], "text")


@query("vote_majority", with_("systems") + "SELECT id, sum((p > 0.5)::INT) >= (count(*) + 1) / 2::DOUBLE AS vote FROM systems GROUP BY id")
def vote_majority(spark, d):
    votes = view(spark, d, "systems").groupBy("id").agg(m.count_if(F.col("p") > 0.5).alias("t"), F.count(F.lit(1)).alias("n"))
    return votes.select("id", (F.col("t") >= (F.col("n") + 1) / 2).alias("vote"))


@query("bl_constant", "SELECT doc_id, 'en' AS label, 0.5::DOUBLE AS score FROM documents")
def bl_constant(spark, d):
    return _docs(spark, d).select("doc_id", F.lit("en").alias("label"), F.lit(0.5).alias("score"))


@query("bl_hash_random", "SELECT doc_id, ['en', 'de', 'fr', 'es'][ascii(substr(md5(doc_id::VARCHAR), 1, 1)) % 4 + 1] AS label, (ascii(substr(md5(doc_id::VARCHAR), 2, 1)) % 2)::BIGINT AS flag FROM documents")
def bl_hash_random(spark, d):
    digest = F.md5(F.col("doc_id").cast("string"))
    pick = F.ascii(F.substring(digest, 1, 1)) % 4
    labels = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])
    return _docs(spark, d).select("doc_id", F.element_at(labels, pick + 1).alias("label"), (F.ascii(F.substring(digest, 2, 1)) % 2).cast("long").alias("flag"))


@query("dx_delete", "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n]+'), lambda t: t <> '' AND lower(t) NOT IN ('the', 'of', 'and', 'la', 'de', 'der')), ' ') AS text FROM documents")
def dx_delete(spark, d):
    return _docs(spark, d).select("doc_id", tx.delete_words(F.col("text"), ["the", "of", "and", "la", "de", "der"]).alias("text"))


@query("qa_nbest", """WITH e AS (SELECT vec_id, i - 1 AS pos, embedding[i]::DOUBLE AS s, embedding[len(embedding) + 1 - i]::DOUBLE AS t FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
    a AS (SELECT vec_id, pos, s FROM e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, pos) <= 5), b AS (SELECT vec_id, pos, t FROM e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY t DESC, pos) <= 5)
    SELECT vec_id, a.pos AS start, b.pos AS "end", round(s + t, 5) AS score FROM a JOIN b USING (vec_id) WHERE a.pos <= b.pos AND b.pos - a.pos < 30
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s + t, 5) DESC, a.pos, b.pos) <= 3""")
def qa_nbest(spark, d):
    """The best spans of the best five starts and ends of each row."""
    e = table(spark, d, "embeddings")
    rows = e.select("vec_id", F.posexplode(F.arrays_zip(F.col("embedding").alias("s"), F.reverse("embedding").alias("t"))).alias("pos", "x"))
    rows = rows.select("vec_id", "pos", F.col("x.s").cast("double").alias("s"), F.col("x.t").cast("double").alias("t"))
    top = lambda c: F.row_number().over(Window.partitionBy("vec_id").orderBy(F.col(c).desc(), "pos"))
    a = rows.withColumn("r", top("s")).filter("r <= 5").select("vec_id", F.col("pos").alias("start"), "s")
    b = rows.withColumn("r", top("t")).filter("r <= 5").select("vec_id", F.col("pos").alias("end"), "t")
    spans = a.join(b, "vec_id").filter((F.col("start") <= F.col("end")) & (F.col("end") - F.col("start") < 30)).withColumn("score", F.round(F.col("s") + F.col("t"), 5))
    best = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.col("score").desc(), "start", "end"))
    return spans.withColumn("r", best).filter("r <= 3").select("vec_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "score")


@query("wm_obfuscate", """WITH s AS (SELECT conv_id, turn, text, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+[ \\n]*'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM conversations),
    x AS (SELECT conv_id, turn, string_agg(piece, '. ' ORDER BY md5(piece), piece) AS shuffled FROM (SELECT conv_id, turn, unnest(ss) AS piece FROM s) GROUP BY ALL)
    SELECT conv_id, turn, 'original' AS type, text FROM s UNION ALL SELECT conv_id, turn, 'shuffled', coalesce(shuffled, '') FROM s LEFT JOIN x USING (conv_id, turn)""")
def wm_obfuscate(spark, d):
    rows = _talk(spark, d).select("conv_id", "turn", "text")
    ordered = F.array_sort(F.transform(tx.sentences(F.col("text")), lambda s: F.struct(F.md5(s).alias("h"), s.alias("s"))))
    shuffled = F.array_join(F.transform(ordered, lambda x: x["s"]), ". ")
    return rows.select("conv_id", "turn", F.lit("original").alias("type"), "text").unionByName(rows.select("conv_id", "turn", F.lit("shuffled").alias("type"), shuffled.alias("text")))


@query("ga_compression")
def ga_compression(spark, d):
    """Likeness of a text's halves by what a shared compression saves, calibrated."""
    import zlib

    import pandas as pd

    @F.pandas_udf("double")
    def saved(texts: pd.Series) -> pd.Series:
        def one(t):
            raw = (t or "").encode()
            x, y = raw[: len(raw) // 2], raw[len(raw) // 2 :]
            cx, cy, cxy = (len(zlib.compress(z, 9)) for z in (x, y, raw))
            return (cx + cy - cxy) / (cx * cy) ** 0.5

        return texts.map(one)

    return _talk(spark, d).select("conv_id", "turn", R(m.sigmoid(10 * (saved("text") + 0.3125 - 0.5)), "score"))
