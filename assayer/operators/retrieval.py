"""Passage alignment, retrieval, embeddings, and pairs."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import measures as m
from assayer.functions import text as tx
from assayer.plans import broadcast_if_small, cut

#: ASCII punctuation and white space: what alignment ignores.
IGNORED = r"[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"


def plain_chars(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, IGNORED, ""))


def char_grams_at(df: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """key, pos, start, end, gram: n-grams over the kept, lower-cased characters, with offsets [start, end) in the whole text.

    Positions come from one pass over the characters; the n-grams from a look-ahead.
    """
    chars = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))).alias("i", "c")).filter(~F.col("c").rlike(f"^{IGNORED}$"))
    order = Window.partitionBy(key).orderBy("i")
    at = chars.withColumns({"pos": F.row_number().over(order) - 1, "last": F.lead("i", length - 1).over(order)}).filter(F.col("last").isNotNull())
    grams = df.select(key, F.posexplode(tx.char_ngrams(plain_chars(F.col(text)), length)).alias("pos", "gram"))
    return at.join(grams, [key, "pos"]).select(key, "pos", F.col("i").alias("start"), (F.col("last") + 1).alias("end"), "gram")


def _plain_grams(key: str, pos: str, length: int, wanted=None):
    """(key, pos, gram) over Arrow batches of kept characters; with ``wanted`` (broadcast hashes in order) only n-grams whose hash is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else wanted.value
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                keys, places, grams = [], [], []
                part = batch.slice(first, 64)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    n = 0 if t is None else max(len(t) - length + 1, 0)
                    hit = range(n)
                    if keep is not None and n:
                        hashes = gram_hashes(t, length)
                        at = np.minimum(np.searchsorted(keep, hashes), max(len(keep) - 1, 0))
                        hit = np.flatnonzero(keep[at] == hashes).tolist() if len(keep) else []
                    keys += [k] * len(hit)
                    places += hit
                    grams += [t[i : i + length] for i in hit]
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(places, pa.int32()), pa.array(grams, pa.string())], names=[key, pos, "gram"])

    return run


def gram_hashes(text: str, length: int) -> np.ndarray:
    """A 64-bit polynomial hash of each n-gram of code points, all by one running sum."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < length:
        return np.zeros(0, np.uint64)
    hashes = np.zeros(len(points) - length + 1, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for k in range(length):
        hashes = hashes * base + (points[k : k + len(hashes)] + np.uint64(1))
    return hashes


def seed_matches(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str, length: int, max_broadcast: int = 2_000_000) -> DataFrame:
    """Places (left_pos, right_pos) in the kept characters at which both texts have the same n-gram.

    The n-grams of ``right`` are made first. While they are ``max_broadcast`` at most, their 64-bit hashes go to all tasks, and
    of ``left`` only n-grams with such a hash are ever made; a larger ``right`` meets all n-grams of ``left`` in a join. The n-grams themselves are compared in either case.
    """

    def grams(df: DataFrame, key: str, pos: str, wanted=None) -> DataFrame:
        plain = df.select(key, plain_chars(F.col(text)).alias("t"))
        return plain.mapInArrow(_plain_grams(key, pos, length, wanted), f"`{key}` {dict(df.dtypes)[key]}, `{pos}` int, gram string")

    known = cut(grams(right, right_key, "right_pos"))
    wanted = None
    if known.limit(max_broadcast + 1).count() <= max_broadcast:

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [np.zeros(0, np.uint64), *(gram_hashes(g, length) for g in batch.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

        values = known.select("gram").mapInArrow(hashed, "h long").distinct().toArrow().column(0).to_numpy()  # 8 bytes each, up to max_broadcast of them
        wanted = left.sparkSession.sparkContext.broadcast(np.sort(values.astype(np.int64).view(np.uint64)))
    return grams(left, left_key, "left_pos", wanted).join(known, "gram").drop("gram")


def diagonal_islands(seeds: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Maximal runs of seeds on one diagonal: keys, left_start, left_end, right_start (kept characters)."""
    diagonal = (F.col("left_pos") - F.col("right_pos")).alias("diagonal")
    runs = Window.partitionBy(*keys, "diagonal").orderBy("left_pos")
    marked = seeds.select(*keys, "left_pos", "right_pos", diagonal).withColumn("run", F.col("left_pos") - F.row_number().over(runs))
    return marked.groupBy(*keys, "diagonal", "run").agg(F.min("left_pos").alias("left_start"), (F.max("left_pos") + length).alias("left_end"), F.min("right_pos").alias("right_start")).drop("diagonal", "run")


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.2, b: float = 0.75, top: int | None = None, max_broadcast: int = 200_000) -> DataFrame:
    """qid, docno, score, rank from token tables (qid, token) and (docno, tokens), the latter with an array a document; repeated query tokens count.

    Only tokens of a query are counted. With ``top`` and up to ``max_broadcast`` query terms, every task scores its documents against all queries
    and gives its best ``top`` of each, so common words make no rows; else the terms meet in a join.
    """
    q = cut(queries.groupBy("qid", "token").agg(F.count(F.lit(1)).alias("qf")))
    if top is not None and q.limit(max_broadcast + 1).count() <= max_broadcast:
        asked = q.collect()  # up to max_broadcast terms
        frequency, n, average = _document_frequencies(docs, {r["token"] for r in asked})
        rows = [{"qid": r["qid"], "token": r["token"], "w": r["qf"] * math.log(1 + (n - df + 0.5) / (df + 0.5))} for r in asked if (df := frequency.get(r["token"]))]
        scored = _best_documents(rows, docs, average, k1, b, top, dict(queries.dtypes)["qid"])
    else:
        terms = cut(q.select("token").distinct())
        found = docs.select("docno", F.explode("tokens").alias("token")).join(broadcast_if_small(terms, max_broadcast), "token")
        tf = found.groupBy("docno", "token").agg(F.count(F.lit(1)).alias("tf"))
        df = cut(tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")))
        stats = docs.filter(F.size("tokens") > 0).agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("tokens")).alias("avgdl")).collect()[0]
        idf = F.log(1 + (F.lit(stats["docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = q.join(df, "token").select("qid", "token", (F.col("qf") * idf).alias("w"))
        average = float(stats["avgdl"] or 1.0)
        length = docs.select("docno", F.size("tokens").alias("dl"))
        hits = weighted.join(tf, "token").join(length, "docno")
        part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(average)))
        scored = hits.groupBy("qid", "docno").agg(F.round(F.sum(part), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "docno")))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def _document_frequencies(docs: DataFrame, terms: set[str]) -> tuple[dict[str, int], int, float]:
    """(documents that have each of the ``terms``, documents with tokens, their mean length), counted inside the tasks in one pass; a row a term and task is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, n, length = shared.value, Counter(), 0, 0
        for batch in batches:
            for tokens in batch.column(0).to_pylist():
                if tokens:
                    counts.update(known.intersection(tokens))
                    n, length = n + 1, length + len(tokens)
        keys, values = [*counts, None, None], [*counts.values(), n, length]
        kinds = ["df"] * len(counts) + ["docs", "length"]
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys, pa.string()), pa.array(values, pa.int64())], names=["kind", "token", "n"])

    found = docs.select("tokens").mapInArrow(run, "kind string, token string, n long").groupBy("kind", "token").agg(F.sum("n").alias("n")).collect()
    whole = {r["kind"]: r["n"] for r in found if r["token"] is None}
    n = whole.get("docs") or 0
    return {r["token"]: r["n"] for r in found if r["token"] is not None}, n, whole["length"] / n if n else 1.0


def _best_documents(rows: list, docs: DataFrame, average: float, k1: float, b: float, top: int, qid_type: str) -> DataFrame:
    """(qid, docno, score): the best ``top`` documents of each query in each block of up to 256 documents, fewer if there are many queries."""
    qids = sorted({r["qid"] for r in rows})
    at = {q: i for i, q in enumerate(qids)}
    index: dict[str, tuple[list, list]] = {}
    for r in sorted(rows, key=lambda r: (r["token"], at[r["qid"]])):
        ids, weights = index.setdefault(r["token"], ([], []))
        ids.append(at[r["qid"]])
        weights.append(r["w"])
    shared = docs.sparkSession.sparkContext.broadcast({t: (np.array(i), np.array(w)) for t, (i, w) in index.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            block = max(1, min(256, (1 << 21) // max(1, len(qids))))  # up to 18 MB of scores and flags
            for first in range(0, whole.num_rows, block):
                batch = whole.slice(first, block)
                scores = np.zeros((batch.num_rows, len(qids)))
                hit = np.zeros((batch.num_rows, len(qids)), bool)
                for n, tokens in enumerate(batch.column(1).to_pylist()):
                    size = len(tokens or ())
                    for token, tf in Counter(tokens or ()).items():
                        if token in known:
                            ids, weights = known[token]
                            scores[n, ids] += weights * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / average))
                            hit[n, ids] = True
                scores = np.round(scores, 6)
                docno = np.array(batch.column(0).to_pylist(), dtype=object)
                order = np.argsort(docno, kind="stable")  # ties go to the smaller document
                out: list[tuple] = []
                for i in np.flatnonzero(hit.any(axis=0)).tolist():
                    mine = order[hit[order, i]]
                    mine = mine[np.argsort(-scores[mine, i], kind="stable")[:top]]
                    out += [(qids[i], docno[n], float(scores[n, i])) for n in mine.tolist()]
                columns = list(zip(*out, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    docno_type = dict(docs.dtypes)["docno"]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kinds = pa.schema([("qid", arrow[qid_type]), ("docno", arrow[docno_type]), ("score", pa.float64())])
    return docs.select("docno", "tokens").mapInArrow(run, f"qid {qid_type}, docno {docno_type}, score double")


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with its rank per query (score down, then docno) and rel, 0 where unjudged."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "docno"))
    return run.withColumn("rank", rank).join(qrels, ["qid", "docno"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def rank_measures(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Per judged query: ndcg at k, reciprocal rank, precision at k, average precision. Queries without a relevant document score 0."""
    rows = judged(run, qrels)
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    hits = F.sum((F.col("rel") > 0).cast("int")).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("hits", hits)
    good = F.col("rel") > 0
    got = rows.groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("dcg"),
        F.min(F.when(good, F.col("rank"))).alias("first"),
        (F.sum(F.when((F.col("rank") <= k) & good, 1).otherwise(0)) / k).alias("precision"),
        F.sum(F.when(good, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("s"),
    )
    best = qrels.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("rel").desc(), "docno")))
    ideal = best.groupBy("qid").agg(F.sum(F.when(F.col("place") <= k, F.col("rel") / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("ideal"), m.count_if(F.col("rel") > 0).alias("relevant"))
    zero = F.lit(0.0)
    return ideal.join(got, "qid", "left").select(
        "qid",
        F.coalesce(m.ratio(F.col("dcg"), F.col("ideal")), zero).alias("ndcg"),
        F.coalesce(1 / F.col("first"), zero).alias("rr"),
        F.coalesce("precision", zero).alias("precision"),
        F.coalesce(m.ratio(F.col("s"), F.col("relevant")), zero).alias("ap"),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in doubles; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return m.ratio(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def cosine_matrix(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, j, sim for every row i of ``left`` and j of ``right`` that share the keys (a document pair)."""
    both = left.withColumnRenamed("vector", "u").join(right.withColumnRenamed("vector", "v"), keys)
    return both.select(*keys, "i", "j", cosine(F.col("u"), F.col("v")).alias("sim"))


def best_threshold(df: DataFrame, steps: int = 100) -> DataFrame:
    """The threshold t in 0 .. 1 with the largest P(sim >= t | positive) + P(sim < t | negative); the smallest of equals.

    Similarities are counted per step before they are summed up, so the pairs meet no cross join.
    """
    step = F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor(F.col("sim") * (steps - 1) + 1e-9))).cast("int")
    step = F.when(F.col("sim") < 0, -1).otherwise(step)
    counts = df.groupBy(step.alias("k")).agg(m.count_if(F.col("positive")).alias("pos"), m.count_if(~F.col("positive")).alias("neg"))
    ks = df.sparkSession.range(-1, steps).select(F.col("id").cast("int").alias("k"))
    filled = ks.join(counts, "k", "left").na.fill(0)
    under = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    value = (F.sum("pos").over(whole) - F.coalesce(F.sum("pos").over(under), F.lit(0))) / F.sum("pos").over(whole) + F.coalesce(F.sum("neg").over(under), F.lit(0)) / F.sum("neg").over(whole)
    scored = filled.withColumn("value", F.round(value, 9)).filter("k >= 0")
    return scored.groupBy().agg(F.max_by("k", F.struct("value", -F.col("k"))).alias("k"), F.max("value").alias("value")).select((F.col("k") / (steps - 1)).alias("threshold"), "value")


def top_match(sims: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """The best j of each (keys, i), the smallest of equals, if it reaches the threshold."""
    best = sims.groupBy(*keys, "i").agg(F.max_by("j", F.struct(F.col("sim"), -F.col("j"))).alias("j"), F.max("sim").alias("sim"))
    return best.filter(F.col("sim") >= threshold)


def pair_prf(gold: DataFrame, run: DataFrame) -> DataFrame:
    """Precision, recall, F1 of unordered pairs (a, b); repeated reported pairs count in the precision's denominator.

    Null where nothing matches.
    """
    pair = [F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")]
    true = gold.select(*pair).distinct()
    found = run.select(*pair).groupBy("x", "y").agg(F.count(F.lit(1)).alias("times"))
    both = true.withColumn("g", F.lit(1)).join(found, ["x", "y"], "full")
    hit = m.count_if(F.col("g").isNotNull() & F.col("times").isNotNull()).cast("double")
    row = both.agg(hit.alias("hits"), F.sum("times").alias("reported"), F.count("g").alias("gold"))
    row = row.select(m.ratio(F.col("hits"), F.col("reported"), None).alias("precision"), m.ratio(F.col("hits"), F.col("gold"), None).alias("recall"))
    return row.select("precision", "recall", (2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))).alias("f1"))


def until_first(log: DataFrame, key: str, order: list[str], kind: str, query_kind: str, hit: Column) -> DataFrame:
    """Per key: events, queries and downloads, the numbers of both up to the first hit, and whether there is one."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = log.withColumns({"place": place, "hit": hit})
    first = F.min(F.when(F.col("hit"), F.col("place"))).over(Window.partitionBy(key))
    rows = rows.withColumn("first", first)
    is_query, before = F.col(kind) == query_kind, F.col("place") <= F.col("first")
    return rows.groupBy(key).agg(
        m.count_if(is_query).alias("queries"), m.count_if(~is_query).alias("downloads"), m.count_if(is_query & before).alias("queries_until"), m.count_if(~is_query & before).alias("downloads_until"), F.max("first").isNotNull().alias("found")
    )


def half_split(df: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """Adds ``half`` 1 or 2 per key in the order of ``by``; the first half gets the odd row."""
    return df.withColumn("half", F.ntile(2).over(Window.partitionBy(*keys).orderBy(by)))


def locate(text: Column, piece: Column) -> Column:
    """0-based offset of a piece; if it isn't there verbatim, the offset in the text with white space collapsed; -1 if in neither."""
    exact = F.instr(text, piece)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"[ \t\n]+", " "))
    loose = F.instr(squeeze(text), squeeze(piece))
    return F.when(exact > 0, exact - 1).when(loose > 0, loose - 1).otherwise(-1)
