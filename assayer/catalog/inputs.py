"""Input relations derived from the shared tables, in SQL that Spark and the oracle both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # verification: truth 0/1 per id and group; scores with ties, 0.5 and gaps
    "truth": "SELECT l.doc_id AS id, d.lang AS grp, d.source AS src, l.quality AS y, l.toxic AS y2 FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "run": """SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 0.5e0 ELSE CAST((doc_id * 7919 + quality * 23) % 101 AS DOUBLE) / 100 END AS value
              FROM labels WHERE doc_id % 13 <> 0""",
    "scored": "SELECT t.id, t.grp, t.src, t.y, COALESCE(r.value, 0.5e0) AS p FROM truth t LEFT JOIN run r ON t.id = r.id",
    # classes: lang against a distorted copy; some answers missing, some unknown
    "gold": "SELECT doc_id AS id, doc_id % 20 AS problem, lang AS label, source FROM documents",
    "answers": """SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'zz' WHEN doc_id % 4 = 0 THEN 'en' WHEN doc_id % 7 = 0 THEN 'fr' ELSE lang END AS label
                  FROM documents WHERE doc_id % 17 <> 0""",
    # style change: one 0/1 sequence per user in event order, and a distorted copy
    "seq": """SELECT user_id AS problem, pos, y, CASE WHEN event_id % 5 = 0 THEN 1 - y ELSE y END AS yhat, author, guess FROM (
                SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
                       CASE WHEN event_type = LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS y,
                       LENGTH(event_type) % 4 + 1 AS author, CASE WHEN event_id % 3 = 0 THEN event_id % 4 + 1 ELSE LENGTH(event_type) % 4 + 1 END AS guess
                FROM events) s""",
    # passages: cases and detections with this-side and source-side intervals
    "cases": """SELECT DISTINCT CONCAT('r', CAST(FLOOR(doc_id / 20) AS BIGINT)) AS ref, (doc_id % 10) * 60 AS off, 50 + n_chars % 100 AS len,
                  CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS sref, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE (doc_id % 6) * 30 END AS soff,
                  CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 40 + n_chars % 90 END AS slen, doc_id % 7 <> 0 AS ext FROM documents""",
    "dets": """SELECT DISTINCT CONCAT('r', CAST(FLOOR(doc_id / 20) AS BIGINT)) AS ref, (doc_id % 10) * 60 + (doc_id % 4) * 20 AS off, 30 + n_chars % 70 AS len,
                  CASE WHEN doc_id % 9 = 0 THEN '' ELSE source END AS sref, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE (doc_id % 6) * 30 + 10 END AS soff,
                  CASE WHEN doc_id % 9 = 0 THEN 0 ELSE 30 + n_chars % 60 END AS slen, doc_id % 9 <> 0 AS ext FROM documents WHERE doc_id % 3 <> 0""",
    # spans, inclusive ends, six labels and the empty one
    "gold_spans": """SELECT CAST(FLOOR(doc_id / 10) AS BIGINT) AS id, CASE WHEN doc_id % 8 = 7 THEN 'X' ELSE CONCAT('L', doc_id % 6) END AS label,
                       (doc_id % 10) * 15 AS s, (doc_id % 10) * 15 + n_chars % 40 AS e FROM documents""",
    "run_spans": """SELECT CAST(FLOOR(doc_id / 10) AS BIGINT) AS id, CASE WHEN doc_id % 9 = 8 THEN 'X' ELSE CONCAT('L', (doc_id + doc_id % 2) % 6) END AS label,
                      (doc_id % 10) * 15 + doc_id % 5 AS s, (doc_id % 10) * 15 + n_chars % 30 AS e FROM documents WHERE doc_id % 4 <> 0""",
    # several systems' scores for the same truth
    "systems": """SELECT CONCAT('s', s.k) AS system, t.id, t.grp, t.y, CASE WHEN (t.id + s.k) % 9 = 0 THEN 0.5e0
                    ELSE CAST((t.id * (7919 + 2 * s.k) + t.y * 11 * s.k) % 101 AS DOUBLE) / 100 END AS p
                  FROM truth t CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) s""",
    # items of three labels per row
    "multi": """SELECT id, label, y, yhat FROM (
                  SELECT doc_id AS id, 'quality' AS label, quality AS y, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE quality END AS yhat, doc_id FROM labels
                  UNION ALL SELECT doc_id, 'toxic', toxic, CASE WHEN doc_id % 6 = 0 THEN 1 - toxic ELSE toxic END, doc_id FROM labels
                  UNION ALL SELECT doc_id, 'even', CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END, doc_id FROM labels) m""",
    # retrieval: a query per customer over orders, graded by price
    "qrels": """SELECT CONCAT('q', o_custkey) AS qid, CONCAT('d', o_orderkey) AS docno, CASE WHEN o_totalprice > 200000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS rel
                FROM orders""",
    "ranked": """SELECT CONCAT('q', o_custkey) AS qid, CONCAT('d', o_orderkey) AS docno, CAST((o_orderkey * 37) % 1009 AS DOUBLE) / 1009 AS score
                 FROM orders WHERE o_orderkey % 5 <> 0""",
    # clusterings per problem
    "tclu": "SELECT doc_id % 20 AS problem, lang AS cluster, doc_id AS doc FROM documents",
    "aclu": "SELECT doc_id % 20 AS problem, source AS cluster, doc_id AS doc FROM documents WHERE doc_id % 6 <> 0",
    # unordered pairs with repeats and self pairs
    "gold_pairs": "SELECT DISTINCT l_partkey AS a, l_suppkey + 100000000 AS b FROM lineitem",
    "run_pairs": "SELECT CASE WHEN l_orderkey % 2 = 0 THEN l_partkey ELSE l_suppkey + 100000000 END AS a, CASE WHEN l_orderkey % 2 = 0 THEN l_suppkey + 100000000 + l_linenumber % 2 ELSE l_partkey END AS b FROM lineitem WHERE l_linenumber <= 3",
    # sentence pairs: each turn against the next of its conversation
    "pairs": """SELECT conv_id, turn, text AS hyp, nxt AS ref FROM (SELECT conv_id, turn, text, LEAD(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) c
                WHERE nxt IS NOT NULL""",
    # neural scores of detoxified texts, as given columns
    "detox": """SELECT doc_id AS id, lang, CAST(doc_id % 97 AS DOUBLE) / 97 AS sim_orig, CAST(doc_id % 89 AS DOUBLE) / 89 AS sim_ref, CAST(doc_id % 83 AS DOUBLE) / 83 AS t_in,
                  CAST(doc_id % 79 AS DOUBLE) / 79 AS t_out, CAST(doc_id % 73 AS DOUBLE) / 73 AS t_ref, CAST(doc_id % 71 AS DOUBLE) / 71 AS fluency FROM documents""",
    # watermark decisions: 0/1 truth and label per text and attack, with text quality
    "marks": """SELECT CAST(FLOOR(doc_id / 16) AS BIGINT) AS id, doc_id % 4 AS type, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS truth, CASE WHEN doc_id % 5 < 2 THEN 1 ELSE 0 END AS label,
                  CAST(FLOOR(doc_id / 16) % 13 AS DOUBLE) / 13 AS bleu, CAST(FLOOR(doc_id / 16) % 11 AS DOUBLE) / 11 AS bert FROM documents""",
    # rows of a clustering of characters, inclusive ends
    "dz_truth": "SELECT CAST(FLOOR(doc_id / 10) AS BIGINT) AS problem, doc_id % 3 AS cluster, (doc_id % 10) * 50 AS s, (doc_id % 10) * 50 + 49 AS e FROM documents",
    "dz_run": """SELECT CAST(FLOOR(doc_id / 10) AS BIGINT) AS problem, doc_id % 4 AS cluster, (doc_id % 10) * 50 + doc_id % 7 AS s, (doc_id % 10) * 50 + 49 AS e
                 FROM documents WHERE FLOOR(doc_id / 10) % 5 <> 0""",
}


def _closure(names: tuple[str, ...]) -> list[str]:
    """The views needed for ``names``, each after those it reads."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and other not in ordered and re.search(rf"\b(FROM|JOIN) {other}\b", VIEWS[name]):
                add(other)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    return ordered


def with_(*names: str, more: str = "") -> str:
    """A WITH clause that defines the views, and ``more`` after them."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in _closure(names)] + ([more] if more else [])
    return "WITH " + ",\n".join(parts) + "\n"


def tables(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Register the shared tables that ``text`` names."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = with_(name) + f"SELECT * FROM {name}"
    tables(spark, sf_dir, text)
    return spark.sql(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
