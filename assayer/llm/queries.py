"""The queries of this subpackage over the shared tables, and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import exact_dedup, lm_scoring, mixing, pii, quality, secrets, sentencepiece, sharding, simhash, substring_dedup, time_parts, url_filter, vector_codes

#: The rules of the query: (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


#: Weights of the query by level; other names weigh 1.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}
MIX_SHARE = 0.5

#: The model file, on the driver.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op4_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, ids, n_tokens, lossless under the query's parameters."""
    return sentencepiece.encode_documents(docs, sentencepiece.Vocabulary.load(PIECE_MODEL), dropout=0.1, seed=11)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def click_moment() -> Column:
    """The moment of a click: its time, for an eighth of the ids moved back by years, for another floored to its Monday."""
    m, k = time_parts.micros(F.col("ts")), F.crc32(F.col("click_id").cast("string")) % 128
    return F.when(k < 16, time_parts.days_before(m, (k + 6) * (k + 6) * (k + 6))).when(k > 111, time_parts.monday(m)).otherwise(m)


def op12_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = _table(spark, sf_dir, "clicks")
    before = time_parts.micros(F.col("arrived_at")) < (date(2024, 3, 1) - date(1970, 1, 1)).days * time_parts.DAY
    order = [time_parts.micros(F.col("arrived_at")), F.col("click_id").cast("long")]
    return time_parts.partition_twice(clicks, click_moment(), before, order, "click_id", share=650)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded_table(_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_url_filter": op2_url_filter,
    "op3_ring_sharding": op3_ring_sharding,
    "op4_repetition_rules": op4_repetition_rules,
    "op5_contextual_pii": op5_contextual_pii,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash": op7_simhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_mix_sources": op10_mix_sources,
    "op11_secret_scan": op11_secret_scan,
    "op12_time_partitions": op12_time_partitions,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {
    "op4_repetition_rules": """
        WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS ws FROM documents),
        toks AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
        grams AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
                  FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS i FROM w, (VALUES (5), (7), (10)) AS widths(n))),
        again AS (SELECT doc_id, n, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, n, g) > 1),
        inside AS (SELECT DISTINCT doc_id, n, i + k AS i FROM again, range(10) AS r(k) WHERE k < n),
        shares AS (SELECT doc_id, n, count(*) AS words, sum(length(word)) AS chars FROM inside JOIN toks USING (doc_id, i) GROUP BY doc_id, n),
        per AS (SELECT doc_id, max(words) FILTER (n = 5) AS w5, max(chars) FILTER (n = 5) AS c5, max(chars) FILTER (n = 7) AS c7, max(chars) FILTER (n = 10) AS c10
                FROM shares GROUP BY doc_id),
        lines AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
        dup AS (SELECT doc_id, count(*) AS n, sum(length(line)) AS chars
                FROM (SELECT * FROM lines WHERE regexp_matches(line, '[^\\x09-\\x0D ]') QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1) GROUP BY doc_id),
        base AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
                        coalesce(w5, 0) AS n_repeat_words, coalesce(dup.chars, 0) / greatest(length(text), 1) AS line_share,
                        coalesce(c5, 0) / greatest(word_chars, 1) AS s5, coalesce(c7, 0) / greatest(word_chars, 1) AS s7, coalesce(c10, 0) / greatest(word_chars, 1) AS s10
                 FROM w LEFT JOIN per USING (doc_id) LEFT JOIN dup USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND line_share <= 0.30 AND s5 <= 0.25 AND s7 <= 0.22 AND s10 <= 0.20 AS kept
        FROM base""",
    "op10_mix_sources": """
        WITH d AS (SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
                          CASE WHEN source IS NULL THEN '(none)' WHEN regexp_extract(source, '([0-9]{1,9})$', 1) = '' THEN 'd'
                               ELSE 'd' || (regexp_extract(source, '([0-9]{1,9})$', 1)::BIGINT % 4) END AS domain,
                          len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x09-\\x0D ]+'), lambda x: x <> '')) AS n_tokens FROM documents),
        rooms AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * 2 AS room FROM d GROUP BY ALL),
        {levels},
        leaf AS (SELECT domain, lang, source, tokens, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM b3),
        o AS (SELECT doc_id, domain, lang, source, n_tokens, budget, epochs, budget - epochs * tokens AS rest,
                     sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('5|' || epochs || '|' || coalesce(doc_id::VARCHAR, 'null')), doc_id
                                         ROWS UNBOUNDED PRECEDING) AS upto
              FROM d JOIN leaf USING (domain, lang, source))
        SELECT doc_id, domain, lang, source, n_tokens, budget, epochs + (rest > 0 AND n_tokens > 0 AND upto <= rest)::BIGINT AS copies FROM o""",
    "op2_url_filter": """
        WITH u AS (SELECT page_id, url, instr(url, '://') AS p FROM pages),
        r AS (SELECT page_id, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS s FROM u),
        h AS (SELECT page_id,
                     translate(regexp_extract(s, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(s, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        rules(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        m AS (SELECT page_id, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(verdict, length(rh) + length(rp)) AS verdict
              FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
        SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)""",
    "op6_substring_dedup": """
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS ws FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS i FROM w)),
        hit AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id),
        gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS cut_at FROM hit GROUP BY doc_id),
        k AS (SELECT w.doc_id, ws, CASE WHEN cut_at IS NULL THEN ws
                ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda p: NOT list_contains(cut_at, p[2])), lambda p: p[1]) END AS kept
              FROM w LEFT JOIN gone USING (doc_id))
        SELECT doc_id, len(ws) AS n_words, len(ws) - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}


def _level_sql(name: str, path: list[str], above: str, pool: str, weights: dict[str, int]) -> str:
    """Water filling of one level, as SQL."""
    at, keys = path[-1], ", ".join(path)
    part = f"PARTITION BY {', '.join(path[:-1])}" if path[:-1] else ""
    cases = " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items())
    weight = f"CASE {at} {cases} ELSE 1 END" if cases else "1"
    return f"""
        {name}a AS (SELECT {keys}, sum(room)::BIGINT AS room, sum(tokens)::BIGINT AS tokens, {weight} AS weight FROM rooms GROUP BY {keys}),
        {name}b AS (SELECT a.*, {pool} AS pool FROM {name}a a {above}),
        {name}c AS (SELECT *, coalesce(sum(room) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                           sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
                    FROM {name}b WINDOW w AS ({part} ORDER BY room::DOUBLE / weight, {at})),
        {name}d AS (SELECT *, room::DOUBLE * onward <= (pool - before)::DOUBLE * weight AS is_full FROM {name}c),
        {name} AS (SELECT {keys}, tokens, CASE WHEN is_full THEN room ELSE least(room, floor(
                          (pool - sum(CASE WHEN is_full THEN room ELSE 0 END) OVER ({part}))::DOUBLE * weight
                          / nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part}), 0))::BIGINT) END::BIGINT AS budget FROM {name}d)"""


ORACLES["op10_mix_sources"] = ORACLES["op10_mix_sources"].replace(
    "{levels}",
    ", ".join(
        [
            _level_sql("b1", ["domain"], "", f"(SELECT floor(sum(tokens) * {MIX_SHARE}::DOUBLE)::BIGINT FROM rooms)", MIX_WEIGHTS["domain"]),
            _level_sql("b2", ["domain", "lang"], "JOIN b1 USING (domain)", "b1.budget", MIX_WEIGHTS["lang"]),
            _level_sql("b3", ["domain", "lang", "source"], "JOIN b2 USING (domain, lang)", "b2.budget", {}),
        ]
    ),
)


def _lloyd_sql(rounds: int) -> str:
    """Lloyd rounds with every distance worked out."""
    steps = ["""
        kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (SELECT r, vec_id, p, v[p * len(v) // 8 + 1:(p + 1) * len(v) // 8] AS x FROM kept, range(8) AS t(p)),
        first AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept QUALIFY e < 16),
        b0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN first USING (r))"""]
    for k in range(rounds + 1):
        steps.append(f"""
        a{k} AS MATERIALIZED (SELECT r, p, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS best
                 FROM parts JOIN b{k} USING (p) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""
        b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM b{k} LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS m FROM (
                 SELECT p, e, i, floor(sum(y) / count(*))::BIGINT AS m FROM (SELECT p, best.e AS e, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{k} JOIN parts USING (r, p)) GROUP BY ALL) GROUP BY ALL)
                 USING (p, e))""")
    return f"""
        WITH {", ".join(steps)},
        coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (r)"""


ORACLES["op13_vector_codes"] = _lloyd_sql(6)
