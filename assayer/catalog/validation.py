"""Validator queries over the shared tables, with faults derived from ids."""

from pyspark.sql import functions as F

from assayer.catalog.inputs import table, view, with_
from assayer.operators import validate as va
from assayer.registry import query


@query("va_missing_ids", with_("gold", "answers") + "SELECT id::VARCHAR AS item, 'MISSING_ID' AS error FROM gold WHERE id NOT IN (SELECT id FROM answers)")
def va_missing_ids(spark, d):
    return va.missing_ids(view(spark, d, "gold"), view(spark, d, "answers"), "id")


ODD = "o AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 14 = 0 THEN ' ' ELSE source END AS source FROM documents)"


def _odd(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.when(i % 9 != 0, F.col("lang")).alias("lang"), F.when(i % 14 == 0, " ").otherwise(F.col("source")).alias("source"))


@query("va_required_attrs", "WITH " + ODD + " SELECT doc_id::VARCHAR AS item, 'MISSING_LANG' AS error FROM o WHERE lang IS NULL OR trim(lang) = '' UNION ALL SELECT doc_id::VARCHAR, 'MISSING_SOURCE' FROM o WHERE source IS NULL OR trim(source) = ''")
def va_required_attrs(spark, d):
    return va.required(_odd(spark, d), "doc_id", ["lang", "source"])


@query("va_nulls", "WITH " + ODD + " SELECT 'lang' AS item, count(*) FILTER (lang IS NULL OR trim(lang) = '') AS n FROM o UNION ALL SELECT 'source', count(*) FILTER (source IS NULL OR trim(source) = '') FROM o")
def va_nulls(spark, d):
    return va.nulls(_odd(spark, d), ["lang", "source"])


SPANS = "s AS (SELECT doc_id, (doc_id % 50) * 40 - 20 AS off, 100 AS len, length(text) AS n FROM documents)"


@query("va_offsets", "WITH " + SPANS + " SELECT doc_id::VARCHAR AS item, 'NEGATIVE_OFFSET' AS error FROM s WHERE off < 0 UNION ALL SELECT doc_id::VARCHAR, 'BEYOND_TEXT' FROM s WHERE off + len > n")
def va_offsets(spark, d):
    docs = table(spark, d, "documents")
    spans = docs.select("doc_id", ((F.col("doc_id") % 50) * 40 - 20).alias("off"), F.lit(100).alias("len"))
    return va.offsets(spans, docs.select("doc_id", F.length("text").alias("n")), "doc_id", "doc_id", "off", "len", "n")


@query("va_referential", "SELECT l_orderkey::VARCHAR || ':' || l_linenumber AS item, 'UNKNOWN_ORDER' AS error FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)")
def va_referential(spark, d):
    lines = table(spark, d, "lineitem").withColumn("line", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    return va.referential(lines, table(spark, d, "orders").filter("o_orderkey % 7 <> 0"), "l_orderkey", "o_orderkey", "line", "UNKNOWN_ORDER")


@query("va_changes", with_("seq", more="c AS (SELECT problem, list(CASE WHEN problem % 11 = 0 AND pos = 1 THEN 2 ELSE y END) AS ch, count(*) + (problem % 5 <> 0)::INT AS n FROM seq GROUP BY problem)") + """
    SELECT problem::VARCHAR AS item, 'INVALID_FORMAT' AS error FROM c WHERE list_contains(ch, 2) UNION ALL SELECT problem::VARCHAR, 'INVALID_LENGTH' FROM c WHERE len(ch) <> n - 1""")
def va_changes(spark, d):
    value = F.when((F.col("problem") % 11 == 0) & (F.col("pos") == 1), 2).otherwise(F.col("y"))
    rows = view(spark, d, "seq").groupBy("problem").agg(F.collect_list(value).alias("ch"), F.count(F.lit(1)).alias("c"))
    rows = rows.withColumn("n", F.col("c") + (F.col("problem") % 5 != 0).cast("int"))
    return va.changes(rows, "problem", "ch", "n")


@query("va_authors", with_("seq", more="c AS (SELECT problem, list(author + (problem % 4 = 0)::INT * 2) AS a, count(*) + (problem % 6 = 0)::INT AS n FROM seq GROUP BY problem)") + """
    SELECT problem::VARCHAR AS item, 'INVALID_AUTHOR' AS error FROM c WHERE list_max(a) > 5 UNION ALL SELECT problem::VARCHAR, 'INVALID_LENGTH' FROM c WHERE len(a) <> n""")
def va_authors(spark, d):
    rows = view(spark, d, "seq").groupBy("problem").agg(F.collect_list(F.col("author") + (F.col("problem") % 4 == 0).cast("int") * 2).alias("a"), F.count(F.lit(1)).alias("c"))
    return va.authors(rows.withColumn("n", F.col("c") + (F.col("problem") % 6 == 0).cast("int")), "problem", "a", "n")


@query("va_labels", "SELECT doc_id::VARCHAR AS item, CASE WHEN lang = 'es' THEN 'UNKNOWN_LABEL' ELSE 'NO_LABEL' END AS error FROM documents WHERE lang = 'es' OR doc_id % 10 = 0 AND lang <> 'es'")
def va_labels(spark, d):
    none = (F.col("doc_id") % 10 == 0) & (F.col("lang") != "es")
    rows = table(spark, d, "documents").select("doc_id", F.when(none, F.array().cast("array<string>")).otherwise(F.array("lang")).alias("labels"))
    return va.labels(rows, "doc_id", "labels", ["en", "de", "fr"])


@query("va_id_sets", with_("truth", "run") + """SELECT id::VARCHAR AS item, 'MISSING_ID' AS error FROM truth WHERE id % 8 <> 0 AND id NOT IN (SELECT id FROM run)
    UNION ALL SELECT id::VARCHAR, 'UNKNOWN_ID' FROM run WHERE id % 8 = 0""")
def va_id_sets(spark, d):
    return va.id_sets(view(spark, d, "truth").filter("id % 8 <> 0"), view(spark, d, "run"), "id")


@query("va_spans", with_("run_spans") + "SELECT id || ':' || label || ':' || s AS item, 'END_BEFORE_START' AS error FROM run_spans WHERE e < s UNION ALL SELECT id || ':' || label || ':' || s, 'EMPTY_LABEL' FROM run_spans WHERE label = 'X'")
def va_spans(spark, d):
    rows = view(spark, d, "run_spans").withColumn("item", F.concat_ws(":", "id", "label", "s"))
    return va.errors(rows, "item", {"END_BEFORE_START": F.col("e") < F.col("s"), "EMPTY_LABEL": F.col("label") == "X"})


@query("va_duplicates", "SELECT l_orderkey::VARCHAR AS item, 'DUPLICATE_ID' AS error FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def va_duplicates(spark, d):
    return va.duplicates(table(spark, d, "lineitem"), "l_orderkey")
