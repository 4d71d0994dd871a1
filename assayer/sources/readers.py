"""Readers: every one names its schema, so nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATION_FILE = (
    "_reference string, feature array<struct<_name: string, _this_offset: long, _this_length: long, _source_reference: string, "
    "_source_offset: long, _source_length: long, _llm: string, _obfuscation: string, _severity: string>>"
)


def annotations(spark: SparkSession, path: str, tag: str, llm: str | None = None, obfuscation: str | None = None, severity: str | None = None) -> DataFrame:
    """Passage annotations of XML documents whose feature name ends with ``tag``: ref, off, len, sref, soff, slen, ext.

    A feature with another llm or obfuscation than asked for is left out, one without passes; an ``about``
    feature of another severity leaves out its whole document.
    """
    docs = spark.read.format("xml").option("rowTag", "document").schema(ANNOTATION_FILE).load(path)
    features = F.coalesce("feature", F.array().cast("array<struct<_name: string, _this_offset: long, _this_length: long, _source_reference: string, _source_offset: long, _source_length: long, _llm: string, _obfuscation: string, _severity: string>>"))
    if severity is not None:
        other = F.exists(features, lambda f: (f["_name"] == "about") & f["_severity"].isNotNull() & (f["_severity"] != severity))
        docs = docs.filter(~other)
    rows = docs.select("_reference", F.explode(features).alias("f")).filter(F.col("f._name").endswith(tag))
    for value, name in ((llm, "_llm"), (obfuscation, "_obfuscation")):
        if value is not None:
            rows = rows.filter(F.col(f"f.{name}").isNull() | (F.col(f"f.{name}") == value))
    ext = F.col("f._source_reference").isNotNull() & F.col("f._source_offset").isNotNull() & F.col("f._source_length").isNotNull()
    plain = lambda c: F.regexp_replace(c, r"\.txt$", "")
    return rows.select(
        plain(F.col("_reference")).alias("ref"),
        F.col("f._this_offset").alias("off"),
        F.col("f._this_length").alias("len"),
        F.when(ext, plain(F.col("f._source_reference"))).otherwise("").alias("sref"),
        F.when(ext, F.col("f._source_offset")).otherwise(0).alias("soff"),
        F.when(ext, F.col("f._source_length")).otherwise(0).alias("slen"),
        ext.alias("ext"),
    ).distinct()


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """Two names per line: ref, sref."""
    parts = F.split(F.trim("value"), " +")
    return spark.read.text(path).filter(F.trim("value") != "").select(parts[0].alias("ref"), parts[1].alias("sref"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; lines that don't parse have them in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def verification_answers(spark: SparkSession, path: str) -> DataFrame:
    """id and value, which may be a number, a boolean ``same``, or a pair of booleans ``is_human`` (0 if the first is true)."""
    rows = spark.read.schema("id string, value string, same boolean, is_human string").json(path)
    pair = F.from_json("is_human", "array<boolean>")
    value = F.coalesce(F.try_to_number("value", F.lit("9.999999")).cast("double"), F.expr("try_cast(value AS double)"), F.col("same").cast("int").cast("double"), F.when(pair[0], 0.0).when(pair[1], 1.0), F.expr("try_cast(is_human AS double)"))
    return rows.select("id", value.alias("value"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """TREC judgements ``qid 0 docno rel``."""
    p = F.split(F.trim("value"), "[ \t]+")
    return spark.read.text(path).filter(F.trim("value") != "").select(p[0].alias("qid"), p[2].alias("docno"), p[3].cast("int").alias("rel"))


def trec_run(spark: SparkSession, path: str) -> DataFrame:
    """TREC run ``qid Q0 docno rank score tag``."""
    p = F.split(F.trim("value"), "[ \t]+")
    return spark.read.text(path).filter(F.trim("value") != "").select(p[0].alias("qid"), p[2].alias("docno"), p[4].cast("double").alias("score"))


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Truth lines ``uid:::gender:::age``."""
    p = F.split("value", ":::")
    return spark.read.text(path).filter(F.trim("value") != "").select(p[0].alias("uid"), p[1].alias("gender"), p[2].alias("age_group"))


def attribution(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth of attribution problems: problem (the file's folder), unknown_text, author."""
    rows = spark.read.schema("ground_truth array<struct<`unknown-text`: string, `true-author`: string>>").option("multiLine", True).json(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(folder.alias("problem"), F.explode("ground_truth").alias("g")).select("problem", F.col("g.`unknown-text`").alias("unknown_text"), F.col("g.`true-author`").alias("author"))


def delimited(spark: SparkSession, path: str, schema: str, separator: str = "\t", header: bool = False, quote: str = '"') -> DataFrame:
    """Rows of a table with one separator (a tab, a comma, a blank) under a schema; a line that does not fit has its text in ``_corrupt_record``."""
    reader = spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.option("sep", separator).option("header", header).option("quote", quote).option("mode", "PERMISSIVE").csv(path)


def text_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """folder, name, text of the whole files whose name the pattern (a regular expression) fits; the folder is the last one above the file."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    rows = rows.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), F.col("value").alias("text"))
    return rows.filter(F.col("name").rlike(f"^(?:{pattern})$"))
