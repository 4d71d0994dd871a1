"""URL filter: a broadcast trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
Rule = tuple[str, str, str]


class UrlTrie:
    """Host labels from the last to the first, then path segments.

    A rule's path is a prefix of the url's path as text: all its segments but the
    last must be equal, and the last is a prefix of the url's segment there. A node
    keeps these last pieces, so ``/en/`` (last piece empty) fits ``/en/x`` but not
    ``/en``. Of the rules that fit, the one with most host labels wins, then the
    longest path; of one host and path listed twice, block wins.
    """

    __slots__ = ("root",)

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("h", {}).setdefault(label, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault("p", {}).setdefault(segment, {})
            ends = node.setdefault("e", {})
            if ends.get(last, ("",))[0] != "block":
                ends[last] = (verdict, host + path)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits, else None."""
        node, found = self.root, None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("h", {}).get(label)
            if node is None:
                break
            at: dict | None = node
            for segment in segments:
                ends = at.get("e")
                if ends:
                    fits = [last for last in ends if segment.startswith(last)]
                    if fits:
                        found = ends[max(fits, key=len)]
                at = at.get("p", {}).get(segment)
                if at is None:
                    break
        return found


def host_and_path(url) -> tuple:
    """Columns (host, path): host after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(
    df: DataFrame,
    rules: Iterable[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_broadcast_rules: int = 1_000_000,
) -> DataFrame:
    """Judge every url: ``id_col``, host, path, rule (null if none fits), verdict.

    Up to ``max_broadcast_rules`` rules are broadcast as one trie and looked up per
    Arrow batch, with no shuffle whatever the spread of hosts. A longer list goes
    the relational way: the host's suffixes join the rules, and the longest rule is
    taken per row. A null url, or one without ``://``, has empty host and path and
    gets the default. Repeated rows each get their own verdict; other columns are
    not read; an empty table gives an empty result.
    """
    rules = [(v, h, p) for v, h, p in rules]
    host, path = host_and_path(F.col(url_col))
    urls = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.select("id", "host", "path")
    if len(rules) > max_broadcast_rules:
        return _by_join(urls, rules, id_col, default)
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("struct<verdict string, rule string>")
    def look_up(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for hosts, paths in batches:
            found = [find(h, p) or (None, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["verdict", "rule"], dtype=object)

    judged = urls.withColumn("r", look_up("host", "path"))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict")
    )


def _by_join(urls: DataFrame, rules: list[Rule], id_col: str, default: str) -> DataFrame:
    """The same verdicts for rule lists too long to broadcast."""
    spark = urls.sparkSession
    table = spark.createDataFrame(rules, "v string, rh string, rp string")
    rows = urls.withColumn("n", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = rows.select("n", "path", F.explode(suffixes).alias("rh")).join(table, "rh").filter(F.startswith("path", F.col("rp")))
    rank = F.struct(F.size(F.split("rh", r"\.")), F.length("rp"), (F.col("v") == "block").cast("int"))
    best = near.groupBy("n").agg(F.max_by(F.struct("v", F.concat("rh", "rp").alias("rule")), rank).alias("r"))
    return rows.join(best, "n", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.v", F.lit(default)).alias("verdict")
    )
