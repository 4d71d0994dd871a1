"""Topics of texts: non-negative factors of a (text, term) table by alternating updates, and the cosine of topic mixtures."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import measures as m
from assayer.plans import bounded_batches, checkpoint_folder, cut, remove_folder

#: Numbers (topics x terms) that a factor may have: the driver and every task hold it.
LARGEST = 1 << 23
TINY = 1e-12


class Topics(NamedTuple):
    """``mixtures``: the given rows without idx and val, and ``w``, an array of a weight a topic; ``terms`` (topic, term); ``losses``: the squared error before each update of the terms."""

    mixtures: DataFrame
    terms: np.ndarray
    losses: list[float]


def _chunk_counts(tokens: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of lists of tokens cut into chunks of ``size``, the last one shorter: (the list and the number of each chunk; chunk, term and count of each chunk's terms, by chunk and term; the terms)."""
    lengths = tokens.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    terms = coded.dictionary.to_pylist()
    many = -(-lengths // size)
    of = np.repeat(np.arange(len(lengths)), many)
    number = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    chunk = np.repeat(np.cumsum(many) - many, lengths) + place // size
    pair, n = np.unique(chunk * max(1, len(terms)) + coded.indices.to_numpy(), return_counts=True)
    return of, number, pair // max(1, len(terms)), pair % max(1, len(terms)), n, terms


def chunk_terms(texts: DataFrame, tokens: str, size: int) -> DataFrame:
    """gram, df, total: how many chunks of ``size`` tokens each term is in, and how often; the row without a term has the number of chunks as df. Counted inside the
    tasks, so that no row of a chunk and a term is shuffled."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, _, _, term, n, terms = _chunk_counts(batch.column(0), size)
            df, total = np.bincount(term, minlength=len(terms)), np.bincount(term, n, len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([*terms, None], pa.string()), pa.array(np.append(df, len(of))), pa.array(np.append(total, 0))], names=["gram", "df", "total"])

    found = texts.select(tokens).mapInArrow(run, "gram string, df long, total long")
    return found.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def frequent_terms(totals: DataFrame, texts: int, least: int, share: float, most: int) -> DataFrame:
    """gram, idx, df: the up to ``most`` terms of ``totals`` (gram, df, total) of the highest total count that at least ``least`` and at most the ``share`` of the texts have, numbered by
    total, then by term."""
    kept = totals.filter(F.col("gram").isNotNull() & (F.col("df") >= least) & (F.col("df") <= share * texts)).orderBy(F.col("total").desc(), "gram").limit(most)
    return cut(kept.select("gram", (F.row_number().over(Window.orderBy(F.col("total").desc(), "gram")) - 1).alias("idx"), "df"))


def chunk_rows(texts: DataFrame, key: str, tokens: str, size: int, vocabulary: DataFrame, total: int) -> DataFrame:
    """key, chunk, idx (ascending), val: for each chunk of ``size`` tokens its terms' counts times ``ln((1 + total) / (1 + df)) + 1``, in rows of length 1.

    ``vocabulary`` (gram, idx, df) is as small as a factor has terms. A chunk is worked out where its text lies.
    """
    known = vocabulary.select("gram", "idx", "df").collect()
    numbers, weights = {r["gram"]: r["idx"] for r in known}, np.zeros(len(known))
    for r in known:
        weights[r["idx"]] = np.log((1 + total) / (1 + r["df"])) + 1
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, number, chunk, term, n, terms = _chunk_counts(batch.column(1), size)
            idx = np.array([numbers.get(t, -1) for t in terms], np.int64)[term]
            kept = np.flatnonzero(idx >= 0)
            kept = kept[np.lexsort((idx[kept], chunk[kept]))]
            chunk, idx = chunk[kept], idx[kept]
            value = n[kept] * weights[idx]
            value /= np.sqrt(np.bincount(chunk, value * value, len(of)))[chunk]
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(chunk, minlength=len(of))))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (idx.astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(number.astype(np.int32)), *lists], names=[key, "chunk", "idx", "val"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, tokens).mapInArrow(run, f"`{key}` {kind}, chunk int, idx array<int>, val array<double>")


def start_factors(topics: int, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).random((topics, size)) + 0.01


def _products(idx: pa.Array, val: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(v H' (n, topics), flat terms, flat values, row of each)."""
    sizes = idx.value_lengths().to_numpy()
    flat, values = idx.flatten().to_numpy(), val.flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    return np.stack([np.bincount(row, values * t[flat], len(sizes)) for t in terms], axis=1), flat, values, row


def factorise(rows: DataFrame, key: str, size: int, topics: int, rounds: int = 30, seed: int = 14) -> Topics:
    """Non-negative factors of ``rows`` (key, idx, val) with ``size`` terms: V ~ W H by multiplicative updates, which never raise the squared error.

    A round is one pass: every task updates the weights of its rows for the terms as they are, writes the rows with their new weights, and beside them one row of sums (W'V, W'W,
    and the error), so that a task that is run again counts once. The sums are topics x terms, whatever the rows; the driver updates the terms from
    them. Weights start from keyed hashes of the row's key, so they do not depend on how rows are split. The table of the last round stays in the checkpoint folder.
    Rows without terms get weights of zero; keys and further columns are carried as they are.
    """
    if topics * size > LARGEST:
        raise ValueError(f"{topics} topics of {size} terms are over {LARGEST} numbers; keep fewer terms")
    spark = rows.sparkSession
    bounded_batches(spark)
    folder = f"{checkpoint_folder(spark)}/topics-{uuid.uuid4().hex}"
    kind = dict(rows.dtypes)[key]
    others = [c for c in rows.columns if c not in (key, "idx", "val")]
    carried = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    schema = f"k {kind}, idx array<int>, val array<double>, w array<double>, sums binary{carried}"
    start = F.transform(F.sequence(F.lit(1), F.lit(topics)), lambda t: (F.pmod(F.xxhash64(F.lit(seed), F.col(key), t), F.lit(1 << 20)) + 1) / F.lit(float(1 << 20)))
    table = rows.select(F.col(key).alias("k"), "idx", "val", start.alias("w"), *others)
    terms, losses = start_factors(topics, size, seed), []

    def update(given: np.ndarray):
        gram = given @ given.T

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wv, ww, error = np.zeros((topics, size)), np.zeros((topics, topics)), 0.0
            kinds = None
            for batch in batches:
                kinds = [c.type for c in batch.columns]
                if not batch.num_rows:
                    continue
                w = batch.column(3).flatten().to_numpy().reshape(-1, topics)
                vh, flat, values, row = _products(batch.column(1), batch.column(2), given)
                w = w * vh / np.maximum(w @ gram, TINY)
                for t in range(topics):
                    wv[t] += np.bincount(flat, values * w[row, t], size)
                ww += w.T @ w
                error += (values * values).sum()
                new = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, topics), pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], new, pa.nulls(batch.num_rows, pa.binary()), *batch.columns[4:]], names=["k", "idx", "val", "w", "sums", *others])
            error += (ww * gram).sum() - 2 * (wv * given).sum()
            sums = pa.array([np.concatenate([wv.ravel(), ww.ravel(), [error]]).tobytes()], pa.binary())
            if kinds is not None:
                empty = [pa.nulls(1, t) for t in kinds]
                yield pa.RecordBatch.from_arrays([*empty[:4], sums, *empty[4:]], names=["k", "idx", "val", "w", "sums", *others])

        return run

    for k in range(rounds):
        table.select("k", "idx", "val", "w", *others).mapInArrow(update(terms), schema).write.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
        written = spark.read.schema(schema).parquet(f"{folder}/{k}")
        total = _added(written.filter("sums is not null").select("sums"), topics * (size + topics) + 1)
        wv, ww = total[: topics * size].reshape(topics, size), total[topics * size : -1].reshape(topics, topics)
        losses.append(float(total[-1]))
        table = written.filter("sums is null")
        if k < rounds - 1:
            terms = terms * wv / np.maximum(ww @ terms, TINY)
    return Topics(table.select(F.col("k").alias(key), "w", *others), terms, losses)


def _added(sums: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' arrays: added up in a few tasks, then from these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = np.zeros(size)
    for r in sums.coalesce(16).mapInArrow(run, "sums binary").collect():
        total += np.frombuffer(r["sums"])
    return total


def top_terms(terms: np.ndarray, names: list[str], most: int) -> list[tuple[int, int, str, float]]:
    """(topic, rank, term, weight) of the ``most`` heaviest terms of each topic; ties by the term's number."""
    return [(t, r + 1, names[i], float(w[i])) for t, w in enumerate(terms) for r, i in enumerate(np.lexsort((np.arange(len(w)), -w))[:most])]


def mean_mixture(mixtures: DataFrame, key: str, topics: int) -> DataFrame:
    """key, w: the mean of the mixtures of a text's chunks, topic by topic."""
    means = [F.avg(F.col("w")[t]) for t in range(topics)]
    return mixtures.groupBy(key).agg(F.array(*means).alias("w"))


def mixture_cosine(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """``pairs`` with ``cosine``, of the arrays ``first`` and ``second``; 0 where either has no weight."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.withColumn("cosine", m.ratio(dot(first, second), F.sqrt(dot(first, first) * dot(second, second))))
