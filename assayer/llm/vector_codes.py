"""Vector codes: product quantisation by Lloyd rounds with Elkan's bounds, in whole numbers."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.plans import bounded_batches, checkpoint_folder, cut, fresh_names, join_counted, remove_folder

#: Components at or beyond this, after scaling, are refused: squared distances must fit into 64 bits.
LARGEST = 1 << 25
#: Rows of a batch whose distances to all entries are worked out at once.
BLOCK = 2048
STATE = "id long, label string, x binary, code binary, upper binary, lower binary, error long, part int, entry int, n long, total array<long>"
STATE_NAMES = ["id", "label", "x", "code", "upper", "lower", "error", "part", "entry", "n", "total"]


class Codes(NamedTuple):
    """``rows``: id, label (text), code (one byte a part), error; ``codebooks`` (part, entry, place); ``asked``: exact distances worked out in each round."""

    rows: DataFrame
    codebooks: np.ndarray
    asked: list[int]


def _up(x: np.ndarray) -> np.ndarray:
    """As float32, never less."""
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def _down(x: np.ndarray) -> np.ndarray:
    """As float32, never more, and not below zero."""
    y = x.astype(np.float32)
    return np.maximum(np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y), np.float32(0))


def _root_up(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squared.astype(np.float64)) * (1 + 1e-15), np.inf)


def _root_down(squared: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(squared.astype(np.float64)) * (1 - 1e-15), -np.inf), 0)


def first_assignment(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, upper, lower) of vectors (n, parts, width) from all their distances; the nearest entry, ties to the lower index."""
    n, parts, entries = len(x), *book.shape[:2]
    code, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.float32), np.zeros((n, parts, entries), np.float32)
    for at in range(0, n, BLOCK):
        some = slice(at, at + BLOCK)
        apart = x[some, :, None, :] - book[None]
        squared = (apart * apart).sum(axis=3)
        code[some] = squared.argmin(axis=2)
        upper[some] = _up(_root_up(squared.min(axis=2)))
        lower[some] = _down(_root_down(squared))
    return code, upper, lower


def next_assignment(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Elkan's step, in place; returns the number of exact distances worked out.

    The bounds are shifted by the entries' movement first. An entry is passed over only if it is
    strictly farther than the own one, by its lower bound or by half the distance between the two
    entries; all others are compared by whole squared distances, so a tie is always seen and goes to the lower index.
    """
    parts, entries = book.shape[:2]
    part = np.arange(parts)
    upper += _up(moved[part[None, :], code])
    upper[:] = np.nextafter(upper, np.float32(np.inf))  # the sum itself is rounded
    lower[:] = _down(lower.astype(np.float64) - moved[None])
    between = book[:, :, None, :] - book[:, None, :, :]
    half = 0.5 * _root_down((between * between).sum(axis=3))
    apart = half + np.where(np.eye(entries, dtype=bool), np.inf, 0)[None]
    row, p = np.nonzero(upper >= apart.min(axis=2)[part[None, :], code])
    own = code[row, p]
    keep = _maybe(upper[row, p], lower[row, p], half[p, own], own).any(axis=1)
    row, p, own = row[keep], p[keep], own[keep]
    squared = _squared(x, book, row, p, own)
    tight = _up(_root_up(squared))
    maybe = _maybe(tight, lower[row, p], half[p, own], own)
    at, entry = np.nonzero(maybe)
    exact = np.full((len(row), entries), np.iinfo(np.int64).max)
    exact[np.arange(len(row)), own] = squared
    exact[at, entry] = _squared(x, book, row[at], p[at], entry)
    best = exact.argmin(axis=1)
    known = lower[row, p]
    known[at, entry] = _down(_root_down(exact[at, entry]))
    known[np.arange(len(row)), own] = _down(_root_down(squared))
    lower[row, p] = known
    code[row, p] = best
    upper[row, p] = _up(_root_up(exact[np.arange(len(row)), best]))
    return len(row) + len(at)


def _maybe(upper: np.ndarray, lower: np.ndarray, half: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which other entries might be as near as the own one."""
    found = (upper[:, None] >= lower) & (upper[:, None] >= half)
    found[np.arange(len(own)), own] = False
    return found


def _squared(x: np.ndarray, book: np.ndarray, row: np.ndarray, p: np.ndarray, entry: np.ndarray) -> np.ndarray:
    out = np.zeros(len(row), np.int64)
    for at in range(0, len(row), 1 << 16):
        some = slice(at, at + (1 << 16))
        apart = x[row[some], p[some]] - book[p[some], entry[some]]
        out[some] = (apart * apart).sum(axis=1)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(flat.shape[1]), len(rows), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _from_binary(column: pa.Array, dtype, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


def _round(book: np.ndarray, moved: np.ndarray | None):
    """One pass: every row with its new code and bounds, then the task's sums by part and entry and, as part -1, the distances it asked for."""
    parts, entries, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, asked = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if moved is None:
                flat = batch.column(2)
                if (flat.value_lengths().to_numpy() != parts * width).any():
                    raise ValueError(f"vectors must all have the length {parts * width} of the first ones")
                x = flat.flatten().to_numpy(zero_copy_only=False).reshape(n, parts, width)
                if x.size and np.abs(x).max() >= LARGEST:
                    raise ValueError(f"a scaled component is {LARGEST} or more")
                code, upper, lower = first_assignment(x, book)
                asked += n * parts * entries
            else:
                x = _from_binary(batch.column(2), np.int32, parts, width).astype(np.int64)
                code = _from_binary(batch.column(3), np.uint8, parts).astype(np.int64)
                upper, lower = (_from_binary(batch.column(k), np.float32, parts, *more).copy() for k, more in ((4, ()), (5, (entries,))))
                asked += next_assignment(x, book, moved, code, upper, lower)
            every = np.arange(n)[:, None]
            apart = x - book[np.arange(parts)[None, :], code]
            error = (apart * apart).sum(axis=(1, 2))
            place = code + np.arange(parts)[None, :] * entries
            count += np.bincount(place.ravel(), minlength=parts * entries).reshape(parts, entries)
            np.add.at(total.reshape(parts * entries, width), place.ravel(), x[every, np.arange(parts)[None, :]].reshape(n * parts, width))
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            columns = [batch.column(0), batch.column(1), _binary(x.astype(np.int32)), _binary(code.astype(np.uint8)), _binary(upper), _binary(lower), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns + none, names=STATE_NAMES)
        p, e = np.nonzero(count)
        k = len(p) + 1
        sums = [pa.array([*p.tolist(), -1], pa.int32()), pa.array([*e.tolist(), 0], pa.int32()), pa.array([*count[p, e].tolist(), asked], pa.int64())]
        sums.append(pa.array([*total[p, e].tolist(), []], pa.list_(pa.int64())))
        empty = [pa.nulls(k, t) for t in (pa.int64(), pa.string(), *[pa.binary()] * 4, pa.int64())]
        yield pa.RecordBatch.from_arrays(empty + sums, names=STATE_NAMES)

    return run


def _start(kept: DataFrame, entries: int, parts: int) -> np.ndarray:
    """The first codebooks: the parts of the vectors of the smallest ids (nulls last, ties by the vector), fewer if there are fewer rows."""
    first = kept.orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    width = len(first[0]["x"])
    if width % parts or any(len(r["x"]) != width for r in first):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    return np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()


def _updated(spark: SparkSession, path: str, book: np.ndarray) -> tuple[np.ndarray, int]:
    """The codebooks after a round, from the tasks' sums (at most parts x entries rows): whole means, down; unused entries stay."""
    width = book.shape[2]
    sums = spark.read.schema(STATE).parquet(path).filter("part is not null").groupBy("part", "entry")
    new, asked = book.copy(), 0
    for r in sums.agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(width)]).collect():
        if r["part"] < 0:
            asked = r["n"]
        else:
            new[r["part"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return new, asked


def compress_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> Codes:
    """Product-quantised codes of all vectors of ``df``.

    Rows whose vector is null or has a null or non-finite component are dropped; each component x becomes floor(scale * x). A vector is cut
    into ``parts`` equal parts, each with a codebook of ``entries`` entries, at first those of the smallest ids. Each round assigns every part to the
    nearest entry (ties to the lower index) and moves each used entry to the whole mean of its parts, rounded down; at the end all are assigned again.

    Elkan: with each row its code, an upper bound of the distance to the own entry and one lower bound per entry are kept, for every part, as float32
    rounded away from pruning. A round is one pass that reads a table of rows and bounds and writes the next (in the shared checkpoint folder; the one before is then
    removed, the last stays); it shifts the bounds by the entries' movement and works out only distances that they leave open. The tasks' sums are written with
    the rows, so a task that is run again counts once, and only sums by part and entry reach the driver. Nothing is shuffled but these.

    Null ids are kept and count as the largest; repeated rows count as often as they come; fewer rows than ``entries`` give so many entries; an empty table gives no
    rows and empty codebooks. Vectors of different lengths, of a length that ``parts`` does not divide, or with scaled components of 2**25 or more are
    refused with a ValueError. Ids are integers; columns other than the three are not read.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    vector = F.col(vector_col)
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    kept = df.filter(vector.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), whole.alias("x"))
    book = _start(kept, entries, parts)
    if not book.shape[1]:
        return Codes(spark.createDataFrame([], "id long, label string, code binary, error long"), book, [])
    folder = f"{checkpoint_folder(spark)}/vector-codes-{uuid.uuid4().hex}"
    moved, asked = None, []
    for k in range(rounds + 1):
        source = kept if moved is None else spark.read.schema(STATE).parquet(f"{folder}/{k - 1}").filter("part is null").select(*STATE_NAMES[:6])
        source.mapInArrow(_round(book, moved), STATE).write.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
        new, n = _updated(spark, f"{folder}/{k}", book)
        asked.append(n)
        if k < rounds:
            step = new - book
            moved, book = _root_up((step * step).sum(axis=2)), new
    return Codes(spark.read.schema(STATE).parquet(f"{folder}/{rounds}").filter("part is null").select("id", "label", "code", "error"), book, asked)


def codebooks_text(book: np.ndarray) -> str:
    """The entries' components by part, entry and place, comma-joined."""
    return ",".join(map(str, book.ravel().tolist()))


def coded_table(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", **how) -> DataFrame:
    """id, code (two hex digits a part), error, label_error (the sum over rows of an equal label, nulls together) and codebooks_sha256 of ``compress_vectors``.

    Sums are made by label before any row moves; a label of many rows is broadcast to them.
    """
    codes = compress_vectors(df, id_col, label_col=label_col, **how)
    label = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label")))
    rows = codes.rows.select(F.col("id"), label.alias("key"), F.lower(F.hex("code")).alias("code"), "error")
    sums = cut(rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    digest = hashlib.sha256(codebooks_text(codes.codebooks).encode()).hexdigest()
    (name,) = fresh_names(rows.select("code", "error"), id_col)
    return join_counted(rows, sums, "key", "n").select(F.col("id").alias(name), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
