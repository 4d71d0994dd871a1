"""Quality rules on repetition: characters inside duplicated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.text_hash import Grams, covered, repeated, word_bounds, word_hashes
from assayer.plans import bounded_batches, fresh_names

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BLANK = b" \t\n\x0b\x0c\r"
#: Largest share of a text's word characters inside duplicated n-grams, by n.
GRAM_LIMITS = {5: 0.25, 7: 0.22, 10: 0.20}
#: Largest share of a text's characters in lines equal to an earlier line.
LINE_LIMIT = 0.30
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5


def measure(raw: bytes, gram_limits: dict[int, float], line_limit: float) -> tuple:
    """The measures of one text in UTF-8, in the order of ``SCHEMA``."""
    data, starts, ends = word_bounds(raw)
    n = len(starts)
    if n == 0:
        return 0, 0, 0, 0, 0, 0.0, [0.0] * len(gram_limits), True, False
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    word_chars = int(chars.sum())
    grams = Grams(word_hashes(data, starts, ends))
    shares, repeat_words = [], 0
    for width in sorted({REPEAT_WINDOW, *gram_limits}):
        flags = repeated(grams.of(width))
        if flags is None:
            shares += [0.0] * (len(gram_limits) - len(shares))
            break  # longer n-grams repeat only where shorter ones do
        inside = covered(flags, width, n)
        if width == REPEAT_WINDOW:
            repeat_words = int(inside.sum())
        if width in gram_limits:
            shares.append(float(chars[inside].sum()) / word_chars)
    lines, line_chars = 0, 0
    if b"\n" in raw:
        seen: set[bytes] = set()
        for line in raw.split(b"\n"):
            if line in seen:
                lines += 1
                line_chars += len(line.decode("utf-8", "replace"))
            elif line.strip(BLANK):
                seen.add(line)
    line_share = line_chars / int(points[-1])
    failed = n < MIN_WORDS or 100 * repeat_words > REPEAT_PERCENT * n
    limits = [gram_limits[w] for w in sorted(gram_limits)]
    kept = not failed and line_share <= line_limit and all(s <= m for s, m in zip(shares, limits, strict=True))
    return n, word_chars, int(SYMBOLS[data].sum()), lines, repeat_words, line_share, shares, failed, kept


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_share", "dup_gram_shares", "base_failed", "kept"]
TYPES = [pa.int64()] * 5 + [pa.float64(), pa.list_(pa.float64()), pa.bool_(), pa.bool_()]
SQL_TYPES = ["long"] * 5 + ["double", "array<double>", "boolean", "boolean"]


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT
) -> DataFrame:
    """One row per row of ``df``: ``id_col``, the measures and the verdict ``kept``.

    Words are split at ASCII white space. Rolling hashes over each whole text find the
    n-grams (n of ``gram_limits``, 5 or more) that occur twice or more in it;
    dup_gram_shares are the shares of word characters inside them, by rising n.
    dup_line_share is the share of characters in lines with a word that equal an earlier
    line. A text is rejected if it has under 10 words, if over 20 % of its words lie
    in repeated 5-word windows (both: base_failed), or if a share is over its limit.

    A null or blank text has no words and is rejected. Rows are judged one by one with
    no shuffle; repeated rows get equal verdicts; other columns are not read; an empty
    table gives an empty result.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(["id long", *(f"{n} {t}" for n, t in zip(NAMES, SQL_TYPES, strict=True))])
    return docs.mapInArrow(_judge(gram_limits, line_limit, lambda batch, made: [batch.column(0), *made], ["id", *NAMES]), schema).withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, text_col: str = "text", gram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The rows of ``df`` that the rules keep, with all columns of whatever names; no shuffle.

    A null, empty or blank text is rejected; repeated rows get one verdict each, the same; an empty table gives an empty result.
    """
    bounded_batches(df.sparkSession)
    (judged,) = fresh_names(df, "judged_text")
    ordered = df.select(F.col(text_col).cast("string").alias(judged), *[F.col(f"`{c}`") for c in df.columns])

    def passing(batch: pa.RecordBatch, made: list[pa.Array]) -> list[pa.Array]:
        return [c.filter(made[-1]) for c in batch.columns[1:]]

    return ordered.mapInArrow(_judge(gram_limits, line_limit, passing, df.columns, text_at=0), df.schema)


def _judge(gram_limits: dict[int, float] | None, line_limit: float, shape, names: list[str], text_at: int = 1):
    limits = dict(gram_limits or GRAM_LIMITS)
    if min(limits) < REPEAT_WINDOW:
        raise ValueError(f"n-grams of {REPEAT_WINDOW} words or more are counted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary())
            rows = [measure(t.as_py() or b"", limits, line_limit) for t in texts]
            columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
            made = [pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays(shape(batch, made), names=names)

    return run
