"""Features of texts: n-gram counts, profiles, tf-idf, context models, selection. All relational."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import measures as m
from assayer.functions import text as tx
from assayer.plans import bounded_batches, broadcast_if_small, cut


def gram_counts(df: DataFrame, keys: list[str], grams: Column) -> DataFrame:
    """keys, gram, n over the exploded array column; counts are combined before the shuffle."""
    return df.select(*keys, F.explode(grams).alias("gram")).groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))


def _grown(texts: DataFrame, keys: list[str], tokens: Column, k: int, kept: DataFrame | None, once: bool = False) -> DataFrame:
    """keys, gram: the k-grams of each text both of whose shorter grams are in ``kept`` (a materialised column gram); ``once``: each gram of a text once. Tokens have no blanks."""
    grams = tx.ngrams(tokens, k)
    rows = texts.select(*keys, F.explode(F.array_distinct(grams) if once else grams).alias("gram"))
    if kept is not None:
        known = broadcast_if_small(kept, 200_000)
        for end, side in (("head", k - 1), ("tail", 1 - k)):
            rows = rows.withColumn(end, F.substring_index("gram", " ", side)).join(known.withColumnRenamed("gram", end), end, "left_semi")
    return rows.select(*keys, "gram")


def most_frequent_grams(texts: DataFrame, tokens: Column, longest: int, most: int) -> DataFrame:
    """gram, n: the ``most`` most frequent n-grams of 1 .. ``longest`` tokens over all texts, and those as frequent as the last of them.

    Length by length: a gram occurs at most as often as the shorter grams in it, so one is only counted if both of these are as frequent as the last of the
    ``most`` best so far. Nothing that could be among the best is left out, and rare n-grams, which are nearly all, are never shuffled.
    """
    found, kept, bound = None, None, 1
    for k in range(1, longest + 1):
        level = cut(_grown(texts, [], tokens, k, kept).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= bound))
        found = level if found is None else found.unionByName(level)
        last = found.orderBy(F.col("n").desc()).limit(most).agg(F.count(F.lit(1)).alias("many"), F.min("n").alias("n")).collect()[0]
        bound = last["n"] if last["many"] == most else 1
        kept = level.filter(F.col("n") >= bound).select("gram")
    return found.filter(F.col("n") >= bound)


def most_dependent_grams(texts: DataFrame, cls: str, tokens: Column, longest: int, least: int, most: int, places: int = 6) -> DataFrame:
    """gram, chi2: n-grams of 1 .. ``longest`` tokens that ``least`` texts or more have, with the dependence of their texts on the class (``chi_square``, rounded); the ``most`` best are among them.

    With the share s of each class, a gram with n texts of each has a chi2 of ``sum(n * (1 / s - 1))`` at most, and so has every longer gram around it. Length by
    length, only grams both of whose shorter grams reach the last of the ``most`` best so far by this bound are counted.
    """
    sizes = cut(texts.groupBy(cls).agg(F.count(F.lit(1)).alias("docs")))
    share = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("docs").alias("whole")))).select(cls, (F.col("whole") / F.col("docs") - 1).alias("over"))  # one row
    classes = sizes.select(cls, F.lit(None).cast("string").alias("gram"), F.lit(0).cast("long").alias("n"), "docs")
    found, kept, bound = None, None, None
    for k in range(1, longest + 1):
        counts = _grown(texts, [cls], tokens, k, kept, once=True).groupBy(cls, "gram").agg(F.count(F.lit(1)).alias("n"))
        reach = counts.join(broadcast_if_small(cut(share), 100_000), cls).groupBy("gram").agg(F.sum("n").alias("df"), F.sum(F.col("n") * F.col("over")).alias("reach"), F.collect_list(F.struct(cls, "n")).alias("by"))
        reach = reach.filter(F.col("df") >= least)  # an entry a class
        level = cut(reach if bound is None else reach.filter(F.col("reach") >= bound))
        of = level.select("gram", F.explode("by").alias("x")).select("x.*", "gram", F.lit(0).cast("long").alias("docs"))
        chi = cut(chi_square(of.unionByName(classes), cls).withColumn("chi2", F.round("chi2", places)))
        found = chi if found is None else found.unionByName(chi)
        last = found.orderBy(F.col("chi2").desc()).limit(most).agg(F.count(F.lit(1)).alias("many"), F.min("chi2").alias("chi2")).collect()[0]
        if last["many"] == most:
            bound = last["chi2"] * (1 - 1e-9) - 2 * 10.0**-places
        kept = (level if bound is None else level.filter(F.col("reach") >= bound)).select("gram")
    return found


def listed_gram_counts(df: DataFrame, keys: list[str], tokens: Column, longest: int, listed: DataFrame) -> DataFrame:
    """keys, the columns of ``listed`` (gram, and others; few rows, broadcast) and n: how often each text has each of these n-grams of 1 .. ``longest`` tokens; other n-grams are never shuffled."""
    rows = df.select(*keys, F.explode(F.concat(*[tx.ngrams(tokens, k) for k in range(1, longest + 1)])).alias("gram")).join(F.broadcast(listed), "gram")
    return rows.groupBy(*keys, *listed.columns).agg(F.count(F.lit(1)).alias("n"))


#: Characters whose n-grams are counted at once in a task.
CHARACTERS = 1 << 20


def _runs(codes: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes (below ``bound``) in order, and how often each occurs."""
    if bound <= 4 * len(codes) + (1 << 16):
        many = np.bincount(codes, minlength=1)
        found = np.flatnonzero(many)
        return found, many[found]
    return np.unique(codes, return_counts=True)


def text_gram_counts(texts: Sequence[str], group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(group, number of the gram, grams, count) of the n-grams of ``size`` characters of texts that each belong to a group (0, 1, ...); sorted by group and gram.

    Characters are numbered by the alphabet of the texts, so a group and an n-gram are one whole number; where that would not fit into 62 bits, they are counted one by one.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    groups = int(group.max()) + 1 if len(group) else 0
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    alphabet = np.flatnonzero(np.bincount(points)) if len(points) else np.zeros(0, np.int64)
    base = len(alphabet)
    if base**size * max(groups, 1) >= 1 << 62:
        counts = Counter((int(g), t[i : i + size]) for g, t in zip(group, texts, strict=True) for i in range(len(t) - size + 1))
        grams = sorted({gram for _, gram in counts})
        number = {gram: k for k, gram in enumerate(grams)}
        rows = sorted((g, number[gram], n) for (g, gram), n in counts.items())
        columns = np.array(rows, np.int64).reshape(-1, 3)
        return columns[:, 0], columns[:, 1], grams, columns[:, 2]
    number = np.zeros(int(alphabet[-1]) + 1 if base else 0, np.int64)
    number[alphabet] = np.arange(base)
    number = number[points]
    starts = max(len(points) - size + 1, 0)
    codes = np.repeat(group.astype(np.int64), lengths)[:starts]
    for k in range(size):
        codes = codes * base + number[k : k + starts]
    inside = np.arange(starts) + size <= np.repeat(np.cumsum(lengths), lengths)[:starts]
    found, many = _runs(codes[inside], base**size * groups)
    of, gram = np.divmod(found, max(base**size, 1))
    distinct, place = np.unique(gram, return_inverse=True)
    letters = np.empty((len(distinct), size), "<u4")
    rest = distinct
    for k in range(size - 1, -1, -1):
        rest, digit = np.divmod(rest, max(base, 1))
        letters[:, k] = alphabet[digit] if base else 0
    flat = letters.tobytes().decode("utf-32-le", "surrogatepass")
    return of, place, [flat[k : k + size] for k in range(0, len(flat), size)], many


def pieces(lengths: Sequence[int]) -> Iterator[slice]:
    """Slices of consecutive rows with about ``CHARACTERS`` characters each, a row at least."""
    start, held = 0, 0
    for k, n in enumerate(lengths):
        held += n
        if held >= CHARACTERS:
            yield slice(start, k + 1)
            start, held = k + 1, 0
    if start < len(lengths):
        yield slice(start, len(lengths))


def char_gram_counts(df: DataFrame, keys: list[str], text: str, lengths: Sequence[int]) -> DataFrame:
    """keys, length, gram, n: character n-grams of each length, counted per key inside the tasks before they are shuffled.

    One Arrow function over whole batches, in arrays (``text_gram_counts``). Null texts have no n-grams; a null key is a key.
    """
    sizes = tuple(lengths)
    fields = [df.schema[k] for k in keys]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "length int", "gram string", "n long"])
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.filter(batch.column(len(keys)).is_valid())
            texts = whole.column(len(keys)).to_pylist()
            for piece in pieces([len(t) for t in texts]):
                rows = whole.slice(piece.start, piece.stop - piece.start)
                numbers: dict[tuple, int] = {}
                named = zip(*[c.to_pylist() for c in rows.columns[:-1]], strict=True) if keys else [()] * rows.num_rows
                group = np.array([numbers.setdefault(key, len(numbers)) for key in named], np.int64)
                first = pa.array(np.unique(group, return_index=True)[1])
                for size in sizes:
                    of, place, grams, many = text_gram_counts(texts[piece], group, size)
                    named_rows = first.take(pa.array(of))
                    columns = [c.take(named_rows) for c in rows.columns[:-1]]
                    gram = pa.array(grams, pa.string()).take(pa.array(place))
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(of), size, np.int32)), gram, pa.array(many.astype(np.int64))], names=[*keys, "length", "gram", "n"])

    slim = df.select(*keys, F.col(text).cast("string").alias("_text"))
    return slim.mapInArrow(run, schema).groupBy(*keys, "length", "gram").agg(F.sum("n").alias("n"))


def pair_gram_counts(pairs: DataFrame, keys: list[str], first: str, second: str, size: int) -> DataFrame:
    """keys, gram, a, b, all_a, all_b: for pairs of arrays of texts, how often each side has each n-gram of ``size`` characters that either has, and all n-grams of each side; worked out where the pair lies."""
    fields = [pairs.schema[k] for k in keys]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "gram string, a long, b long, all_a long, all_b long"])
    bounded_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[[t for t in ts or () if t is not None] for ts in batch.column(len(keys) + k).to_pylist()] for k in range(2)]
            for piece in pieces([sum(map(len, a)) + sum(map(len, b)) for a, b in zip(*sides, strict=True)]):
                texts, group = [], []
                for k, both in enumerate(zip(sides[0][piece], sides[1][piece], strict=True)):
                    for side, ts in enumerate(both):
                        texts += ts
                        group += [2 * k + side] * len(ts)
                of, place, grams, many = text_gram_counts(texts, np.array(group, np.int64), size)
                whole = np.bincount(of, many, 2 * (piece.stop - piece.start)).astype(np.int64)
                cells, at = np.unique(of // 2 * max(len(grams), 1) + place, return_inverse=True)
                row, gram = np.divmod(cells, max(len(grams), 1))
                counts = [pa.array(np.bincount(at[of % 2 == k], many[of % 2 == k], len(cells)).astype(np.int64)) for k in range(2)]
                columns = [c.take(pa.array(row + piece.start)) for c in batch.columns[: len(keys)]]
                named = pa.array(grams, pa.string()).take(pa.array(gram))
                yield pa.RecordBatch.from_arrays([*columns, named, *counts, pa.array(whole[2 * row]), pa.array(whole[2 * row + 1])], names=[*keys, "gram", "a", "b", "all_a", "all_b"])

    return pairs.select(*keys, first, second).mapInArrow(run, schema)


def vocabulary(counts: DataFrame, least: int) -> DataFrame:
    """Grams whose counts sum to ``least`` or more."""
    return counts.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def max_abs_scaled(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Relative frequencies per key, divided by the gram's largest over all keys."""
    whole = counts.groupBy(*keys).agg(F.sum("n").alias("all"))
    rel = counts.join(whole, keys).withColumn("f", F.col("n") / F.col("all"))
    top = rel.groupBy("gram").agg(F.max("f").alias("top"))
    return rel.join(top, "gram").select(*keys, "gram", (F.col("f") / F.col("top")).alias("value"))


def profile(counts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The ``size`` most frequent grams of each key with their relative frequency."""
    whole = counts.groupBy(*keys).agg(F.sum("n").alias("all"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "gram"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= size)
    return top.join(whole, keys).select(*keys, "gram", (F.col("n") / F.col("all")).alias("f"))


def cng_distance(unknown: DataFrame, known: DataFrame, unknown_key: str, known_key: str) -> DataFrame:
    """Dissimilarity of each unknown profile to each known one, in [0, 1].

    A shared gram adds ``(2 (f1 - f2) / (f1 + f2))**2``, one the known profile lacks adds 4; the sum is divided by four
    times the unknown profile's size.
    """
    sizes = unknown.groupBy(unknown_key).agg(F.count(F.lit(1)).alias("size"))
    both = unknown.withColumnRenamed("f", "f1").join(known.withColumnRenamed("f", "f2"), "gram")
    term = F.pow(2 * (F.col("f1") - F.col("f2")) / (F.col("f1") + F.col("f2")), F.lit(2))
    shared = both.groupBy(unknown_key, known_key).agg(F.sum(term).alias("s"), F.count(F.lit(1)).alias("c"))
    grid = sizes.crossJoin(broadcast_if_small(cut(known.select(known_key).distinct()), 100_000))  # every text meets every author: that is the result
    full = grid.join(shared, [unknown_key, known_key], "left").na.fill(0)
    return full.select(unknown_key, known_key, ((F.col("s") + 4 * (F.col("size") - F.col("c"))) / (4 * F.col("size"))).alias("distance"))


def tf_idf(counts: DataFrame, key: str, texts: Column | int) -> DataFrame:
    """key, gram, weight with smoothed idf ``ln((1 + N) / (1 + df)) + 1`` and rows of length 1."""
    df = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    n = F.lit(texts) if isinstance(texts, int) else texts
    raw = counts.join(df, "gram").withColumn("w", F.col("n") * (F.log((1 + n) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "gram", (F.col("w") / F.col("norm")).alias("w"))


def pair_cosine(sides: DataFrame, pair: list[str]) -> DataFrame:
    """Dot product over the norms of the two sides of each pair, from rows (pair, gram, a, b) of their weights."""
    sums = sides.groupBy(*pair).agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return sums.select(*pair, m.ratio(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))).alias("cosine"))


def min_max_distance(sides: DataFrame, keys: list[str]) -> DataFrame:
    """``1 - sum(min) / (sum(max) + 1e-6)`` over rows (keys, gram, a, b)."""
    return sides.groupBy(*keys).agg((1 - F.sum(F.least("a", "b")) / (F.sum(F.greatest("a", "b")) + F.lit(1e-6))).alias("distance"))


def context_counts(df: DataFrame, keys: list[str], text: str, order: int) -> DataFrame:
    """keys, ord, ctx, ch, n: how often a character follows each context of 0 .. ``order`` characters.

    A context and its character are an n-gram, so n-grams are counted and split afterwards.
    """
    counts = char_gram_counts(df, keys, text, range(1, order + 2))
    o = F.col("length") - 1
    ctx, ch = F.substring(F.col("gram"), F.lit(1), o), F.substring(F.col("gram"), F.col("length"), F.lit(1))
    return counts.select(*keys, o.alias("ord"), ctx.alias("ctx"), ch.alias("ch"), "n")


def merge_models(*models: DataFrame, keys: list[str]) -> DataFrame:
    """The model of all texts of several: counts add."""
    union = models[0]
    for other in models[1:]:
        union = union.unionByName(other)
    return union.groupBy(*keys, "ord", "ctx", "ch").agg(F.sum("n").alias("n"))


def subtract_model(model: DataFrame, part: DataFrame, keys: list[str]) -> DataFrame:
    """The model without the texts of ``part``."""
    return merge_models(model, part.withColumn("n", -F.col("n")), keys=keys).filter("n > 0")


def cross_entropy(texts: DataFrame, key: str, text: str, model: DataFrame, author: str, order: int, max_broadcast: int = 500_000) -> DataFrame:
    """key, author, entropy: mean bits per character of each text under each author's model.

    A character's chance is its share after the longest context in which the author used it, else 1/256; the
    first characters have only shorter contexts. The chances of all authors stand in one row per (context, character), and each distinct
    pair of the texts is looked up once, whatever the number of texts.
    """
    whole = char_gram_counts(texts, [key], text, [order + 1])
    ends = F.col("length")
    later = whole.select(key, F.substring("gram", F.lit(1), ends - 1).alias("ctx"), F.substring("gram", ends, F.lit(1)).alias("ch"), F.col("n").alias("times"))
    t = F.col(text)
    cell = lambda j: F.when(F.length(t) > j, F.struct(F.substring(t, 1, j).alias("ctx"), F.substring(t, j + 1, 1).alias("ch")))
    first = texts.select(key, F.explode(F.array_compact(F.array(*[cell(j) for j in range(order)]))).alias("x"))
    first = first.groupBy(key, "x.ctx", "x.ch").agg(F.count(F.lit(1)).alias("times"))
    seen = cut(later.unionByName(first))
    model = cut(model)
    authors = cut(model.select(author).distinct())
    totals = model.groupBy(author, "ord", "ctx").agg(F.sum("n").alias("total"))
    chances = model.join(totals, [author, "ord", "ctx"]).groupBy("ord", "ctx", "ch").agg(F.map_from_entries(F.collect_list(F.struct(author, F.col("n") / F.col("total")))).alias("p"))
    chances = cut(chances)  # an entry per author
    cells = seen.select("ctx", "ch").distinct()
    for o in range(order, -1, -1):
        level = chances.filter(F.col("ord") == o).select(F.col("ctx").alias(f"c{o}"), "ch", F.col("p").alias(f"p{o}"))
        suffix = F.when(F.length("ctx") >= o, F.substring("ctx", F.length("ctx") - o + 1, F.lit(o)) if o else F.lit(""))
        cells = cells.withColumn(f"c{o}", suffix).join(level, [f"c{o}", "ch"], "left")
    cells = cells.join(broadcast_if_small(authors, 1000))  # every distinct pair under every author
    p = F.coalesce(*[F.element_at(f"p{o}", F.col(author)) for o in range(order, -1, -1)], F.lit(1.0 / 256))
    bits = cells.groupBy("ctx", "ch").agg(F.collect_list(F.struct(F.col(author), (-F.log2(p)).alias("bits"))).alias("by"))
    rows = seen.join(broadcast_if_small(cut(bits), max_broadcast), ["ctx", "ch"]).select(key, "times", F.explode("by").alias("x"))
    return rows.groupBy(key, F.col(f"x.{author}").alias(author)).agg((F.sum(F.col("x.bits") * F.col("times")) / F.sum("times")).alias("entropy"))


def chi_square(counts: DataFrame, cls: str) -> DataFrame:
    """gram, chi2: dependence of summed counts on the class, as observed against expected by class share."""
    shares = counts.groupBy(cls).agg(F.sum("docs").alias("d"))
    shares = shares.withColumn("share", F.col("d") / F.sum("d").over(Window.partitionBy(F.lit(0)))).select(cls, "share")
    grams = counts.filter(F.col("gram").isNotNull()).groupBy("gram").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct(cls, "n"))).alias("by"))
    grid = grams.crossJoin(broadcast_if_small(cut(shares), 100_000))  # a row a class
    expected = F.col("total") * F.col("share")
    observed = F.coalesce(F.element_at("by", F.col(cls)), F.lit(0))
    return grid.groupBy("gram").agg(F.sum(F.pow(observed - expected, F.lit(2)) / expected).alias("chi2"))


def chunks(df: DataFrame, keys: list[str], tokens: Column, size: int) -> DataFrame:
    """keys, chunk, tokens: consecutive pieces of ``size`` tokens, the last one shorter."""
    rows = df.select(*keys, tokens.alias("t"))
    starts = F.when(F.size("t") > 0, F.sequence(F.lit(1), F.size("t"), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return rows.select(*keys, "t", F.posexplode(starts).alias("chunk", "s")).select(*keys, "chunk", F.slice("t", F.col("s"), F.lit(size)).alias("tokens"))


def term_frequencies(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, gram, n over the words of lower-cased text with all but a-z and blanks removed."""
    plain = F.split(F.regexp_replace(F.lower(text), "[^a-z ]", ""), " +")
    return gram_counts(df, keys, F.filter(plain, lambda w: w != ""))


def word_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return gram_counts(df, keys, tx.words(F.lower(text)))


def impostor_shares(
    unknown: DataFrame, known: DataFrame, impostors: DataFrame, iterations: int = 100, sample: int = 250, keep: float = 0.5, seed: int = 2019
) -> DataFrame:
    """text, author, share: how often an author is no farther from a text than the nearest sampled impostor.

    ``unknown(text, gram, f)``, ``known(author, gram, f)`` (centroids) and ``impostors(other, gram, f)`` hold each gram once.
    In each iteration a gram is kept with the chance ``keep``, and ``sample`` of all impostors (or as many as there are) are
    drawn anew for each text, both by keyed hashes. The distance is ``min_max_distance`` over the kept grams. Every
    text meets every author and its sampled impostors in every iteration; without impostors share is null. Names come out as strings.
    """
    rounds = F.explode(F.sequence(F.lit(1), F.lit(iterations)))
    drawn = lambda *of: F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def halved(rows: DataFrame, key: str) -> DataFrame:
        return rows.select(F.col(key).cast("string").alias("name"), "gram", F.col("f").cast("double").alias("f"), rounds.alias("k")).filter(drawn(F.lit("gram"), "k", "gram") < keep)

    texts = unknown.select(F.col("text").cast("string").alias("text")).distinct()
    order = Window.partitionBy("text", "k").orderBy(F.xxhash64(F.lit(seed), F.lit("impostor"), "k", "text", "name"), "name")
    met = texts.crossJoin(impostors.select(F.col("other").cast("string").alias("name")).distinct()).withColumn("k", rounds)
    met = met.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= sample).select("text", "name", "k", F.lit(False).alias("own"))
    authors = texts.crossJoin(known.select(F.col("author").cast("string").alias("name")).distinct()).select("text", "name", rounds.alias("k"), F.lit(True).alias("own"))
    of_text = halved(unknown, "text").withColumnRenamed("name", "text")
    others = halved(known, "author").withColumn("own", F.lit(True)).unionByName(halved(impostors, "other").withColumn("own", F.lit(False)))
    pairs = authors.unionByName(met)
    shared = pairs.join(others, ["name", "k", "own"]).join(of_text.withColumnRenamed("f", "g"), ["text", "k", "gram"])
    shared = shared.groupBy("text", "name", "k", "own").agg(F.sum(F.least("f", "g")).alias("mn"))
    sums = pairs.join(others.groupBy("name", "k", "own").agg(F.sum("f").alias("sf")), ["name", "k", "own"], "left")
    sums = sums.join(of_text.groupBy("text", "k").agg(F.sum("f").alias("sg")), ["text", "k"], "left").join(shared, ["text", "name", "k", "own"], "left")
    mn, both = F.coalesce("mn", F.lit(0.0)), F.coalesce("sf", F.lit(0.0)) + F.coalesce("sg", F.lit(0.0))
    far = sums.select("text", "name", "k", "own", F.round(1 - mn / (both - mn + F.lit(1e-6)), 9).alias("distance"))
    near = far.filter(~F.col("own")).groupBy("text", "k").agg(F.min("distance").alias("near"))
    won = far.filter("own").join(near, ["text", "k"], "left").withColumn("won", (F.col("distance") <= F.col("near")).cast("double"))
    return won.groupBy("text", F.col("name").alias("author")).agg(F.avg("won").alias("share"))
