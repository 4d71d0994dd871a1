"""Personal data: fixed shapes, and bootstrapped contextual extraction of unseen identifiers."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.plans import bounded_batches, broadcast_if_small, cut

#: The first four have fixed shapes; a secret has none, its spans all come from contexts.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE, SECRET, OTHER = 4, 4, len(KINDS)

LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MAYBE = re.compile(rb"[0-9@]|dot")  # any base span, key or loose shape has one of these

#: Shapes that may be an identifier if the words around them say so; by kind.
LOOSE = {
    0: re.compile(r"[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,}"),
    1: re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    2: re.compile(r"(?<![0-9+.,-])[0-9]{4}(?:[ -][0-9]{4,6})[ -][0-9]{4,5}(?![0-9.-])"),
    3: re.compile(r"(?<![0-9+(.,-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])(?:[0-9]{2,4}[ .-]){1,3}[0-9]{2,4}(?![0-9.-])"),
}
#: Seeds of secrets: hexadecimal keys of usual lengths with letters and digits.
KEY = re.compile(r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])(?=[0-9]*[a-f])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What a word must hold to be an identifier in the slot of a pattern.
LIKELY = re.compile(r"[0-9@_]")
EDGE = ".,;:!?()[]{}<>\"'`"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d)
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            floor = domain.end()
            found.append((start, floor))
        at = text.find("@", at + 1)
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points of the fixed shapes, by kind and start."""
    spans = [(0, s, e) for s, e in _emails(text)]
    spans += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    spans += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    spans += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return spans


def _loose_fits(kind: int, text: str) -> bool:
    digits = _digits(text)
    return kind < 2 or (13 <= len(digits) <= 15 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15)


def _short(value: str) -> str:
    """A value, or a digest behind its start if it is long: different values stay different."""
    return value if len(value) <= 200 else f"{value[:100]}#{hashlib.sha256(value.encode('utf-8', 'surrogatepass')).hexdigest()}"


def _united(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of ``spans``, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _free(taken: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether a span overlaps none of a union."""
    at = bisect_left(taken[0], end)
    return at == 0 or taken[1][at - 1] <= start


def mentions(text: str) -> tuple[list, list]:
    """(base spans, mentions): a mention (kind, start, end, is_seed) is a base span, a key (the seeds), or a loose shape that overlaps none of those."""
    base = base_spans(text)
    taken = _united([(s, e) for _, s, e in base])
    rows = [(k, s, e, True) for k, s, e in base]
    shapes = [(SECRET, KEY), *LOOSE.items()]
    for kind, shape in shapes:
        found = [(m.start(), m.end()) for m in shape.finditer(text) if (kind == SECRET or _loose_fits(kind, m[0])) and _free(taken, m.start(), m.end())]
        rows += [(kind, s, e, kind == SECRET) for s, e in found]
        taken = _united([*zip(*taken, strict=True), *found]) if found else taken
    return base, rows


def units(text: str, rows: list) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The text as a sequence of units, one for each mention (overlapping ones share one) and each word outside them.

    Returns their normal forms (``<kind>`` for a mention, else the word lower-cased and without edge punctuation; words of punctuation alone are no
    units), and (start, end, number of the mention in ``rows`` or -1).
    """
    names: list[str] = []
    places: list[tuple[int, int, int]] = []

    def words(start: int, end: int) -> None:
        for m in WORD.finditer(text, start, end):
            raw = m[0]
            left = len(raw) - len(raw.lstrip(EDGE))
            word = raw.strip(EDGE)
            if word:
                names.append(_short(word.lower()))
                places.append((m.start() + left, m.start() + left + len(word), -1))

    at = 0
    for n in sorted(range(len(rows)), key=lambda n: (rows[n][1], -rows[n][2])):
        kind, start, end, _ = rows[n]
        if start < at:
            continue  # shares the unit of the mention it overlaps
        words(at, start)
        names.append(f"<{KINDS[kind]}>")
        places.append((start, end, n))
        at = end
    words(at, len(text))
    return names, places


def patterns_at(names: list[str], i: int) -> tuple[str, str, str, str]:
    """The patterns around unit i: the unit before, the two before, the one behind, both neighbours."""
    left = names[i - 1] if i else "^"
    second = names[i - 2] if i > 1 else "^"
    right = names[i + 1] if i + 1 < len(names) else "$"
    return f"L {left}", f"LL {second} {left}", f"R {right}", f"B {left} {right}"


def _instance(kind: int, value: str) -> str:
    return _digits(value) if kind in (2, 3) else _short(value.lower())


SPAN = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
MENTION = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("seed", pa.bool_()), ("inst", pa.string()), ("around", pa.list_(pa.string()))])
SCANNED = "id long, th long, base array<struct<k:int,s:int,e:int>>, found array<struct<k:int,s:int,e:int,seed:boolean,inst:string,around:array<string>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The base spans of each text, and its mentions; seeds with the patterns around them."""
    for batch in batches:
        bases, found = [], []
        for t in batch.column(2).cast(pa.binary()):
            raw = t.as_py() or b""
            base, rows, mine = [], [], []
            if MAYBE.search(raw):
                text = raw.decode("utf-8", "replace")
                base, rows = mentions(text)
                names, places = units(text, rows) if rows else ([], [])
                around = {n: list(patterns_at(names, i)) for i, (_, _, n) in enumerate(places) if n >= 0}
                for n, (k, s, e, seed) in enumerate(rows):
                    mine.append({"k": k, "s": s, "e": e, "seed": seed, "inst": _instance(k, text[s:e]), "around": around.get(n, []) if seed else []})
            bases.append([dict(zip("kse", b, strict=True)) for b in base])
            found.append(mine)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(bases, pa.list_(SPAN)), pa.array(found, pa.list_(MENTION))], names=["id", "th", "base", "found"]
        )


FILLED_NAMES = ["pattern", "n", "id", "th", "s", "e", "k", "seed", "inst", "patterns"]
FILLED = "pattern string, n long, id long, th long, s int, e int, k int, seed boolean, inst string, patterns array<string>"
FILLED_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.string())]
#: Patterns of other words that a task counts before it passes them on.
COUNTED = 200_000


def _fill(shared):
    """What fills the slots of the candidate patterns in the whole corpus: rows (id, th, s, e, k, seed, inst, patterns) for mentions and
    words like identifiers, and rows (pattern, n) that count all other words. With None for the candidates, the slots of all patterns."""

    def counted(plain: Counter) -> pa.RecordBatch:
        none = [None] * len(plain)
        columns = [list(plain), list(plain.values()), *[none] * 8]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FILLED_TYPES, strict=True)], names=FILLED_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lefts = shared.value if shared is not None else (None, None)
        plain: Counter = Counter()
        for batch in batches:
            rows = []
            for i, th, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                text = (t.as_py() or b"").decode("utf-8", "replace")
                names, places, found = None, None, ()
                if LIKELY.search(text) or MAYBE.search(text.encode()):
                    _, found = mentions(text)
                    names, places = units(text, found)
                    likely = [n >= 0 or LIKELY.search(w) is not None for w, (_, _, n) in zip(names, places, strict=True)]
                else:
                    names = [_short(x) for w in text.lower().translate(BLANKS).split(" ") if (x := w.strip(EDGE))]
                    likely = None
                second, left = "^", "^"
                for at, name in enumerate(names):
                    right = names[at + 1] if at + 1 < len(names) else "$"
                    if known is None:
                        hits = [f"L {left}", f"LL {second} {left}", f"R {right}", f"B {left} {right}"]
                    else:
                        hits = [p for p in (f"L {left}", f"LL {second} {left}", f"B {left} {right}") if p in known] if left in lefts else []
                        if (p := "R " + right) in known:
                            hits.append(p)
                    if hits:
                        if likely is None or not likely[at]:
                            plain.update(hits)
                        else:
                            s, e, n = places[at]
                            kind, seed = (found[n][0], found[n][3]) if n >= 0 else (OTHER, False)
                            rows.append((None, None, i, th, s, e, kind, seed, _instance(kind, text[s:e]), hits))
                    second, left = left, name
                if len(plain) > COUNTED:
                    yield counted(plain)
                    plain = Counter()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FILLED_TYPES, strict=True)], names=FILLED_NAMES)
        if plain:
            yield counted(plain)

    return run


def fill_slots(docs: DataFrame, patterns: DataFrame, max_patterns: int) -> DataFrame:
    """What stands in the slots of the ``patterns`` (pattern, k): rows (id, th, s, e, k, seed, inst, pids) and rows (pid, n), a pid being the hash of a pattern.

    Up to ``max_patterns`` patterns are known to all tasks. Beyond that the slots of all patterns are written down, those of other words as counts, and meet the
    patterns in a join; the result is the same.
    """
    distinct = cut(patterns.select("pattern").distinct())
    pid = lambda p: F.xxhash64(p)
    if distinct.limit(max_patterns + 1).count() <= max_patterns:
        names = {r["pattern"] for r in distinct.collect()}
        shared = docs.sparkSession.sparkContext.broadcast((names, {p.split(" ")[2 if p.startswith("LL ") else 1] for p in names if not p.startswith("R ")}))
        filled = docs.mapInArrow(_fill(shared), FILLED)
        return cut(filled.select(F.when(F.col("pattern").isNotNull(), pid("pattern")).alias("pid"), "n", "id", "th", "s", "e", "k", "seed", "inst", F.transform("patterns", pid).alias("pids")))
    filled = cut(docs.mapInArrow(_fill(None), FILLED))
    wanted = distinct.select(pid("pattern").alias("pid"))
    plain = filled.filter("pattern is not null").groupBy(pid("pattern").alias("pid")).agg(F.sum("n").alias("n")).join(wanted, "pid", "left_semi")
    slot = ["id", "th", "s", "e", "k", "seed", "inst"]
    slots = filled.filter("patterns is not null").select(*slot, F.explode(F.transform("patterns", pid)).alias("pid")).join(wanted, "pid", "left_semi")
    slots = slots.groupBy(*slot).agg(F.sort_array(F.collect_list("pid")).alias("pids"))  # four at most for each repeat of the row
    return cut(plain.select("pid", "n").unionByName(slots, allowMissingColumns=True).select("pid", "n", *slot, "pids"))


#: White space other than blanks, as blanks.
BLANKS = str.maketrans("\t\n\x0b\x0c\r", "     ")


def _spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def candidate_patterns(scanned: DataFrame, min_support: int) -> DataFrame:
    """(pattern, k) of the patterns around at least ``min_support`` distinct seeds of a kind, whatever else the table holds."""
    seeds = scanned.select(F.explode("found").alias("m")).filter("m.seed").select("m.k", "m.inst", "m.around")
    seeds = seeds.select("k", "inst", F.explode("around").alias("pattern")).distinct()
    return cut(seeds.groupBy("pattern", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_support).select("pattern", "k"))


def rate_patterns(
    filled: DataFrame, kinds: DataFrame, min_support: int, min_score: float, tolerance: float = 1e-6, max_rounds: int = 200, small: int = 50_000
) -> tuple[DataFrame, DataFrame]:
    """(trusted patterns (pid, k, score), confidences (k, inst, confidence)) from the slots' fillers, by rounds until no confidence moves.

    A pattern's score for a kind is the confidence gathered over its distinct fillers of that kind or of none, divided by
    all its distinct fillers that look like identifiers and all mentions of other words in its slot; from ``min_score`` on it is trusted.
    ``kinds`` has a row (pid, k) for each candidate pattern. Tables of patterns of up to ``small`` rows are broadcast. Seeds have confidence 1. A candidate's is the chance that any of its trusted patterns is right, ``1 - prod(1 - score)``. Scores only grow
    with confidences and these with scores, so the rounds settle; if they have not in ``max_rounds``, that is an error. Patterns that would miss ``min_score`` even if all their candidates were
    right are left out before the first round.
    """
    edges = filled.filter("pids is not null").select(F.explode("pids").alias("pid"), "k", "inst", "seed").distinct()
    plain = filled.filter("pids is null").groupBy("pid").agg(F.sum("n").alias("n"))
    totals = edges.select("pid", F.lit(1).cast("long").alias("n")).unionByName(plain.select("pid", "n")).groupBy("pid").agg(F.sum("n").alias("total"))
    of_kind = edges.withColumnRenamed("k", "own").join(broadcast_if_small(kinds, small), "pid").filter((F.col("own") == F.col("k")) | ((F.col("own") == OTHER) & ~F.col("seed")))
    near = cut(of_kind.select("pid", "k", "inst", "seed"))
    table = near.groupBy("pid", "k").agg(F.sum(F.col("seed").cast("long")).alias("seeds"), F.count(F.lit(1)).alias("best")).join(totals, "pid")
    table = cut(table.filter((F.col("seeds") >= min_support) & (F.col("best") >= min_score * F.col("total"))).drop("best"))  # as many rows as patterns at most
    candidates = cut(near.filter(~F.col("seed")).join(broadcast_if_small(table.select("pid", "k"), small), ["pid", "k"]).select("pid", "k", "inst"))
    confidence = candidates.select("k", "inst").distinct().withColumn("confidence", F.lit(0.0))
    for _ in range(max_rounds):
        gathered = candidates.join(confidence, ["k", "inst"]).groupBy("pid", "k").agg(F.sum("confidence").alias("more"))
        scored = table.join(gathered, ["pid", "k"], "left")
        scored = scored.withColumn("score", F.least(F.lit(0.999), (F.col("seeds") + F.coalesce("more", F.lit(0.0))) / F.col("total"))).filter(F.col("score") >= min_score)
        scored = cut(scored.select("pid", "k", "score"))
        wrong = F.exp(F.sum(F.log(1 - F.col("score"))))
        raised = candidates.join(broadcast_if_small(scored, small), ["pid", "k"]).groupBy("k", "inst").agg((1 - wrong).alias("raised"))
        new = confidence.withColumnRenamed("confidence", "old").join(raised, ["k", "inst"], "left")
        new = cut(new.select("k", "inst", F.coalesce("raised", F.lit(0.0)).alias("confidence"), (F.coalesce("raised", F.lit(0.0)) - F.col("old") > tolerance).alias("moved")))
        confidence = new.select("k", "inst", "confidence")
        if new.filter("moved").isEmpty():
            return scored, confidence
    raise RuntimeError(f"confidences did not settle in {max_rounds} rounds")


def find_personal_data(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_support: int = 5,
    min_score: float = 0.8,
    min_confidence: float = 0.9,
    max_broadcast: int = 50_000,
    max_patterns: int = 200_000,
) -> DataFrame:
    """One row per row of ``df``: the base counts and hash, and all spans.

    n_email, n_ip, n_card, n_phone and base_sha256 are of the fixed shapes; ``spans`` holds those and the discovered ones as
    ``kind:start:end``, by kind then start, in code points, end exclusive; n_discovered counts the latter. ``secrets`` holds the spans of the kind without a fixed shape, likewise.

    1. Seeds are the base spans, and as seeds of secrets hexadecimal keys (``KEY``). The patterns around them are counted (``candidate_patterns``).
    2. The whole corpus is read again for what fills the slots of these patterns: mentions, words that look like
       identifiers (with a digit, an @ or an underscore), and, as evidence against a pattern, all other words.
    3. Patterns and instances rate each other until nothing moves (``rate_patterns``).
    4. Discovered are: loose shapes (``LOOSE``) whose instance has ``min_confidence``, wherever they stand; and keys and words like
       identifiers where the trusted patterns around them give ``min_confidence``, as the kind of the best. So a key without a trusted pattern around it is
       none, and a secret or number of an unseen shape is found in the slot of a trusted one.

    A null text counts as empty. Null ids and repeated rows each come out; spans are
    matched back by id and text hash, so rows that share an id keep apart. Other
    columns are not read; an empty table gives an empty result. Ids are integers.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).cast("string").alias("text"))
    scanned = cut(docs.mapInArrow(_scan, SCANNED))
    patterns = candidate_patterns(scanned, min_support)
    filled = fill_slots(docs, patterns, max_patterns)
    kinds = cut(patterns.select(F.xxhash64("pattern").alias("pid"), "k"))
    trusted, confidence = rate_patterns(filled, kinds, min_support, min_score, small=max_broadcast)

    loose = scanned.select("id", "th", F.explode("found").alias("m")).select("id", "th", "m.*").filter(~F.col("seed"))
    sure = cut(confidence.filter(F.col("confidence") >= min_confidence).select("k", "inst"))
    by_value = loose.join(broadcast_if_small(sure, max_broadcast), ["k", "inst"]).select("id", "th", "k", "s", "e")
    slots = filled.filter((F.col("k") == OTHER) | ((F.col("k") == SECRET) & F.col("seed"))).select("id", "th", "s", "e", F.col("k").alias("own"), F.explode("pids").alias("pid"))
    rated = slots.distinct().join(broadcast_if_small(trusted, max_broadcast), "pid").filter((F.col("own") == OTHER) | (F.col("own") == F.col("k")))
    right = 1 - F.exp(F.sum(F.log(1 - F.col("score"))))
    by_place = rated.groupBy("id", "th", "s", "e", "k").agg(right.alias("sure")).filter(F.col("sure") >= min_confidence)
    by_place = by_place.groupBy("id", "th", "s", "e").agg(F.max_by("k", F.struct(F.round("sure", 9), -F.col("k"))).alias("k")).select("id", "th", "k", "s", "e")

    added = by_value.unionByName(by_place).distinct().groupBy("id", "th").agg(F.collect_list(F.struct("k", "s", "e")).alias("more"))
    added = cut(added).select(F.col("id").alias("more_id"), F.col("th").alias("more_th"), "more")
    both = scanned.join(broadcast_if_small(added, max_broadcast), F.col("id").eqNullSafe(F.col("more_id")) & (F.col("th") == F.col("more_th")), "left")
    empty = F.array().cast("array<struct<k:int,s:int,e:int>>")
    base_kinds = F.transform("base", lambda x: x["k"])
    counts = [(F.size(base_kinds) - F.size(F.array_remove(base_kinds, i))).cast("long").alias(f"n_{KINDS[i]}") for i in range(BASE)]
    more = F.coalesce("more", empty)
    of_base, secret = (F.filter(more, f) for f in (lambda x: x["k"] < BASE, lambda x: x["k"] == SECRET))
    return both.select(
        F.col("id").alias(id_col),
        *counts,
        F.sha2(_spans_text(F.col("base")), 256).alias("base_sha256"),
        _spans_text(F.concat("base", of_base)).alias("spans"),
        F.size(of_base).cast("long").alias("n_discovered"),
        _spans_text(secret).alias("secrets"),
    )
