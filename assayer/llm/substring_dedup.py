"""Substring deduplication: suffix automata of reference contexts, documents streamed for matching statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.text_hash import Grams, sliding_min, word_bounds, word_hashes
from assayer.plans import bounded_batches, cut, join_counted

#: A run of windows with one anchor is cut into contexts of this many windows at most.
RUN = 32
#: Windows that more than this part of all windows of crowded anchors share go into the broadcast shards; so there are fewer of them than this.
HOT_SHARE = 4000
#: Words of a broadcast shard, about.
SHARD_WORDS = 50_000


class SuffixAutomaton:
    """The suffix automaton of a growing token sequence; texts are set apart by tokens of their own."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.last, self.texts = 0, 0

    def _extend(self, token: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        p = self.last
        while p >= 0 and token not in nxt[p]:
            nxt[p][token] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][token]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(token) == q:
                    nxt[p][token] = copy
                    p = link[p]
                link[q] = link[new] = copy
        self.last = new

    def add(self, tokens: list[int]) -> None:
        self.texts += 1
        for token in tokens:
            self._extend(token)
        self._extend(-self.texts)

    def matching_statistics(self, tokens: list[int]) -> Iterator[int]:
        """For each place, the length of the longest piece ending there that occurs in the reference."""
        return (matched for _, matched in self.walk(tokens))

    def walk(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """For each place, the state of that piece and its length."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for token in tokens:
            while state and token not in nxt[state]:
                state = link[state]
                matched = length[state]
            if token in nxt[state]:
                state = nxt[state][token]
                matched += 1
            yield state, matched


class Shard:
    """An automaton over passages of several documents that knows the smallest id under which each window stands."""

    def __init__(self, passages: list[tuple[int, np.ndarray]], window: int):
        self.window, self.automaton = window, SuffixAutomaton()
        a = self.automaton
        least: list[int | None] = [None]
        for id_, tokens in passages:
            a.texts += 1
            for token in [*tokens.tolist(), ("end", a.texts)]:
                a._extend(token)
                least += [None] * (len(a.next) - len(least))
                least[a.last] = id_
        for state in sorted(range(1, len(a.next)), key=a.length.__getitem__, reverse=True):
            up = a.link[state]
            if least[state] is not None and up >= 0 and (least[up] is None or least[state] < least[up]):
                least[up] = least[state]
        self.least = least

    def repeats(self, id_: int, tokens: list[int]) -> Iterator[int]:
        """The starts of the windows of a document that stand in the shard under a smaller id."""
        a, window = self.automaton, self.window
        for end, (state, matched) in enumerate(a.walk(tokens)):
            if matched >= window:
                while a.length[a.link[state]] >= window:  # the state of the window itself
                    state = a.link[state]
                if self.least[state] < id_:
                    yield end - window + 1


class Reference:
    """The contexts of one anchor, met in rising id order."""

    def __init__(self, window: int):
        self.window, self.automaton = window, SuffixAutomaton()
        self.tokens: dict[str, int] = {}
        self.seen: dict[str, int] = {}
        self.waiting: list[str] = []
        self.at: int | None = None

    def repeats(self, id_: int, text: str) -> list[tuple[int, int]]:
        """Ranges [first, end) of windows of ``text`` that occur under a smaller id; ``text`` joins the reference."""
        if self.at != id_:
            for old in self.waiting:
                self.automaton.add([self.tokens.setdefault(w, len(self.tokens)) for w in old.split(" ")])
            self.waiting, self.at = [], id_
        words = text.split(" ")
        if (first := self.seen.get(text)) is not None and first != id_:
            return [(0, len(words) - self.window + 1)]
        found: list[tuple[int, int]] = []
        if self.automaton.texts:
            known = self.tokens.get
            for end, length in enumerate(self.automaton.matching_statistics([known(w, -(1 << 60)) for w in words])):
                if length >= self.window:
                    at = end - self.window + 1
                    if found and found[-1][1] == at:
                        found[-1] = (found[-1][0], at + 1)
                    else:
                        found.append((at, at + 1))
        if first is None:
            self.seen[text] = id_
            self.waiting.append(text)
        return found


def anchors_of(raw: bytes, window: int) -> np.ndarray:
    """For each window of words, the least hash among its n-grams of half its length.

    Equal windows have equal anchors, wherever they stand; the anchors of neighbouring
    windows are mostly one and the same, so a text has few.
    """
    data, starts, ends = word_bounds(raw)
    if len(starts) < window:
        return np.zeros(0, np.uint64)
    gram = window // 2
    return sliding_min(Grams(word_hashes(data, starts, ends)).of(gram), window - gram + 1)


def _summaries(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, anchors = [], [], []
            for t in batch.column(2).cast(pa.binary()):
                raw = t.as_py() or b""
                words = raw.split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                anchors.append(np.unique(anchors_of(raw, window)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))],
                names=["id", "th", "n_words", "sha", "anchors"],
            )

    return run


CONTEXT = pa.struct([("a", pa.int64()), ("start", pa.int32()), ("text", pa.string())])
WINDOW = pa.struct([("digest", pa.binary()), ("start", pa.int32())])


def _contexts(window: int):
    """Contexts of shared anchors, and digests of the windows of crowded anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contexts, windows = [], []
            for t, few, many in zip(batch.column(2).cast(pa.binary()), batch.column(3), batch.column(4), strict=True):
                raw = t.as_py()
                words = raw.split()
                at = anchors_of(raw, window).view(np.int64)
                mine, digests = [], []
                for ids, small in ((few, True), (many, False)):
                    shared = np.array(ids.as_py() or [], np.int64)
                    if not len(shared):
                        continue
                    hit = np.isin(at, shared)
                    edge = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1]) | (at[1:] != at[:-1]), [True])))
                    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                        if not hit[s]:
                            continue
                        if small:
                            for k in range(s, e, RUN):
                                text = b" ".join(words[k : min(k + RUN, e) + window - 1])
                                mine.append({"a": int(at[s]), "start": k, "text": text.decode("utf-8", "replace")})
                        else:
                            digests += [{"digest": hashlib.blake2b(b" ".join(words[k : k + window]), digest_size=16).digest(), "start": k} for k in range(s, e)]
                contexts.append(mine)
                windows.append(digests)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(contexts, pa.list_(CONTEXT)), pa.array(windows, pa.list_(WINDOW))], names=["id", "th", "text", "contexts", "windows"]
            )

    return run


def _stream(window: int):
    """Rows sorted by (anchor, id) against the automaton of their anchor; yields ranges of removed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, reference = None, None
        for batch in batches:
            rows = []
            for a, id_, th, start, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != anchor:
                    anchor, reference = a, Reference(window)
                rows += [(id_, th, start + s, start + e + window - 1) for s, e in reference.repeats(id_, text)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", "th", "s", "e"]
            )

    return run


def _passages(window: int):
    """(id, tokens): the passages that the given windows of each document make up; a token is a word's 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for id_, t, starts in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                tokens = word_hashes(*word_bounds(t.as_py())).view(np.int64)
                at = np.unique(np.array(starts, np.int64))
                edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1, [True])))
                for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    ids.append(id_)
                    found.append(tokens[at[s] : at[e - 1] + window].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["id", "tokens"])

    return run


#: Automata of this process by the broadcast they were built from.
_SHARDS: dict[int, list[Shard]] = {}


def _against(shared, window: int):
    """Streams documents against the broadcast shards; yields ranges of removed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, passages = shared.value
        if key not in _SHARDS:
            _SHARDS.clear()
            made: list[list] = [[]]
            room = SHARD_WORDS
            for id_, tokens in passages:
                if room <= 0:
                    made.append([])
                    room = SHARD_WORDS
                made[-1].append((id_, tokens))
                room -= len(tokens)
            _SHARDS[key] = [Shard(p, window) for p in made if p]
        shards = _SHARDS[key]
        for batch in batches:
            rows = []
            for id_, th, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                tokens = word_hashes(*word_bounds(t.as_py())).view(np.int64).tolist()
                rows += [(id_, th, start, start + window) for shard in shards for start in shard.repeats(id_, tokens)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", "th", "s", "e"]
            )

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, ranges = [], [], []
        for t, found in zip(batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
            words = t.as_py().split()
            gone = np.zeros(len(words) + 1, np.int64)
            for r in found.as_py():
                gone[r["s"]] += 1
                gone[r["e"]] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            counts.append(int(gone.sum()))
            digests.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).digest())
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
            ranges.append([{"s": s, "e": e} for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)])
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(ranges, kind)],
            names=["id", "th", "n_removed", "kept", "removed"],
        )


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, crowd: int = 500) -> DataFrame:
    """One row per row of ``df``: id, n_words, n_removed, kept_sha256, removed.

    A window is ``window`` consecutive words (split at ASCII white space) of one document. Every word
    is removed that lies in a window whose words also stand in a row of smaller id.
    removed lists the maximal ranges of removed words, [s, e); kept_sha256 is of the kept words joined by one space.

    1. Every text lists the anchors of its windows (``anchors_of``). Equal windows share an anchor.
       Copies of a whole text leave here: all but the smallest id lose every word.
    2. Anchors of one document only are dropped, which leaves the repeated part of the corpus.
    3. The words around each shared anchor form its reference shard. Shards are dealt out by
       anchor; in each, contexts come in rising id order, stream through the suffix automaton of those
       before them, and join it. Matching statistics of ``window`` or more mark the windows to remove. A shard
       has the contexts of ``crowd`` documents at most.
    4. Anchors of more documents would make too large a shard. The 128-bit digest of each of their windows is counted and aggregated to its smallest id.
       A window in over ``crowd`` rows, and in over a 4000th part of these windows, is hot; there are fewer than 4,000 such windows whatever the input. The
       passages they make up, at most 200,000 words, are broadcast as shards. Every task builds their suffix automata, in which each state knows the
       smallest id, and the documents stream past them where they are, without a shuffle. Windows that are less common
       meet the smallest id of their digest in a join in which no digest is frequent.

    Null texts have no words. Rows without an id neither lose words nor count as a reference, but equal to
    another whole text. Rows that share an id do not remove each other's words. Other columns are not read; an empty table gives an
    empty result.
    """
    bounded_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    summary = cut(docs.mapInArrow(_summaries(window), "id long, th long, n_words long, sha binary, anchors array<long>"))
    copies = cut(summary.groupBy("sha").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    marked = join_counted(summary, copies, "sha", "n", "left").withColumn("first_id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first_id")))
    lone = marked.select("id", "th", "anchors", "first_id").filter((F.size("anchors") > 0) & (F.col("id") == F.col("first_id")))
    anchored = cut(lone.select("id", "th", F.explode("anchors").alias("a")))
    seen = anchored.groupBy("a").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared = seen.filter("lo < hi").select("a", (F.col("n") <= crowd).alias("small"))
    touched = anchored.join(shared, "a").groupBy("id", "th").agg(
        F.collect_set(F.when(F.col("small"), F.col("a"))).alias("few"), F.collect_set(F.when(~F.col("small"), F.col("a"))).alias("many")
    )
    found = docs.join(touched, ["id", "th"]).select("id", "th", "text", "few", "many")
    schema = "id long, th long, text string, contexts array<struct<a:long,start:int,text:string>>, windows array<struct<digest:binary,start:int>>"
    found = cut(found.mapInArrow(_contexts(window), schema))
    contexts = found.select("id", "th", F.explode("contexts").alias("c")).select("c.a", "id", "th", "c.start", "c.text")
    dealt = contexts.repartition("a").sortWithinPartitions("a", "id", "th", "start")
    ranges = dealt.mapInArrow(_stream(window), "id long, th long, s int, e int")
    crowded = found.select("id", "th", F.explode("windows").alias("w")).select("w.digest", "id", "th", "w.start")
    lowest = cut(crowded.groupBy("digest").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi"))
    bound = max(crowd, (lowest.agg(F.sum("n")).collect()[0][0] or 0) // HOT_SHARE)
    hot, mild = lowest.filter(F.col("n") > bound), lowest.filter(F.col("n") <= bound)
    ranges = ranges.unionByName(_hot_ranges(found, crowded, hot, window))
    late = crowded.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(mild, "digest").filter(F.col("id") > F.col("lo"))
    ranges = ranges.unionByName(late.select("id", "th", F.col("start").alias("s"), (F.col("start") + window).alias("e")))
    gathered = ranges.groupBy("id", "th").agg(F.collect_list(F.struct("s", "e")).alias("found"))
    texts = found.select("id", "th", "text").join(gathered, ["id", "th"])
    result = texts.mapInArrow(_kept, "id long, th long, n_removed long, kept binary, removed array<struct<s:int,e:int>>").dropDuplicates(["id", "th"])
    result = result.select(F.col("id").alias("r_id"), F.col("th").alias("r_th"), "n_removed", "kept", "removed")
    whole = marked.select("id", "th", "n_words", "sha", "first_id")
    both = whole.join(result, (F.col("id") == F.col("r_id")) & (F.col("th") == F.col("r_th")), "left")
    copy = (F.col("id") > F.col("first_id")) & (F.col("n_words") >= window)
    all_words = F.array(F.struct(F.lit(0).alias("s"), F.col("n_words").cast("int").alias("e")))
    nothing = F.array().cast("array<struct<s:int,e:int>>")
    return both.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept", "sha")))).alias("kept_sha256"),
        F.when(copy, all_words).otherwise(F.coalesce("removed", nothing)).alias("removed"),
    )


def _hot_ranges(found: DataFrame, crowded: DataFrame, hot: DataFrame, window: int) -> DataFrame:
    """Ranges (id, th, s, e) of the windows of ``hot`` in rows of greater id, by broadcast automata of their passages."""
    sc = found.sparkSession.sparkContext
    first = crowded.join(F.broadcast(hot.select("digest", F.col("lo").alias("id"))), ["digest", "id"])
    first = first.groupBy("digest", "id").agg(F.min(F.struct("th", "start")).alias("at"))  # one place of each hot window
    spots = cut(first.groupBy("id", F.col("at.th").alias("th")).agg(F.collect_list("at.start").alias("starts")))
    texts = found.select("id", "th", "text").join(F.broadcast(spots), ["id", "th"]).dropDuplicates(["id", "th"])
    passages = texts.select("id", "text", "starts").mapInArrow(_passages(window), "id long, tokens array<long>").collect()  # 200,000 words at most
    made = sorted((r["id"], r["tokens"]) for r in passages)
    shared = sc.broadcast((hash((sc.applicationId, str(made))), [(i, np.array(t, np.int64)) for i, t in made]))
    streamed = found.filter(F.size("windows") > 0).select("id", "th", "text") if made else found.limit(0).select("id", "th", "text")
    return streamed.mapInArrow(_against(shared, window), "id long, th long, s int, e int")


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for t, gone in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
            words = t.as_py().split()
            for r in reversed(gone.as_py() or []):
                del words[r["s"] : r["e"]]
            texts.append(b" ".join(words).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])


def kept_texts(df: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with the ranges of ``dedup_substrings`` cut out, for tables whose ids are unique."""
    gone = verdicts.select(F.col(id_col).alias("id"), "removed")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return docs.join(gone, "id").select("id", "text", "removed").mapInArrow(_cut_words, "id long, text string").withColumnRenamed("id", id_col)
