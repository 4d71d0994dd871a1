"""Adaptive time partitions: leaves of years, months, days and hours within a limit of rows, in parts of exactly that many."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import date
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from assayer.plans import checkpoint_folder, cut, fresh_names, remove_folder

DAY, HOUR = 86_400_000_000, 3_600_000_000
LEAST = -(1 << 63)
#: Bins into which a round of the radix selection cuts each open range of keys.
BINS = 256
#: The sort key of a row, after its leaf: moment, the order columns, a hash of the row and its number.
MOMENT, START, HASH, NUMBER = "m", "start", "h", "u"


class Leaf(NamedTuple):
    """A run of sibling periods, from the first moment (microseconds) on; ``first`` is None for the leaf of null moments."""

    name: str
    first: int | None
    rows: int


def micros(moment: Column) -> Column:
    """Microseconds since 1970 of a timestamp as it reads, whatever its zone."""
    day = F.unix_date(F.to_date(moment)).cast("long")
    second = (F.date_part(F.lit("SECOND"), moment) * 1_000_000).cast("long")
    return day * DAY + F.hour(moment).cast("long") * HOUR + F.minute(moment).cast("long") * 60_000_000 + second


def days_before(m: Column, days: Column) -> Column:
    return m - days.cast("long") * DAY


def monday(m: Column) -> Column:
    """Midnight of the Monday on or before a moment."""
    day = ((m - F.pmod(m, F.lit(DAY))) / DAY).cast("long")
    return (day - F.pmod(day - 4, F.lit(7))) * DAY


def _first_micros(year: int, month: int = 1, day: int = 1) -> int:
    return (date(year, month, day) - date(1970, 1, 1)).days * DAY


def staged_rows(df: DataFrame, moment: Column, starting: Column, order: list[Column], folder: str) -> DataFrame:
    """``df`` with its sort key, written into ``folder``: m, whether the row is of the starting layout, k0.., a hash of the row, and a number of its own.

    The number settles ties between equal rows, and is fixed by writing it. ``moment`` and ``order`` are whole numbers; nulls of ``order`` sort first.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    key = [F.coalesce(c, F.lit(LEAST)).alias(f"k{i}") for i, c in enumerate(order)]
    given = df.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(df.columns, names, strict=True)], moment.alias(MOMENT), F.coalesce(starting, F.lit(False)).alias(START), *key)
    given.withColumn(HASH, F.xxhash64(*plain.columns)).withColumn(NUMBER, F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
    return df.sparkSession.read.parquet(f"{folder}/rows")


def key_columns(staged: DataFrame) -> list[str]:
    return [MOMENT, *sorted((c for c in staged.columns if c[0] == "k"), key=lambda c: int(c[1:])), HASH, NUMBER]


def hourly_counts(staged: DataFrame) -> DataFrame:
    """(y, mo, day, hour, n_start, n_all) of the hours that have rows; null moments are one row of nulls."""
    hour = staged.withColumn("at", F.col(MOMENT) - F.pmod(F.col(MOMENT), F.lit(HOUR))).groupBy("at").agg(F.count_if(START).alias("n_start"), F.count(F.lit(1)).alias("n_all"))
    day = ((F.col("at") - F.pmod(F.col("at"), F.lit(DAY))) / DAY).cast("int")
    on = F.date_from_unix_date(day)
    return cut(hour.select(F.year(on).alias("y"), F.month(on).alias("mo"), day.alias("day"), (F.pmod(F.col("at"), F.lit(DAY)) / HOUR).cast("int").alias("hour"), "n_start", "n_all"))


def find_leaves(counts: DataFrame, n: str, limit: int) -> list[Leaf]:
    """The leaves of a layout, in time order, the null leaf last.

    Only sums of the children of nodes above ``limit`` come to the driver: a layout of r rows has at most r / limit such nodes on a level, and ``limit`` is a share of
    the rows, so this does not grow with the table.
    """
    counts = counts.filter(F.col(n) > 0)

    def sums(level: list[str], inside: DataFrame) -> dict[tuple, int]:
        return {tuple(r[c] for c in level): r["n"] for r in inside.filter("y is not null").groupBy(*level).agg(F.sum(n).alias("n")).collect()}

    years = sums(["y"], counts)
    leaves: list[Leaf] = []
    if years:
        wide = [k for k, r in years.items() if r > limit]
        months = sums(["y", "mo"], counts.filter(F.col("y").isin([k[0] for k in wide]))) if wide else {}
        wide = [k for k, r in months.items() if r > limit]
        days = sums(["y", "mo", "day"], counts.filter((F.col("y") * 12 + F.col("mo")).isin([y * 12 + mo for y, mo in wide]))) if wide else {}
        wide = [k for k, r in days.items() if r > limit]
        hours = sums(["y", "mo", "day", "hour"], counts.filter(F.col("day").isin([k[2] for k in wide]))) if wide else {}

        def day_of(k: tuple) -> date:
            return date.fromordinal(date(1970, 1, 1).toordinal() + k[2])

        def walk(siblings: list[tuple[str, int, int, object]], above: str) -> None:
            """siblings: (member, first moment, rows, what splits it further or None if nothing can)."""
            run: list = []

            def close() -> None:
                if run and sum(s[2] for s in run):
                    leaves.append(Leaf(f"{above}{run[0][0]}-{run[-1][0]}", run[0][1], sum(s[2] for s in run)))
                run.clear()

            for s in siblings:
                if s[2] > limit:
                    close()
                    if s[3] is None:
                        run.append(s)
                        close()
                    else:
                        walk(s[3](), f"{above}{s[0]}/")
                else:
                    if run and sum(x[2] for x in run) + s[2] > limit:
                        close()
                    run.append(s)
            close()

        def all_hours(k: tuple) -> list:
            return [(f"{h:02d}", k[2] * DAY + h * HOUR, hours.get((*k, h), 0), None) for h in range(24)]

        def all_days(k: tuple) -> list:
            first, after = _first_micros(*k) // DAY, (_first_micros(k[0], k[1] + 1) if k[1] < 12 else _first_micros(k[0], 12, 31) + DAY) // DAY
            return [(f"{day_of((*k, d)).day:02d}", d * DAY, days.get((*k, d), 0), lambda d=d: all_hours((*k, d))) for d in range(first, after)]

        def all_months(y: int) -> list:
            return [(f"{mo:02d}", _first_micros(y, mo), months.get((y, mo), 0), lambda mo=mo: all_days((y, mo))) for mo in range(1, 13)]

        span = range(min(years)[0], max(years)[0] + 1)
        walk([(f"{y:04d}", _first_micros(y), years.get((y,), 0), lambda y=y: all_months(y)) for y in span], "")
    none = counts.filter("y is null").agg(F.sum(n)).collect()[0][0]
    return leaves + ([Leaf("null", None, none)] if none else [])


def _order_bytes(columns: list[np.ndarray]) -> np.ndarray:
    """One byte string a row that sorts as the rows of whole numbers do."""
    rows = np.stack([c.astype(np.int64) for c in columns], axis=1).view(np.uint64) ^ np.uint64(1 << 63)
    flat = np.ascontiguousarray(rows.astype(">u8")).view(np.uint8).reshape(len(rows), -1)
    return np.concatenate([flat, np.ones((len(flat), 1), np.uint8)], axis=1).view(f"S{flat.shape[1] + 1}").ravel()


def _leaf_of(leaves: list[Leaf]):
    """Numbers of the leaves of moments (LEAST for null), by search among their first moments."""
    firsts = np.array([x.first for x in leaves if x.first is not None], np.int64)

    def find(m: np.ndarray) -> np.ndarray:
        return np.where(m == LEAST, len(leaves) - 1, np.searchsorted(firsts, m, side="right") - 1)

    return find


class _Range(NamedTuple):
    """An open range of keys: of a leaf, equal to ``low`` before column c, between ``low`` and ``high`` on it."""

    leaf: int
    c: int
    low: tuple[int, ...]
    high: tuple[int, ...]


def _histogram(ranges: list[_Range], width: int):
    """Rows (leaf, key...): for each range and bin of it the rows, least and greatest of each column."""
    leaf = np.array([r.leaf for r in ranges])
    lows = np.array([r.low for r in ranges], np.int64).reshape(-1, width)
    highs = np.array([r.high for r in ranges], np.int64).reshape(-1, width)
    at_column = np.array([r.c for r in ranges])
    lower, upper = (_order_bytes([leaf, *x.T]) for x in (lows, highs))
    span = np.array([r.high[r.c] - r.low[r.c] for r in ranges], np.uint64)
    step = span // np.uint64(BINS) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, key = batch.column(0).to_numpy(), np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            # ranges of a leaf share no key but may end in the open on later columns: only columns up to c tell
            text = _order_bytes([own, *key.T])
            r = np.searchsorted(lower, text, side="right") - 1
            inside = (r >= 0) & (text <= upper[np.maximum(r, 0)])
            r, key = r[inside], key[inside]
            if not len(r):
                continue
            mine = key[np.arange(len(r)), at_column[r]]
            bins = ((mine.view(np.uint64) - lows[r, at_column[r]].view(np.uint64)) // step[r]).astype(np.int64)
            place = r * (BINS + 1) + bins
            order = np.argsort(place, kind="stable")
            place, key = place[order], key[order]
            starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            n = np.diff(np.concatenate((starts, [len(place)])))
            least, most = np.minimum.reduceat(key, starts), np.maximum.reduceat(key, starts)
            columns = [place[starts], n, *least.T, *most.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["place", "n", *[f"a{i}" for i in range(width)], *[f"z{i}" for i in range(width)]])

    return run


def find_boundaries(staged: DataFrame, leaves: list[Leaf], limit: int) -> dict[int, list[tuple[int, ...]]]:
    """For each leaf of over ``limit`` rows, by its number: the keys of its rows at every multiple of ``limit``.

    Radix selection over all leaves at once. Each round cuts every open range of keys that holds a boundary into bins on its first column that still varies, and counts the
    rows of each bin in the tasks; the bin that holds the boundary is the next range, with the least and greatest key of its rows. Ranges end as single keys, for each row's number differs. There
    are fewer boundaries than rows / limit, so the bins that come to the driver do not grow with the table.
    """
    keys = key_columns(staged)
    width = len(keys)
    wide = [i for i, x in enumerate(leaves) if x.rows > limit]
    if not wide:
        return {}
    spark, find = staged.sparkSession, _leaf_of(leaves)
    flags = np.zeros(len(leaves), bool)
    flags[wide] = True

    def only_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = find(batch.column(0).to_numpy())
            mine = pa.array(flags[leaf])
            yield pa.RecordBatch.from_arrays([pa.array(leaf).filter(mine), *[c.filter(mine) for c in batch.columns]], names=["leaf", *keys])

    plain = staged.select(F.coalesce(MOMENT, F.lit(LEAST)).alias(MOMENT), *keys[1:])
    folder = f"{checkpoint_folder(spark)}/wide-leaves-{uuid.uuid4().hex}"
    plain.mapInArrow(only_wide, "leaf long, " + ", ".join(f"{k} long" for k in keys)).write.parquet(folder)
    rows = spark.read.parquet(folder)
    ends = [f(k).alias(f"{'a' if f is F.min else 'z'}{i}") for f in (F.min, F.max) for i, k in enumerate(keys)]
    open_at: dict[_Range, list[tuple[int, int]]] = {}  # ranks within the range, from 1 on, and the numbers of their boundaries
    for r in rows.groupBy("leaf").agg(*ends).collect():
        ranks = range(1, (leaves[r["leaf"]].rows - 1) // limit + 1)
        low, high = tuple(r[f"a{i}"] for i in range(width)), tuple(r[f"z{i}"] for i in range(width))
        open_at[_closed_up(r["leaf"], low, high)] = [(k * limit, k) for k in ranks]
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    schema = ", ".join(f"{c} long" for c in ["place", "n", *[f"a{i}" for i in range(width)], *[f"z{i}" for i in range(width)]])
    while open_at:
        ranges = sorted(open_at, key=lambda x: (x.leaf, x.low))
        bins = rows.mapInArrow(_histogram(ranges, width), schema).groupBy("place")
        bins = bins.agg(F.sum("n").alias("n"), *[F.min(f"a{i}").alias(f"a{i}") for i in range(width)], *[F.max(f"z{i}").alias(f"z{i}") for i in range(width)]).collect()
        by_range: dict[int, list] = {}
        for b in sorted(bins, key=lambda b: b["place"]):
            by_range.setdefault(b["place"] // (BINS + 1), []).append(b)
        following: dict[_Range, list[tuple[int, int]]] = {}
        for i, one in enumerate(ranges):
            before, waiting = 0, sorted(open_at[one])
            for b in by_range[i]:
                mine = [w for w in waiting if before < w[0] <= before + b["n"]]
                if mine:
                    low, high = tuple(b[f"a{j}"] for j in range(width)), tuple(b[f"z{j}"] for j in range(width))
                    if b["n"] == 1 or low == high:
                        found.update({(one.leaf, k): low for _, k in mine})
                    else:
                        following[_closed_up(one.leaf, low, high)] = [(rank - before, k) for rank, k in mine]
                before += b["n"]
        open_at = following
    remove_folder(spark, folder)
    return {i: [found[i, k] for k in range(1, (leaves[i].rows - 1) // limit + 1)] for i in wide}


def _closed_up(leaf: int, low: tuple[int, ...], high: tuple[int, ...]) -> _Range:
    """The range from the least to the greatest of each column, cut on the first column on which they differ; later columns are left open."""
    c = next((i for i, (a, z) in enumerate(zip(low, high, strict=True)) if a != z), len(low) - 1)
    most = (1 << 63) - 1
    return _Range(leaf, c, (*low[: c + 1], *[LEAST] * (len(low) - c - 1)), (*high[: c + 1], *[most] * (len(low) - c - 1)))


class File(NamedTuple):
    """A file of a layout: its number, leaf and part, and the slot (task) that writes it."""

    number: int
    leaf: str
    part: int
    rows: int
    slot: int


class Layout(NamedTuple):
    """Files in order, and how rows find theirs: the number of each leaf's first file, and the boundaries of its parts."""

    leaves: list[Leaf]
    files: list[File]
    first: list[int]
    bounds: dict[int, list[tuple[int, ...]]]


def make_layout(staged: DataFrame, counts: DataFrame, n: str, limit: int, only_start: bool) -> Layout:
    leaves = find_leaves(counts, n, limit)
    bounds = find_boundaries(staged.filter(START) if only_start else staged, leaves, limit)
    slots = int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, before, files, first = sum(x.rows for x in leaves), 0, [], []
    for x in leaves:
        first.append(len(files))
        for part in range(1, (x.rows - 1) // limit + 2):
            rows = min(limit, x.rows - (part - 1) * limit)
            files.append(File(len(files), x.name, part, rows, before * slots // total))
            before += rows
    return Layout(leaves, files, first, bounds)


def _file_number(layout: Layout):
    """The number of the file of each row, from its key columns (the moment LEAST where null)."""
    find = _leaf_of(layout.leaves)
    flat = [(i, *b) for i, bs in sorted(layout.bounds.items()) for b in bs]
    bounds = _order_bytes([np.array(c, np.int64) for c in zip(*flat, strict=True)]) if flat else None
    wide = np.zeros(len(layout.leaves), bool)
    wide[list(layout.bounds)] = True
    first = np.array(layout.first, np.int64)
    before = np.concatenate(([0], np.cumsum([len(layout.bounds.get(i, ())) for i in range(len(layout.leaves))])))[:-1]  # boundaries of earlier leaves

    @F.arrow_udf("int")
    def number(*key: pa.Array) -> pa.Array:
        key = [k.to_numpy(zero_copy_only=False) for k in key]
        leaf = find(key[0])
        out = first[leaf]
        at = np.flatnonzero(wide[leaf])
        if len(at):
            text = _order_bytes([leaf[at], *[k[at] for k in key]])
            out[at] += np.searchsorted(bounds, text, side="left") - before[leaf[at]]  # boundaries below the row
        return pa.array(out.astype(np.int32))

    return number


def _routed(staged: DataFrame, layout: Layout) -> DataFrame:
    keys = key_columns(staged)
    return staged.withColumn("file", _file_number(layout)(F.coalesce(MOMENT, F.lit(LEAST)), *keys[1:]))


def _file_table(spark: SparkSession, files: list[File]) -> DataFrame:
    """(file, leaf, part, slot): fewer rows than twice the nodes above the limit and their children, whatever the table."""
    return F.broadcast(spark.createDataFrame([(f.number, f.leaf, f.part, f.slot) for f in files], "file int, leaf string, part int, slot int"))


def write_files(staged: DataFrame, layout: Layout, files: list[File], columns: list[str], names: list[str], folder: str) -> None:
    """Append ``files`` of a layout, one Parquet file each, in key order, into folders by leaf and part (``names``). Each is written by one task, streaming from its sort."""
    rows = _routed(staged, layout).join(_file_table(staged.sparkSession, files), "file")
    rows = rows.withColumn("leaf", F.coalesce(F.translate("leaf", "/", "_"), F.lit("")))  # folders need no escapes; never null, so that no further sort is put in
    slots = 1 + max((f.slot for f in files), default=0)
    rows = rows.repartitionById(slots, F.col("slot").cast("int")).sortWithinPartitions("leaf", "part", *key_columns(staged))
    given = [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]
    given += [F.col("leaf").alias(names[0]), F.col("part").alias(names[1])]
    rows.select(*given).write.mode("append").option("maxRecordsPerFile", 0).partitionBy(*names).parquet(folder)


def read_files(spark: SparkSession, like: DataFrame, names: list[str], folder: str) -> DataFrame:
    """The rows of a layout's folder with c0.. for the table's columns, and leaf, part, path and place in the file."""
    schema = StructType([*like.schema.fields, StructField(names[0], StringType()), StructField(names[1], IntegerType())])
    rows = spark.read.schema(schema).parquet(folder)
    given = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(like.columns)]
    about = rows.metadataColumn("_metadata")
    return rows.select(*given, F.translate(F.col(names[0]), "_", "/").alias("leaf"), F.col(names[1]).alias("part"), about["file_path"].alias("path"), about["row_index"].alias("place"))


def _marks() -> list[Column]:
    """The number of rows and the sums of both halves of their hashes: they tell a file's rows, in any order, whatever equal rows it has."""
    return [F.count(F.lit(1)).alias("rows"), F.sum(F.col(HASH).bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(HASH, 32)).alias("high")]


def file_marks(files: DataFrame, width: int) -> dict[tuple[str, int], tuple[str, tuple]]:
    """{(leaf, part): (path, marks)} of the files of a folder."""
    hashed = files.withColumn(HASH, F.xxhash64(*[f"c{i}" for i in range(width)]))
    return {(r["leaf"], r["part"]): (r["path"], (r["rows"], r["low"], r["high"])) for r in hashed.groupBy("leaf", "part", "path").agg(*_marks()).collect()}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, id) file by file in order: for each file its rows and the SHA-256 of its ids, comma-joined."""
    number, n, digest = None, 0, None
    done: list[tuple[int, int, str]] = []
    for batch in batches:
        file = batch.column(0).to_numpy()
        starts = [0, *(np.flatnonzero(file[1:] != file[:-1]) + 1).tolist(), len(file)] if len(file) else [0]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if number != file[s]:
                if number is not None:
                    done.append((number, n, digest.hexdigest()))
                number, n, digest = int(file[s]), 0, hashlib.sha256()
            ids = ",".join(batch.column(1).slice(s, e - s).to_pylist())
            digest.update((("," if n else "") + ids).encode())
            n += e - s
    if number is not None:
        done.append((number, n, digest.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.int64(), pa.string()), strict=True)], names=["file", "n_rows", "ids_sha256"])


def partition_twice(df: DataFrame, moment: Column, starting: Column, order: list[Column], id_col: str, share: int = 650) -> DataFrame:
    """Lay out the rows of ``df`` for which ``starting`` holds, then all rows, in a new folder under the shared checkpoint folder; one row per final file.

    ``moment`` and ``order`` (whole numbers or null) are the sort key of a row; further ties go by a hash of the row, then by a number that is written with it. The limit
    L is 1 + floor(rows / share) for both layouts. Years from the first to the last moment are siblings; a node above L rows splits into all its months, days or hours. In time
    order a sibling within L joins the run of the sibling before it if that stays within L, else starts one. Leaves are runs with rows, hours above L, and the null moments.
    A leaf's rows fill parts of L in order, one file each. The second layout writes only files whose leaf, part and rows were not there, then deletes
    the starting files that do not recur.

    Plan: rows are staged once with their keys; leaves come from hourly counts (``find_leaves``), part boundaries from a radix selection (``find_boundaries``); each row finds its file by
    searching these, whose number is bounded by ``share``, and is shuffled once to the task that writes the file. No window ranks rows. ids_sha256 and n_rows are read from
    the files in their order. A stopped run leaves a folder that no later call reads.

    Result: leaf, part, n_rows, n_new (rows that are not ``starting``), rewritten, columns, ids_sha256 (a null id is ``null``), path. Null moments are the leaf ``null``, null order columns sort
    first, a null ``starting`` is false; repeated rows are all kept; an empty table gives no files; columns of any name are kept but maps, which have no hash.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/time-parts-{uuid.uuid4().hex}"
    staged = staged_rows(df, moment, starting, order, f"{folder}/staged")
    counts = hourly_counts(staged)
    limit = 1 + staged.count() // share
    width, columns, names, data = len(df.columns), list(df.columns), fresh_names(df, "leaf", "part"), f"{folder}/data"

    start = make_layout(staged, counts, "n_start", limit, True)
    write_files(staged.filter(START), start, start.files, columns, names, data)
    were = file_marks(read_files(spark, df, names, data), width)

    final = make_layout(staged, counts, "n_all", limit, False)
    marks = _routed(staged, final).groupBy("file").agg(*_marks(), F.count_if(~F.col(START)).alias("n_new")).collect()  # a row per file
    stay, new = set(), {}
    for r in marks:
        f = final.files[r["file"]]
        new[f.number] = r["n_new"]
        if were.get((f.leaf, f.part), ("", ()))[1] == (r["rows"], r["low"], r["high"]):
            stay.add(f.number)
    kept = {(final.files[i].leaf, final.files[i].part) for i in stay}
    write_files(staged, final, [f for f in final.files if f.number not in stay], columns, names, data)
    _delete(spark, [path for at, (path, _) in were.items() if at not in kept])

    there = read_files(spark, df, names, data)
    at = df.columns.index(id_col)
    numbered = there.select("leaf", "part", F.coalesce(F.col(f"c{at}").cast("string"), F.lit("null")).alias("id"), "place").join(_file_table(spark, final.files), ["leaf", "part"])
    slots = 1 + max((f.slot for f in final.files), default=0)
    ordered = numbered.repartitionById(slots, F.col("slot").cast("int")).sortWithinPartitions("file", "place").select("file", "id")
    digests = ordered.mapInArrow(_digests, "file int, n_rows long, ids_sha256 string")
    paths = {(r["leaf"], r["part"]): r["path"] for r in there.select("leaf", "part", "path").distinct().collect()}
    told = [(f.number, f.leaf, f.part, new[f.number], f.number not in stay, ",".join(columns), paths[f.leaf, f.part]) for f in final.files]
    told = spark.createDataFrame(told, "file int, leaf string, part long, n_new long, rewritten boolean, columns string, path string")
    digests = cut(digests)
    remove_folder(spark, f"{folder}/staged")
    return digests.join(F.broadcast(told), "file").select("leaf", "part", "n_rows", "n_new", "rewritten", "columns", "ids_sha256", "path")


def _delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete files of the shared storage, as many as a layout has at most."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(p))
        at.getFileSystem(conf).delete(at, False)
