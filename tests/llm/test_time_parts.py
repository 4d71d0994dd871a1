"""Adaptive time partitions against a plain walk over sorted rows."""

import calendar
import glob
import hashlib
import random
import zlib
from datetime import datetime, timedelta
from urllib.parse import unquote, urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from assayer.llm import queries, time_parts

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
CUTOFF = datetime(2024, 3, 1)


def plain_moment(row):
    ts, k = row[1], None if row[0] is None else zlib.crc32(str(row[0]).encode()) % 128
    if ts is None or k is None:
        return ts
    if k < 16:
        return ts - timedelta(days=(k + 6) ** 3)
    if k > 111:
        return datetime(ts.year, ts.month, ts.day) - timedelta(days=ts.weekday())
    return ts


def plain_leaves(moments, limit):
    """[(name, moments of it)], by walking down from years."""
    leaves = []

    def walk(siblings, above, level):
        run = []

        def close():
            rows = [m for _, ms in run for m in ms]
            if rows:
                leaves.append((f"{above}{run[0][0]}-{run[-1][0]}", rows))
            run.clear()

        for name, ms in siblings:
            if len(ms) > limit:
                close()
                if level == 3:
                    leaves.append((f"{above}{name}-{name}", ms))
                else:
                    m = ms[0]
                    if level == 0:
                        more = [(f"{x:02d}", [y for y in ms if y.month == x]) for x in range(1, 13)]
                    elif level == 1:
                        more = [(f"{x:02d}", [y for y in ms if y.day == x]) for x in range(1, calendar.monthrange(m.year, m.month)[1] + 1)]
                    else:
                        more = [(f"{x:02d}", [y for y in ms if y.hour == x]) for x in range(24)]
                    walk(more, f"{above}{name}/", level + 1)
            else:
                if sum(len(x) for _, x in run) + len(ms) > limit:
                    close()
                run.append((name, ms))
        close()

    ms = [m for m in moments if m is not None]
    if ms:
        years = range(min(ms).year, max(ms).year + 1)
        walk([(f"{y:04d}", [m for m in ms if m.year == y]) for y in years], "", 0)
    return leaves


def plain_layout(rows, limit):
    """{(leaf, part): rows in order}."""
    moments = [plain_moment(r) for r in rows]
    least = datetime(1, 1, 1)
    where = {m: name for name, ms in plain_leaves(moments, limit) for m in ms}
    by_leaf = {}
    for r, m in zip(rows, moments, strict=True):
        by_leaf.setdefault("null" if m is None else where[m], []).append((m or least, r[2] or least, -(1 << 63) if r[0] is None else r[0], r))
    files = {}
    for name, mine in by_leaf.items():
        ordered = [x[3] for x in sorted(mine, key=lambda x: x[:3])]
        for k in range(0, len(ordered), limit):
            files[name, k // limit + 1] = ordered[k : k + limit]
    return files


def hold(spark, rows, share, sub=queries):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    before = F.col("arrived_at") < F.lit(CUTOFF).cast("timestamp_ntz")
    order = [time_parts.micros(F.col("arrived_at")), F.col("click_id")]
    got = time_parts.partition_twice(df, queries.click_moment(), before, order, "click_id", share=share).collect()
    limit = 1 + len(rows) // share
    old = [r for r in rows if r[2] is not None and r[2] < CUTOFF]
    start, final = plain_layout(old, limit), plain_layout(rows, limit)
    ids = lambda rs: hashlib.sha256(",".join("null" if r[0] is None else str(r[0]) for r in rs).encode()).hexdigest()
    bag = lambda rs: sorted(map(str, rs))
    want = {}
    for at, rs in final.items():
        new = sum(r[2] is None or r[2] >= CUTOFF for r in rs)
        want[at] = (len(rs), new, bag(start.get(at, [])) != bag(rs), ids(rs))
    assert {(r["leaf"], r["part"]): (r["n_rows"], r["n_new"], r["rewritten"], r["ids_sha256"]) for r in got} == want and len(got) == len(want)
    paths = [unquote(urlparse(r["path"]).path) for r in got]
    if paths:
        top = paths[0].split("/data/")[0]
        there = [p for p in glob.glob(f"{glob.escape(top)}/**", recursive=True) if p.endswith(".parquet")]
        there = [unquote(p) for p in there]
        assert sorted(there) == sorted(unquote(p) for p in paths)
    return got, final


def made_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = datetime(2024, 1, 1) + timedelta(seconds=int(120 * 86400 * rng.random() ** 3), microseconds=rng.randrange(1_000_000))
        rows.append((i, ts, ts + timedelta(seconds=rng.randrange(90_000)), i % 7, rng.choice(["a", None]), rng.random(), "{}"))
    rows += [(n + i, None, datetime(2024, 1, 2 + i % 90 // 3), None, None, None, None) for i in range(n // 10)]
    hot = datetime(2024, 1, 9, 5, 30)
    rows += [(2 * n + i % 50, hot, hot + timedelta(days=i % 80), 1, "hot", 1.0, None) for i in range(n // 4)]  # one moment, equal keys that differ elsewhere
    rows += [(3 * n, hot, hot, 1, "same", 1.0, None)] * (n // 5)  # equal rows over several parts
    rows += [(None, hot, None, None, None, None, None), (None, None, None, None, None, None, None)]
    return rows + rows[: n // 50]


@pytest.mark.parametrize("share", [5, 40, 150])
def test_layouts_against_a_plain_walk(spark, share):
    got, final = hold(spark, made_rows(1500, share), share)
    assert {len(r["leaf"].split("/")) for r in got} >= ({1, 2} if share == 5 else {1, 3, 4})
    if share > 5:
        assert not all(r["rewritten"] for r in got) and max(r["part"] for r in got) > 5


def test_equal_rows_that_shift_between_parts_stay(spark):
    at = datetime(2024, 1, 1)
    rows = [(0, at, datetime(2024, 3, 2), None, None, None, None)] + [(5, at, datetime(2024, 1, 1), None, None, None, None)] * 40
    got, _ = hold(spark, rows, 10)
    assert any(not r["rewritten"] for r in got)


def test_files_hold_the_tables_columns_and_clashing_names(spark):
    names = "leaf, Part, m, h, u, start, c0, k0, file, slot, path, place".split(", ")
    rows = [(i, datetime(2024, 1, 1 + i % 20), datetime(2024, 2, 1 + i % 28), 1, "k", 0.5, "p", *[f"{c}{i}" for c in names]) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c in names))
    got = time_parts.partition_twice(df, queries.click_moment(), F.col("click_id") < 100, [F.col("click_id")], "click_id", share=20).collect()
    kept = []
    for r in got:
        t = pq.ParquetFile(unquote(urlparse(r["path"]).path)).read()
        assert t.column_names == df.columns and r["columns"] == ",".join(df.columns) and len(t) == r["n_rows"]
        kept += [tuple(x.values()) for x in t.to_pylist()]
    assert sorted(kept) == sorted(rows)


def test_empty_and_one_sided(spark):
    assert hold(spark, [], 650)[0] == []
    late = [(1, datetime(2024, 4, 1), datetime(2024, 4, 2), None, None, None, None)]
    got, _ = hold(spark, late, 650)
    assert [(r["leaf"], r["part"], r["n_new"], r["rewritten"]) for r in got] == [(f"{plain_moment(late[0]).year}-{plain_moment(late[0]).year}", 1, 1, True)]
    old = [(1, None, datetime(2024, 1, 2), None, None, None, None)]
    got, _ = hold(spark, old, 650)
    assert [(r["leaf"], r["n_new"], r["rewritten"]) for r in got] == [("null", 0, False)]
