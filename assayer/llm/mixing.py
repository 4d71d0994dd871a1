"""Mixing sources to target weights: hierarchical budgets, seeded epochs. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.plans import broadcast_if_small, cut

LEVELS = ("domain", "lang", "source")
#: Ranges of the seeded order that are summed before any rows are sorted; three hex digits.
BUCKETS = 4096


def count_words(text: Column) -> Column:
    """Words of a text, split at ASCII white space; null counts as none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x09-\x0D ]+"), "")), F.lit(0)).cast("long")


def domain_of(source: Column, domains: int = 4) -> Column:
    """``d0`` .. by the number at the end of a source's name; ``d`` without one."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("long") % domains).cast("string"))).otherwise(F.lit("d"))


def weight_of(names: Column, weights: dict[str, int]) -> Column:
    """The weight of each name as a long; 1 where none is given."""
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.element_at(table, names), F.lit(1)).cast("long")


def share_out(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds ``budget``: the parent's ``pool`` shared by ``weight``, at most ``room`` each.

    A child whose room is under its share is filled, and what it leaves goes to its
    siblings by their weights, until every child is full or has its share: water
    filling. In the order of room per weight the full children come first, so two
    running sums find them.
    """
    usable = children.withColumn("room", F.when(F.col("weight") > 0, F.col("room")).otherwise(F.lit(0).cast("long")))
    ratio = F.when(F.col("weight") > 0, F.col("room").cast("double") / F.col("weight")).otherwise(F.lit(0.0))
    within = Window.partitionBy(*parents)
    order = within.orderBy("ratio", name)
    before = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = F.col("room").cast("double") * F.col("onward") <= (F.col("pool") - F.col("before")).cast("double") * F.col("weight")
    marked = usable.withColumn("ratio", ratio).withColumns({"before": before, "onward": onward}).withColumn("full", full)
    spent = F.sum(F.when(F.col("full"), F.col("room")).otherwise(0)).over(within)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(within)
    level = marked.withColumns({"spent": spent, "open_weight": open_weight})
    share = F.floor((F.col("pool") - F.col("spent")).cast("double") * F.col("weight") / F.col("open_weight")).cast("long")
    budget = F.when(F.col("full"), F.col("room")).otherwise(F.least("room", share)).cast("long")
    return level.withColumn("budget", budget).drop("ratio", "before", "onward", "full", "spent", "open_weight")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], share: float, max_epochs: int) -> DataFrame:
    """Budgets for ``leaves(domain, lang, source, tokens)``, from the root down.

    The root's pool is ``share`` of all tokens. A node's room is ``max_epochs`` times the
    tokens below it. A shortage goes to siblings first: a node's budget never exceeds its room, so
    its children always find place for it among themselves, and only what a whole node
    lacks goes one level up to the node's own siblings.
    """
    room = (F.col("tokens") * max_epochs).cast("long")
    rooms = leaves.withColumn("room", room)
    pool: DataFrame | None = None
    for depth, name in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        level = rooms.groupBy(*path).agg(F.sum("room").alias("room"), F.sum("tokens").alias("tokens"))
        level = level.withColumn("weight", weight_of(F.col(name), weights.get(name, {})))
        if pool is None:
            level = level.withColumn("pool", F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(1))) * F.lit(share)).cast("long"))
            pool = share_out(level.withColumn("root", F.lit(0)), ["root"], name).drop("root")
        else:
            above = pool.select(*path[:-1], F.col("budget").alias("pool"))
            pool = share_out(level.join(above, path[:-1]), path[:-1], name)
    return pool.select(*LEVELS, "tokens", "budget")


def _placed(df: DataFrame, weights: dict, share: float, max_epochs: int, seed: int, columns: dict[str, Column], max_broadcast: int) -> tuple[DataFrame, Callable, DataFrame]:
    """(slim, ordered, plan): ``columns`` of ``df``; what adds ``leaf``, ``key`` and ``bucket`` to rows that have them; and the leaves' budgets and ends."""
    levels = list(LEVELS)
    slim = cut(df.select(*[c.alias(n) for n, c in columns.items()]))
    leaves = slim.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, weights, share, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    budgets = cut(budgets.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")))
    place = F.struct("budget", "epochs", "rest").alias("leaf")

    def ordered(rows: DataFrame, plan: DataFrame) -> DataFrame:
        rows = rows.join(broadcast_if_small(plan, max_broadcast), levels, "left")
        key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("leaf.epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
        return rows.withColumn("key", key).withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))

    sums = ordered(slim, budgets.select(*levels, place)).groupBy(*levels, F.col("leaf.rest").alias("rest"), "bucket").agg(F.sum("n_tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
    ends = ends.groupBy(*levels).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("t")).alias("before")), "bucket").alias("end"))
    plan = cut(budgets.join(ends, levels, "left").select(*levels, F.struct("budget", "epochs", "rest", "end").alias("leaf")))
    return slim, ordered, plan


def _copies(inside: Column) -> Column:
    """How often a row is taken: the whole epochs, and once more inside the prefix. A row without tokens has no part in a prefix."""
    more = inside & (F.col("leaf.rest") > 0) & (F.col("n_tokens") > 0)
    return (F.col("leaf.epochs") + more.cast("long")).alias("copies")


def _by_place(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clear, edge) with ``copies``.

    clear: the rows whose range of the seeded order lies before or behind the end of their leaf's prefix. edge: those of
    the one range in which it ends, about the 4096th part of a leaf, sorted within the leaf.
    """
    last = F.coalesce(F.col("leaf.end.bucket"), F.lit(BUCKETS))
    clear = placed.filter(F.col("bucket") != last).withColumn("copies", _copies(F.col("bucket") < last))
    order = Window.partitionBy(*LEVELS).orderBy("key", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.filter(F.col("bucket") == last).withColumn("upto", F.col("leaf.end.before") + F.sum("n_tokens").over(order))
    return clear, edge.withColumn("copies", _copies(F.col("upto") <= F.col("leaf.rest"))).drop("upto")


def _columns(id_col: str, text_col: str, lang_col: str, source_col: str, domain: Column | None) -> dict[str, Column]:
    none = F.lit("(none)")
    name = F.col(source_col).cast("string")
    return {
        "id": F.col(id_col).cast("long"),
        "domain": F.coalesce(domain if domain is not None else domain_of(name), none),
        "lang": F.coalesce(F.col(lang_col).cast("string"), none),
        "source": F.coalesce(name, none),
        "n_tokens": count_words(F.col(text_col).cast("string")),
    }


def mix_sources(
    df: DataFrame,
    weights: dict[str, dict[str, int]],
    share: float = 0.5,
    max_epochs: int = 2,
    seed: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    domain: Column | None = None,
    max_broadcast: int = 100_000,
) -> DataFrame:
    """One row per row of ``df``: ``id_col``, domain, lang, source, n_tokens, budget, copies.

    ``weights`` maps a level (domain, lang, source) to weights by name; a name without
    one weighs 1, and weight 0 takes nothing. Each leaf takes ``budget`` tokens: as many whole
    epochs as fit, then the longest prefix of the next epoch that stays within the rest.
    An epoch's order is the MD5 of (seed, epoch, id). copies says how often a row is taken.

    The prefix of a leaf is found without sorting it: tokens are summed over 4096
    ranges of the order, and only rows of the one range in which the prefix ends are sorted.
    A null or empty text has no tokens: it comes with every whole epoch of its leaf, takes no part in a prefix, and a leaf without any
    tokens has no epoch. Null names form a node called ``(none)``. Repeated rows share
    one place in the order and are taken one after the other. Other columns are not read; an empty table gives an empty result.
    """
    columns = _columns(id_col, text_col, lang_col, source_col, domain)
    slim, ordered, plan = _placed(df, weights, share, max_epochs, seed, columns, max_broadcast)
    clear, edge = _by_place(ordered(slim, plan))
    return clear.unionByName(edge).select(F.col("id").alias(id_col), *LEVELS, "n_tokens", F.col("leaf.budget").alias("budget"), "copies")


def take_mixed(
    df: DataFrame,
    weights: dict[str, dict[str, int]],
    share: float = 0.5,
    seed: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    domain: Column | None = None,
    max_broadcast: int = 100_000,
) -> DataFrame:
    """The rows of ``df`` that a mix of one epoch takes (``mix_sources`` with ``max_epochs`` 1), with all columns.

    Whole rows go by their range of the seeded order without a shuffle; only those of the range in which a leaf's prefix ends are
    sorted within the leaf. Nulls, empty texts, ties, repeated rows and empty tables as there; columns of any name are
    carried through. A leaf without any tokens gives no row.
    """
    columns = _columns(id_col, text_col, lang_col, source_col, domain)
    _, ordered, plan = _placed(df, weights, share, 1, seed, columns, max_broadcast)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])
    clear, edge = _by_place(ordered(rows, plan))
    return clear.unionByName(edge).filter(F.col("copies") > 0).select("row.*")
