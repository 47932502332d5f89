"""Mixing sources to target weights: budgets flow down a tree, each leaf gives a seeded token prefix.

Native DataFrame operations only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.llm.common import barrier

#: Documents of a leaf are dealt by their order into slices of about this many.
SLICE = 512
#: Hexadecimal digits of a document's place in its leaf's order.
DIGITS = 15
WHITE = r"[ \t-\r]+"


def whitespace_tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WHITE}", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(F.regexp_replace(trimmed, f"{WHITE}$", ""), WHITE))).cast("long")


def leaf_supplies(leaves: DataFrame, levels: list[str]) -> DataFrame:
    """Tokens and documents of each leaf; combined before the shuffle."""
    return leaves.groupBy(*levels).agg(F.sum("tokens").alias("supply"), F.count("*").alias("docs"))


def allocate(supplies: DataFrame, levels: list[str], weights: DataFrame | None, share: float, epochs: int) -> DataFrame:
    """``budget`` in tokens for each leaf, from ``levels``, ``supply``, ``docs``.

    The whole budget is ``share`` times all supply. Each node splits its budget among its children in
    proportion to their weights; a child that can't take its part (its leaves give ``epochs``
    times their supply at most) is filled, and what it leaves goes to its siblings. Only what all
    siblings together can't take is left to the level above, where the same rule holds. Since a
    node's capacity is the sum of its leaves', filling each level once from the top does both.

    ``weights`` has a row ``level, path (array of names), weight`` for a node; others weigh 1. Weights
    that aren't positive are read as 0: such a node gets nothing while a sibling can take it.
    """
    tree = supplies.withColumn("cap", F.col("supply") * F.lit(epochs))
    budgets = None
    for depth in range(len(levels)):
        path = levels[: depth + 1]
        nodes = tree.groupBy(*path).agg(F.sum("cap").alias("cap"))
        named = nodes.withColumn("path", F.array(*[F.coalesce(F.col(name).cast("string"), F.lit("")) for name in path]))
        if weights is None:
            named = named.withColumn("weight", F.lit(1.0))
        else:
            own = weights.where(F.col("level") == depth).groupBy("path").agg(F.max("weight").alias("weight"))
            named = named.join(own, "path", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0)))
        if budgets is None:
            named = named.withColumn("budget", F.sum("cap").over(Window.partitionBy()) * F.lit(share / epochs))
        else:
            same = reduce(Column.__and__, [F.col(f"n.{name}").eqNullSafe(F.col(f"b.{name}")) for name in levels[:depth]])
            named = named.alias("n").join(budgets.alias("b"), same).select("n.*", "b.budget")
        budgets = _fill(named, levels[:depth]).select(*path, F.col("given").alias("budget"))
    return budgets.select(*levels, F.round("budget").cast("long").alias("budget"))


def _fill(children: DataFrame, parents: list[str]) -> DataFrame:
    """``given``: weighted filling of siblings under their capacities.

    Siblings in the order of capacity by weight are filled up to a level; the first of them whose
    capacity lies above what would be left for it and those behind it sets the level for the rest.
    """
    rate = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(math.inf))
    order = Window.partitionBy(*parents).orderBy("rate", *[F.col("path")])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    sized = children.withColumn("rate", rate).withColumns(
        {"filled": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "open": F.sum("weight").over(onward)}
    )
    level = F.when(F.col("open") > 0, (F.col("budget") - F.col("filled")) / F.col("open"))
    levelled = sized.withColumn("level", F.when(level < F.col("rate"), level)).withColumn(
        "level", F.first("level", ignorenulls=True).over(order.rowsBetween(*whole))
    )
    # Weightless siblings take, in their order, what no other could.
    last = F.least(F.col("cap"), F.greatest(F.col("budget") - F.col("filled"), F.lit(0.0)))
    weighted = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return levelled.withColumn("given", F.when(F.col("weight") > 0, F.greatest(weighted, F.lit(0.0))).otherwise(last))


def mix(
    docs: DataFrame,
    levels: list[Column],
    weights: DataFrame | None = None,
    share: float = 0.5,
    epochs: int = 1,
    seed: int = 0,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """``row`` (the document's columns), ``leaf`` (its path), ``tokens`` and ``copies`` for the documents that are taken.

    In each epoch a leaf's documents stand in an order of their own, given by the MD5 of the seed, the
    epoch and the key (and the text's MD5, so that rows with one key have an order too). Whole
    epochs are taken while the budget lasts, then the documents of the next epoch's order before which
    fewer tokens than the rest of the budget stand. So a leaf falls short by nothing and goes over by
    less than one document. ``copies`` is the number of epochs that hold the document.

    Documents without tokens are never taken; null levels form leaves of their own; repeated rows are
    documents each; ties in the hash stand in the order of key and text hash; equal rows share their
    place and are taken together. An empty table gives an empty result.

    No window holds a leaf: its order is cut into slices, slices are summed before they are shuffled, and only
    the one slice in which the budget ends is ordered row by row.
    """
    names = [f"level{position}" for position in range(len(levels))]
    keyed = docs.select(
        F.struct("*").alias("row"),
        *[level.cast("string").alias(name) for level, name in zip(levels, names, strict=True)],
        F.col(key).alias("key"),
        F.md5(F.col(text)).alias("print"),
    )
    counted = keyed.select(*names, "key", "print", whitespace_tokens(F.col(f"row.{text}")).alias("tokens"))
    light, _ = barrier(counted.where("tokens > 0"), "mix-leaves")
    supplies = leaf_supplies(light, names)
    plan, _ = barrier(_with(supplies, allocate(supplies, names, weights, share, epochs), names), "mix-budgets")
    plan = plan.select(
        *names,
        F.expr("budget div supply").cast("int").alias("full"),
        F.expr("budget % supply").alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("docs") / SLICE)).cast("long").alias("slices"),
    )
    each = ["key", "print", *names]
    kind = lambda name: F.lit(name).alias("kind")
    full = _with(light, plan.where("full > 0"), names).select(*each, "tokens", F.col("full").alias("copies"), kind("full"))
    part = _prefixes(light, plan, names, seed).select(*each, "tokens", F.lit(1).alias("copies"), kind("part"))
    # Equal rows share every value; an epoch that is taken whole and one that is taken in part add up.
    taken = full.unionByName(part).distinct().groupBy(*each).agg(F.max("tokens").alias("tokens"), F.sum("copies").cast("int").alias("copies"))
    return _with(keyed, taken, each).select("row", F.array(*names).alias("leaf"), "tokens", "copies")


def _with(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    same = reduce(Column.__and__, [F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}")) for name in names])
    more = [F.col(f"r.{name}") for name in right.columns if name not in names]
    return left.alias("l").join(right.alias("r"), same).select("l.*", *more)


def _prefixes(light: DataFrame, plan: DataFrame, names: list[str], seed: int) -> DataFrame:
    """The documents of each leaf's last, partial epoch."""
    name = F.md5(F.concat_ws(":", F.lit(seed), F.col("full"), F.col("key"), F.col("print")))
    placed = _with(light, plan.where("rest > 0"), names).withColumn("place", F.conv(F.substring(name, 1, DIGITS), 16, 10).cast("long"))
    placed = placed.withColumn("slice", F.floor(F.col("place") / (F.lit(16.0**DIGITS) / F.col("slices"))).cast("long"))
    sums = placed.groupBy(*names, "slice").agg(F.sum("tokens").alias("sum"))
    ahead = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("ahead", F.coalesce(F.sum("sum").over(ahead), F.lit(0)))
    known = _with(placed, starts, [*names, "slice"]).where("ahead < rest")
    inside = F.col("ahead") + F.col("sum") <= F.col("rest")
    row = Window.partitionBy(*names, "slice").orderBy("place", "key", "print")
    last = known.where(~inside).withColumn("through", F.sum("tokens").over(row)).withColumn(
        "own", F.sum("tokens").over(Window.partitionBy(*names, "slice", "place", "key", "print"))
    )
    cut = last.where(F.col("ahead") + F.col("through") - F.col("own") < F.col("rest"))
    keep = [*names, "key", "print", "tokens"]
    return known.where(inside).select(*keep).unionByName(cut.select(*keep))
