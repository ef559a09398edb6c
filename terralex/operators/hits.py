"""Hits: which cells a query hits, and which items in them.

A row per cell and item, ``cell_id, item_id``; a cell of which every item is hit has one row without an item.
A hit cell is one or the other, never both. Long rows instead of an array per cell keep a cell with very
many items spread over tasks. A set operator marks the rows of both sides and groups them by cell and item once; what
is full is a row of that table too, and meets the other rows of its cell in a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralex.sources.scratch import written
from terralex.sources.world import World


def kept(hits: DataFrame) -> DataFrame:
    """Hits written once, for a query that reads them several times."""
    return written(hits, "hits")


def full_cells(hits: DataFrame) -> DataFrame:
    return hits.filter("item_id IS NULL").select("cell_id")


def partial(hits: DataFrame) -> DataFrame:
    return hits.filter("item_id IS NOT NULL")


def cells_of(hits: DataFrame) -> DataFrame:
    return hits.select("cell_id").distinct()


def of_cells(cells: DataFrame) -> DataFrame:
    """Cells as full hits."""
    return cells.select("cell_id").distinct().withColumn("item_id", F.lit(None).cast("bigint"))


def of_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of cell and item as partial hits."""
    return pairs.select("cell_id", "item_id").distinct()


LEFT, RIGHT = 1, 2
#: Parts of a cell in a set operator; its full row goes to each, so items of a large cell are spread over tasks.
SALTS = 8


def _marked(a: DataFrame, b: DataFrame) -> DataFrame:
    """cell_id, item_id, own (the sides that have the row), full (the sides that have the whole cell, or 0): both sides grouped once, their full rows told to the items by a window."""
    both = a.withColumn("side", F.lit(LEFT)).unionByName(b.withColumn("side", F.lit(RIGHT)))
    once = both.groupBy("cell_id", "item_id").agg(F.bit_or("side").alias("own"))
    every = F.array(*map(F.lit, range(SALTS)))
    dealt = once.withColumn("salt", F.explode(F.when(F.col("item_id").isNull(), every).otherwise(F.array(F.pmod(F.hash("item_id"), F.lit(SALTS))))))
    full = F.max(F.when(F.col("item_id").isNull(), F.col("own"))).over(Window.partitionBy("cell_id", "salt"))
    return dealt.withColumn("full", F.coalesce(full, F.lit(0))).filter("item_id IS NOT NULL OR salt = 0").drop("salt")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells or items that either hits; full wins."""
    return _marked(a, b).filter("item_id IS NULL OR full = 0").select("cell_id", "item_id")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """What both hit."""
    return _marked(a, b).filter("IF(item_id IS NULL, full, own | full) = 3").select("cell_id", "item_id")


def _less(a: DataFrame, b: DataFrame, world: World, sides: tuple[int, ...]) -> DataFrame:
    """What one of these sides hits and the other doesn't. A full cell of which the other hits items is spelt out but for them.

    The marked rows are used two times, in plans that Spark shuffles once: for full cells of one side, with the number of items that the other hits,
    and for items, which are kept where neither side is full and else taken from what is spelt out."""
    marked, one = _marked(a, b), f"full IN ({', '.join(map(str, sides))})"
    cells = marked.filter(one).groupBy("cell_id").agg(F.count("item_id").alias("met"))
    there = world.cell_items.select(F.col("cell_id").alias("in_cell"), "item_id")
    spelt = cells.join(there, F.expr("cell_id = in_cell AND met > 0"), "left").filter("met = 0 OR item_id IS NOT NULL").select("cell_id", "item_id", F.lit(True).alias("kept"), F.lit(False).alias("lost"))
    own = marked.filter("item_id IS NOT NULL").select("cell_id", "item_id", F.expr(f"full = 0 AND own IN ({', '.join(map(str, sides))})").alias("kept"), F.expr(one).alias("lost"))
    return spelt.unionByName(own).groupBy("cell_id", "item_id").agg(F.bool_or("kept").alias("kept"), F.bool_or("lost").alias("lost")).filter("kept AND NOT lost").select("cell_id", "item_id")


def difference(a: DataFrame, b: DataFrame, world: World) -> DataFrame:
    """What a hits and b doesn't, cell by cell: an item of several cells can stay through one that b misses."""
    return _less(a, b, world, (LEFT,))


def symmetric(a: DataFrame, b: DataFrame, world: World) -> DataFrame:
    """What exactly one of both hits."""
    return _less(a, b, world, (LEFT, RIGHT))


def to_full(hits: DataFrame) -> DataFrame:
    """Every hit cell as a whole."""
    return of_cells(hits)


def pairs(hits: DataFrame, world: World) -> DataFrame:
    """Every hit pair of cell and item, full cells spelt out."""
    whole = world.cell_items.select("cell_id", "item_id").join(full_cells(hits), "cell_id", "left_semi")
    return partial(hits).unionByName(whole)


def flatten(hits: DataFrame, world: World) -> DataFrame:
    """The items hit anywhere: item_id."""
    return pairs(hits, world).select("item_id").distinct()


def listed(hits: DataFrame) -> DataFrame:
    """A row per cell: cell_id, full_match, own (listed items, 0 if full). For lists of items use rows: a cell may have any number."""
    return hits.groupBy("cell_id").agg(F.max(F.col("item_id").isNull()).alias("full_match"), F.count("item_id").alias("own"))


def counted(hits: DataFrame, world: World) -> DataFrame:
    """A row per cell: cell_id, full_match, n (hit items, of a full cell all). The hits are read once."""
    return listed(hits).join(world.table("cell_sizes"), "cell_id", "left").select(
        "cell_id", "full_match", F.when(F.col("full_match"), F.coalesce("n_items", F.lit(0))).otherwise(F.col("own")).alias("n")
    )


def by_region(hits: DataFrame, world: World) -> DataFrame:
    """Roll-up along the hierarchy: region_id, cells hit, full cells, pairs of hit cell and item."""
    parents = world.cell_parents.select("cell_id", "region_id")
    return parents.join(counted(hits, world), "cell_id").groupBy("region_id").agg(F.count("*").alias("cells"), F.sum(F.col("full_match").cast("bigint")).alias("full_cells"), F.sum("n").alias("pairs"))


def sub_hierarchy(hits: DataFrame, world: World) -> DataFrame:
    """The hierarchy cut down to regions with a hit cell: region_id, parent_id, cells and pairs (of a hit cell and an item) in the whole region, own_cells and own_pairs of those that lie
    directly in it. As cells lie in all regions above theirs, the parent of a region that is left is left too; roots have none."""
    own = F.col("direct").cast("bigint")
    sums = world.cell_parents.join(counted(hits, world), "cell_id").groupBy("region_id").agg(
        F.count("*").alias("cells"), F.sum("n").alias("pairs"), F.sum(own).alias("own_cells"), F.sum(own * F.col("n")).alias("own_pairs")
    )
    return sums.join(world.regions.select("region_id", "parent_id"), "region_id", "left").select("region_id", "parent_id", "cells", "pairs", "own_cells", "own_pairs")
