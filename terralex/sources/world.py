"""The tables of a world: a Parquet folder each, read lazily. Those with a place (:mod:`terralex.functions.curve`) are stored in its order.

=============  =====================================================================================
items          item_id, osm_type, is_region, shape (POINT, WAY, POLYGON), score
points         item_id, pos, lat, lon: vertices of points and ways
regions        region_id (an item's id too), parent_id, name, min_lat, max_lat, min_lon, max_lon
cells          cell_id, min_lat, max_lat, min_lon, max_lon
outlines       item_id, ring, pos, lat, lon: vertices of the rings of areas and regions; what an odd number of rings holds is
               inside, so a hole is one more ring. A region without rings is its box (optional)
borders        cell_id, pos, lat, lon: vertices of a cell's border; a cell without any has the corners of its box (optional)
cell_edges     src, dst: neighbours, both ways
cell_parents   cell_id, region_id, direct: closure of the hierarchy, distinct
cell_items     cell_id, item_id: distinct
tags           item_id, k, v: a key may repeat
phrases        phrase, k, v (optional)
item_boxes     item_id, min_lat, max_lat, min_lon, max_lon, place (these and the next ones follow from the others, and are written with them)
segments       item_id, kind (0 lone point, 1 part of a way, 2 part of a ring), lat, lon, to_lat, to_lon, place
cell_boxes     cell_id, min_lat, max_lat, min_lon, max_lon, place
cell_rings     cell_id, ring (vertices of the border in order), its box, place
cell_discs     cell_id, lat, lon, radius, inner: the disc of each cell, around the mean of its border's vertices
region_covers  region_id, parent_id, place and box of all its cells' boxes
region_cells   region_id, cell_id, direct, box of the cell, place of the region's cover
stray_cells    cell_id, box and place of cells that lie directly in no region
cell_sizes     cell_id, n_items
region_sizes   region_id, cells, pairs, items
tag_values     value_id, v, low, n, first_part, last_part, chunk: the dictionary of values, and the parts of the index that hold their items
postings       part, value_id, item_id: the text index
value_grams    gram, value_id, chunk: trigrams of values, for queries that don't say how a value begins
=============  =====================================================================================
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralex.functions.curve import NAME, laid_out, near, with_place
from terralex.functions.geo import BOX, Shape, haversine
from terralex.functions.text import trigrams
from terralex.sources.scratch import exists, guard, written

#: Rows of a part of the text index, about, and how many parts there are at most.
PART_ROWS, MOST_PARTS = 1 << 20, 4096
OPTIONAL = ("phrases", "outlines", "borders", "item_boxes", "segments", "cell_boxes", "cell_rings", "cell_discs", "region_covers", "region_cells", "stray_cells", "cell_sizes", "region_sizes", "tag_values", "postings", "value_grams")


def rings(world: World) -> DataFrame:
    """item_id, ring, pos, lat, lon of all areas; regions without rings as their boxes."""
    ids = world.regions.select(F.col("region_id").alias("item_id"), "min_lat", "max_lat", "min_lon", "max_lon")
    if world.outlines is not None:
        ids = ids.join(world.outlines.select("item_id").distinct(), "item_id", "left_anti")
    corners = [("min_lat", "min_lon"), ("min_lat", "max_lon"), ("max_lat", "max_lon"), ("max_lat", "min_lon")]
    boxes = ids.select("item_id", F.lit(0).alias("ring"), F.posexplode(F.array(*(F.struct(F.col(a).alias("lat"), F.col(o).alias("lon")) for a, o in corners))).alias("pos", "p")).select("item_id", "ring", "pos", "p.lat", "p.lon")
    return boxes if world.outlines is None else world.outlines.select("item_id", "ring", "pos", "lat", "lon").unionByName(boxes)


def cell_borders(world: World) -> DataFrame:
    """cell_id, pos, lat, lon; cells without a border as their boxes."""
    ids = world.cells if world.borders is None else world.cells.join(world.borders.select("cell_id").distinct(), "cell_id", "left_anti")
    corners = [("min_lat", "min_lon"), ("min_lat", "max_lon"), ("max_lat", "max_lon"), ("max_lat", "min_lon")]
    boxes = ids.select("cell_id", F.posexplode(F.array(*(F.struct(F.col(a).alias("lat"), F.col(o).alias("lon")) for a, o in corners))).alias("pos", "p")).select("cell_id", "pos", "p.lat", "p.lon")
    return boxes if world.borders is None else world.borders.select("cell_id", "pos", "lat", "lon").unionByName(boxes)


def _item_boxes(world: World) -> DataFrame:
    vertices = world.points.select("item_id", "lat", "lon").unionByName(rings(world).select("item_id", "lat", "lon"))
    return with_place(vertices.groupBy("item_id").agg(*_around("lat", "lon")))


def _around(lat: str, lon: str) -> list[Column]:
    return [F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"), F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon")]


def _segments(world: World) -> DataFrame:
    """Lone points, and each piece of ways and of rings, which are closed."""
    way = Window.partitionBy("item_id").orderBy("pos")
    ahead, first = (lambda c: F.lead(c).over(way)), F.lag("pos").over(way).isNull()
    lines = world.points.select("item_id", F.when(first & ahead("pos").isNull(), 0).otherwise(1).alias("kind"), "lat", "lon", ahead("lat").alias("to_lat"), ahead("lon").alias("to_lon"))
    lines = lines.filter("kind = 0 OR to_lat IS NOT NULL").withColumn("to_lat", F.coalesce("to_lat", "lat")).withColumn("to_lon", F.coalesce("to_lon", "lon"))
    ring = Window.partitionBy("item_id", "ring").orderBy("pos")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    areas = rings(world).select("item_id", F.lit(2).alias("kind"), "lat", "lon", following("lat").alias("to_lat"), following("lon").alias("to_lon"))
    boxed = lines.unionByName(areas).withColumns({"min_lat": F.least("lat", "to_lat"), "max_lat": F.greatest("lat", "to_lat"), "min_lon": F.least("lon", "to_lon"), "max_lon": F.greatest("lon", "to_lon")})
    return with_place(boxed).drop(*BOX)


def _cell_boxes(world: World) -> DataFrame:
    return with_place(world.cells.select("cell_id", *BOX))


def _cell_rings(world: World) -> DataFrame:
    ring = F.transform(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return with_place(cell_borders(world).groupBy("cell_id").agg(ring.alias("ring"), *_around("lat", "lon")))


def _cell_discs(world: World) -> DataFrame:
    """cell_id, lat, lon, radius, inner: around the mean of the different vertices of a cell's border, to the furthest and to the nearest of them."""
    return reaching(cell_borders(world).select("cell_id", "lat", "lon").distinct(), None)


def reaching(own: DataFrame, centres: DataFrame | None) -> DataFrame:
    """Discs around centres (cell_id, lat, lon; the means, where there are none) with the reach to vertices (cell_id, lat, lon)."""
    centres = own.groupBy("cell_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")) if centres is None else centres
    reach = F.expr(haversine("lat", "lon", "to_lat", "to_lon"))
    ends = own.select("cell_id", F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    return centres.join(ends, "cell_id").groupBy("cell_id").agg(F.any_value("lat").alias("lat"), F.any_value("lon").alias("lon"), F.max(reach).alias("radius"), F.min(reach).alias("inner"))


def _region_covers(world: World) -> DataFrame:
    held = world.cell_parents.select("cell_id", "region_id").join(world.cells, "cell_id").groupBy("region_id").agg(
        F.min("min_lat").alias("min_lat"), F.max("max_lat").alias("max_lat"), F.min("min_lon").alias("min_lon"), F.max("max_lon").alias("max_lon")
    )
    return with_place(held.join(world.regions.select("region_id", "parent_id"), "region_id", "left"))


def _region_cells(world: World) -> DataFrame:
    covers = world.table("region_covers").select("region_id", "place")
    return world.cell_parents.select("region_id", "cell_id", "direct").join(covers, "region_id").join(world.cells.select("cell_id", *BOX), "cell_id").select("region_id", "cell_id", "direct", *BOX, "place")


def _stray_cells(world: World) -> DataFrame:
    return world.table("cell_boxes").join(world.cell_parents.filter("direct").select("cell_id"), "cell_id", "left_anti")


def _cell_sizes(world: World) -> DataFrame:
    return world.cell_items.groupBy("cell_id").agg(F.count("*").alias("n_items"))


def _region_sizes(world: World) -> DataFrame:
    """region_id, cells, pairs (of a cell and an item), items (different ones)."""
    parents = world.cell_parents.select("cell_id", "region_id")
    cells = parents.join(world.table("cell_sizes"), "cell_id", "left").groupBy("region_id").agg(F.count("*").alias("cells"), F.sum(F.coalesce("n_items", F.lit(0))).alias("pairs"))
    items = parents.join(world.cell_items, "cell_id").select("region_id", "item_id").distinct().groupBy("region_id").agg(F.count("*").alias("items"))
    return cells.join(items, "region_id", "left").select("region_id", "cells", "pairs", F.coalesce("items", F.lit(0)).alias("items"))


def _tag_values(world: World) -> DataFrame:
    """value_id, v, low (in lower case), n (its items), first_part, last_part, chunk: each value once. Ids follow the order of low, so readers skip what can't match.

    The index is cut by the running number of its rows into parts of about PART_ROWS (more where that made over MOST_PARTS), so a frequent value has several parts and rare ones share one."""
    counts = world.tags.filter("v IS NOT NULL").select("v", "item_id").distinct().groupBy("v").agg(F.count("*").alias("n")).withColumn("low", F.lower("v"))
    ordered = counts.repartitionByRange("low", "v").sortWithinPartitions("low", "v").withColumn("chunk", F.spark_partition_id()).withColumn("value_id", F.monotonically_increasing_id())
    ordered = written(ordered, "values")
    ahead = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
    chunks = ordered.groupBy("chunk").agg(F.sum("n").alias("rows"))
    rows = max(PART_ROWS, -(-(chunks.agg(F.sum("rows")).first()[0] or 0) // MOST_PARTS))
    chunks = chunks.select("chunk", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("chunk").orderBy("value_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(chunks, "chunk")
    part = lambda more: F.floor((F.col("before") + F.col("own") + more) / rows).cast("int")
    placed = placed.select("value_id", "v", "low", "n", part(F.lit(0)).alias("first_part"), part(F.col("n") - 1).alias("last_part"), "chunk")
    return placed.repartition("chunk").sortWithinPartitions("chunk", "value_id")


def _postings(world: World) -> DataFrame:
    """part, value_id, item_id: the items of a value, dealt over its parts."""
    values = world.table("tag_values").select("v", "value_id", "first_part", "last_part")
    part = F.col("first_part") + F.pmod(F.xxhash64("item_id"), F.col("last_part") - F.col("first_part") + 1).cast("int")
    pairs = world.tags.filter("v IS NOT NULL").select("v", "item_id").distinct().join(values, "v").select(part.alias("part"), "value_id", "item_id")
    parts = (values.agg(F.max("last_part")).first()[0] or 0) + 1
    return pairs.repartition(parts, "part").sortWithinPartitions("part", "value_id", "item_id")


def _value_grams(world: World) -> DataFrame:
    """gram, value_id, chunk: the values that have a trigram, in the order of trigrams."""
    grams = world.table("tag_values").select(F.explode(trigrams("low")).alias("gram"), "value_id", "chunk")
    return grams.repartitionByRange("gram", "value_id").sortWithinPartitions("gram", "value_id")


#: Tables that follow from others, in an order in which they can be made.
DERIVED = {
    "item_boxes": _item_boxes, "segments": _segments, "cell_boxes": _cell_boxes, "cell_rings": _cell_rings, "cell_discs": _cell_discs, "region_covers": _region_covers, "region_cells": _region_cells, "stray_cells": _stray_cells, "cell_sizes": _cell_sizes, "region_sizes": _region_sizes, "tag_values": _tag_values, "postings": _postings, "value_grams": _value_grams,
}


def stored(table: DataFrame, name: str, folder: str, mode: str = "errorifexists") -> None:
    """Writes a table in the layout in which it is read."""
    table = laid_out(table) if name in DERIVED and NAME in table.columns else table
    table.write.mode(mode).partitionBy(*{"postings": ["part"], "tag_values": ["chunk"]}.get(name, [])).parquet(folder)


@dataclass(frozen=True)
class World:
    items: DataFrame
    points: DataFrame
    regions: DataFrame
    cells: DataFrame
    cell_edges: DataFrame
    cell_parents: DataFrame
    cell_items: DataFrame
    tags: DataFrame
    phrases: DataFrame | None = None
    outlines: DataFrame | None = None
    borders: DataFrame | None = None
    item_boxes: DataFrame | None = None
    segments: DataFrame | None = None
    cell_boxes: DataFrame | None = None
    cell_rings: DataFrame | None = None
    cell_discs: DataFrame | None = None
    region_covers: DataFrame | None = None
    region_cells: DataFrame | None = None
    stray_cells: DataFrame | None = None
    cell_sizes: DataFrame | None = None
    region_sizes: DataFrame | None = None
    tag_values: DataFrame | None = None
    postings: DataFrame | None = None
    value_grams: DataFrame | None = None

    def __post_init__(self) -> None:
        guard(self.spark)

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]

    @classmethod
    def load(cls, spark: SparkSession, folder: str, optional: tuple[str, ...] = OPTIONAL) -> World:
        """Tables of a folder. A missing table fails, unless it is optional."""
        found = {}
        for name in cls.names():
            if name not in optional or exists(spark, f"{folder}/{name}"):
                found[name] = spark.read.parquet(f"{folder}/{name}")
        return cls(**found)

    def write(self, folder: str, mode: str = "errorifexists") -> None:
        """All tables, also those that follow from others, from what is already written."""
        written = self
        for name in self.names():
            if (table := written.table(name)) is not None:
                stored(table, name, f"{folder}/{name}", mode)
                written = World(**{n: getattr(written, n) for n in self.names()} | {name: self.spark.read.parquet(f"{folder}/{name}")})

    def table(self, name: str) -> DataFrame | None:
        """A table; one that follows from others is planned where it isn't stored."""
        found = getattr(self, name)
        return DERIVED[name](self) if found is None and name in DERIVED else found

    def near(self, name: str, shape: Shape) -> DataFrame:
        """Of a stored table the rows whose place is near the shape; all of one that is planned, or has no places."""
        found = getattr(self, name)
        return self.table(name) if found is None else near(found, shape)

    def views(self, prefix: str = "") -> None:
        for name in self.names():
            if (table := getattr(self, name)) is not None:
                table.createOrReplaceTempView(f"{prefix}{name}")

    @property
    def spark(self) -> SparkSession:
        return self.items.sparkSession


def read_phrases(spark: SparkSession, path: str, tags: DataFrame) -> DataFrame:
    """A text source of three lines each: phrase, key, value. Phrases with a space and unknown pairs are left out; phrases are lower-cased.

    Lines are read as one text per file, so that triples don't depend on how Spark cuts files."""
    line = F.split(F.regexp_replace("value", r"\n+$", ""), "\n")
    triples = spark.read.text(path, wholetext=True).select(line.alias("lines")).select(
        F.explode(F.expr("transform(sequence(0, greatest(size(lines) div 3 - 1, 0)), i -> struct(get(lines, 3 * i) AS phrase, get(lines, 3 * i + 1) AS k, get(lines, 3 * i + 2) AS v))")).alias("t")
    )
    known = tags.select("k", "v").distinct()
    return triples.select(F.lower("t.phrase").alias("phrase"), "t.k", "t.v").filter(~F.col("phrase").contains(" ")).join(known, ["k", "v"], "left_semi").select("phrase", "k", "v").distinct()


def validate(world: World) -> DataFrame:
    """check, violations: one row per rule between the tables. Regions above themselves are looked for while the plan is composed."""
    from terralex.operators.tree import endless

    def lost(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
        return left.select(F.col(left_key).alias("id")).join(right.select(F.col(right_key).alias("id")), "id", "left_anti")

    def repeated(table: DataFrame, *keys: str) -> DataFrame:
        return table.groupBy(*keys).count().filter("count > 1")

    rules = {
        "item ids repeat": repeated(world.items, "item_id"),
        "cell ids repeat": repeated(world.cells, "cell_id"),
        "cell items repeat": repeated(world.cell_items, "cell_id", "item_id"),
        "cell parents repeat": repeated(world.cell_parents, "cell_id", "region_id"),
        "tags of no item": lost(world.tags, world.items, "item_id", "item_id"),
        "points of no item": lost(world.points, world.items, "item_id", "item_id"),
        "cell items of no cell": lost(world.cell_items, world.cells, "cell_id", "cell_id"),
        "cell items of no item": lost(world.cell_items, world.items, "item_id", "item_id"),
        "cell parents of no region": lost(world.cell_parents, world.regions, "region_id", "region_id"),
        "regions that are no item": lost(world.regions, world.items.filter("is_region"), "region_id", "item_id"),
        "parents that are no region": lost(world.regions.filter("parent_id IS NOT NULL"), world.regions, "parent_id", "region_id"),
        "regions above themselves": endless(world.regions.select(F.col("region_id").alias("node"), F.col("parent_id").alias("parent"))),
        "edges to no cell": lost(world.cell_edges, world.cells, "dst", "cell_id"),
    }
    out = None
    for name, broken in rules.items():
        row = broken.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out
