"""Operators over hits that follow the hierarchy of regions: coverage, exclusive cells, the dominant element."""

from __future__ import annotations

from math import sqrt
from typing import Literal, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.functions.geo import Point, Polygon, Rect, bearing, clipped, destination, distance, hull, middle
from terralex.operators import hits, items, leaves
from terralex.sources.world import World

MOST_CELLS, MOST_ITEMS = 10, 20  # fixed values: hits below both can be about one item
INSIDE = 0.9  # fixed value: share of its items from which a region counts as hit


def region_sizes(world: World) -> DataFrame:
    """region_id, cells, pairs (of a cell and an item), items (different ones); stored with a written world."""
    return world.table("region_sizes")


def _cells_of_regions(world: World, regions: DataFrame) -> DataFrame:
    return hits.of_cells(world.cell_parents.join(regions, "region_id", "left_semi"))


def by_cell_coverage(found: DataFrame, world: World, share: float) -> DataFrame:
    """All cells of each region of which more than this share of cells is hit; a share of 0 or less hits nothing."""
    if share <= 0:
        return leaves.cells(world, [])
    hit = world.cell_parents.join(hits.cells_of(found), "cell_id", "left_semi").groupBy("region_id").agg(F.count("*").alias("hit"))
    return _cells_of_regions(world, hit.join(region_sizes(world), "region_id").filter(F.col("hit") > F.col("cells") * share))


def by_item_coverage(found: DataFrame, world: World, share: float) -> DataFrame:
    """As by_cell_coverage, with the hit items of cells against the region's different items: one in several cells counts for each."""
    if share <= 0:
        return leaves.cells(world, [])
    parents = world.cell_parents.select("cell_id", "region_id")
    hit = parents.join(hits.counted(found, world), "cell_id").groupBy("region_id").agg(F.sum("n").alias("hit"))
    return _cells_of_regions(world, hit.join(region_sizes(world), "region_id").filter(F.col("hit") > F.col("items") * share))


def inside(found: DataFrame, world: World) -> DataFrame:
    return by_item_coverage(found, world, INSIDE)


def exclusive(found: DataFrame, world: World, most: int, least: int = 0) -> DataFrame:
    """Hits in cells with least to most direct parents; most 0 hits nothing."""
    if most <= 0:
        return leaves.cells(world, [])
    counts = world.cells.select("cell_id").join(world.cell_parents.filter("direct").groupBy("cell_id").agg(F.count("*").alias("n")), "cell_id", "left")
    keep = counts.filter(F.coalesce("n", F.lit(0)).between(least, most))
    return found.join(keep, "cell_id", "left_semi")


class Element(NamedTuple):
    kind: Literal["item", "region"]
    id: int


def region_ranks(found: DataFrame, world: World) -> DataFrame:
    """region_id, cells, full, partial, the region that hits are most about first."""
    cells = hits.listed(found)
    met = world.cell_parents.select("cell_id", "region_id").join(cells, "cell_id").groupBy("region_id").agg(
        F.sum(F.col("full_match").cast("bigint")).alias("full"), F.sum((~F.col("full_match")).cast("bigint")).alias("partial")
    )
    ranked = met.join(region_sizes(world).select("region_id", "cells"), "region_id")
    return ranked.orderBy((F.col("full") / F.col("cells")).desc(), (F.col("partial") / F.col("cells")).desc(), F.desc("full"), F.desc("partial"), F.desc("cells"), "region_id")


def main_item(found: DataFrame, world: World) -> DataFrame:
    """One row: the item among item_id with the longest box diagonal; points only where there is nothing longer."""
    own = items.boxes(world).join(found.select("item_id").distinct(), "item_id", "left_semi")
    return own.withColumn("size", (F.col("max_lat") - F.col("min_lat")) ** 2 + (F.col("max_lon") - F.col("min_lon")) ** 2).orderBy(F.desc("size"), F.desc("item_id")).limit(1)


def dominant(found: DataFrame, world: World) -> Element | None:
    """The item or region that hits are about; the hits are written, and one row of each of two top-1 queries reaches the driver."""
    found = hits.kept(found)
    best = region_ranks(found, world).first()
    if best is None:
        return None
    if best["full"] < best["cells"] and best["full"] + best["partial"] < MOST_CELLS:
        few = hits.flatten(found, world).limit(MOST_ITEMS)
        if 0 < few.count() < MOST_ITEMS and (item := main_item(few, world).first()):
            return Element("item", item["item_id"])
    return Element("region", best["region_id"])


def relevant(found: DataFrame, world: World) -> DataFrame:
    """Hits cut down to the dominant element."""
    element = dominant(found, world)
    if element is None:
        return leaves.cells(world, [])
    return leaves.item(world, element.id) if element.kind == "item" else leaves.region(world, element.id)


# ---- areas beside and between elements; their few points are worked out on the driver

Direction = Literal["north", "east", "south", "west"]
ANGLES = {"north": 0.0, "east": 90.0, "south": 180.0, "west": 270.0}


def _outline(world: World, element: Element) -> list[Point]:
    """The points of a point or way, or a region's corners."""
    if (box := world.regions.filter(F.col("region_id") == element.id).first()) is not None:
        return Rect(box["min_lat"], box["max_lat"], box["min_lon"], box["max_lon"]).corners
    return [(r["lat"], r["lon"]) for r in world.points.filter(F.col("item_id") == element.id).orderBy("pos").collect()]  # the vertices of one item


def _is_region(world: World, element: Element) -> bool:
    return not world.regions.filter(F.col("region_id") == element.id).isEmpty()


def wedge(point: Point, length: float, direction: Direction) -> Polygon:
    """A triangle that opens by 45 degrees to each side."""
    angle, reach = ANGLES[direction], length * sqrt(2)
    return Polygon(tuple(clipped([point, destination(point, angle - 45, reach), destination(point, angle + 45, reach)])))


def depth_scale(diagonal: float) -> float:
    """How many times its own extent lies beside a box; fixed values."""
    return 10.0 if diagonal < 100 else 2 + 8 * (1000 - diagonal) / 1000 if diagonal < 1000 else 2.0


def beside(box: Rect, direction: Direction) -> Polygon:
    """A trapezoid, half as wide again to each side at its far end; north and east begin in the middle, south and west at the near edge."""
    scale, high, wide = depth_scale(box.diagonal), box.max_lat - box.min_lat, box.max_lon - box.min_lon
    lat, lon = box.centre
    if direction in ("north", "south"):
        near, far = (lat, lat + scale * high) if direction == "north" else (box.min_lat, box.min_lat - scale * high)
        points = [(near, box.min_lon), (near, box.max_lon), (far, box.max_lon + wide / 2), (far, box.min_lon - wide / 2)]
    else:
        near, far = (lon, lon + scale * wide) if direction == "east" else (box.min_lon, box.min_lon - scale * wide)
        points = [(box.min_lat, near), (box.max_lat, near), (box.max_lat + high / 2, far), (box.min_lat - high / 2, far)]
    return Polygon(tuple(clipped(points)))


def compass(found: DataFrame, world: World, direction: str) -> DataFrame:
    """What lies in a direction of the dominant element; an unknown direction hits nothing."""
    element = dominant(found, world) if direction in ANGLES else None
    if element is None:
        return leaves.cells(world, [])
    points = _outline(world, element)
    if element.kind == "region":
        area = leaves.area(world, beside(Rect.around(points), direction), "poly-cellbbox")
        return area.join(leaves.region(world, element.id), "cell_id", "left_anti")
    if _is_region(world, element):
        return leaves.area(world, beside(Rect.around(points), direction))
    if len(points) == 1:
        return leaves.area(world, wedge(points[0], 200.0, direction))
    sign, axis = (1 if direction in ("north", "east") else -1), (0 if direction in ("north", "south") else 1)
    begin = max((middle(a, b) for a, b in zip(points, points[1:])), key=lambda p: sign * p[axis])
    length = max(1000.0, sum(distance(a, b) for a, b in zip(points, points[1:])))
    return leaves.area(world, Polygon(tuple(hull([*points, *wedge(begin, length, direction).points]))))


def diamond(a: Point, b: Point) -> Polygon:
    """Between two points; a quarter of their distance wide to each side of the middle."""
    half, centre, angle = distance(a, b) / 4, middle(a, b), bearing(a, b)
    return Polygon(tuple(clipped([a, destination(centre, angle + 90, half), b, destination(centre, angle - 90, half)])))


def _across(box: Rect, sector: int) -> list[Point]:
    """The two places of a box that lie across a direction, given as an eighth of the circle from north."""
    lat, lon = box.centre
    return [
        [(lat, box.min_lon), (lat, box.max_lon)],
        [(box.max_lat, box.min_lon), (box.min_lat, box.max_lon)],
        [(box.max_lat, lon), (box.min_lat, lon)],
        [(box.max_lat, box.max_lon), (box.min_lat, box.min_lon)],
    ][sector % 4]


def _sector(a: Point, b: Point) -> int:
    return round(bearing(a, b) / 45) % 8


def between_boxes(a: Rect, b: Rect) -> Polygon:
    """From the places of one box that lie across the way to the other box, to the same places of that."""
    sector = _sector(a.centre, b.centre)
    near, far = _across(a, sector), _across(b, sector)
    return Polygon(tuple(clipped([near[0], far[0], far[1], near[1]])))


def box_to_point(box: Rect, point: Point) -> Polygon:
    """From a box to a point: over an edge the half of the box that faces it, over a corner the diagonal across."""
    sector = _sector(box.centre, point)
    one, other = _across(box, sector)
    if sector % 2:
        return Polygon(tuple(clipped([one, point, other])))
    edge = {0: (box.max_lat, None), 2: (None, box.max_lon), 4: (box.min_lat, None), 6: (None, box.min_lon)}[sector]
    front = [tuple(e if e is not None else x for e, x in zip(edge, p)) for p in (one, other)]
    return Polygon(tuple(clipped([one, front[0], point, front[1], other])))


def between_shapes(left: Rect | list[Point], right: Rect | list[Point]) -> Polygon:
    """Between two boxes, points (lists of one) or ways."""
    if isinstance(left, Rect) and isinstance(right, Rect):
        return between_boxes(left, right)
    if isinstance(right, Rect):
        left, right = right, left
    if isinstance(left, Rect):
        return box_to_point(left, right[0]) if len(right) == 1 else Polygon(tuple(hull([*left.corners, *right])))
    return diamond(left[0], right[0]) if len(left) == len(right) == 1 else Polygon(tuple(hull([*left, *right])))


def _shape(world: World, element: Element, boxed: bool) -> Rect | list[Point]:
    points = _outline(world, element)
    return Rect.around(points) if boxed or _is_region(world, element) else points


def between(one: DataFrame, other: DataFrame, world: World) -> DataFrame:
    """What lies between two dominant elements; boxes count where one is a region; between two regions, cells that are in neither."""
    a, b = dominant(one, world), dominant(other, world)
    if a is None or b is None or a == b:
        return leaves.cells(world, [])
    boxed = "region" in (a.kind, b.kind)
    shape = between_shapes(_shape(world, a, boxed), _shape(world, b, boxed))
    if a.kind == b.kind == "region":
        own = leaves.region(world, a.id).unionByName(leaves.region(world, b.id))
        return leaves.area(world, shape, "poly-cellbbox").join(own, "cell_id", "left_anti")
    return leaves.area(world, shape)
