"""Elementary queries: each gives hits."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.functions.geo import Point, Polygon, Rect, Shape, box_columns, distance, segment_meets_box
from terralex.operators import hits, items, places
from terralex.sources.world import World

Accuracy = Literal["auto", "poly-item", "poly-itembbox", "polybbox-item", "polybbox-itembbox", "poly-cell", "poly-cellbbox", "polybbox-cell", "polybbox-cellbbox"]
#: Sizes in metres from which the next coarser accuracy is chosen.
SIZES = (("poly-item", 1_000.0), ("poly-itembbox", 2_000.0), ("poly-cellbbox", 250_000.0), ("polybbox-cellbbox", float("inf")))
SHORT = 5_000.0  # fixed value, metres: length and radius below which a path is a corridor
LONG = 20  # a perimeter of so many diagonals counts by its length


def text(world: World, query: str, scope: Literal["all", "items", "regions"] = "all") -> DataFrame:
    """Items by tag value as partial hits, regions by tag value as their full cells. An empty query hits nothing."""
    found = items.with_value(world, query) if query.strip('"?') else world.items.select("item_id").limit(0)
    regions = world.regions.select(F.col("region_id").alias("item_id"))
    single = hits.of_pairs(world.cell_items.join(found.join(regions, "item_id", "left_anti"), "item_id", "left_semi"))
    whole = hits.of_cells(world.cell_parents.join(found.select(F.col("item_id").alias("region_id")), "region_id", "left_semi"))
    return {"items": single, "regions": whole}.get(scope) or hits.union(whole, single)


def item(world: World, item_id: int) -> DataFrame:
    """The item in each of its cells."""
    return hits.of_pairs(world.cell_items.filter(F.col("item_id") == item_id))


def region(world: World, region_id: int) -> DataFrame:
    return hits.of_cells(world.cell_parents.filter(F.col("region_id") == region_id))


def region_exclusive(world: World, region_id: int) -> DataFrame:
    """Cells of the region that none of its children has."""
    children = world.regions.filter(F.col("parent_id") == region_id).select("region_id")
    theirs = world.cell_parents.join(children, "region_id", "left_semi").select("cell_id")
    return region(world, region_id).join(theirs, "cell_id", "left_anti")


def cells(world: World, cell_ids: Iterable[int] | DataFrame) -> DataFrame:
    """Cells by id: a few, or a table of any size with a cell_id."""
    if not isinstance(cell_ids, DataFrame):
        return hits.of_cells(world.cells.filter(F.col("cell_id").isin(*cell_ids)))
    return hits.of_cells(world.cells.join(cell_ids.select("cell_id"), "cell_id", "left_semi"))


def cell_at(world: World, lat: float, lon: float) -> DataFrame:
    """The cell whose border holds a place (its box, where it has no border); a cell has its lower edges."""
    return hits.of_cells(places.cells_at(world, lat, lon))


def accuracy_for(shape: Shape) -> str:
    """By the size: the diagonal, or the length of an outline that is long against it."""
    diagonal, length = shape.box.diagonal, shape.length
    size = length / LONG if length > LONG * diagonal else diagonal
    return next(name for name, most in SIZES if size < most)


def met_cells(world: World, shape: Shape) -> DataFrame:
    """cell_id, inside: cells whose box the shape meets, and whether it encloses it.

    Of a stored world down the hierarchy: a region whose cells' boxes all lie in the shape gives them without a test, of a region
    that the shape meets otherwise the direct cells are tested, and cells of others aren't read. Regions and their cells are found by ranges of the curve."""
    box = box_columns()
    tested = lambda name: world.near(name, shape).filter(F.expr(shape.meets_box(box))).select("cell_id", F.expr(shape.encloses_box(box)).alias("inside"))
    if world.region_cells is None:
        return tested("cell_boxes")
    covers = world.near("region_covers", shape).filter(F.expr(shape.meets_box(box))).select("region_id", F.expr(shape.encloses_box(box)).alias("enclosed"))
    own = world.near("region_cells", shape).join(covers, "region_id").filter("enclosed OR direct")
    own = own.filter(F.expr(f"enclosed OR {shape.meets_box(box)}")).select("cell_id", F.expr(f"enclosed OR {shape.encloses_box(box)}").alias("inside"))
    return own.unionByName(tested("stray_cells")).groupBy("cell_id").agg(F.bool_or("inside").alias("inside"))


def area(world: World, shape: Shape, accuracy: Accuracy = "auto") -> DataFrame:
    """What lies in a polygon or rectangle.

    Down to cells: full hits of all cells whose box the shape (or its box) meets. Down to items: a cell that the
    shape encloses is full; of others that it meets the items are tested by shape or box, and a cell of
    which all are hit (also one without items) is full."""
    if accuracy not in ("poly-item", "poly-itembbox", "polybbox-item", "polybbox-itembbox", "poly-cell", "poly-cellbbox", "polybbox-cell", "polybbox-cellbbox"):
        accuracy = accuracy_for(shape)
    own = shape.box if accuracy.startswith("polybbox") else shape
    marked = met_cells(world, own)
    if "cell" in accuracy:
        return hits.of_cells(marked)
    inside, edge = marked.filter("inside").select("cell_id"), marked.filter("NOT inside").select("cell_id")
    found = items.meeting(world, own, exact="bbox" not in accuracy.partition("-")[2])
    there = world.cell_items.join(edge, "cell_id", "left_semi").select("cell_id", "item_id")
    hit = there.join(found, "item_id", "left_semi").select("cell_id", "item_id")
    missed = there.join(found, "item_id", "left_anti").select("cell_id").distinct()
    whole = inside.unionByName(edge.join(missed, "cell_id", "left_anti"))
    return hits.of_cells(whole).unionByName(hit.join(missed, "cell_id", "left_semi"))


def rect(world: World, min_lat: float, max_lat: float, min_lon: float, max_lon: float, accuracy: Accuracy = "auto") -> DataFrame:
    return area(world, Rect(min_lat, max_lat, min_lon, max_lon), accuracy)


def polygon(world: World, points: Iterable[Point], accuracy: Accuracy = "auto") -> DataFrame:
    """Closed by itself; fewer than three points hit nothing."""
    points = tuple(points)
    if points and points[0] == points[-1]:
        points = points[:-1]
    return area(world, Polygon(points), accuracy) if len(points) > 2 else cells(world, []).limit(0)


def point(world: World, lat: float, lon: float, radius: float = 0.0, accuracy: Accuracy = "auto") -> DataFrame:
    """With a radius the square around; else the polygons of the place's cell that hold the place."""
    if radius > 0:
        return area(world, Rect.square((lat, lon), radius), accuracy)
    holds = items.holding(world, (lat, lon))
    return hits.of_pairs(world.cell_items.join(hits.cells_of(cell_at(world, lat, lon)), "cell_id", "left_semi").join(holds, "item_id", "left_semi"))


def crossed(world: World, points: list[Point]) -> DataFrame:
    """Full cells that a line meets."""
    literal = lambda p: (f"CAST({p[0]!r} AS DOUBLE)", f"CAST({p[1]!r} AS DOUBLE)")
    tests = [segment_meets_box(literal(a), literal(b), box_columns()) for a, b in zip(points, points[1:])]
    return hits.of_cells(world.near("cell_boxes", Rect.around(points)).filter(F.expr(" OR ".join(tests))))


def path(world: World, points: list[Point], radius: float = 0.0) -> DataFrame:
    """Along a line: one point is a place. A short line of three points or more (it and the radius below SHORT) has the cells whose borders come within
    radius metres of it; any other the cells that it meets, and those within radius metres of these."""
    from terralex.operators.distance import dilate

    points = [(float(a), float(b)) for a, b in points]
    if not points:
        return cells(world, []).limit(0)
    if len(points) == 1:
        return point(world, *points[0], radius)
    if len(points) > 2 and 0 < radius < SHORT and sum(distance(a, b) for a, b in zip(points, points[1:])) < SHORT:
        return hits.of_cells(places.corridor(world, points, radius))
    found = crossed(world, points)
    return dilate(found, world, radius) if radius > 0 else found


#: From a point to a point: hits. Flags are the router's own.
Router = Callable[[World, Point, Point, int, float], DataFrame]


def straight(world: World, begin: Point, end: Point, flags: int = 0, radius: float = 0.0) -> DataFrame:
    return path(world, [begin, end], radius)


def no_route(world: World, begin: Point, end: Point, flags: int = 0, radius: float = 0.0) -> DataFrame:
    return cells(world, []).limit(0)


def from_cells(find: Callable[[Point, Point, int, float], Iterable[int] | DataFrame]) -> Router:
    """A router that gives a list or a table of cells."""
    return lambda world, begin, end, flags=0, radius=0.0: cells(world, find(begin, end, flags, radius))


def route(world: World, points: list[Point], router: Router = straight, flags: int = 0, radius: float = 0.0) -> DataFrame:
    """The union of the legs between consecutive points; fewer than two points hit nothing."""
    legs = [router(world, a, b, flags, radius) for a, b in zip(points, points[1:])]
    if not legs:
        return cells(world, []).limit(0)
    out = legs[0]
    for leg in legs[1:]:
        out = out.unionByName(leg)
    full = hits.of_cells(hits.full_cells(out))
    return hits.union(full, hits.partial(out))
