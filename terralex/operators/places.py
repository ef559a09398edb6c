"""Where places lie: the cells whose borders hold them, and the cells near a line.

A border is an array of vertices in the row of its cell. Many places at once meet the borders in an equi-join over squares of the curve's levels: a
border lies in at most four squares of its own level, and a place is in one square of each level that borders have. Then rays tell which
borders hold it. Like a box, a border has its lower and left edges, so in a gapless net a place has one cell.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import cos, radians

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.functions.curve import DEPTH, LEVELS, with_place
from terralex.functions.geo import EARTH, Point, Rect, box_columns
from terralex.sources.world import World


def holds(lat: str, lon: str, ring: str = "ring") -> str:
    """An expression: the ring holds the place, both given as expressions. An edge is taken from its lower end, so that both cells beside it round alike."""
    a, b = f"{ring}[i]", f"{ring}[(i + 1) % size({ring})]"
    west = lambda low, high: f"({high}.lon - {low}.lon) * ({lat} - {low}.lat) - ({high}.lat - {low}.lat) * ({lon} - {low}.lon) > 0"
    crossed = f"({a}.lat <= {lat}) <> ({b}.lat <= {lat}) AND IF({a}.lat < {b}.lat, {west(a, b)}, {west(b, a)})"
    return f"(aggregate(sequence(0, size({ring}) - 1), 0, (n, i) -> n + IF({crossed}, 1, 0)) % 2 = 1)"


def cells_at(world: World, lat: float, lon: float) -> DataFrame:
    """cell_id of the cells whose border holds one place."""
    spot = Rect(lat, lat, lon, lon)
    found = world.near("cell_rings", spot).filter(F.expr(spot.meets_box(box_columns())))
    return found.filter(F.expr(holds(f"CAST({float(lat)!r} AS DOUBLE)", f"CAST({float(lon)!r} AS DOUBLE)"))).select("cell_id")


def _morton(y: str, x: str) -> str:
    return f"(2 * CAST(CONV(BIN({y}), 4, 10) AS BIGINT) + CAST(CONV(BIN({x}), 4, 10) AS BIGINT))"


def _held(spots: DataFrame, rings: DataFrame, levels: Iterable[int], *same: str) -> DataFrame:
    """Pairs of spots (_lat, _lon) and rings (ring, box, place) that hold them, with equal values of the columns in same. Both have no other common columns."""
    # a spot is a box without extent, so it is on the finest level; its square on a coarser one has fewer digits
    spots = with_place(spots, ("_lat", "_lat", "_lon", "_lon"), "_place").withColumn("_level", F.explode(F.array(*map(F.lit, sorted(levels)))))
    finest = (1 << 2 * DEPTH) - 1
    square = F.expr(f"(CAST(_level AS BIGINT) << {2 * DEPTH}) + ((_place & {finest}) >> (2 * ({DEPTH} - _level)))")
    spots = spots.withColumn("_square", square).drop("_place", "_level")
    cells = rings.withColumn("_level", F.shiftright("place", 2 * DEPTH).cast("int"))
    step = lambda c, low, width: f"CAST(LEAST((1 << {DEPTH}) - 1, GREATEST(0, FLOOR(({c} - ({low}D)) / {width}D * {1 << DEPTH}))) AS BIGINT) >> ({DEPTH} - _level)"
    rows = F.expr(f"sequence({step('min_lat', -90, 180)}, {step('max_lat', -90, 180)})")
    columns = F.expr(f"sequence({step('min_lon', -180, 360)}, {step('max_lon', -180, 360)})")  # two of each at most
    cells = cells.withColumn("_y", F.explode(rows)).withColumn("_x", F.explode(columns)).withColumn("_square", F.expr(f"(CAST(_level AS BIGINT) << {2 * DEPTH}) + {_morton('_y', '_x')}"))
    pairs = spots.join(cells.drop("_y", "_x", "_level", "place"), ["_square", *same])
    return pairs.filter("_lat BETWEEN min_lat AND max_lat AND _lon BETWEEN min_lon AND max_lon").filter(F.expr(holds("_lat", "_lon"))).drop("_square")


def locate(world: World, places: DataFrame) -> DataFrame:
    """places (lat, lon and other columns, but for cell_id) with the cell_id of each cell whose border holds them; places in no cell have no row.

    The levels that borders have, a dozen at most, are asked for while the plan is composed."""
    rings = world.table("cell_rings")
    levels = [r[0] for r in rings.select(F.shiftright("place", 2 * DEPTH).alias("level")).filter("level IS NOT NULL").distinct().collect()]
    if not levels:
        return places.withColumn("cell_id", F.lit(None).cast("bigint")).limit(0)
    spots = places.withColumn("_spot", F.struct(*places.columns)).select("_spot", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return _held(spots, rings.select("cell_id", "ring", "place", *box_columns()), levels).select("_spot.*", "cell_id")


def nested_rings(vertices: DataFrame) -> DataFrame:
    """vertices (item_id, ring, pos, lat, lon) -> item_id, ring, within: of a hole the ring that it is cut from, of an outer ring itself.

    A ring in an odd number of others of its item is a hole of the innermost one, by its first vertex (a ring that touches another there counts by the side that borders have)."""
    several = vertices.groupBy("item_id").agg(F.countDistinct("ring").alias("n")).filter("n > 1").select("item_id")
    own = vertices.join(several, "item_id", "left_semi").withColumnRenamed("ring", "number")
    ring = F.transform(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    around = [F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon")]
    rings = with_place(own.groupBy("item_id", "number").agg(ring.alias("ring"), *around))
    spots = rings.select("item_id", F.col("number").alias("_of"), F.col("ring")[0]["lat"].alias("_lat"), F.col("ring")[0]["lon"].alias("_lon"))
    pairs = _held(spots, rings, LEVELS, "item_id").filter("_of <> number").select("item_id", F.col("_of").alias("ring"), F.col("number").alias("other"))
    depth = pairs.groupBy("item_id", "ring").agg(F.count("*").alias("depth"))
    inner = pairs.join(depth.withColumnRenamed("ring", "other"), ["item_id", "other"], "left").groupBy("item_id", "ring").agg(
        F.count("*").alias("depth"), F.max_by("other", F.struct(F.coalesce("depth", F.lit(0)), F.col("other"))).alias("innermost")
    )
    all_rings = vertices.select("item_id", "ring").distinct()
    return all_rings.join(inner, ["item_id", "ring"], "left").select("item_id", "ring", F.when(F.col("depth") % 2 == 1, F.col("innermost")).otherwise(F.col("ring")).alias("within"))


# ---- cells near a line


def _apart(p: str, a: str, b: str) -> str:
    """The square of the distance of a point from a segment; points are structs x, y."""
    dx, dy = f"({b}.x - {a}.x)", f"({b}.y - {a}.y)"
    length = f"({dx} * {dx} + {dy} * {dy})"
    t = f"IF({length} = 0, 0D, LEAST(1D, GREATEST(0D, (({p}.x - {a}.x) * {dx} + ({p}.y - {a}.y) * {dy}) / {length})))"
    return f"(POWER({p}.x - {a}.x - {t} * {dx}, 2) + POWER({p}.y - {a}.y - {t} * {dy}, 2))"


def _side(a: str, b: str, p: str) -> str:
    return f"(({b}.x - {a}.x) * ({p}.y - {a}.y) - ({b}.y - {a}.y) * ({p}.x - {a}.x))"


def corridor(world: World, points: list[Point], radius: float) -> DataFrame:
    """cell_id of the cells whose border comes within radius metres of a short line, or holds it. Metres are those of the plane at the line's middle latitude."""
    around = Rect.around(points).grown(radius)
    lat0, lon0 = around.centre
    high, wide = radians(1) * EARTH, radians(1) * EARTH * cos(radians(lat0))
    number = lambda x: f"CAST({x!r} AS DOUBLE)"
    flat = lambda p: f"named_struct('x', {number((p[1] - lon0) * wide)}, 'y', {number((p[0] - lat0) * high)})"
    legs = f"array({', '.join(f'named_struct({chr(39)}a{chr(39)}, {flat(p)}, {chr(39)}b{chr(39)}, {flat(q)})' for p, q in zip(points, points[1:]))})"
    edges = f"transform(sequence(0, size(ring) - 1), i -> named_struct('a', flat[i], 'b', flat[(i + 1) % size(ring)]))"  # noqa: F541
    crossing = f"({_side('l.a', 'l.b', 'e.a')} * {_side('l.a', 'l.b', 'e.b')} < 0 AND {_side('e.a', 'e.b', 'l.a')} * {_side('e.a', 'e.b', 'l.b')} < 0)"
    close = " OR ".join(f"{_apart(p, f'{s}.a', f'{s}.b')} <= {number(float(radius) ** 2)}" for p, s in (("e.a", "l"), ("e.b", "l"), ("l.a", "e"), ("l.b", "e")))
    rings = world.near("cell_rings", around).filter(F.expr(around.meets_box(box_columns())))
    rings = rings.withColumn("flat", F.expr(f"transform(ring, v -> named_struct('x', (v.lon - {number(lon0)}) * {number(wide)}, 'y', (v.lat - {number(lat0)}) * {number(high)}))"))
    first = points[0]
    met = f"{holds(number(float(first[0])), number(float(first[1])))} OR exists({legs}, l -> exists({edges}, e -> {crossing} OR {close}))"
    return rings.filter(F.expr(met)).select("cell_id")
