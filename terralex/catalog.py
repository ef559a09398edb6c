"""The named queries over the driver's tables, and for most the same question in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex.functions.geo import Rect
from terralex.functions.text import matches, packed_id, packed_kind, packed_number
from terralex.operators import coverage, distance, hits, items, leaves, places, stats, tree
from terralex.sources import fixtures
from terralex.sources.scratch import new_path
from terralex.sources.world import World, validate

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, without: tuple[str, ...] = ()):
    """Registers a function of a world under its name; sql names the fixture views. without: tables that the world shall not have."""

    def register(f: Callable[[World], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(fixtures.world(spark, sf_dir, without))
        if sql:
            _SQL[f.__name__] = fixtures.with_views(sql)
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Hits as one row per cell and item; a full cell has -1.
def _shown(found: DataFrame) -> DataFrame:
    return found.select("cell_id", F.coalesce("item_id", F.lit(-1).cast("bigint")).alias("item_id"))


#: Items with BUILDING in a value, as pairs of cell and item, and cells of regions by name.
BUILDING = "SELECT cell_id, item_id FROM fx_cell_item WHERE item_id IN (SELECT item_id FROM fx_tag WHERE contains(lower(v), 'building'))"
AUTO = BUILDING.replace("building", "automobile")
FULL = "SELECT cell_id, CAST(-1 AS BIGINT) AS item_id FROM"
REGION7 = "SELECT cell_id FROM fx_cell_parent WHERE region_id = 7"


# ---- convex shapes in SQL, told by the sides of their edges (the queries cast rays instead)


def _sides(points: list[tuple[float, float]], lat: str, lon: str) -> list[str]:
    """One expression per edge, 0 or more where the place is on the inner side."""
    area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(points, points[1:] + points[:1]))
    ring = points if area > 0 else points[::-1]
    number = lambda x: f"CAST({x} AS DOUBLE)"
    return [f"({number(b[0] - a[0])}*({lon}-{number(a[1])})-{number(b[1] - a[1])}*({lat}-{number(a[0])}))" for a, b in zip(ring, ring[1:] + ring[:1])]


def _corner_sides(points: list[tuple[float, float]]) -> list[list[str]]:
    corners = [_sides(points, lat, lon) for lat in ("min_lat", "max_lat") for lon in ("min_lon", "max_lon")]
    return [list(edge) for edge in zip(*corners)]


def _convex_meets_box(points: list[tuple[float, float]]) -> str:
    """No axis parts them: neither latitude, longitude, nor an edge's normal."""
    lats, lons = zip(*points)
    tests = [f"min_lat<={max(lats)} AND max_lat>={min(lats)} AND min_lon<={max(lons)} AND max_lon>={min(lons)}"]
    return " AND ".join(tests + [f"greatest({','.join(edge)})>=0" for edge in _corner_sides(points)])


def _convex_holds_box(points: list[tuple[float, float]]) -> str:
    return " AND ".join(f"least({','.join(edge)})>=0" for edge in _corner_sides(points))


def _convex_meets_segment(n: int) -> str:
    """Sides p0.. of the begin and q0.. of the end: what is left of the segment after each edge cut it."""
    enters = ",".join(f"CASE WHEN p{k}<0 THEN p{k}/(p{k}-q{k}) ELSE 0 END" for k in range(n))
    leaves_ = ",".join(f"CASE WHEN q{k}<0 THEN p{k}/(p{k}-q{k}) ELSE 1 END" for k in range(n))
    return " AND ".join(f"NOT (p{k}<0 AND q{k}<0)" for k in range(n)) + f" AND greatest({enters})<=least({leaves_})"


def _line_cells(points: list[tuple[float, float]]) -> str:
    """Cells that a line meets; of each leg the part within the cell's latitudes and longitudes is compared."""
    legs = []
    for (lat1, lon1), (lat2, lon2) in zip(points, points[1:]):
        at = lambda c, v, d: f"({c}-CAST({v} AS DOUBLE))/CAST({d} AS DOUBLE)"
        ends = [(at(f"min_{c}", v, w - v), at(f"max_{c}", v, w - v)) for c, v, w in (("lat", lat1, lat2), ("lon", lon1, lon2))]
        first, last = [f"least({a},{b})" for a, b in ends], [f"greatest({a},{b})" for a, b in ends]
        legs.append(f"SELECT cell_id FROM fx_cell WHERE greatest(0,{','.join(first)})<=least(1,{','.join(last)})")
    return " UNION ".join(legs)


GAP = "2*6371000*asin(least(1, sqrt(power(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*power(sin(radians(b.lon-a.lon)/2),2))))"
CENTRES = "SELECT cell_id, (min_lat+max_lat)/2 AS lat, (min_lon+max_lon)/2 AS lon FROM fx_cell"


def _metres(lat: str, lon: str) -> str:
    return f"2*6371000*asin(least(1, sqrt(power(sin(radians(lat-{lat})/2),2)+cos(radians(lat))*cos(radians({lat}))*power(sin(radians(lon-{lon})/2),2))))"


def _discs(lat: str, lon: str) -> str:
    """Discs of cells around a centre, given by the corners a, b, c of a cell's border."""
    reach = ", ".join(_metres(f"{p}lat", f"{p}lon") for p in "abc")
    corners = ", ".join(f"{e} AS {p}{c}" for p, pair in zip("abc", fixtures.BORDER) for c, e in zip(("lat", "lon"), pair))
    sides = ", ".join(f"power({p}lat-{q}lat,2)+power({p}lon-{q}lon,2) AS {p}{q}" for p, q in ("ab", "bc", "ca"))
    return f"SELECT *, greatest({reach}) AS r, least({reach}) AS inside FROM (SELECT *, {lat} AS lat, {lon} AS lon FROM (SELECT *, {sides} FROM (SELECT cell_id, {corners} FROM fx_cell) k) s) m"


TWICE = "2*(alat*(blon-clon)+blat*(clon-alon)+clat*(alon-blon))"
SQUARES = [f"({p}lat*{p}lat+{p}lon*{p}lon)" for p in "abc"]
AROUND = (f"({SQUARES[0]}*(blon-clon)+{SQUARES[1]}*(clon-alon)+{SQUARES[2]}*(alon-blon))/({TWICE})", f"({SQUARES[0]}*(clat-blat)+{SQUARES[1]}*(alat-clat)+{SQUARES[2]}*(blat-alat))/({TWICE})")
DISCS = _discs("(alat+blat+clat)/3", "(alon+blon+clon)/3")
ANNULI = _discs(*AROUND)
SMALLEST = _discs(*(f"CASE WHEN ab>=bc+ca THEN (a{c}+b{c})/2 WHEN bc>=ab+ca THEN (b{c}+c{c})/2 WHEN ca>=ab+bc THEN (c{c}+a{c})/2 ELSE {e} END" for c, e in zip(("lat", "lon"), AROUND)))

#: Sides of a region's ring, 0 or more where a place is on the inner side; and that the ring holds a place.
EDGES = list(zip(fixtures.RING, fixtures.RING[1:] + fixtures.RING[:1]))


def _ring_sides(lat: str, lon: str) -> list[str]:
    return [f"(({b[0]}-({a[0]}))*({lon}-({a[1]}))-({b[1]}-({a[1]}))*({lat}-({a[0]})))" for a, b in EDGES]


def _ring_holds(lat: str, lon: str) -> str:
    return f"least({','.join(_ring_sides(lat, lon))})>=0"


def _ring_meets(points: list[tuple[float, float]]) -> str:
    """No edge of the ring or of the polygon parts them."""
    corners = [_sides(points, lat, lon) for lat, lon in ((f"({a})", f"({o})") for a, o in fixtures.RING)]
    theirs = [_ring_sides(f"CAST({lat} AS DOUBLE)", f"CAST({lon} AS DOUBLE)") for lat, lon in points]
    return " AND ".join(f"greatest({','.join(edge)})>=0" for edge in [*zip(*corners), *zip(*theirs)])


TRIANGLE = [(-12.0, -12.0), (8.0, -3.0), (-2.0, 11.0)]
LINE = [(-20.0, -20.0), (3.0, 4.0), (12.0, -8.0)]


# ---- the store


@query("SELECT item_id, osm_type, is_region, shape, score FROM fx_item")
def scan_items(w):
    return w.items


@query("SELECT item_id, osm_type, shape, score FROM fx_item WHERE item_id IN (7, 31, 1000000001)")
def item_lookup(w):
    return items.lookup(w, 7, 31, 1000000001, 999999999999).select("item_id", "osm_type", "shape", "score")


@query("SELECT item_id, string_agg(k || '=' || v, ', ' ORDER BY k || '=' || v) AS tags FROM fx_tag GROUP BY item_id")
def tags_concat(w):
    return items.all_tags(w)


@query("SELECT MIN(min_lat) AS min_lat, MAX(max_lat) AS max_lat, MIN(min_lon) AS min_lon, MAX(max_lon) AS max_lon FROM fx_box")
def store_bbox(w):
    return items.boundary(w)


@query("""
    SELECT COUNT(*) AS items, COUNT(*) FILTER (is_region) AS regions, COUNT(*) FILTER (shape='POINT') AS points, COUNT(*) FILTER (shape='WAY') AS ways, COUNT(*) FILTER (shape='POLYGON') AS polygons,
           (SELECT COUNT(*) FROM fx_tag) AS tags, (SELECT CAST(SUM(strlen(k)+strlen(v)) AS BIGINT) FROM fx_tag) AS tag_bytes, (SELECT COUNT(*) FROM fx_point) AS vertices FROM fx_item""")
def store_stats(w):
    return items.store_stats(w)


@query("SELECT COUNT(*) AS rules, CAST(0 AS BIGINT) AS broken FROM range(13)")
def validate_counts(w):
    return validate(w).agg(F.count("*").alias("rules"), F.sum("violations").alias("broken"))


@query("SELECT item_id, item_id*4+osm_type AS packed, item_id AS number, osm_type AS kind FROM fx_item")
def osm_id_pack(w):
    packed = w.items.select("item_id", packed_id(F.col("item_id"), F.col("osm_type")).alias("packed"))
    return packed.select("item_id", "packed", packed_number(F.col("packed")).alias("number"), packed_kind(F.col("packed")).alias("kind"))


@query("""
    SELECT item_id, CASE WHEN count(*) = 1 THEN 'POINT (' ELSE 'LINESTRING (' END || string_agg(printf('%.3f', lon) || ' ' || printf('%.3f', lat), ', ' ORDER BY pos) || ')' AS wkt FROM fx_point GROUP BY item_id
    UNION ALL SELECT o.item_id, 'POLYGON ((' || string_agg(printf('%.3f', o.lon) || ' ' || printf('%.3f', o.lat), ', ' ORDER BY o.pos) || ', ' || any_value(printf('%.3f', f.lon) || ' ' || printf('%.3f', f.lat)) || '))' FROM fx_outline o JOIN (SELECT * FROM fx_outline WHERE pos = 0) f ON o.item_id = f.item_id GROUP BY o.item_id""")
def geometry_text(w):
    return items.geometry_text(w)


@query("SELECT CAST(0 AS BIGINT) AS broken_tags")
def tag_sanity(w):
    return items.broken_tags(w).agg(F.count("*").alias("broken_tags"))


@query("SELECT DISTINCT k AS path, CAST(NULL AS VARCHAR) AS parent_path, k AS name FROM fx_tag UNION ALL SELECT DISTINCT k || ':' || v, k, v FROM fx_tag")
def tag_tree(w):
    return items.tag_nodes(w)


# ---- items


def _in_rect(a: int, b: int, c: int, d: int) -> str:
    return f"SELECT item_id FROM fx_box WHERE min_lat<={b} AND max_lat>={a} AND min_lon<={d} AND max_lon>={c}"


@query(_in_rect(-20, -10, -20, -5))
def item_boxes_in_rect(w):
    return items.meeting(w, Rect(-20, -10, -20, -5), exact=False)


@query("SELECT item_id FROM fx_point WHERE lat BETWEEN -20 AND -10 AND lon BETWEEN -20 AND -5 AND item_id < 1000000000 AND item_id IN (SELECT item_id FROM fx_tag WHERE k='balance' AND v='negative')")
def rect_filter_partner(w):
    return items.in_rect(w, Rect(-20, -10, -20, -5), items.with_tag(w, "balance", "negative"))


@query("SELECT DISTINCT item_id FROM fx_tag WHERE starts_with(lower(v), 'nation_1')")
def tag_value_prefix(w):
    return items.with_value(w, "NATION_1?")


@query("SELECT DISTINCT item_id FROM fx_tag WHERE suffix(lower(v), '00001')")
def tag_value_suffix(w):
    return items.with_value(w, "?00001")


@query("SELECT DISTINCT item_id FROM fx_tag WHERE contains(lower(v), 'hold')")
def tag_value_contains(w):
    return items.with_value(w, "hold")


@query("SELECT DISTINCT item_id FROM fx_tag WHERE lower(v) = 'machinery'")
def tag_value_exact(w):
    return items.with_value(w, '"MACHINERY"')


@query("SELECT DISTINCT item_id FROM fx_tag WHERE k IN ('amenity', 'balance')")
def key_select(w):
    return items.with_key(w, ["amenity", "balance"])


@query("""SELECT item_id FROM fx_tag WHERE k='mktsegment' AND v='BUILDING' AND item_id NOT IN (SELECT item_id FROM fx_tag WHERE k='balance' AND v='negative') ORDER BY item_id LIMIT 25""")
def item_intersect_diff_limit(w):
    return items.complete([items.with_tag(w, "mktsegment", "BUILDING")], [items.with_tag(w, "balance", "negative")], limit=25)


@query(f"SELECT item_id FROM ({_in_rect(-20, 0, -20, 0)}) t WHERE item_id IN (SELECT item_id FROM fx_tag WHERE k='mktsegment') ORDER BY item_id LIMIT 50")
def item_geo_limit(w):
    return items.complete([items.meeting(w, Rect(-20, 0, -20, 0), exact=False), items.with_key(w, ["mktsegment"])], limit=50)


@query("SELECT DISTINCT item_id FROM fx_tag WHERE (k='mktsegment' AND v='BUILDING') OR k='amenity'")
def tag_node_items(w):
    return items.of_tag_nodes(w, ("mktsegment", "BUILDING"), ("amenity",))


@query("SELECT DISTINCT k AS path, k AS ancestors, 1 AS depth FROM fx_tag UNION ALL SELECT DISTINCT k || ':' || v, k || ',' || v, 2 FROM fx_tag")
def tag_ancestors(w):
    return items.ancestors(items.tag_nodes(w))


@query("SELECT DISTINCT item_id FROM fx_tag WHERE (k='mktsegment' AND lower(v)='building') OR (k='balance' AND lower(v)='negative')")
def tag_phrase(w):
    return items.of_phrases(w, "Building", "negative")


@query("SELECT item_id FROM fx_tag WHERE contains(lower(v), 'building') UNION SELECT t.item_id FROM fx_tag t JOIN fx_phrase p ON t.k=p.k AND t.v=p.v WHERE p.phrase='building'")
def item_search(w):
    return items.search(w, "Building")


@query("SELECT * FROM fx_item WHERE item_id IN (SELECT item_id FROM fx_tag WHERE k='amenity')")
def items_of_ids(w):
    return items.of_ids(w, items.with_key(w, ["amenity"]))


@query("""
    WITH n AS (SELECT DISTINCT k AS path, TRUE AS root FROM fx_tag UNION SELECT DISTINCT k || ':' || v, FALSE FROM fx_tag)
    SELECT (SELECT COUNT(*) FROM n) AS nodes, (SELECT COUNT(*) FROM n WHERE root) AS roots, (SELECT COUNT(DISTINCT phrase) FROM fx_phrase) AS phrases, (SELECT COUNT(*) FROM (SELECT DISTINCT k, v FROM fx_phrase) p) AS mapped""")
def tag_stats(w):
    return items.tag_stats(w)


@query("""
    SELECT 'items' AS name, COUNT(*) AS n FROM fx_item UNION ALL SELECT 'points', COUNT(*) FROM fx_point UNION ALL SELECT 'outlines', COUNT(*) FROM fx_outline UNION ALL SELECT 'item_boxes', COUNT(*) FROM fx_box
    UNION ALL SELECT 'tag_values', COUNT(DISTINCT v) FROM fx_tag UNION ALL SELECT 'postings', COUNT(*) FROM (SELECT DISTINCT v, item_id FROM fx_tag) t UNION ALL SELECT 'region_sizes', COUNT(DISTINCT region_id) FROM fx_cell_parent""")
def world_written(w):
    """A world written to a folder and loaded from it, with the tables that follow from others."""
    folder = new_path(w.spark, "world")
    w.write(folder)
    again, out = World.load(w.spark, folder), None
    for name in ("items", "points", "outlines", "item_boxes", "tag_values", "postings", "region_sizes"):
        own = getattr(again, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = own if out is None else out.unionByName(own)
    return out


# ---- elementary queries


@query("SELECT cell_id, item_id FROM fx_cell_item WHERE item_id = 31")
def leaf_item(w):
    return _shown(leaves.item(w, 31))


@query(f"{FULL} ({REGION7}) t")
def leaf_region(w):
    return _shown(leaves.region(w, 7))


@query(f"{FULL} fx_cell_parent WHERE region_id = 7 AND cell_id NOT IN (SELECT cell_id FROM fx_cell_parent WHERE region_id IN (SELECT region_id FROM fx_region WHERE parent_id = 7))")
def leaf_region_exclusive(w):
    return _shown(leaves.region_exclusive(w, 7))


@query(f"{FULL} fx_cell WHERE cell_id IN (3, 17, 399)")
def leaf_cells(w):
    return _shown(leaves.cells(w, [3, 17, 399, 4000]))


@query(f"{FULL} fx_cell WHERE min_lat <= 1.5 AND 1.5 < max_lat AND min_lon <= -7.25 AND -7.25 < max_lon", without=("borders",))
def leaf_cell(w):
    """Of a world whose cells are their boxes."""
    return _shown(leaves.cell_at(w, 1.5, -7.25))


#: Corners of a cell's triangle: a lies lowest, b highest.
CORNERS = ", ".join(f"{e} AS {p}{c}" for p, pair in zip("abc", fixtures.BORDER) for c, e in zip(("lat", "lon"), pair))


def _in_triangle(lat: str, lon: str) -> str:
    """On each edge's inner side; what lies on an edge is in it if the triangle is to the right of it."""
    side = lambda p, q, lat, lon: f"(({q}lon-{p}lon)*({lat}-{p}lat)-({q}lat-{p}lat)*({lon}-{p}lon))"
    return " AND ".join(f"({side(p, q, lat, lon)}>0)=({side(p, q, f'{r}lat', f'{r}lon')}>0)" for p, q, r in ("abc", "acb", "cba"))


@query(f"WITH t AS (SELECT cell_id, {CORNERS} FROM fx_cell) {FULL} t WHERE {_in_triangle('1.5', '-6.0')}")
def leaf_cell_border(w):
    return _shown(leaves.cell_at(w, 1.5, -6.0))


@query(f"""
    WITH t AS (SELECT cell_id, {CORNERS}, min_lat, max_lat, min_lon, max_lon FROM fx_cell)
    SELECT item_id, pos, cell_id FROM fx_point p JOIN t ON p.lat BETWEEN min_lat AND max_lat AND p.lon BETWEEN min_lon AND max_lon AND {_in_triangle('p.lat', 'p.lon')}""")
def point_cells(w):
    """The cells of all vertices of points and ways."""
    return places.locate(w, w.points.select("item_id", "pos", "lat", "lon")).select("item_id", "pos", "cell_id")


@query(f"""
    WITH f AS (SELECT cell_id FROM fx_cell_parent WHERE region_id IN (SELECT item_id FROM fx_tag WHERE contains(lower(v), 'nation_1'))),
    p AS (SELECT cell_id, item_id FROM fx_cell_item WHERE item_id IN (SELECT item_id FROM fx_tag WHERE contains(lower(v), 'nation_1')) AND item_id NOT IN (SELECT region_id FROM fx_region))
    SELECT DISTINCT cell_id, CAST(-1 AS BIGINT) AS item_id FROM f UNION ALL SELECT cell_id, item_id FROM p WHERE cell_id NOT IN (SELECT cell_id FROM f)""")
def leaf_text(w):
    return _shown(leaves.text(w, "nation_1"))


@query(BUILDING)
def leaf_text_items(w):
    return _shown(leaves.text(w, "building", "items"))


@query(f"SELECT DISTINCT cell_id, CAST(-1 AS BIGINT) AS item_id FROM fx_cell_parent WHERE region_id IN (SELECT item_id FROM fx_tag WHERE lower(v) = 'nation_3')")
def leaf_text_regions(w):
    return _shown(leaves.text(w, '"nation_3"', "regions"))


@query(f"{FULL} fx_cell WHERE min_lat<=3 AND max_lat>=-4 AND min_lon<=9 AND max_lon>=-6")
def leaf_rect(w):
    return _shown(leaves.rect(w, -4, 3, -6, 9))


@query("""
    WITH c AS (SELECT *, min_lat>=-4 AND max_lat<=3 AND min_lon>=-6 AND max_lon<=9 AS whole FROM fx_cell WHERE min_lat<=3 AND max_lat>=-4 AND min_lon<=9 AND max_lon>=-6),
    i AS (SELECT c.cell_id, x.item_id, b.min_lat<=3 AND b.max_lat>=-4 AND b.min_lon<=9 AND b.max_lon>=-6 AS hit FROM c JOIN fx_cell_item x ON c.cell_id=x.cell_id AND NOT c.whole JOIN fx_box b ON x.item_id=b.item_id),
    f AS (SELECT cell_id FROM c WHERE whole OR cell_id NOT IN (SELECT cell_id FROM i WHERE NOT hit))
    SELECT cell_id, CAST(-1 AS BIGINT) AS item_id FROM f UNION ALL SELECT cell_id, item_id FROM i WHERE hit AND cell_id NOT IN (SELECT cell_id FROM f)""")
def leaf_rect_item_boxes(w):
    return _shown(leaves.rect(w, -4, 3, -6, 9, "poly-itembbox"))


@query(f"""
    WITH c AS (SELECT cell_id, {_convex_holds_box(TRIANGLE)} AS whole FROM fx_cell WHERE {_convex_meets_box(TRIANGLE)}),
    v AS (SELECT a.item_id, a.lat, a.lon, coalesce(b.lat, a.lat) AS lat2, coalesce(b.lon, a.lon) AS lon2 FROM (SELECT * FROM fx_point WHERE pos=0) a LEFT JOIN (SELECT * FROM fx_point WHERE pos=1) b ON a.item_id=b.item_id),
    s AS (SELECT item_id, {", ".join(f"{e} AS p{k}" for k, e in enumerate(_sides(TRIANGLE, "lat", "lon")))}, {", ".join(f"{e} AS q{k}" for k, e in enumerate(_sides(TRIANGLE, "lat2", "lon2")))} FROM v),
    h AS (SELECT item_id FROM s WHERE {_convex_meets_segment(3)} UNION ALL SELECT region_id FROM fx_region WHERE {_ring_meets(TRIANGLE)}),
    x AS (SELECT c.cell_id, i.item_id, i.item_id IN (SELECT item_id FROM h) AS hit FROM c JOIN fx_cell_item i ON c.cell_id=i.cell_id AND NOT c.whole),
    f AS (SELECT cell_id FROM c WHERE whole OR cell_id NOT IN (SELECT cell_id FROM x WHERE NOT hit))
    SELECT cell_id, CAST(-1 AS BIGINT) AS item_id FROM f UNION ALL SELECT cell_id, item_id FROM x WHERE hit AND cell_id NOT IN (SELECT cell_id FROM f)""")
def leaf_polygon_exact(w):
    return _shown(leaves.polygon(w, TRIANGLE, "poly-item"))


@query(f"""
    WITH c AS (SELECT cell_id, {_convex_holds_box(TRIANGLE)} AS whole FROM fx_cell WHERE {_convex_meets_box(TRIANGLE)}),
    x AS (SELECT c.cell_id, i.item_id, i.item_id IN (SELECT item_id FROM fx_box WHERE {_convex_meets_box(TRIANGLE)}) AS hit FROM c JOIN fx_cell_item i ON c.cell_id=i.cell_id AND NOT c.whole),
    f AS (SELECT cell_id FROM c WHERE whole OR cell_id NOT IN (SELECT cell_id FROM x WHERE NOT hit))
    SELECT cell_id, CAST(-1 AS BIGINT) AS item_id FROM f UNION ALL SELECT cell_id, item_id FROM x WHERE hit AND cell_id NOT IN (SELECT cell_id FROM f)""")
def leaf_polygon_item_boxes(w):
    return _shown(leaves.polygon(w, TRIANGLE, "poly-itembbox"))


BOX = [(-12.0, -12.0), (-12.0, 11.0), (8.0, 11.0), (8.0, -12.0)]


@query(f"""
    WITH c AS (SELECT cell_id, min_lat>=-12 AND max_lat<=8 AND min_lon>=-12 AND max_lon<=11 AS whole FROM fx_cell WHERE min_lat<=8 AND max_lat>=-12 AND min_lon<=11 AND max_lon>=-12),
    v AS (SELECT a.item_id, a.lat, a.lon, coalesce(b.lat, a.lat) AS lat2, coalesce(b.lon, a.lon) AS lon2 FROM (SELECT * FROM fx_point WHERE pos=0) a LEFT JOIN (SELECT * FROM fx_point WHERE pos=1) b ON a.item_id=b.item_id),
    s AS (SELECT item_id, {", ".join(f"{e} AS p{k}" for k, e in enumerate(_sides(BOX, "lat", "lon")))}, {", ".join(f"{e} AS q{k}" for k, e in enumerate(_sides(BOX, "lat2", "lon2")))} FROM v),
    h AS (SELECT item_id FROM s WHERE {_convex_meets_segment(4)} UNION ALL SELECT region_id FROM fx_region WHERE {_ring_meets(BOX)}),
    x AS (SELECT c.cell_id, i.item_id, i.item_id IN (SELECT item_id FROM h) AS hit FROM c JOIN fx_cell_item i ON c.cell_id=i.cell_id AND NOT c.whole),
    f AS (SELECT cell_id FROM c WHERE whole OR cell_id NOT IN (SELECT cell_id FROM x WHERE NOT hit))
    SELECT cell_id, CAST(-1 AS BIGINT) AS item_id FROM f UNION ALL SELECT cell_id, item_id FROM x WHERE hit AND cell_id NOT IN (SELECT cell_id FROM f)""")
def leaf_polygon_box_items(w):
    return _shown(leaves.polygon(w, TRIANGLE, "polybbox-item"))


@query(f"{FULL} fx_cell WHERE {_convex_meets_box(TRIANGLE)}")
def leaf_polygon_cells(w):
    return _shown(leaves.polygon(w, TRIANGLE, "poly-cellbbox"))


@query("""
    WITH b AS (SELECT degrees(200000/6371000.0) AS d), s AS (SELECT -d AS lo, d AS hi FROM b)
    SELECT cell_id, CAST(-1 AS BIGINT) AS item_id FROM fx_cell, s WHERE min_lat<=hi AND max_lat>=lo AND min_lon<=hi AND max_lon>=lo""")
def leaf_point_radius(w):
    return _shown(leaves.point(w, 0.0, 0.0, 200000.0))


@query("SELECT x.cell_id, x.item_id FROM fx_cell_item x JOIN fx_cell c ON x.cell_id=c.cell_id JOIN fx_region r ON x.item_id=r.region_id WHERE c.min_lat<=1.5 AND 1.5<c.max_lat AND c.min_lon<=-7.25 AND -7.25<c.max_lon AND x.item_id IN (SELECT region_id FROM fx_region WHERE " + _ring_holds("1.5", "-7.25") + ")", without=("borders",))
def leaf_point(w):
    return _shown(leaves.point(w, 1.5, -7.25))


@query(f"""
    WITH l AS ({_line_cells(LINE)}), d AS ({DISCS}), h AS (SELECT d.* FROM d JOIN l ON d.cell_id=l.cell_id)
    SELECT DISTINCT b.cell_id, CAST(-1 AS BIGINT) AS item_id FROM h a JOIN d b ON {GAP}-a.r-b.r<=50000""")
def leaf_path(w):
    return _shown(leaves.path(w, LINE, 50_000.0))


SHORT_LINE = [(-2.512, -2.510), (-2.499, -2.496), (-2.490, -2.488)]


def _corridor_cells(points: list[tuple[float, float]], radius: float) -> str:
    """Triangles of which an edge comes near a leg, on the plane around the line's middle; none of them holds the line and is further off."""
    lats, lons = zip(*points)
    grow = math.degrees(radius / 6_371_000)
    wider = grow / math.cos(math.radians(max(map(abs, lats)) + grow))
    lat0, lon0 = (min(lats) - grow + max(lats) + grow) / 2, (min(lons) - wider + max(lons) + wider) / 2
    metre = math.radians(1) * 6_371_000
    flat = lambda lat, lon: (f"(({lon}-({lon0}))*{metre * math.cos(math.radians(lat0))})", f"(({lat}-({lat0}))*{metre})")
    corner = {p: (f"x_{p}", f"y_{p}") for p in "abc"}
    placed = ", ".join(f"{v} AS {c}_{p}" for p in "abc" for c, v in zip("xy", flat(f"{p}lat", f"{p}lon")))

    def apart(p, a, b):
        along = f"(({p[0]}-{a[0]})*({b[0]}-{a[0]})+({p[1]}-{a[1]})*({b[1]}-{a[1]}))/(power({b[0]}-{a[0]},2)+power({b[1]}-{a[1]},2))"
        share = f"greatest(0,least(1,{along}))"
        return f"sqrt(power({p[0]}-{a[0]}-{share}*({b[0]}-{a[0]}),2)+power({p[1]}-{a[1]}-{share}*({b[1]}-{a[1]}),2))"

    turn = lambda a, b, p: f"sign(({b[0]}-{a[0]})*({p[1]}-{a[1]})-({b[1]}-{a[1]})*({p[0]}-{a[0]}))"
    tests = []
    for p, q in zip(points, points[1:]):
        p, q = flat(*p), flat(*q)
        for a, b in ((corner[x], corner[y]) for x, y in ("ab", "bc", "ca")):
            tests.append(f"least({apart(p, a, b)},{apart(q, a, b)},{apart(a, p, q)},{apart(b, p, q)})<={radius} OR ({turn(p, q, a)}<>{turn(p, q, b)} AND {turn(a, b, p)}<>{turn(a, b, q)})")
    return f"SELECT cell_id FROM (SELECT *, {placed} FROM (SELECT cell_id, {CORNERS} FROM fx_cell) k) f WHERE {' OR '.join(tests)} OR ({_in_triangle(*map(str, points[0]))})"


@query(f"{FULL} ({_corridor_cells(SHORT_LINE, 1500.0)}) t")
def leaf_path_corridor(w):
    return _shown(leaves.path(w, SHORT_LINE, 1500.0))


@query(f"{FULL} ({_line_cells(LINE)}) t")
def leaf_route(w):
    return _shown(leaves.route(w, LINE))


@query(f"{FULL} fx_cell WHERE cell_id IN (3, 17)")
def leaf_route_cells(w):
    return _shown(leaves.route(w, LINE, leaves.from_cells(lambda *_: [3, 17])))


@query("SELECT cell_id, CAST(-1 AS BIGINT) AS item_id FROM fx_cell WHERE false")
def leaf_route_none(w):
    return _shown(leaves.route(w, LINE, leaves.no_route))


# ---- sets of hits


def _building(w: World) -> DataFrame:
    return leaves.text(w, "building", "items")


@query(f"""
    WITH f AS ({REGION7}), p AS ({BUILDING})
    SELECT cell_id, CAST(-1 AS BIGINT) AS item_id FROM f UNION ALL SELECT cell_id, item_id FROM p WHERE cell_id NOT IN (SELECT cell_id FROM f)""")
def cqr_union(w):
    return _shown(hits.union(_building(w), leaves.region(w, 7)))


@query(f"SELECT cell_id, item_id FROM ({BUILDING}) p WHERE cell_id IN ({REGION7})")
def cqr_intersect(w):
    return _shown(hits.intersect(_building(w), leaves.region(w, 7)))


@query(f"""
    WITH f AS ({REGION7}), p AS ({BUILDING})
    SELECT cell_id, CAST(-1 AS BIGINT) AS item_id FROM f WHERE cell_id NOT IN (SELECT cell_id FROM p)
    UNION ALL SELECT x.cell_id, x.item_id FROM fx_cell_item x WHERE x.cell_id IN (SELECT cell_id FROM f) AND x.cell_id IN (SELECT cell_id FROM p) AND NOT EXISTS (SELECT 1 FROM p WHERE p.cell_id=x.cell_id AND p.item_id=x.item_id)""")
def cqr_difference(w):
    return _shown(hits.difference(leaves.region(w, 7), _building(w), w))


@query(f"WITH a AS ({BUILDING}), b AS (SELECT cell_id, item_id FROM fx_cell_item WHERE item_id IN (SELECT item_id FROM fx_tag WHERE contains(lower(v), 'negative'))) (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
def cqr_symdiff(w):
    return _shown(hits.symmetric(_building(w), leaves.text(w, "negative", "items"), w))


@query(f"SELECT DISTINCT item_id FROM fx_cell_item WHERE cell_id IN ({REGION7}) UNION SELECT item_id FROM ({AUTO}) t")
def cqr_flatten(w):
    return hits.flatten(hits.union(leaves.text(w, "automobile", "items"), leaves.region(w, 7)), w)


# ---- growing and reducing hits


@query(f"SELECT DISTINCT cell_id, CAST(-1 AS BIGINT) AS item_id FROM ({BUILDING}) t")
def cqr_to_full(w):
    return _shown(hits.to_full(_building(w)))


@query(f"""
    WITH h AS (SELECT p.region_id, COUNT(DISTINCT b.cell_id) AS n FROM fx_cell_parent p JOIN ({BUILDING}) b ON p.cell_id=b.cell_id GROUP BY 1),
    s AS (SELECT region_id, COUNT(*) AS cells FROM fx_cell_parent GROUP BY 1)
    SELECT DISTINCT p.cell_id, CAST(-1 AS BIGINT) AS item_id FROM fx_cell_parent p JOIN h ON p.region_id=h.region_id JOIN s ON s.region_id=h.region_id WHERE h.n > s.cells*0.3""")
def region_cell_coverage(w):
    return _shown(coverage.by_cell_coverage(_building(w), w, 0.3))


ITEM_COVERAGE = f"""
    WITH h AS (SELECT p.region_id, COUNT(*) AS n FROM fx_cell_parent p JOIN (HITS) b ON p.cell_id=b.cell_id GROUP BY 1),
    s AS (SELECT p.region_id, COUNT(DISTINCT x.item_id) AS n FROM fx_cell_parent p JOIN fx_cell_item x ON p.cell_id=x.cell_id GROUP BY 1)
    SELECT DISTINCT p.cell_id, CAST(-1 AS BIGINT) AS item_id FROM fx_cell_parent p JOIN h ON p.region_id=h.region_id JOIN s ON s.region_id=h.region_id WHERE h.n > s.n*SHARE"""


@query(ITEM_COVERAGE.replace("HITS", BUILDING).replace("SHARE", "0.2"))
def region_item_coverage(w):
    return _shown(coverage.by_item_coverage(_building(w), w, 0.2))


@query(ITEM_COVERAGE.replace("HITS", f"SELECT cell_id, item_id FROM fx_cell_item WHERE cell_id IN ({REGION7})").replace("SHARE", "0.9"))
def in_op(w):
    return _shown(coverage.inside(leaves.region(w, 7), w))


@query(BUILDING)
def query_exclusive_cells(w):
    return _shown(coverage.exclusive(_building(w), w, 1))


@query(f"{FULL} ({REGION7}) t")
def relevant_element(w):
    return _shown(coverage.relevant(leaves.region(w, 7), w))


@query("SELECT cell_id, item_id FROM fx_cell_item WHERE item_id = 31")
def relevant_item(w):
    return _shown(coverage.relevant(leaves.item(w, 31), w))


@query(f"{FULL} fx_cell WHERE {_convex_meets_box([(0, -25), (0, -15), (20, -10), (20, -30)])} AND cell_id NOT IN ({REGION7})")
def compass_north(w):
    return _shown(coverage.compass(leaves.region(w, 7), w, "north"))


@query()
def compass_east_of_item(w):
    return _shown(coverage.compass(leaves.item(w, 31), w, "east"))


@query(f"{FULL} fx_cell WHERE {_convex_meets_box([(-25, -15), (-15, -25), (25, 15), (15, 25)])} AND cell_id NOT IN (SELECT cell_id FROM fx_cell_parent WHERE region_id IN (5, 29))")
def between_regions(w):
    return _shown(coverage.between(leaves.region(w, 5), leaves.region(w, 29), w))


def _ends(**items_: tuple[int, int]) -> str:
    """Coordinates of single vertices, as columns alat, alon and so on."""
    return "SELECT " + ", ".join(f"max(CASE WHEN item_id={i} AND pos={p} THEN {c} END) AS {n}{c}" for n, (i, p) in items_.items() for c in ("lat", "lon")) + " FROM fx_point"


def _whole_box(lats: list[str], lons: list[str], source: str) -> str:
    """Cells that the box around some places meets: what a polygon of more than 250 km is cut down to."""
    return f"SELECT cell_id, CAST(-1 AS BIGINT) AS item_id FROM fx_cell, {source} WHERE min_lat<=greatest({','.join(lats)}) AND max_lat>=least({','.join(lats)}) AND min_lon<=greatest({','.join(lons)}) AND max_lon>=least({','.join(lons)})"


def _turned(lat: str, lon: str, angle: str, arc: str) -> tuple[str, str]:
    """The place at the end of an arc, all in radians but for the result."""
    end = f"asin(sin({lat})*cos({arc})+cos({lat})*sin({arc})*cos({angle}))"
    return f"degrees({end})", f"degrees({lon}+atan2(sin({angle})*sin({arc})*cos({lat}),cos({arc})-sin({lat})*sin({end})))"


#: Between places a and b: their difference of longitude, the middle of the way, its direction at a and its length as an arc.
HALFWAY = """
    SELECT *, atan2(sin(ra)+sin(rb),sqrt(power(cos(ra)+cos(rb)*cos(dl),2)+power(cos(rb)*sin(dl),2))) AS mlat, radians(alon)+atan2(cos(rb)*sin(dl),cos(ra)+cos(rb)*cos(dl)) AS mlon,
           atan2(sin(dl)*cos(rb),cos(ra)*sin(rb)-sin(ra)*cos(rb)*cos(dl)) AS turn, 2*asin(sqrt(power(sin((rb-ra)/2),2)+cos(ra)*cos(rb)*power(sin(dl/2),2))) AS arc
    FROM (SELECT *, radians(alat) AS ra, radians(blat) AS rb, radians(blon-alon) AS dl FROM e) r"""
BESIDE = [_turned("mlat", "mlon", f"turn{sign}pi()/2", "arc/4") for sign in "+-"]


@query(f"WITH e AS ({_ends(a=(31, 0), b=(33, 0))}), h AS ({HALFWAY}) {_whole_box(['alat', 'blat', *(lat for lat, _ in BESIDE)], ['alon', 'blon', *(lon for _, lon in BESIDE)], 'h')}")
def between_points(w):
    return _shown(coverage.between(leaves.item(w, 31), leaves.item(w, 33), w))


@query(f"WITH e AS ({_ends(a=(1000000001, 0), b=(1000000001, 1), c=(1000000004, 0), d=(1000000004, 1))}) {_whole_box([f'{p}lat' for p in 'abcd'], [f'{p}lon' for p in 'abcd'], 'e')}")
def between_ways(w):
    return _shown(coverage.between(leaves.item(w, 1000000001), leaves.item(w, 1000000004), w))


@query(f"WITH e AS ({_ends(a=(1000000001, 0), b=(1000000001, 1), c=(33, 0))}) {_whole_box([f'{p}lat' for p in 'abc'], [f'{p}lon' for p in 'abc'], 'e')}")
def between_way_and_point(w):
    return _shown(coverage.between(leaves.item(w, 1000000001), leaves.item(w, 33), w))


NORTH = [_turned("mlat", "mlon", f"radians({angle})", "arc*sqrt(2)") for angle in (-45, 45)]


@query(f"WITH e AS ({_ends(a=(1000000001, 0), b=(1000000001, 1))}), h AS ({HALFWAY}) {_whole_box(['alat', 'blat', *(lat for lat, _ in NORTH)], ['alon', 'blon', *(lon for _, lon in NORTH)], 'h')}")
def compass_north_of_way(w):
    return _shown(coverage.compass(leaves.item(w, 1000000001), w, "north"))


# ---- distances

@query(f"WITH d AS ({CENTRES}) SELECT e.src AS a, e.dst AS b, CAST(ROUND({GAP}) AS BIGINT) AS metres FROM fx_cell_edge e JOIN d a ON e.src=a.cell_id JOIN d b ON e.dst=b.cell_id")
def cell_center_distance(w):
    found = distance.between_cells(distance.discs(w, "center"), w.cell_edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return found.withColumn("metres", F.round("metres").cast("bigint"))


@query(f"WITH d AS ({DISCS}) SELECT a.cell_id AS a, b.cell_id AS b, CAST(ROUND(greatest(0, {GAP}-a.r-b.r)) AS BIGINT) AS metres FROM d a JOIN d b ON a.cell_id<>b.cell_id AND {GAP}-a.r-b.r<=300000")
def sphere_distance(w):
    return distance.neighbours(w, 300_000.0).withColumn("metres", F.round("metres").cast("bigint"))


@query(f"""
    WITH d AS ({DISCS}), p AS ({AUTO}), h AS (SELECT DISTINCT d.* FROM d WHERE cell_id IN (SELECT cell_id FROM p) AND cell_id IN ({REGION7})),
    n AS (SELECT DISTINCT b.cell_id FROM h a JOIN d b ON a.cell_id<>b.cell_id AND {GAP}-a.r-b.r<=100000)
    SELECT cell_id, CAST(-1 AS BIGINT) AS item_id FROM n UNION ALL SELECT cell_id, item_id FROM p WHERE cell_id IN (SELECT cell_id FROM h) AND cell_id NOT IN (SELECT cell_id FROM n)""")
def cell_dilation(w):
    return _shown(distance.dilate(hits.intersect(leaves.text(w, "automobile", "items"), leaves.region(w, 7)), w, 100_000.0))


@query(f"SELECT cell_id, CAST(ROUND(r) AS BIGINT) AS radius, CAST(ROUND(inside) AS BIGINT) AS inner_radius FROM ({ANNULI}) d")
def annulus(w):
    return distance.discs(w, "annulus").select("cell_id", F.round("radius").cast("bigint").alias("radius"), F.round("inner").cast("bigint").alias("inner_radius"))


@query(f"WITH d AS ({ANNULI}) SELECT e.src AS a, e.dst AS b, CAST(ROUND(greatest(0, {GAP}-a.r-b.r)) AS BIGINT) AS metres FROM fx_cell_edge e JOIN d a ON e.src=a.cell_id JOIN d b ON e.dst=b.cell_id")
def annulus_distance(w):
    found = distance.between_cells(distance.discs(w, "annulus"), w.cell_edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return found.withColumn("metres", F.round("metres").cast("bigint"))


@query(f"WITH a AS (SELECT CAST(1.5 AS DOUBLE) AS lat, CAST(-7.25 AS DOUBLE) AS lon), b AS ({DISCS}) SELECT b.cell_id, CAST(ROUND(greatest(0, {GAP}-b.r)) AS BIGINT) AS metres FROM a, b")
def point_distance(w):
    return distance.to_point(distance.discs(w), 1.5, -7.25).withColumn("metres", F.round("metres").cast("bigint"))


@query(f"SELECT cell_id, CAST(ROUND(r) AS BIGINT) AS radius FROM ({SMALLEST}) d")
def min_sphere(w):
    return distance.discs(w, "min_sphere").select("cell_id", F.round("radius").cast("bigint").alias("radius"))


# ---- roll-up, counts, rankings


@query("SELECT p.region_id, COUNT(DISTINCT p.cell_id) AS cells, COUNT(x.item_id) AS pairs, COUNT(DISTINCT x.item_id) AS items FROM fx_cell_parent p LEFT JOIN fx_cell_item x ON p.cell_id=x.cell_id GROUP BY 1")
def region_sizes(w):
    return coverage.region_sizes(w)


@query("SELECT cell_id, region_id, direct FROM fx_cell_parent")
def cell_parents_closed(w):
    """All regions of each cell, from the direct ones and the regions' parents."""
    return tree.closed(w.cell_parents.filter("direct"), w.regions.select(F.col("region_id").alias("node"), F.col("parent_id").alias("parent")))


@query(f"SELECT p.region_id, COUNT(DISTINCT h.cell_id) AS cells, CAST(0 AS BIGINT) AS full_cells, COUNT(*) AS pairs FROM ({BUILDING}) h JOIN fx_cell_parent p ON h.cell_id=p.cell_id WHERE h.cell_id IN ({REGION7}) GROUP BY 1")
def minimum_slice(w):
    return hits.by_region(hits.intersect(_building(w), leaves.region(w, 7)), w)


@query(f"SELECT p.region_id, COUNT(DISTINCT h.cell_id) AS cells, CAST(0 AS BIGINT) AS full_cells, COUNT(*) AS pairs FROM ({BUILDING}) h JOIN fx_cell_parent p ON h.cell_id=p.cell_id GROUP BY 1")
def clustered_counts(w):
    return hits.by_region(_building(w), w)


@query(f"""
    SELECT p.region_id, any_value(r.parent_id) AS parent_id, COUNT(DISTINCT h.cell_id) AS cells, COUNT(*) AS pairs, COUNT(DISTINCT h.cell_id) FILTER (direct) AS own_cells, COUNT(*) FILTER (direct) AS own_pairs
    FROM ({BUILDING}) h JOIN fx_cell_parent p ON h.cell_id=p.cell_id JOIN fx_region r ON p.region_id=r.region_id GROUP BY 1""")
def clustered_subset(w):
    return hits.sub_hierarchy(_building(w), w)


@query("SELECT DISTINCT item_id FROM fx_tag WHERE contains(lower(v), 'ation_1') UNION SELECT item_id FROM fx_tag WHERE suffix(lower(v), 'y')")
def tag_value_trigrams(w):
    """A part of a value by its trigrams, and an end too short for them."""
    return items.with_value(w, "ATION_1").unionByName(items.with_value(w, "?y")).distinct()


def stat(sql: str | None = None):
    """Registers a function of the larger table of tags."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(fixtures.table(spark, sf_dir, "fx_bulk_tag"))
        if sql:
            _SQL[f.__name__] = fixtures.with_views(sql)
        return f

    return register


PAIRS = "SELECT k, v, COUNT(*) AS n FROM fx_bulk_tag GROUP BY k, v"
KEYS = "SELECT k, COUNT(*) AS n, COUNT(DISTINCT v) AS n_values FROM fx_bulk_tag GROUP BY k"


@stat(PAIRS)
def tag_kv_counts(t):
    return stats.pair_counts(t)


@stat(KEYS)
def tag_key_counts(t):
    return stats.key_counts(stats.pair_counts(t))


@stat(f"{KEYS} ORDER BY n DESC, k LIMIT 3")
def topk_keys(t):
    return stats.top(stats.key_counts(stats.pair_counts(t)), 3)


@stat(f"SELECT k, v, n, CAST(row_number() OVER (PARTITION BY k ORDER BY n DESC, v) AS INT) AS place FROM ({PAIRS}) p QUALIFY place <= 2")
def topk_values_per_key(t):
    return stats.top_values(stats.pair_counts(t), 2)


@stat(f"SELECT k, v, n FROM ({PAIRS}) p WHERE k = 'nation' ORDER BY n DESC, v LIMIT 4")
def values_of_key(t):
    return stats.values_of(stats.pair_counts(t), "nation", 4)


@stat(f"{PAIRS} ORDER BY n DESC, k, v LIMIT 10")
def topk_kv(t):
    return stats.top(stats.pair_counts(t), 10)


@stat(f"SELECT * FROM ({PAIRS}) p WHERE NOT starts_with(k, 'pri') AND k <> 'year' AND NOT (k = 'status' AND v = 'O')")
def kv_exclusion(t):
    return stats.without(stats.pair_counts(t), ["year"], ["pri"], [("status", "O")])


@stat(f"SELECT * FROM ({KEYS}) p ORDER BY abs(n - 3000), k LIMIT 3")
def shannon_topk_keys(t):
    return stats.top(stats.key_counts(stats.pair_counts(t)), 3, stats.closest_to(3000))


@stat(f"SELECT * FROM ({PAIRS}) p ORDER BY abs(n - 3000), k, v LIMIT 5")
def shannon_topk_kv(t):
    return stats.top(stats.pair_counts(t), 5, stats.closest_to(3000))


@stat(f"""
    WITH p AS ({PAIRS} ORDER BY n DESC, k, v LIMIT 12), t AS (SELECT DISTINCT f.* FROM fx_bulk_tag f JOIN p ON f.k=p.k AND f.v=p.v)
    SELECT a.k, a.v, b.k AS k2, b.v AS v2, COUNT(*) AS n FROM t a JOIN t b ON a.item_id=b.item_id AND (a.k, a.v) < (b.k, b.v) GROUP BY 1, 2, 3, 4""")
def kv_overlap(t):
    return stats.overlaps(t, F.broadcast(stats.top(stats.pair_counts(t), 12)))


@stat(f"""
    WITH RECURSIVE p AS (SELECT *, row_number() OVER (ORDER BY n DESC, k, v) AS place FROM ({PAIRS}) c),
    t AS (SELECT DISTINCT f.item_id, p.place, p.n FROM fx_bulk_tag f JOIN p ON f.k=p.k AND f.v=p.v),
    o AS (SELECT a.place, b.place AS other FROM t a JOIN t b ON a.item_id=b.item_id AND a.place<>b.place GROUP BY a.place, b.place, a.n, b.n HAVING 200*COUNT(*) > a.n+b.n),
    q AS (SELECT p.place, p.k, p.v, p.n, coalesce(any_value(l.others), []) AS others FROM p LEFT JOIN (SELECT place, list(other) AS others FROM o GROUP BY place) l ON p.place=l.place GROUP BY ALL),
    late AS (SELECT MIN(place) AS place FROM q WHERE len([x for x in others if x < place]) < place-1),
    one AS (SELECT MIN(q.place) AS place FROM q, late WHERE q.place<>late.place AND NOT list_contains(q.others, late.place)),
    r AS (SELECT late.place, [one.place, late.place] AS chosen FROM late, one WHERE late.place IS NOT NULL
          UNION ALL SELECT q.place, CASE WHEN list_has_any(q.others, r.chosen) THEN r.chosen ELSE list_append(r.chosen, q.place) END FROM r JOIN q ON q.place=r.place+1)
    SELECT k, v, n FROM q JOIN (SELECT unnest(chosen[1:5]) AS place FROM r WHERE place=(SELECT MAX(place) FROM p)) c ON q.place=c.place""")
def disjoint_topk(t):
    return t.sparkSession.createDataFrame(stats.disjoint_top(t, 5), "k string, v string, n long")


@stat(f"""
    WITH p AS ({PAIRS}), b AS (SELECT k FROM p GROUP BY k ORDER BY MAX(n) DESC, k LIMIT 2)
    SELECT k, v, n, CAST(row_number() OVER (PARTITION BY k ORDER BY n DESC, v) AS INT) AS place FROM p WHERE k IN (SELECT k FROM b) QUALIFY place <= 3""")
def facets(t):
    return stats.facets(t, 2, 3)
