"""A world made by hand: storage, checks, and operators against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralex.functions.circles import min_annulus, min_circle
from terralex.functions.geo import Polygon, Rect, hull, segment_meets_box
from terralex.functions.geo import distance as geo_distance
from terralex.operators import coverage, distance, hits, items, leaves, places, tree
from terralex.sources import world as world_module
from terralex.sources.world import World, read_phrases, validate


@pytest.fixture(scope="module")
def small(spark):
    """A root over two regions of two cells each; items 10 to 13, of which 12 lies in two cells and 13 in none."""
    make = spark.createDataFrame
    box = "min_lat double, max_lat double, min_lon double, max_lon double"
    return World(
        items=make([(1, 3, True, "POLYGON", 0), (2, 3, True, "POLYGON", 0), (3, 3, True, "POLYGON", 0)] + [(i, 1, False, "POINT", i) for i in (10, 11, 13)] + [(12, 2, False, "WAY", 5)], "item_id long, osm_type int, is_region boolean, shape string, score int"),
        points=make([(10, 0, 0.5, 0.5), (11, 0, 0.5, 1.5), (12, 0, 0.2, 1.8), (12, 1, 0.2, 2.2), (13, 0, 9.0, 9.0)], "item_id long, pos int, lat double, lon double"),
        regions=make([(1, None, "all", 0.0, 1.0, 0.0, 4.0), (2, 1, "west", 0.0, 1.0, 0.0, 2.0), (3, 1, "east", 0.0, 1.0, 2.0, 4.0)], f"region_id long, parent_id long, name string, {box}"),
        cells=make([(i, 0.0, 1.0, float(i), float(i + 1)) for i in range(4)], f"cell_id long, {box}"),
        cell_edges=make([(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)], "src long, dst long"),
        cell_parents=make([(i, 2 + i // 2, True) for i in range(4)] + [(i, 1, False) for i in range(4)], "cell_id long, region_id long, direct boolean"),
        cell_items=make([(0, 10), (1, 11), (1, 12), (2, 12)], "cell_id long, item_id long"),
        tags=make([(10, "amenity", "Cafe"), (11, "amenity", "Bar"), (12, "highway", "Cafe Road"), (2, "name", "West Cafe")], "item_id long, k string, v string"),
    )


def rows(found):
    return sorted((r.cell_id, -1 if r.item_id is None else r.item_id) for r in found.collect())


def test_write_and_load(spark, small, tmp_path):
    small.write(str(tmp_path / "world"))
    again = World.load(spark, str(tmp_path / "world"))
    assert again.phrases is None
    for name in World.names()[:8]:
        assert sorted(map(repr, getattr(again, name).collect())) == sorted(map(repr, getattr(small, name).collect()))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        World.load(spark, str(tmp_path / "nowhere"))


def test_what_follows_is_written_too(spark, small, tmp_path):
    small.write(str(tmp_path / "world"))
    again = World.load(spark, str(tmp_path / "world"))
    assert {(r.region_id, r.cells, r.pairs, r["items"]) for r in again.region_sizes.collect()} == {(1, 4, 4, 3), (2, 2, 3, 3), (3, 2, 1, 1)}
    assert {(r.cell_id, r.n_items) for r in again.cell_sizes.collect()} == {(0, 1), (1, 2), (2, 1)}
    assert {r.low for r in again.tag_values.collect()} == {"cafe", "bar", "cafe road", "west cafe"}
    plan = items.with_value(again, "cafe?")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "StartsWith(low,cafe)" in plan
    assert sorted(r.item_id for r in items.with_value(again, "cafe?").collect()) == [10, 12]


@pytest.fixture(scope="module")
def shaped(spark, small):
    """The small world with an area that has a hole, an island in it, and a region with a ring of its own."""
    square = lambda a, b: [(a, a), (a, b), (b, b), (b, a)]
    rings = [(20, 0, square(20.0, 30.0)), (20, 1, square(22.0, 28.0)), (20, 2, square(24.0, 26.0)), (3, 0, [(0.0, 2.0), (0.0, 4.0), (1.0, 4.0)])]
    outlines = spark.createDataFrame([(i, r, k, *p) for i, r, points in rings for k, p in enumerate(points)], "item_id long, ring int, pos int, lat double, lon double")
    return World(**{n: getattr(small, n) for n in World.names()} | {"outlines": outlines, "items": small.items.unionByName(spark.createDataFrame([(20, 2, False, "POLYGON", 1)], small.items.schema))})


def test_areas_with_holes(shaped):
    held = lambda lat, lon: sorted(r.item_id for r in items.holding(shaped, (lat, lon)).collect())
    assert held(21.0, 25.0) == [20] and held(23.0, 25.0) == [] and held(25.0, 25.0) == [20] and held(40.0, 25.0) == []
    assert held(0.2, 3.5) == [1, 3] and held(0.9, 2.2) == [1]  # the box of region 3 holds both, its ring one
    met = lambda *box: 20 in {r.item_id for r in items.meeting(shaped, Rect(*box)).collect()}
    assert met(21, 21.5, 24, 25) and not met(22.5, 23.5, 23, 25) and met(24.5, 25.5, 24.5, 25.5) and met(10, 40, 10, 40) and met(19, 20, 19, 20)
    whole = {r.item_id for r in items.meeting(shaped, Polygon(((21.0, 21.0), (21.0, 21.5), (21.5, 21.2)))).collect()}
    assert whole == {20}  # it lies inside, no vertex and no segment meets it
    text = {r.item_id: r.wkt for r in items.geometry_text(shaped).collect()}
    ring = lambda a, b: f"({a}.000 {a}.000, {b}.000 {a}.000, {b}.000 {b}.000, {a}.000 {b}.000, {a}.000 {a}.000)"
    assert text[20] == f"MULTIPOLYGON (({ring(20, 30)}, {ring(22, 28)}), ({ring(24, 26)}))" and text[3] == "POLYGON ((2.000 0.000, 4.000 0.000, 4.000 1.000, 2.000 0.000))"


def test_smallest_circles_and_annuli():
    r = np.random.default_rng(0)
    area = lambda c, p: (lambda q: q.max() - q.min())(((p - c) ** 2).sum(axis=1))
    for n in (1, 2, 3, 4, 6, 25):
        points = r.uniform(0, 1, (n, 2))
        centre, ring = min_circle(points), min_annulus(points)
        for step in r.normal(0, 1e-2, (80, 2)):
            assert np.hypot(*(points - centre - step).T).max() >= np.hypot(*(points - centre).T).max() - 1e-9
            assert n < 3 or area(ring + step, points) >= area(ring, points) - 1e-7
    assert min_circle(np.array([[0.0, 0.0], [0.0, 2.0], [0.0, 1.0]])).tolist() == [0.0, 1.0] == min_annulus(np.array([[0.0, 0.0], [0.0, 2.0], [0.0, 1.0]])).tolist()


def test_metrics_differ(small, spark):
    borders = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 1.0, 1.0), (0, 2, 0.3, 0.9)], "cell_id long, pos int, lat double, lon double")
    world = World(**{n: getattr(small, n) for n in World.names()} | {"borders": borders})
    found = {m: {r.cell_id: r for r in distance.discs(world, m).collect()} for m in ("center", "sphere", "min_sphere", "annulus")}
    assert len({round(f[0].radius) for f in found.values()}) == 4
    assert abs(found["annulus"][0].radius - found["annulus"][0].inner) < 50 < found["sphere"][0].radius - found["sphere"][0].inner
    assert found["min_sphere"][0].radius < found["annulus"][0].radius and found["min_sphere"][1].radius > 0


def test_near_cells_of_very_different_sizes(spark):
    """All pairs, also of small cells beside a huge one, against plain arithmetic."""
    r = random.Random(3)
    cells = [(i, r.uniform(-80, 80), r.uniform(-180, 180), r.choice([0.0, 500.0, 3e4, 9e5]), 0.0) for i in range(150)] + [(900, 0.0, 179.9, 5e6, 0.0), (901, 0.0, -179.9, 10.0, 0.0)]
    discs = spark.createDataFrame(cells, "cell_id long, lat double, lon double, radius double, inner double")
    near = discs.filter("cell_id % 3 = 0")
    gap = lambda a, b: max(0.0, geo_distance((a[1], a[2]), (b[1], b[2])) - a[3] - b[3])
    want = {(a[0], b[0]) for a in cells for b in cells if a[0] % 3 == 0 and a[0] != b[0] and gap(a, b) <= 400_000}
    got = [(x.a, x.b) for x in distance.within(near, discs, 400_000.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_shapes_between():
    a, b = Rect(0, 1, 0, 1), Rect(10, 12, 0, 2)
    assert coverage.between_boxes(a, b).points == ((0.5, 0), (11, 0), (11, 2), (0.5, 1))
    assert coverage.between_boxes(Rect(0, 1, 0, 1), Rect(10, 11, 10, 11)).points == ((1, 0), (11, 10), (10, 11), (0, 1))
    assert coverage.box_to_point(a, (0.5, 9.0)).points == ((1, 0.5), (1, 1), (0.5, 9.0), (0, 1), (0, 0.5))
    assert set(coverage.box_to_point(a, (-8.0, -8.0)).points) == {(1, 0), (0, 1), (-8.0, -8.0)}
    way = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]
    assert set(coverage.between_shapes(way, [(5.0, 5.0)]).points) <= {*way, (5.0, 5.0)} and len(coverage.between_shapes([(0.0, 0.0)], [(1.0, 1.0)]).points) == 4
    assert set(coverage.between_shapes(way, a).points) <= {*way, *a.corners}


def test_validate_counts_what_is_broken(spark, small):
    assert {r.violations for r in validate(small).collect()} == {0}
    broken = World(**{n: getattr(small, n) for n in World.names()} | {"cell_items": small.cell_items.unionByName(spark.createDataFrame([(0, 10), (77, 10), (0, 99)], "cell_id long, item_id long"))})
    found = {r.rule: r.violations for r in validate(broken).collect()}
    assert (found["cell items repeat"], found["cell items of no cell"], found["cell items of no item"]) == (1, 1, 1)


def test_phrases(spark, small, tmp_path):
    path = tmp_path / "phrases"
    path.write_text("COFFEE\namenity\nCafe\ntwo words\namenity\nBar\nunknown\namenity\nPub\nPint\namenity\nBar\n")
    found = read_phrases(spark, str(path), small.tags)
    assert sorted(tuple(r) for r in found.collect()) == [("coffee", "amenity", "Cafe"), ("pint", "amenity", "Bar")]
    named = World(**{n: getattr(small, n) for n in World.names()} | {"phrases": found})
    assert [r.item_id for r in items.of_phrases(named, "Coffee").collect()] == [10]


def test_text_scopes(small):
    assert rows(leaves.text(small, "cafe", "items")) == [(0, 10), (1, 12), (2, 12)]
    assert rows(leaves.text(small, "cafe", "regions")) == [(0, -1), (1, -1)]
    assert rows(leaves.text(small, "cafe")) == [(0, -1), (1, -1), (2, 12)]
    assert rows(leaves.text(small, '"CAFE"')) == [(0, 10)] and rows(leaves.text(small, "")) == []


def test_set_operators_against_sets(small):
    """Every pair of some hits, against sets of pairs of cell and item plus the full cells."""
    there = {}
    for r in small.cell_items.collect():
        there.setdefault(r.cell_id, set()).add(r.item_id)
    some = [leaves.text(small, "cafe", "items"), leaves.region(small, 2), leaves.cells(small, [1, 3]), leaves.item(small, 11), leaves.cells(small, [])]

    def spelt(found):
        return {(c, i) for c, i in rows(found) if i != -1} | {(c, i) for c, f in rows(found) if f == -1 for i in there.get(c, ())}

    for a in some:
        for b in some:
            x, y = spelt(a), spelt(b)
            full = lambda h: {c for c, i in rows(h) if i == -1}
            for found, want, whole in (
                (hits.union(a, b), x | y, full(a) | full(b)),
                (hits.intersect(a, b), x & y, full(a) & full(b)),
                (hits.difference(a, b, small), x - y, full(a) - {c for c, _ in rows(b)}),
                (hits.symmetric(a, b, small), x ^ y, None),
            ):
                assert spelt(found) == want and (whole is None or full(found) == whole)
                assert len(rows(found)) == len(set(rows(found)))


def test_coverage_and_exclusive(small):
    one = leaves.cells(small, [0])
    assert rows(coverage.by_cell_coverage(one, small, 0.4)) == [(0, -1), (1, -1)]
    assert rows(coverage.by_cell_coverage(one, small, 0.5)) == [] == rows(coverage.by_cell_coverage(one, small, 0))
    assert rows(coverage.exclusive(one, small, 1)) == [(0, -1)] and rows(coverage.exclusive(one, small, 0)) == []
    assert rows(leaves.region_exclusive(small, 1)) == [] and rows(leaves.region_exclusive(small, 3)) == [(2, -1), (3, -1)]


def test_search_has_a_positive_term(small):
    with pytest.raises(ValueError):
        items.complete([])
    cafe, bar = items.with_value(small, "cafe"), items.with_value(small, "bar")
    assert [r.item_id for r in items.complete([cafe], [bar], F.col("item_id") > 5, 1).collect()] == [10]


def test_geometry_text(small):
    found = {r.item_id: r.wkt for r in items.geometry_text(small).collect()}
    assert found[10] == "POINT (0.500 0.500)" and found[12] == "LINESTRING (1.800 0.200, 2.200 0.200)"
    assert found[3] == "POLYGON ((2.000 0.000, 4.000 0.000, 4.000 1.000, 2.000 1.000, 2.000 0.000))"


def _winding(polygon: Polygon, lat: float, lon: float) -> bool:
    """Inside by the winding number, not by ray parity."""
    turns = 0
    for (a1, o1), (a2, o2) in polygon.edges:
        left = (o2 - o1) * (lat - a1) - (lon - o1) * (a2 - a1)
        turns += (a1 <= lat < a2 and left < 0) - (a2 <= lat < a1 and left > 0)
    return turns != 0


def test_polygon_holds_points_as_by_winding(spark):
    r = random.Random(5)
    for _ in range(5):
        polygon = Polygon(tuple(hull((r.uniform(-9, 9), r.uniform(-9, 9)) for _ in range(8))))
        dots = [(r.uniform(-10, 10), r.uniform(-10, 10)) for _ in range(300)]
        found = spark.createDataFrame(dots, "lat double, lon double").select("lat", "lon", F.expr(polygon.contains("lat", "lon")).alias("inside"))
        assert all(row.inside == _winding(polygon, row.lat, row.lon) for row in found.collect())


def test_segments_meet_boxes_as_by_clipping(spark):
    r = random.Random(6)
    box = Rect(-1.0, 2.0, -3.0, 1.0)
    lines = [tuple(r.uniform(-5, 5) for _ in range(4)) for _ in range(500)] + [(0.0, 0.0, 0.0, 0.0), (2.0, 1.0, 4.0, 4.0), (3.0, -9.0, 3.0, 9.0)]

    def meets(a, o, b, p):
        first, last = 0.0, 1.0
        for start, end, low, high in ((a, b, box.min_lat, box.max_lat), (o, p, box.min_lon, box.max_lon)):
            if start == end:
                if not low <= start <= high:
                    return False
                continue
            t = sorted(((low - start) / (end - start), (high - start) / (end - start)))
            first, last = max(first, t[0]), min(last, t[1])
        return first <= last

    values = tuple(f"CAST({v} AS DOUBLE)" for v in (box.min_lat, box.max_lat, box.min_lon, box.max_lon))
    found = spark.createDataFrame(lines, "a double, o double, b double, p double").withColumn("hit", F.expr(segment_meets_box(("a", "o"), ("b", "p"), values)))
    assert all(row.hit == meets(row.a, row.o, row.b, row.p) for row in found.collect())


def test_hull_holds_its_points():
    r = random.Random(7)
    dots = [(r.uniform(0, 1), r.uniform(0, 1)) for _ in range(60)]
    ring = hull(dots)
    turns = [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2])]
    assert len({t > 0 for t in turns}) == 1 and set(ring) <= set(dots)
    assert all(_winding(Polygon(tuple(ring)), *d) for d in dots if d not in ring)
    assert hull([(1.0, 1.0)] * 3) == [(1.0, 1.0)]


def test_two_islands_and_a_lake(shaped, spark):
    square = lambda a, o, d: [(a, o), (a, o + d), (a + d, o + d), (a + d, o)]
    rings_ = {(40, 7): square(0, 0, 10), (40, 2): square(50, 50, 10), (40, 5): square(51, 51, 2), (40, 3): square(55, 55, 4), (40, 9): square(56, 56, 2), (40, 1): square(56.5, 56.5, 0.5), (41, 0): square(1, 1, 1)}
    outlines = spark.createDataFrame([(i, r, k, float(a), float(o)) for (i, r), points in rings_.items() for k, (a, o) in enumerate(points)], "item_id long, ring int, pos int, lat double, lon double")
    within = {(x.item_id, x.ring): x.within for x in places.nested_rings(outlines).collect()}
    assert within == {(40, 7): 7, (40, 2): 2, (40, 5): 2, (40, 3): 2, (40, 9): 9, (40, 1): 9, (41, 0): 0}
    world = World(**{n: getattr(shaped, n) for n in World.names()} | {"outlines": outlines})
    text = {r.item_id: r.wkt for r in items.geometry_text(world).collect()}
    assert text[40].startswith("MULTIPOLYGON (((50.000 50.000") and text[40].count("((") == 3 + 1 - 1 and text[41].startswith("POLYGON ((1.000 1.000")


def test_a_frequent_value_is_written_evenly(spark, small, tmp_path, monkeypatch):
    """Half of all items have one value; parts have about as many rows all the same, and searches find what a scan finds."""
    monkeypatch.setattr(world_module, "PART_ROWS", 50)
    rare = [(i, "name", f"Street {i % 83} of Ward") for i in range(400)] + [(i, "x", v) for i, v in enumerate(["", "a", "ab", "AB", "abc", "ABC", "É", "né?", "x\x03", "\x02x"])]
    tags = spark.createDataFrame([(i, "kind", "House") for i in range(400)] + rare, "item_id long, k string, v string")
    plain = World(**{n: getattr(small, n) for n in World.names()} | {"tags": tags})
    plain.write(str(tmp_path / "world"))
    again = World.load(spark, str(tmp_path / "world"))
    sizes = [r["count"] for r in again.postings.groupBy("part").count().collect()]
    assert len(sizes) > 12 and max(sizes) < 100
    house = again.tag_values.filter("low = 'house'").first()
    assert house.n == 400 and house.last_part - house.first_part >= 7
    assert again.tag_values.count() == again.tag_values.select("value_id").distinct().count() == tags.select("v").distinct().count()
    for query in ("house", '"HOUSE"', "hou?", "?use", "street 7", "?ward", "s", "?d", "ab", '"ab"', "abc", "é", "né?", "?é", "reet 1", "x", "nothing here", "eet 80 of"):
        assert sorted(r.item_id for r in items.with_value(again, query).collect()) == sorted(r.item_id for r in items.with_value(plain, query).collect())
    plan = items.values_like(again, "reet 80")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "PushedFilters: [In(gram" in plan


def test_sub_hierarchy_of_hits(small):
    found = {r.region_id: tuple(r)[1:] for r in hits.sub_hierarchy(leaves.text(small, "bar", "items"), small).collect()}
    assert found == {1: (None, 1, 1, 0, 0), 2: (1, 1, 1, 1, 1)}
    assert hits.sub_hierarchy(leaves.cells(small, []), small).isEmpty()


def test_trees_of_any_depth(spark, small):
    r = random.Random(4)
    parent = {n: r.randrange(max(0, n - 3), n) if n else None for n in range(120)}  # some 60 levels
    edges = spark.createDataFrame(list(parent.items()), "node long, parent long")
    want = set()
    for n in parent:
        at, steps = parent[n], 1
        while at is not None:
            want.add((n, at, steps))
            at, steps = parent[at], steps + 1
    assert {tuple(x) for x in tree.above(edges).collect()} == want and max(s for *_, s in want) > 30
    assert tree.endless(edges).isEmpty() and tree.above(edges.limit(0)).isEmpty()
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, 6), (6, None), (7, 7)], "node long, parent long")
    assert {x.node for x in tree.endless(ring).collect()} == {1, 2, 3, 4, 7}
    with pytest.raises(ValueError):
        tree.above(ring)
    nodes = spark.createDataFrame([("a", None, "a"), ("a:b", "a", "b"), ("a:b:c", "a:b", "c"), ("a:b:c:d", "a:b:c", "d"), ("z", None, "z")], "path string, parent_path string, name string")
    assert {x.path: (x.ancestors, x.depth) for x in items.ancestors(nodes).collect()} == {"a": ("a", 1), "a:b": ("a,b", 2), "a:b:c": ("a,b,c", 3), "a:b:c:d": ("a,b,c,d", 4), "z": ("z", 1)}
    direct = spark.createDataFrame([(0, 3), (0, 2), (1, 2)], "cell_id long, region_id long")
    up = spark.createDataFrame([(3, 2), (2, 1), (1, None)], "node long, parent long")
    assert {tuple(x) for x in tree.closed(direct, up).collect()} == {(0, 3, True), (0, 2, True), (0, 1, False), (1, 2, True), (1, 1, False)}
    looped = World(**{n: getattr(small, n) for n in World.names()} | {"regions": small.regions.withColumn("parent_id", F.expr("IF(region_id = 1, 3L, parent_id)"))})
    assert {x.rule: x.violations for x in validate(looped).collect()}["regions above themselves"] == 3
