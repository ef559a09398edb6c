"""The curve, the layout of stored worlds, the way down the hierarchy, places in borders and corridors, against plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from terralex.functions import curve
from terralex.functions.geo import EARTH, Polygon, Rect, hull
from terralex.operators import hits, items, leaves, places
from terralex.sources.world import World

BOX = "min_lat double, max_lat double, min_lon double, max_lon double"


def some_shapes(r, n):
    for _ in range(n):
        lat, lon, size = r.uniform(-80, 80), r.uniform(-170, 170), r.choice([0.001, 0.5, 8, 60])
        dots = [(lat + r.uniform(-size, size), lon + r.uniform(-size, size)) for _ in range(6)]
        yield Rect.around(dots)
        yield Polygon(tuple(hull(dots)))
        yield Rect(lat, lat, lon, lon)


def test_cover_holds_all_boxes_that_touch(spark):
    r = random.Random(1)
    boxes = []
    for shape in [*some_shapes(r, 60)]:  # near the shapes, and of all sizes
        lat, lon = shape.first
        high, wide = r.choice([0, 1e-6, 0.01, 3, 90]), r.choice([0, 1e-6, 0.02, 7, 180])
        boxes += [(lat + r.uniform(-1, 1) * high, lon + r.uniform(-1, 1) * wide, high, wide) for _ in range(8)]
    boxes += [(0.0, 0.0, 0.0, 0.0), (-90.0, -180.0, 180.0, 360.0), (95.0, 170.0, 3.0, 30.0), (90.0, 180.0, 0.0, 0.0), (45.0, 90.0, 1e-9, 1e-9), (-0.5, -0.5, 1.0, 1.0)]
    rows = [(k, a, a + h, o, o + w) for k, (a, o, h, w) in enumerate(boxes)] + [(-1, None, 1.0, 2.0, 3.0)]
    placed = curve.with_place(spark.createDataFrame(rows, f"id long, {BOX}"))
    known = {x.id: x.place for x in placed.collect()}
    assert known.pop(-1) is None
    r = random.Random(1)
    shapes = [*some_shapes(r, 60), Rect(-90, 90, -180, 180), Rect(92, 99, 150, 190), Rect(0, 0, 0, 0)]
    seen = 0
    for shape in shapes:
        ranges = curve.cover(shape)
        assert len(ranges) < 250 and all(a <= b for a, b in ranges) and ranges == sorted(ranges)
        for k, a, b, o, p in rows[:-1]:
            if shape.touches(Rect(a, b, o, p)):
                seen += 1
                assert any(x <= known[k] <= y for x, y in ranges)
    assert seen > 300
    small = curve.cover(Rect(10, 10.01, 20, 20.01))
    assert sum(1 for p in known.values() if any(x <= p <= y for x, y in small)) < 0.7 * len(known)


def rows_read(found):
    """Rows that the scans of a plan gave."""
    found.collect()

    def walk(plan):
        kids = plan.children()
        own = plan.metrics().get("numOutputRows").get().value() if plan.nodeName().startswith("Scan parquet") else 0
        if plan.nodeName() == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            return walk(plan.plan())
        return own + sum(walk(kids.apply(i)) for i in range(kids.size()))

    return walk(found._jdf.queryExecution().executedPlan())


def test_a_small_shape_reads_few_row_groups(spark, tmp_path):
    n = 300
    cells = spark.range(n * n).select(F.col("id").alias("cell_id"), F.expr(f"(id div {n}) * 0.1D AS min_lat"), F.expr(f"(id div {n}) * 0.1D + 0.1D AS max_lat"), F.expr(f"(id % {n}) * 0.1D AS min_lon"), F.expr(f"(id % {n}) * 0.1D + 0.1D AS max_lon"))
    curve.laid_out(curve.with_place(cells)).write.option("parquet.block.size", 64 << 10).option("parquet.page.size", 8 << 10).parquet(str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    for shape in (Rect(3.03, 3.31, 7.02, 7.24), Polygon(((1.0, 1.0), (1.5, 1.1), (1.2, 1.7)))):
        found = curve.near(stored, shape).filter(F.expr(shape.meets_box(curve.box_columns())))
        assert "PushedFilters: [Or(" in found._jdf.queryExecution().executedPlan().toString() or "place" in found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1][:400]
        want = cells.filter(F.expr(shape.meets_box(curve.box_columns()))).count()
        assert found.count() == want > 5 and rows_read(found) < n * n / 5


@pytest.fixture(scope="module")
def nested(spark, tmp_path_factory):
    """A world of three levels of regions over a 16 x 16 grid of cells in borders like kites, with strays, stored."""
    r, make = random.Random(9), spark.createDataFrame
    cells, parents, borders = [], [], []
    for c in range(256):
        y, x = divmod(c, 16)
        cells.append((c, float(y), float(y + 1), float(x), float(x + 1)))
        borders += [(c, k, *p) for k, p in enumerate([(y, x + 0.5), (y + 0.5, x + 1), (y + 1.0, x + 0.5), (y + 0.5, float(x))])]
        if c % 29:
            chain = [1000 + (y // 4) * 4 + x // 4, 100 + (y // 8) * 2 + x // 8, 1]
            parents += [(c, p, k == 0) for k, p in enumerate(chain)]
    regions = [(1, None)] + [(100 + k, 1) for k in range(4)] + [(1000 + k, 100 + (k // 8) * 2 + k % 4 // 2) for k in range(16)]
    spots = [(5000 + k, 0, r.uniform(0, 16), r.uniform(0, 16)) for k in range(300)]
    ways = [(9000 + k, p, 3.0 + k + p, 2.0 + 3 * p) for k in range(5) for p in range(3)]
    of = lambda a, o: int(a) * 16 + int(o)
    world = World(
        items=make([(i, 3, True, "POLYGON", 0) for i, _ in regions] + [(i, 1, False, "POINT", 0) for i, *_ in spots] + [(9000 + k, 2, False, "WAY", 0) for k in range(5)], "item_id long, osm_type int, is_region boolean, shape string, score int"),
        points=make(spots + ways, "item_id long, pos int, lat double, lon double"),
        regions=make([(i, p, str(i), 0.0, 1.0, 0.0, 1.0) for i, p in regions], f"region_id long, parent_id long, name string, {BOX}"),
        cells=make(cells, f"cell_id long, {BOX}"),
        cell_edges=make([(0, 1), (1, 0)], "src long, dst long"),
        cell_parents=make(parents, "cell_id long, region_id long, direct boolean"),
        cell_items=make(sorted({(of(a, o), i) for i, _, a, o in spots + ways}), "cell_id long, item_id long"),
        tags=make([(5000, "k", "v")], "item_id long, k string, v string"),
        borders=make([(c, k, float(a), float(o)) for c, k, a, o in borders], "cell_id long, pos int, lat double, lon double"),
    )
    folder = str(tmp_path_factory.mktemp("worlds") / "nested")
    world.write(folder)
    return world, World.load(spark, folder)


SHAPES = [Rect(1.5, 9.5, 0.5, 12.2), Rect(-1, 20, -1, 20), Rect(3.2, 3.3, 4.1, 4.2), Polygon(((0.5, 0.5), (14.5, 2.0), (9.0, 13.0))), Polygon(((-1.0, -1.0), (8.5, -1.0), (8.5, 17.0), (-1.0, 17.0))), Rect(50, 51, 50, 51)]


def spelt(found):
    return sorted((r.cell_id, -1 if r.item_id is None else r.item_id) for r in found.collect())


def test_down_the_hierarchy_as_flat(nested):
    flat, stored = nested
    assert flat.region_cells is None and stored.region_cells is not None
    for shape in SHAPES:
        rows = lambda w: sorted(tuple(r) for r in leaves.met_cells(w, shape).collect())  # noqa: E731, B023
        assert rows(stored) == rows(flat)
        for accuracy in ("poly-item", "poly-itembbox", "poly-cell"):
            assert spelt(leaves.area(stored, shape, accuracy)) == spelt(leaves.area(flat, shape, accuracy))


def test_enclosed_regions_are_not_tested_cell_by_cell(nested):
    _, stored = nested
    shape = SHAPES[4]
    covers = curve.near(stored.region_covers, shape).filter(F.expr(shape.meets_box(curve.box_columns()))).select("region_id", F.expr(shape.encloses_box(curve.box_columns())).alias("enclosed"))
    tested = stored.region_cells.join(covers, "region_id").filter("NOT enclosed AND direct").count()
    met = leaves.met_cells(stored, shape).count()
    assert met > 130 and tested <= 64 and {r.region_id for r in covers.filter("enclosed").collect()} >= {100, 101}


def test_items_of_a_stored_world_as_planned(nested):
    flat, stored = nested
    for shape in SHAPES:
        for exact in (True, False):
            ids = lambda w: sorted(r.item_id for r in items.meeting(w, shape, exact).collect())  # noqa: E731, B023
            assert ids(stored) == ids(flat)
    assert {r.kind for r in stored.segments.select("kind").distinct().collect()} == {0, 1, 2}
    assert sorted(r.item_id for r in items.holding(stored, (0.5, 0.5)).collect()) == sorted(r.item_id for r in items.holding(flat, (0.5, 0.5)).collect())


def test_places_in_borders(spark, nested):
    flat, stored = nested
    r = random.Random(2)
    spots = [(k, r.uniform(-1, 17), r.uniform(-1, 17)) for k in range(400)] + [(900, 0.0, 0.5), (901, 1.0, 0.5), (902, 0.5, 1.0), (903, 0.5, 0.0), (904, 0.5, 0.5), (905, None, 1.0), (906, 95.0, 1.0)]
    df = spark.createDataFrame(spots, "ring long, lat double, lon double")  # a column of a clashing name
    inside = lambda a, o: abs(a - math.floor(a) - 0.5) + abs(o - math.floor(o) - 0.5)
    got = {(x.ring, x.cell_id) for x in places.locate(stored, df).collect()}
    for k, a, o in spots[:400]:
        want = {(k, math.floor(a) * 16 + math.floor(o))} if 0 <= a < 16 and 0 <= o < 16 and inside(a, o) < 0.5 else set()
        assert {g for g in got if g[0] == k} == want
    assert {g for g in got if g[0] >= 900} == {(x.ring, x.cell_id) for x in places.locate(flat, df).collect() if x.ring >= 900} and (904, 0) in got and not any(g[0] in (905, 906) for g in got)
    assert [x.cell_id for x in leaves.cell_at(stored, 0.5, 0.5).collect()] == [0] and leaves.cell_at(stored, 0.05, 0.05).isEmpty()


def test_a_gapless_net_gives_each_place_one_cell(spark, nested):
    """Triangles that halve squares along their diagonal; also places on the diagonals and corners."""
    flat, _ = nested
    cells, borders = [], []
    for c in range(100):
        y, x = divmod(c, 10)
        low, high = [(y, x), (y, x + 1), (y + 1, x)], [(y + 1, x + 1), (y + 1, x), (y, x + 1)]
        for n, ring in ((2 * c, low), (2 * c + 1, high)):
            cells.append((n, y / 7, (y + 1) / 7, x / 7, (x + 1) / 7))
            borders += [(n, k, a / 7, o / 7) for k, (a, o) in enumerate(ring)]
    make = spark.createDataFrame
    net = World(**{n: getattr(flat, n) for n in World.names()} | {"cells": make(cells, f"cell_id long, {BOX}"), "borders": make(borders, "cell_id long, pos int, lat double, lon double")})
    spots = [(k, (k % 61) / 61 * 9.5 / 7, (k // 61) / 61 * 9.5 / 7) for k in range(61 * 61)] + [(5000 + k, (k // 20) / 14, (k % 20) / 14) for k in range(400)]
    got = places.locate(net, make(spots, "id long, lat double, lon double")).groupBy("id").count().collect()
    assert len(got) == len(spots) and {x["count"] for x in got} == {1}


def test_corridor_against_dense_points(nested):
    _, stored = nested
    line, lat0 = [(7.99, 7.99), (8.002, 8.004), (8.01, 8.006)], 8.0
    metres = lambda a, b: math.hypot((a[0] - b[0]) * math.radians(1) * EARTH, (a[1] - b[1]) * math.radians(1) * EARTH * math.cos(math.radians(lat0)))
    dense = [(p[0] + t / 50 * (q[0] - p[0]), p[1] + t / 50 * (q[1] - p[1])) for p, q in zip(line, line[1:]) for t in range(51)]

    def gap(c):
        y, x = divmod(c, 16)
        ring = [(y, x + 0.5), (y + 0.5, x + 1), (y + 1, x + 0.5), (y + 0.5, x)]
        return min(metres(d, (a[0] + t / 800 * (b[0] - a[0]), a[1] + t / 800 * (b[1] - a[1]))) for a, b in zip(ring, ring[1:] + ring[:1]) for t in range(801) for d in dense[::5])

    near = {c: gap(c) for c in (118, 119, 120, 134, 135, 136, 137, 152)}
    for radius in (1000.0, 4990.0):
        got = {r.cell_id for r in leaves.path(stored, line, radius).collect()}
        assert {c for c, g in near.items() if g < radius - 150} <= got and not {c for c, g in near.items() if g > radius + 150} & got
    wide = {r.cell_id for r in leaves.path(stored, line, 5000.0).collect()}  # no longer short: discs of whole cells
    assert len(wide) > len({r.cell_id for r in leaves.path(stored, line, 4999.0).collect()})
    across = [(8.3, 8.49), (8.3, 8.5), (8.3, 8.51)]  # inside one border, far from its edges
    assert spelt(leaves.path(stored, across, 500.0)) == [(136, -1)]
    long = [(7.9, 7.9), (8.0, 8.0), (8.1, 8.1)]
    assert spelt(leaves.path(stored, long)) == spelt(leaves.crossed(stored, long)) and hits.full_cells(leaves.path(stored, long, 10.0)).count() >= 2
