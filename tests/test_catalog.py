from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from terralex import catalog
from terralex.functions.geo import Rect
from terralex.operators import coverage, distance, hits, leaves, stats
from terralex.sources import fixtures
from terralex.sources.fixtures import SOURCES

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
#: Some of each kind, as planning takes seconds a query; TERRALEX_ALL=1 compares all that have SQL.
SOME = [
    "tags_concat", "geometry_text", "rect_filter_partner", "item_search", "tag_stats", "world_written", "leaf_text", "leaf_rect_item_boxes", "leaf_polygon_exact", "leaf_polygon_box_items", "leaf_point",
    "cqr_union", "cqr_intersect", "cqr_difference", "cqr_symdiff", "region_item_coverage", "between_regions", "cell_dilation", "sphere_distance", "annulus", "min_sphere", "minimum_slice", "kv_overlap", "facets",
]
COMPARED = sorted(SQL) if os.environ.get("TERRALEX_ALL") else SOME


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in SOURCES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", COMPARED)
def test_same_rows_as_sql(spark, data, duck, name):
    found = QUERIES[name](spark, data)
    columns = sorted(found.columns)
    answer = duck.execute(SQL[name])
    at = [[c[0] for c in answer.description].index(c) for c in columns]
    assert sorted(map(repr, (tuple(r) for r in found.select(*columns).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in answer.fetchall())


def test_between_regions_has_neither(spark, data):
    world = fixtures.world(spark, data)
    found = {r.cell_id for r in coverage.between(leaves.region(world, 5), leaves.region(world, 29), world).collect()}
    own = {r.cell_id for i in (5, 29) for r in leaves.region(world, i).collect()}
    assert found and not found & own


def test_set_operators_read_each_side_once(spark, data):
    plan = QUERIES["cqr_symdiff"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") < 60 and plan.count("Join ") < 30


def test_nothing_hit_stays_nothing(spark, data):
    world = fixtures.world(spark, data)
    none = leaves.cells(world, [])
    assert coverage.dominant(none, world) is None
    assert coverage.compass(none, world, "north").isEmpty() and coverage.between(none, none, world).isEmpty()
    assert coverage.compass(leaves.region(world, 7), world, "up").isEmpty()
    assert distance.dilate(none, world, 1e5).isEmpty() and hits.by_region(none, world).isEmpty()


def test_known_neighbours_dilate_alike(spark, data):
    world = fixtures.world(spark, data)
    near = leaves.cells(world, [3, 200])
    known = distance.neighbours(world, 400_000.0)
    rows = lambda df: sorted(r.cell_id for r in df.collect())
    assert rows(distance.dilate(near, world, 250_000.0)) == rows(distance.dilate(near, world, 250_000.0, known=known))


def test_beside_is_asymmetric():
    north, south = coverage.beside(Rect(0, 1, 0, 1), "north").box, coverage.beside(Rect(0, 1, 0, 1), "south").box
    assert (north.min_lat, north.max_lat) == (0.5, 2.5) and (south.min_lat, south.max_lat) == (-2.0, 0.0)


def test_disjoint_top(spark):
    rows = [(i, "a", "x") for i in range(6)] + [(i, "b", "y") for i in range(5)] + [(i, "c", "z") for i in range(10, 14)] + [(i, "d", "w") for i in range(20, 23)]
    tags = spark.createDataFrame(rows, "item_id long, k string, v string")
    assert stats.disjoint_top(tags, 3) == [("a", "x", 6), ("c", "z", 4), ("d", "w", 3)]
    assert stats.disjoint_top(tags.filter("k IN ('a', 'b')"), 3) == []


def brute_disjoint(rows, k):
    items = {}
    for i, *tag in rows:
        items.setdefault(tuple(tag), set()).add(i)
    ranked = sorted(items, key=lambda t: (-len(items[t]), t))
    apart = lambda a, b: len(items[a] & items[b]) <= (len(items[a]) + len(items[b])) / 200
    two = next(((b, a) for i, a in enumerate(ranked) for b in ranked[:i] if apart(a, b)), None)
    if two is None:
        return []
    chosen = list(two)
    for tag in ranked[ranked.index(two[1]) + 1 :]:
        if all(apart(tag, c) for c in chosen):
            chosen.append(tag)
    return [(*t, len(items[t])) for t in chosen[:k]]


def test_disjoint_top_goes_through_all_tags(spark):
    inside = [(i, "in", f"{j:02}") for j in range(30) for i in range(100 - j)]  # overlap one another
    apart = [(i, "out", "a") for i in range(1000, 1005)] + [(2000, "out", "b")]
    nearly = [(i, "near", "n") for i in (99, *range(3000, 3064))]  # shares one item with the first: more than (100 + 65) // 200
    wide = [(i, "wide", "w") for i in range(5000, 5500)] + [(i, "wide", "v") for i in range(5499, 5900)] + [(i, "wide", "u") for i in range(5898, 6200)]
    for rows, k, candidates in ((inside + apart, 3, 4), (inside + apart, 9, 200), (inside + apart + nearly, 9, 3), (wide, 3, 200), (wide + inside + apart, 9, 2), (inside, 3, 4)):
        tags = spark.createDataFrame(rows, "item_id long, k string, v string")
        assert stats.disjoint_top(tags, k, candidates) == brute_disjoint(rows, k)
    assert brute_disjoint(inside + apart, 3) == [("in", "00", 100), ("out", "a", 5), ("out", "b", 1)] and len(brute_disjoint(wide, 3)) == 3


def test_tasks_that_group_by_item_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(stats, "FEW", 50)
    rows = [(i, "k", str(j)) for i in range(200) for j in range(4)] * 2 + [(None, "k", "0"), (None, "k", "1")]
    tags = spark.createDataFrame(rows, "item_id long, k string, v string").repartition(3)
    sets = stats.item_sets(tags, len(rows))
    held = sets.select(F.spark_partition_id().alias("task"), F.size("own").alias("n")).groupBy("task").sum("n").collect()
    assert len(held) > 20 and max(r[1] for r in held) < 100 and sum(r[1] for r in held) == 800
    counts = {(r.v, r.v2): r.n for r in stats.overlaps(tags, F.broadcast(stats.top(stats.pair_counts(tags), 3))).collect()}
    assert counts == {("0", "1"): 200, ("0", "2"): 200, ("1", "2"): 200}


def test_items_meet_once(spark, data):
    """All tags of frequent values in one task was what a join by tag made of kv_overlap and disjoint_topk."""
    plan = QUERIES["kv_overlap"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(item_id") == 1
