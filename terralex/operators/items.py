"""Items: projections, predicates, and searches that give sets of items.

A set of items is a DataFrame with item_id. Predicates are columns, so Spark prunes and pushes down."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex.functions.curve import BEYOND
from terralex.functions.geo import Point, Rect, Shape, box_columns
from terralex.functions.text import BEGIN, matches, needed_trigrams
from terralex.operators import tree
from terralex.operators.places import nested_rings
from terralex.sources.world import World, rings


def lookup(world: World, *item_ids: int) -> DataFrame:
    """Rows of these ids; unknown ids have none."""
    return world.items.filter(F.col("item_id").isin(*item_ids))


def of_ids(world: World, ids: DataFrame) -> DataFrame:
    return world.items.join(ids.select("item_id").distinct(), "item_id", "left_semi")


def all_tags(world: World) -> DataFrame:
    """item_id, tags: ``k=v`` in order, comma-separated."""
    return world.tags.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "k", "v"))), ", ").alias("tags"))


def geometry_text(world: World) -> DataFrame:
    """item_id, wkt: points, ways and areas as well-known text, to a thousandth of a degree; an area of several outer rings is a MULTIPOLYGON, holes follow the ring that they are cut from.
    An item's vertices meet in one row."""
    place = F.format_string("%.3f %.3f", "lon", "lat")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", place.alias("place")))), lambda p: p["place"])
    lines = world.points.groupBy("item_id").agg(ordered.alias("places")).select(
        "item_id", F.concat(F.when(F.size("places") == 1, "POINT (").otherwise("LINESTRING ("), F.array_join("places", ", "), F.lit(")")).alias("wkt")
    )
    closed = F.transform(F.array_sort(F.collect_list(F.struct("pos", place.alias("place")))), lambda p: p["place"])
    own = rings(world).groupBy("item_id", "ring").agg(closed.alias("places")).select("item_id", "ring", F.concat(F.lit("("), F.array_join(F.concat("places", F.slice("places", 1, 1)), ", "), F.lit(")")).alias("text"))
    nested = own if world.outlines is None else own.join(nested_rings(world.outlines), ["item_id", "ring"], "left")
    nested = nested.withColumn("within", F.coalesce("within", "ring") if "within" in nested.columns else F.col("ring"))
    listed = lambda *by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, "text"))), lambda r: r["text"]), ", ")
    outer = nested.groupBy("item_id", "within").agg(F.concat(F.lit("("), listed((F.col("ring") != F.col("within")).alias("hole"), "ring"), F.lit(")")).alias("text"))
    areas = outer.groupBy("item_id").agg(F.count("*").alias("n"), listed("within").alias("all"))
    areas = areas.select("item_id", F.when(F.col("n") == 1, F.concat(F.lit("POLYGON "), "all")).otherwise(F.concat(F.lit("MULTIPOLYGON ("), "all", F.lit(")"))).alias("wkt"))
    return lines.unionByName(areas)


def broken_tags(world: World) -> DataFrame:
    """Tags without a key or a value."""
    return world.tags.filter("k IS NULL OR k = '' OR v IS NULL")


def boxes(world: World) -> DataFrame:
    """item_id and bounding box of every item with a shape."""
    return world.table("item_boxes")


def boundary(world: World) -> DataFrame:
    """One row: the box of all shapes."""
    return boxes(world).agg(F.min("min_lat").alias("min_lat"), F.max("max_lat").alias("max_lat"), F.min("min_lon").alias("min_lon"), F.max("max_lon").alias("max_lon"))


def _held(world: World, areas: DataFrame, point: Point) -> DataFrame:
    """Of these areas (item_id) those whose rings lie an odd number of times east of the point."""
    lat, lon = (f"CAST({float(x)!r} AS DOUBLE)" for x in point)
    east = world.near("segments", Rect(point[0], point[0], point[1], BEYOND)).filter("kind = 2").join(areas.select("item_id"), "item_id", "left_semi")
    crossed = f"(lat <= {lat}) <> (to_lat <= {lat}) AND {lon} < lon + ({lat} - lat) * (to_lon - lon) / (to_lat - lat)"
    return east.filter(crossed).groupBy("item_id").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("item_id")


def _boxes_at(world: World, point: Point) -> DataFrame:
    lat, lon = point
    spot = Rect(lat, lat, lon, lon)
    return world.near("item_boxes", spot).filter(F.expr(spot.meets_box(box_columns())))


def holding(world: World, point: Point) -> DataFrame:
    """Areas that hold the point."""
    return _held(world, _boxes_at(world, point), point)


def meeting(world: World, shape: Shape, exact: bool = True) -> DataFrame:
    """Items whose shape meets the query's; exact=False compares boxes of items. Of a stored world only ranges of the curve near the shape are read.

    Exact: a lone point lies in the query, a segment of a way or ring meets it, or an area holds all of the query, so its first vertex."""
    if not exact:
        return world.near("item_boxes", shape).filter(F.expr(shape.meets_box(box_columns()))).select("item_id")
    test = f"IF(kind = 0, {shape.contains('lat', 'lon')}, {shape.meets_segment(('lat', 'lon'), ('to_lat', 'to_lon'))})"
    met = world.near("segments", shape).filter(F.expr(test)).select("item_id")
    return met.unionByName(_held(world, _boxes_at(world, shape.first), shape.first)).distinct()


def in_rect(world: World, rect: Rect, among: DataFrame | None = None) -> DataFrame:
    """Items that meet the rectangle, among others if given."""
    found = meeting(world, rect)
    return found if among is None else found.join(among.select("item_id"), "item_id", "left_semi")


def values_like(world: World, query: str) -> DataFrame:
    """Rows of a stored dictionary whose value matches. What a value begins with is found by its order, anything else of three letters or more by the
    trigrams that it must have, so only values with all of them are read and compared; shorter queries compare all values."""
    values, grams = world.tag_values, needed_trigrams(query)
    if grams and world.value_grams is not None and not grams[0].startswith(BEGIN):
        having = world.value_grams.filter(F.col("gram").isin(*grams)).groupBy("chunk", "value_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
        values = values.join(having.select("chunk", "value_id"), ["chunk", "value_id"], "left_semi")
    return values.filter(matches("low", query))


def with_value(world: World, query: str) -> DataFrame:
    """Items with a tag whose value matches. Of a stored world only the parts of the index that the matching values name are read."""
    if world.postings is None or world.tag_values is None:
        return world.tags.filter(F.col("v").isNotNull()).withColumn("low", F.lower("v")).filter(matches("low", query)).select("item_id").distinct()
    found = values_like(world, query).select("value_id", F.explode(F.sequence("first_part", "last_part")).alias("part"))
    return world.postings.join(found, ["part", "value_id"], "left_semi").select("item_id").distinct()


def with_key(world: World, keys: Iterable[str]) -> DataFrame:
    """Items with a tag of one of these keys."""
    return world.tags.filter(F.col("k").isin(*keys)).select("item_id").distinct()


def with_tag(world: World, k: str, v: str) -> DataFrame:
    return world.tags.filter((F.col("k") == k) & (F.col("v") == v)).select("item_id").distinct()


def store_stats(world: World) -> DataFrame:
    """One row of sizes."""
    items = world.items.agg(
        F.count("*").alias("items"), F.count(F.when(F.col("is_region"), 1)).alias("regions"), *(F.count(F.when(F.col("shape") == s.upper(), 1)).alias(f"{s}s") for s in ("point", "way", "polygon"))
    )
    tags = world.tags.agg(F.count("*").alias("tags"), F.sum(F.octet_length("k") + F.octet_length("v")).alias("tag_bytes"))
    return items.crossJoin(tags).crossJoin(world.points.agg(F.count("*").alias("vertices")))  # one row each


def complete(required: list[DataFrame], excluded: list[DataFrame] = (), predicate: Column | None = None, limit: int | None = None) -> DataFrame:
    """Items in all of required and none of excluded, by id, the first ``limit`` of them. Nothing required: no items."""
    if not required:
        raise ValueError("a search needs a positive term")
    out = required[0].select("item_id")
    for other in required[1:]:
        out = out.join(other.select("item_id"), "item_id", "left_semi")
    for other in excluded:
        out = out.join(other.select("item_id"), "item_id", "left_anti")
    out = out.filter(predicate) if predicate is not None else out
    out = out.distinct()
    return out if limit is None else out.orderBy("item_id").limit(limit)


# ---- the tree of tags: a key, and under it key:value


def tag_nodes(world: World) -> DataFrame:
    """path, parent_path, name."""
    keys = world.tags.select(F.col("k").alias("path"), F.lit(None).cast("string").alias("parent_path"), F.col("k").alias("name"))
    return keys.unionByName(world.tags.select(F.concat_ws(":", "k", "v").alias("path"), F.col("k").alias("parent_path"), F.col("v").alias("name"))).distinct()


def of_tag_nodes(world: World, *paths: tuple[str, ...]) -> DataFrame:
    """Items of any of the nodes, each given by its names from the root: (key,) or (key, value)."""
    tests = [F.col("k") == p[0] if len(p) == 1 else (F.col("k") == p[0]) & (F.col("v") == p[1]) for p in paths]
    test = tests[0]
    for other in tests[1:]:
        test = test | other
    return world.tags.filter(test).select("item_id").distinct()


def ancestors(nodes: DataFrame) -> DataFrame:
    """path, ancestors (names from the root, comma-separated), depth, of a tree (path, parent_path, name) of any depth."""
    higher = tree.above(nodes.select(F.col("path").alias("node"), F.col("parent_path").alias("parent"))).join(nodes.select(F.col("path").alias("above"), "name"), "above")
    chains = nodes.select("path", F.lit(0).alias("steps"), "name").unionByName(higher.select(F.col("node").alias("path"), "steps", "name"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("place"), "name"))), lambda n: n["name"])  # as many as the tree is deep
    return chains.groupBy("path").agg(F.array_join(ordered, ",").alias("ancestors"), F.count("*").cast("int").alias("depth"))


def of_phrases(world: World, *phrases: str) -> DataFrame:
    """Items whose tags any of the phrases stands for; case doesn't count."""
    named = world.phrases.filter(F.col("phrase").isin(*(p.lower() for p in phrases))).select("k", "v")
    return world.tags.join(named, ["k", "v"], "left_semi").select("item_id").distinct()


def search(world: World, query: str) -> DataFrame:
    """Items with a matching value, or whose tags the query as a phrase stands for, where the world has phrases."""
    found = with_value(world, query)
    return found if world.phrases is None else found.unionByName(of_phrases(world, query.strip('"?'))).distinct()


def tag_stats(world: World) -> DataFrame:
    """One row: nodes of the tag tree, roots, phrases and the tags that phrases stand for."""
    nodes = tag_nodes(world).agg(F.count("*").alias("nodes"), F.count(F.when(F.col("parent_path").isNull(), 1)).alias("roots"))
    if world.phrases is None:
        return nodes.withColumn("phrases", F.lit(0).cast("bigint")).withColumn("mapped", F.lit(0).cast("bigint"))
    return nodes.crossJoin(world.phrases.agg(F.countDistinct("phrase").alias("phrases"), F.countDistinct("k", "v").alias("mapped")))  # one row each
