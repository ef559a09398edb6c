"""Distances between cells, and growing hits by them.

A cell counts as a disc: its centre and a radius that depends on the metric. Cells near others are found by an
equi-join over buckets of latitude and longitude that are as wide as the reach, so no pair further
than two buckets apart is ever made. Reaches come in classes by powers of two, so one huge cell widens no bucket but its own.
"""

from __future__ import annotations

from typing import Literal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.functions.circles import min_annulus, min_circle
from terralex.functions.geo import EARTH, haversine
from terralex.operators import hits
from terralex.sources.world import World, cell_borders, reaching

Metric = Literal["center", "sphere", "min_sphere", "annulus"]


def _centres(group: pd.DataFrame, metric: Metric) -> pd.DataFrame:
    points = group[["lat", "lon"]].to_numpy()
    lat, lon = (min_annulus if metric == "annulus" else min_circle)(points)
    return pd.DataFrame({"cell_id": group["cell_id"].iloc[:1], "lat": lat, "lon": lon})


def discs(world: World, metric: Metric = "sphere") -> DataFrame:
    """cell_id, lat, lon, radius, inner: the disc of each cell around the vertices of its border, degrees as a plane for centres.

    center: the middle of its box, no radius. sphere: the mean of the vertices, stored with a world. min_sphere: the smallest circle. annulus: the
    annulus with the least area. Radius and inner radius are those of the furthest and of the nearest vertex."""
    if metric == "center":
        return world.cells.select("cell_id", F.expr("(min_lat+max_lat)/2 AS lat"), F.expr("(min_lon+max_lon)/2 AS lon"), F.lit(0.0).alias("radius"), F.lit(0.0).alias("inner"))
    if metric == "sphere":
        return world.table("cell_discs").select("cell_id", "lat", "lon", "radius", "inner")
    own = cell_borders(world).select("cell_id", "lat", "lon").distinct()
    return reaching(own, own.groupBy("cell_id").applyInPandas(lambda g: _centres(g, metric), "cell_id long, lat double, lon double"))


def between_cells(metric_discs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) of cells -> a, b, metres: 0 where the discs touch."""
    left = metric_discs.select(F.col("cell_id").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("radius").alias("r1"))
    right = metric_discs.select(F.col("cell_id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("radius").alias("r2"))
    gap = F.expr(f"GREATEST(0.0, {haversine('lat1', 'lon1', 'lat2', 'lon2')} - r1 - r2)")
    return pairs.join(left, "a").join(right, "b").select("a", "b", gap.alias("metres"))


def to_point(metric_discs: DataFrame, lat: float, lon: float) -> DataFrame:
    """cell_id, metres from a point."""
    gap = haversine("lat", "lon", f"CAST({float(lat)!r} AS DOUBLE)", f"CAST({float(lon)!r} AS DOUBLE)")
    return metric_discs.select("cell_id", F.expr(f"GREATEST(0.0, {gap} - radius)").alias("metres"))


LEAST, CLASSES = 1000.0, 16  # the radius of the first class in metres, and how many classes there are up to half of the globe


def _slotted(cells: DataFrame, radius: float, bands: int) -> DataFrame:
    """cells (lat, lon, at: the class of the pair) with band and slot, those up to ``bands`` beside their own too."""
    step = F.expr(f"DEGREES(({float(radius)!r}D + {2 * LEAST!r}D * POWER(2, at)) / {EARTH!r}D)")
    own = cells.withColumn("step", F.greatest(F.lit(1e-6), step)).withColumn("own", F.floor(F.col("lat") / F.col("step")).cast("bigint"))
    own = own.withColumn("band", F.explode(F.sequence(F.col("own") - bands, F.col("own") + bands)))
    top = "LEAST(90.0D, (GREATEST(ABS(band), ABS(band + 1)) + 1) * step)"
    own = own.withColumn("slots", F.expr(f"GREATEST(1, CAST(FLOOR(360 * COS(RADIANS({top})) / (1.6D * step)) AS BIGINT))"))  # 1.6: an arc is at most pi/2 chords
    slot = F.expr("CAST(FLOOR((lon + 180) * slots / 360) AS BIGINT)")
    around = F.array_distinct(F.transform(F.array(*map(F.lit, range(-bands, bands + 1))), lambda i: F.pmod(slot + i, F.col("slots"))))
    return own.withColumn("slot", F.explode(around)).drop("step", "own", "slots")


def within(near: DataFrame, metric_discs: DataFrame, radius: float) -> DataFrame:
    """a, b, metres: each cell a of near (cell_id) with each other cell b at most radius metres away.

    A pair belongs to the class of the larger disc. A band is as high as the reach of its class; its buckets are wide enough that a partner is in a neighbour at most."""
    kind = F.expr(f"CAST(LEAST({CLASSES - 1}, GREATEST(0, CEIL(LOG2(GREATEST(radius, 1D) / {LEAST!r}D)))) AS INT)")
    known = metric_discs.withColumn("class", kind)
    classes = F.broadcast(known.select(F.col("class").alias("at")).distinct())  # at most CLASSES rows
    theirs = known.select("class", F.col("cell_id").alias("b"), "lat", "lon", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("radius").alias("r2"))
    mine = known.join(near.select("cell_id").distinct(), "cell_id", "left_semi").select("class", F.col("cell_id").alias("a"), "lat", "lon", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("radius").alias("r1"))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        plain = ("class", "lat", "lon")
        found = _slotted(left, radius, 1).drop(*plain).join(_slotted(right, radius, 0).drop(*plain), ["at", "band", "slot"])
        gap = F.expr(f"GREATEST(0.0, {haversine('lat1', 'lon1', 'lat2', 'lon2')} - r1 - r2)")
        return found.filter("a <> b").select("a", "b", gap.alias("metres")).filter(F.col("metres") <= radius)

    alike = met(mine.join(classes, F.expr("at >= class")), theirs.withColumn("at", F.col("class")))
    return alike.unionByName(met(mine.withColumn("at", F.col("class")), theirs.join(classes, F.expr("at > class"))))


def neighbours(world: World, threshold: float, metric: Metric = "sphere") -> DataFrame:
    """All pairs of cells up to threshold metres apart, both ways: write it once and give it to dilate()."""
    return within(world.cells, discs(world, metric), threshold)


def dilate(found: DataFrame, world: World, radius: float, metric: Metric = "sphere", known: DataFrame | None = None) -> DataFrame:
    """Hits, and as full hits all cells at most radius metres from a hit cell. known: neighbours() up to at least radius."""
    if known is None:
        close = within(hits.cells_of(found), discs(world, metric), radius)
    else:
        close = known.filter(F.col("metres") <= radius).join(hits.cells_of(found).withColumnRenamed("cell_id", "a"), "a", "left_semi")
    return hits.union(found, hits.of_cells(close.select(F.col("b").alias("cell_id"))))
