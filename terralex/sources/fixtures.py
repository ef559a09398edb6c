"""A world over the driver's order tables; the same SQL for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from terralex.sources.scratch import exists, guard, new_path
from terralex.sources.world import DERIVED, World, stored

SOURCES = ("region", "nation", "customer", "supplier", "orders")

#: A region's ring in its box, latitude and longitude: five corners, in the order in which longitude runs ahead of latitude.
HIGH, WIDE = "(max_lat-min_lat)", "(max_lon-min_lon)"
RING = [
    ("min_lat", f"min_lon+CAST(0.2 AS DOUBLE)*{WIDE}"),
    (f"min_lat+CAST(0.3 AS DOUBLE)*{HIGH}", "min_lon"),
    ("max_lat", f"min_lon+CAST(0.5 AS DOUBLE)*{WIDE}"),
    (f"min_lat+CAST(0.6 AS DOUBLE)*{HIGH}", "max_lon"),
    ("min_lat", "max_lon"),
]
#: A cell's border in its box: a triangle, obtuse in every other cell.
BORDER = [
    ("min_lat", "min_lon"),
    ("max_lat", f"min_lon+CASE WHEN cell_id%2=0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END*{WIDE}"),
    (f"min_lat+CASE WHEN cell_id%2=0 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END*{HIGH}", f"min_lon+CASE WHEN cell_id%2=0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END*{WIDE}"),
]

VIEWS = {
    "fx_item": """
        SELECT CAST(r_regionkey AS BIGINT) AS item_id, 3 AS osm_type, TRUE AS is_region, 'POLYGON' AS shape, 0 AS score FROM region
        UNION ALL SELECT CAST(5+n_nationkey AS BIGINT),3,TRUE,'POLYGON',0 FROM nation
        UNION ALL SELECT 30+c_custkey,1,FALSE,'POINT',CAST(FLOOR(ABS(c_acctbal)) AS INT) FROM customer
        UNION ALL SELECT 1000000000+s_suppkey,2,FALSE,'WAY',CAST(FLOOR(ABS(s_acctbal)) AS INT) FROM supplier""",
    "fx_spot": """
        SELECT 30+c_custkey AS item_id, 0 AS pos, n AS nat, a AS oa, o AS oo FROM (SELECT c_custkey, c_nationkey AS n, (c_custkey*7919)%10000 AS a,(c_custkey*104729)%10000 AS o FROM customer) t
        UNION ALL SELECT 1000000000+s_suppkey,0,s_nationkey,(s_suppkey*7919)%10000,(s_suppkey*104729)%10000 FROM supplier
        UNION ALL SELECT 1000000000+s_suppkey,1,s_nationkey,(s_suppkey*6151)%10000,(s_suppkey*3571)%10000 FROM supplier""",
    "fx_point": """
        SELECT item_id, pos, CAST(-25+10*(nat%5) AS DOUBLE)+CAST(oa AS DOUBLE)/CAST(1000 AS DOUBLE) AS lat, CAST(-25+10*FLOOR(nat/5.0) AS DOUBLE)+CAST(oo AS DOUBLE)/CAST(1000 AS DOUBLE) AS lon FROM fx_spot""",
    "fx_region": """
        SELECT CAST(r_regionkey AS BIGINT) AS region_id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name, CAST(-25.0+10*r_regionkey AS DOUBLE) AS min_lat, CAST(-15.0+10*r_regionkey AS DOUBLE) AS max_lat, CAST(-25.0 AS DOUBLE) AS min_lon, CAST(25.0 AS DOUBLE) AS max_lon FROM region
        UNION ALL SELECT CAST(5+n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), n_name, CAST(-25.0+10*(n_nationkey%5) AS DOUBLE), CAST(-15.0+10*(n_nationkey%5) AS DOUBLE), CAST(-25.0+10*FLOOR(n_nationkey/5.0) AS DOUBLE), CAST(-15.0+10*FLOOR(n_nationkey/5.0) AS DOUBLE) FROM nation""",
    "fx_outline": " UNION ALL ".join(f"SELECT region_id AS item_id, 0 AS ring, {k} AS pos, {lat} AS lat, {lon} AS lon FROM fx_region" for k, (lat, lon) in enumerate(RING)),
    "fx_border": " UNION ALL ".join(f"SELECT cell_id, {k} AS pos, {lat} AS lat, {lon} AS lon FROM fx_cell" for k, (lat, lon) in enumerate(BORDER)),
    "fx_grid": """
        SELECT CAST(n_nationkey*16+g.gx*4+g.gy AS BIGINT) AS cell_id, n_nationkey, CAST(-25.0+10*(n_nationkey%5)+2.5*g.gx AS DOUBLE) AS min_lat, CAST(-25.0+10*FLOOR(n_nationkey/5.0)+2.5*g.gy AS DOUBLE) AS min_lon FROM nation CROSS JOIN (SELECT x.v AS gx,y.v AS gy FROM (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) x CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) y) g""",
    "fx_cell": """
        SELECT cell_id, min_lat, min_lat+CAST(2.5 AS DOUBLE) AS max_lat, min_lon, min_lon+CAST(2.5 AS DOUBLE) AS max_lon FROM fx_grid""",
    "fx_cell_edge": """
        SELECT a.cell_id AS src, b.cell_id AS dst FROM fx_grid a JOIN fx_grid b ON a.min_lat=b.min_lat AND (a.min_lon=b.min_lon+2.5 OR a.min_lon=b.min_lon-2.5)
        UNION ALL SELECT a.cell_id, b.cell_id FROM fx_grid a JOIN fx_grid b ON a.min_lon=b.min_lon AND (a.min_lat=b.min_lat+2.5 OR a.min_lat=b.min_lat-2.5)""",
    "fx_cell_parent": """
        SELECT cell_id, CAST(5+n_nationkey AS BIGINT) AS region_id, TRUE AS direct FROM fx_grid UNION ALL SELECT c.cell_id, CAST(n.n_regionkey AS BIGINT), FALSE FROM fx_grid c JOIN nation n ON c.n_nationkey=n.n_nationkey""",
    "fx_cell_item": """
        SELECT DISTINCT CAST(nat*16+FLOOR(oa/2500.0)*4+FLOOR(oo/2500.0) AS BIGINT) AS cell_id, item_id FROM fx_spot
        UNION ALL SELECT cell_id, region_id FROM fx_cell_parent""",
    "fx_tag": """
        SELECT 30+c_custkey AS item_id,'name' AS k,c_name AS v FROM customer UNION ALL SELECT 30+c_custkey,'mktsegment',c_mktsegment FROM customer
        UNION ALL SELECT 30+c.c_custkey,'addr:nation',n.n_name FROM customer c JOIN nation n ON c.c_nationkey=n.n_nationkey
        UNION ALL SELECT 30+c_custkey,'balance',CASE WHEN c_acctbal<0 THEN 'negative' ELSE 'positive' END FROM customer
        UNION ALL SELECT 1000000000+s_suppkey,'name',s_name FROM supplier UNION ALL SELECT 1000000000+s_suppkey,'amenity','supplier' FROM supplier
        UNION ALL SELECT CAST(5+n_nationkey AS BIGINT),'name',n_name FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT),'name',r_name FROM region""",
    "fx_phrase": """
        SELECT DISTINCT LOWER(v) AS phrase, k, v FROM fx_tag WHERE k IN ('mktsegment', 'balance')""",
    "fx_bulk_tag": """
        SELECT o_orderkey AS item_id,'status' AS k,o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey,'priority',o_orderpriority FROM orders UNION ALL SELECT o_orderkey,'year',CAST(YEAR(o_orderdate) AS STRING) FROM orders
        UNION ALL SELECT o.o_orderkey,'segment',c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey UNION ALL SELECT o.o_orderkey,'nation',n.n_name FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey JOIN nation n ON c.c_nationkey=n.n_nationkey""",
    "fx_box": """
        SELECT item_id, MIN(lat) AS min_lat, MAX(lat) AS max_lat, MIN(lon) AS min_lon, MAX(lon) AS max_lon FROM fx_point GROUP BY item_id
        UNION ALL SELECT region_id, min_lat, max_lat, min_lon, max_lon FROM fx_region""",
}


def with_views(body: str) -> str:
    """body with the views it names, and those they name, as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name) if name not in needed else None

    visit(body)
    if not needed:
        return body
    listed = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    more = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    return f"WITH {more[1] or ''}{listed}, {body[more.end():]}" if more else f"WITH {listed} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = with_views(f"SELECT * FROM {name}")
    sources = ", ".join(f"{s} AS (SELECT * FROM parquet.`{sf_dir}/{s}.parquet`)" for s in SOURCES if re.search(rf"\b{s}\b", text))
    return spark.sql(f"WITH {sources}, {text[5:]}")


NAMES = {
    "items": "item", "points": "point", "regions": "region", "cells": "cell", "cell_edges": "cell_edge", "cell_parents": "cell_parent", "cell_items": "cell_item", "tags": "tag",
    "phrases": "phrase", "outlines": "outline", "borders": "border",
}
_stored: dict[tuple[str, str, str, tuple[str, ...]], str] = {}


class FixtureWorld(World):
    """A world whose tables are written when they are first used, once in an application, and then read as those of any world."""

    def __init__(self, spark: SparkSession, sf_dir: str, without: tuple[str, ...] = ()) -> None:
        self.__dict__["source"] = spark, sf_dir, without
        guard(spark)

    def __getattribute__(self, name: str):
        return FixtureWorld._stored_table(self, name) if name in NAMES or name in DERIVED else super().__getattribute__(name)

    def all_tables(self) -> dict[str, DataFrame | None]:
        """Every table, written if it wasn't yet."""
        return {name: getattr(self, name) for name in World.names()}

    def _stored_table(self, name: str) -> DataFrame:
        spark, sf_dir, without = self.source
        if name in without:
            return None
        key = spark.sparkContext.applicationId, sf_dir, name, without if name in DERIVED else ()
        if key not in _stored or not exists(spark, f"{_stored[key]}/_SUCCESS"):
            table = DERIVED[name](self) if name in DERIVED else view(spark, sf_dir, f"fx_{NAMES[name]}")
            path = new_path(spark, f"world-{name}")
            stored(table, name, path)
            _stored[key] = path
        return spark.read.parquet(_stored[key])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, written when it is first used, once in an application."""
    guard(spark)
    key = spark.sparkContext.applicationId, sf_dir, name, ()
    if key not in _stored or not exists(spark, f"{_stored[key]}/_SUCCESS"):
        path = new_path(spark, name)
        view(spark, sf_dir, name).write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def world(spark: SparkSession, sf_dir: str, without: tuple[str, ...] = ()) -> World:
    """without: optional tables that the world shall not have."""
    return FixtureWorld(spark, sf_dir, without)
