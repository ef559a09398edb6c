"""Trees of any depth: all nodes above each, by pointer doubling.

Each round doubles how far up is known, so a tree of depth d takes about log2(d) rounds, each a few joins whose tables are written
to the shared folder. A node that lies above itself would never end; such nodes are found by the number of rounds and reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.sources.scratch import remove, written


def _doubled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (node, parent) -> (node, above, steps) of all that is above, and (node, far): nodes with more steps above them than there are nodes."""
    jumps = written(edges.filter("node IS NOT NULL AND parent IS NOT NULL").select("node", F.col("parent").alias("far")).distinct(), "jumps")
    known, reach, most = written(jumps.select("node", F.col("far").alias("above"), F.lit(1).alias("steps")), "above"), 1, jumps.select("node").distinct().count()
    while not jumps.isEmpty() and reach <= most:
        further = jumps.join(known.select(F.col("node").alias("far"), F.col("above").alias("next"), "steps"), "far").select("node", F.col("next").alias("above"), (F.col("steps") + reach).alias("steps"))
        more = written(known.unionByName(further).groupBy("node", "above").agg(F.min("steps").alias("steps")), "above")
        ahead = written(jumps.join(jumps.select(F.col("node").alias("far"), F.col("far").alias("next")), "far").select("node", F.col("next").alias("far")).distinct(), "jumps")
        remove(known)
        remove(jumps)
        known, jumps, reach = more, ahead, 2 * reach
    return known, jumps


def above(edges: DataFrame) -> DataFrame:
    """edges (node, parent) -> node, above, steps (the fewest). Nodes above themselves raise an error."""
    known, endless = _doubled(edges)
    if not endless.isEmpty():
        raise ValueError(f"nodes lie above themselves, {endless.first()['node']} or one above it among them")
    return known


def endless(edges: DataFrame) -> DataFrame:
    """node: those above themselves, and all below them."""
    return _doubled(edges)[1].select("node").distinct()


def closed(direct: DataFrame, edges: DataFrame) -> DataFrame:
    """direct (cell_id, region_id) and edges of regions (node, parent) -> cell_id, region_id, direct: cells with all regions above them, as a world's cell_parents.

    A region that is both a direct one and above another is direct."""
    own = direct.select("cell_id", "region_id").distinct()
    far = own.join(above(edges).select(F.col("node").alias("region_id"), "above"), "region_id").select("cell_id", F.col("above").alias("region_id"), F.lit(False).alias("direct"))
    return own.withColumn("direct", F.lit(True)).unionByName(far).groupBy("cell_id", "region_id").agg(F.bool_or("direct").alias("direct"))
