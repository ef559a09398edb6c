"""Exact links inside groups of candidates, without a row per pair.

Candidates share a bucket (a band of a sketch). They are compared by bucket, or buckets become stars around
their smallest member and stars candidate groups, where chance candidates are too few to connect them. A bucket
or group of more than ``BLOCK`` members is split into blocks, and each pair of blocks that share a bucket is one unit of work. A unit gives link counts and a spanning
forest of its links, so rows follow the members and never the pairs. The number of members of a unit is
bounded; units of a large group go to different tasks. Minima and sizes of groups are written before rows meet
them: with plain shuffles on both sides of that join, Spark can split a hot group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import remove, written

BLOCK = 512


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root), root the smallest node that is reachable; nodes without an edge have no row.

    Large-star and small-star steps in turn until nothing changes (Kiveris et al.); each step is written
    to the shared folder, so its lineage is one step long. Hot nodes are grouped by partial minima. The minima
    are written before edges meet them: with both sides of the join plain shuffles, Spark can split a hot node.
    """
    ends = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = written(ends, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = written(both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = written(small.select("e.*").filter("u <> v").distinct(), "edges")
        for old in (lowest, large, least):
            remove(old)
        remove(now)
        now = after
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def shared_buckets(classes: DataFrame) -> DataFrame:
    """classes (node, bands array<long>) -> (root, node, size): buckets with more than one member."""
    buckets = classes.select(F.explode("bands").alias("root"), "node")
    return buckets.join(written(buckets.groupBy("root").agg(F.count("*").alias("size")).filter("size > 1"), "sizes"), "root")


def candidate_groups(classes: DataFrame) -> DataFrame:
    """classes (node, bands array<long>) -> (root, node, size) of those that share buckets, directly or over others."""
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    centres = buckets.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    stars = buckets.join(written(centres, "centres"), "bucket").filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    groups = connected_components(stars)
    return groups.join(written(groups.groupBy("root").agg(F.count("*").alias("size")), "sizes"), "root").select("root", "node", "size")


def _block(size: str = "size") -> Column:
    return F.pmod(F.xxhash64("node"), F.ceil(F.col(size) / BLOCK)).cast("int")


def partner_blocks(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """classes (node, bands), groups (root, node, size) -> groups and with: the blocks of its group that a node is compared with.

    Of a group of more than ``BLOCK`` nodes these are its own block and those that hold a node with which it shares a bucket; so the copies of a node
    follow its candidates, and not the size of a group that chance candidates connect. Where a bucket has nodes in half of a group's blocks or more, its
    nodes go to all blocks instead of a row for each being made. No pair that shares a bucket is left out."""
    groups = written(groups, "groups")
    spots = written(
        groups.filter(F.col("size") > BLOCK).join(classes.select("node", F.explode("bands").alias("bucket")), "node").select("node", "bucket", _block().alias("block"), F.ceil(F.col("size") / BLOCK).alias("blocks")), "spots"
    )
    held = written(spots.select("bucket", "block").distinct(), "held")
    wide = written(held.groupBy("bucket").agg(F.count("*").alias("held")).filter("held > 1"), "wide")
    own = spots.join(wide, "bucket")
    everywhere = own.filter("2 * held >= blocks").select("node").distinct().withColumn("all", F.lit(True))
    near = own.filter("2 * held < blocks").join(held.withColumnRenamed("block", "other"), "bucket").filter("block <> other").select("node", "other").distinct()
    near = near.groupBy("node").agg(F.collect_list("other").alias("near"))
    every = F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK).cast("int") - 1)
    some = F.array_append(F.coalesce("near", F.array().cast("array<int>")), _block())
    return groups.join(near, "node", "left").join(everywhere, "node", "left").select("root", "node", "size", F.when(F.col("all") | (F.col("size") <= BLOCK), every).otherwise(some).alias("with"))


#: Gets (payloads of left, payloads of right or None, bucket or group) -> Boolean matrix of links; None: left against itself.
Kernel = Callable[[list, list | None, object], np.ndarray]


def _forest(link: np.ndarray, left: list, right: list) -> list[tuple]:
    """Edges that connect what link connects; rows are left, columns right (the same list: against itself)."""
    out, seen_rows, seen_columns = [], np.zeros(len(left), bool), np.zeros(len(right), bool)
    for start in np.flatnonzero(link.any(axis=1)).tolist():
        if seen_rows[start]:
            continue
        seen_rows[start], rows = True, [start]
        while rows:
            new = link[rows].any(axis=0) & ~seen_columns
            seen_columns |= new
            columns = np.flatnonzero(new)
            out += [(left[start], right[c]) for c in columns.tolist()]
            fresh = link[:, columns].any(axis=1) & ~seen_rows if len(columns) else np.zeros(len(left), bool)
            seen_rows |= fresh
            rows = np.flatnonzero(fresh).tolist()
            out += [(left[start], left[r]) for r in rows]
    return [(a, b) for a, b in out if a != b]


def _unit(root: object, rows: list[tuple], kernel: Kernel) -> Iterator[tuple]:
    """rows (lo, hi, block, node, copies, payload) of one unit -> (node, linked documents, other node or None)."""
    lo, hi = rows[0][0], rows[0][1]
    unique = {r[3]: r for r in rows}
    left = [r for r in unique.values() if r[2] == lo]
    right = [r for r in unique.values() if r[2] == hi]
    if not left or not right:
        return
    if lo == hi:
        link = kernel([r[5] for r in left], None, root)
        np.fill_diagonal(link, False)
    else:
        link = kernel([r[5] for r in left], [r[5] for r in right], root)
    for side, counts in ((left, link @ np.array([r[4] for r in right], np.int64)), (right, np.array([r[4] for r in left], np.int64) @ link)):
        yield from ((r[3], n, None) for r, n in zip(side, counts.tolist()) if n)
        if lo == hi:
            break
    yield from ((a, 0, b) for a, b in _forest(link, [r[3] for r in left], [r[3] for r in right]))


def _units(batches: Iterator[pa.RecordBatch], kernel: Kernel, prepare: Callable) -> Iterator[pa.RecordBatch]:
    def out(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["node", "n", "other"])

    current, rows, found = None, [], []
    for batch in batches:
        for root, lo, hi, block, node, copies, payload in zip(*(batch.column(c).to_pylist() for c in ("root", "lo", "hi", "block", "node", "copies", "payload"))):
            if (root, lo, hi) != current:
                if rows:
                    found += _unit(current[0], rows, kernel)
                current, rows = (root, lo, hi), []
                if len(found) > 20_000:
                    yield out(found)
                    found = []
            if (ready := prepare(node, payload)) is not None:
                rows.append((lo, hi, block, node, copies, ready))
    if rows:
        found += _unit(current[0], rows, kernel)
    yield out(found)


def links(members: DataFrame, kernel: Kernel, prepare: Callable) -> DataFrame:
    """members (root, node, copies, payload, size of the root's group) -> (node, n, other): counts of linked documents, and edges that connect what is linked.

    A member is compared with all blocks of its group, or with those of a column ``with``. prepare(node, payload) makes what kernel gets, or None for a row that isn't the node's."""
    blocks = F.col("with") if "with" in members.columns else F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK).cast("int") - 1)
    placed = members.withColumn("block", _block()).withColumn("with", F.explode(blocks))
    units = placed.select("root", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "node", "copies", "payload")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(n, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    return dealt.mapInArrow(lambda b: _units(b, kernel, prepare), "node binary, n long, other binary")


def linked_classes(classes: DataFrame, found: DataFrame) -> DataFrame:
    """classes (node, rep, copies) -> node, n_links, class_id (smallest rep that links reach), class_node (its node)."""
    found = written(found, "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    own = classes.select("node", "rep", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = written(own, "classes")
    first = written(own.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("first")), "first")
    return own.join(first, "root").select(
        "node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("first.rep").alias("class_id"), F.col("first.node").alias("class_node")
    )
