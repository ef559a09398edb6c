"""Hard-negative mining: k-means inverted lists, visited by upper bounds, exact.

Components become ``floor(SCALE * x)``; a score is the integer inner product of two such vectors. K-means of a bounded sample gives
centroids; every row goes to the list of its nearest one, and a list keeps its radius, the largest distance of a row from the centroid. For an anchor q
and a list of centre c and radius r, Cauchy-Schwarz says that no row scores above q.c + |q| r or below q.c - |q| r.

A search visits the lists of an anchor from the highest upper bound down, a span of them per round (``FIRST``, then ``GROWTH`` times as many in all). It leaves out
lists whose bounds lie outside all of the anchor's windows of scores, and stops at an upper bound that is strictly below the k-th score so far; at an equal one, ties
by vec_id can still change the result. Bounds are widened by more than floating-point arithmetic can err, so the sample only decides how much is read, never what is found.

Work is dealt in units of at most about ``CHUNK`` anchors and ``BLOCK`` rows of a list, so a list with a third of all rows goes to many tasks. Vectors travel as
16-bit numbers where they fit. What reaches the driver is the sample (``SAMPLE`` rows, at most ``SAMPLE_BYTES``) and one row per list.

Where bounds don't prune (as with vectors that differ in all directions), each anchor meets each row once: work and shuffles then grow with anchors x rows, the latter
divided by the sizes of a unit.

Defined results: rows with a null vec_id or label, a null or empty vector, or a component that is null, not finite or not finite after scaling take no part. Vectors of different lengths
have no score. Repeated rows are ranked each for itself, and a positive found twice counts once; an anchor's id is never its own positive or negative, and of repeated anchors that with the
smallest label and vector counts. Scores beyond 64 bits count as the nearest number of 64 bits. Labels may be of any type with a text form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.llm.common import written

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
LOW, HIGH = 30, 90  # a negative's score, in percent of the positive's
SAMPLE, SAMPLE_BYTES, LISTS, PER_LIST, TURNS, SEED = 20_000, 64_000_000, 1024, 1024, 8, 11
BLOCK, CHUNK, FIRST, GROWTH = 2048, 1024, 8, 8
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_EXACT = 2.0**53


# ---- vectors


def packed(v: np.ndarray) -> bytes:
    """A vector of whole numbers: a letter for the type, then the numbers."""
    return b"h" + v.astype("<i2").tobytes() if np.abs(v).max() < 1 << 15 else b"d" + v.astype("<f8").tobytes()


def unpacked(blobs: list[bytes]) -> np.ndarray:
    """Vectors of one length as rows."""
    size = len(blobs[0])
    if all(len(b) == size and b[:1] == b"h" for b in blobs):
        return np.ascontiguousarray(np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), size)[:, 1:]).view("<i2").astype(np.float64)
    return np.array([np.frombuffer(b[1:], "<i2" if b[:1] == b"h" else "<f8").astype(np.float64) for b in blobs])


def length_of(blob: bytes) -> int:
    return (len(blob) - 1) // (2 if blob[:1] == b"h" else 8)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as int64, exact and clipped to its range: by floats where every sum stays exact, else by Python's whole numbers."""
    n = a.shape[1]
    small_a, small_b = (n * np.abs(x).max(axis=1) < 2.0**26 for x in (a, b))
    out = np.empty((len(a), len(b)), np.int64)
    out[np.ix_(small_a, small_b)] = a[small_a] @ b[small_b].T
    whole = lambda x: np.frompyfunc(int, 1, 1)(x)
    for rows, columns in ((~small_a, np.ones(len(b), bool)), (small_a, ~small_b)):
        if rows.any() and columns.any():
            if n * np.abs(a[rows]).max() * np.abs(b[columns]).max() < _EXACT:
                out[np.ix_(rows, columns)] = a[rows] @ b[columns].T
            else:
                out[np.ix_(rows, columns)] = np.clip(whole(a[rows]) @ whole(b[columns]).T, LEAST, MOST).astype(np.int64)
    return out


def quantised(row: list | None) -> np.ndarray | None:
    if not row or None in row:
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        v = np.floor(SCALE * np.array(row, np.float64)) + 0.0
    return v if np.isfinite(v).all() else None


# ---- the index


def k_means(points: np.ndarray, k: int) -> np.ndarray:
    """Centres after ``TURNS`` turns, from k different points; a centre without points stays."""
    points = np.unique(points, axis=0)
    centres = points[np.random.default_rng(SEED).permutation(len(points))[:k]].copy()
    for _ in range(TURNS):
        own = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    own = np.empty(len(points), np.int64)
    for begin in range(0, len(points), 4096):
        own[begin : begin + 4096] = np.argmin(half - points[begin : begin + 4096] @ centres.T, axis=1)
    return own


@dataclass(frozen=True)
class Centres:
    """Centres by length of vector. Lists are numbered from 0; a length that the sample doesn't have is one list, -length, around 0."""

    by_length: dict[int, tuple[int, np.ndarray]]

    @classmethod
    def of_sample(cls, blobs: list[bytes], rows: int) -> Centres:
        groups: dict[int, list[bytes]] = {}
        for blob in blobs:
            groups.setdefault(length_of(blob), []).append(blob)
        found, at = {}, 0
        for length, own in sorted(groups.items()):
            with np.errstate(all="ignore"):
                centres = k_means(unpacked(own), max(1, min(LISTS, rows // PER_LIST)))
            found[length] = at, np.nan_to_num(centres)
            at += len(centres)
        return cls(found)

    def of(self, length: int) -> tuple[list[int], np.ndarray]:
        if length not in self.by_length:
            return [-length], np.zeros((1, length))
        at, centres = self.by_length[length]
        return list(range(at, at + len(centres))), centres


def _quantised(batches: Iterator[pa.RecordBatch], centres: Centres | None) -> Iterator[pa.RecordBatch]:
    """Rows that take part: vec_id, label, vector; with centres also list and reach."""
    for batch in batches:
        ids, labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
        kept = [(i, label, v) for i, label, row in zip(ids, labels, batch.column("embedding").to_pylist()) if i is not None and label is not None and (v := quantised(row)) is not None]
        columns = [pa.array([i for i, _, _ in kept], pa.int64()), pa.array([x for _, x, _ in kept], pa.string()), pa.array([packed(v) for _, _, v in kept], pa.binary())]
        if centres is None:
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "vector"])
            continue
        lists, reach = np.empty(len(kept), np.int64), np.empty(len(kept))
        sizes = np.array([len(v) for _, _, v in kept], np.int64)
        with np.errstate(all="ignore"):
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                numbers, own = centres.of(size)
                points = np.array([kept[i][2] for i in at])
                near = nearest(points, own)
                lists[at], reach[at] = np.array(numbers)[near], np.linalg.norm(points - own[near], axis=1)
        reach = np.where(np.isfinite(reach), reach, np.inf)
        yield pa.RecordBatch.from_arrays([*columns, pa.array(lists), pa.array(reach)], ["vec_id", "label", "vector", "list", "reach"])


@dataclass(frozen=True)
class Index:
    """rows: vec_id, label, vector, list, reach, salt. blocks: list, block, rows (vec_id, label, vector). radius and parts: by list."""

    rows: DataFrame
    blocks: DataFrame
    centres: Centres
    radius: dict[int, float]
    parts: dict[int, int]


def build(vectors: DataFrame) -> Index:
    """vectors: vec_id, embedding, label; every row that takes part is in a list."""
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    spark, n = vectors.sparkSession, slim.count()
    length = slim.agg(F.max(F.size("embedding"))).first()[0] or 1
    fewer = slim.filter("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, length)))))
    sample = fewer.mapInArrow(lambda b: _quantised(b, None), "vec_id long, label string, vector binary").select("vector").collect()
    centres = Centres.of_sample([bytes(r["vector"]) for r in sample], n)
    rows = slim.mapInArrow(lambda b: _quantised(b, centres), "vec_id long, label string, vector binary, list long, reach double")
    rows = written(rows.withColumn("salt", F.xxhash64("vec_id", F.monotonically_increasing_id())), "clustered")
    known = rows.groupBy("list").agg(F.max("reach").alias("radius"), F.count("*").alias("n")).collect()  # a row per list
    parts = {r["list"]: ceil(r["n"] / BLOCK) for r in known}
    if not known:
        return Index(rows, rows.select("list", F.lit(0).alias("block"), F.array(F.struct("vec_id", "label", "vector")).alias("rows")), centres, {}, {})
    sizes = F.broadcast(spark.createDataFrame(list(parts.items()), "list long, parts long"))
    blocks = rows.join(sizes, "list").groupBy("list", F.pmod("salt", "parts").cast("int").alias("block")).agg(F.collect_list(F.struct("vec_id", "label", "vector")).alias("rows"))
    return Index(rows, written(blocks, "lists"), centres, {r["list"]: r["radius"] for r in known}, parts)


# ---- searching


def bounds(q: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and highest score that a row of each list can have with each q, widened beyond rounding errors."""
    with np.errstate(all="ignore"):
        norm, middle = np.linalg.norm(q, axis=1)[:, None], q @ centres.T
        reach = norm * radius[None, :]
        reach = reach + 1e-9 * (reach + norm * np.linalg.norm(centres, axis=1)[None, :]) + 1e-3
        low, high = middle - reach, middle + reach
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def _visits(batches: Iterator[pa.RecordBatch], centres: Centres, radius: dict[int, float], begin: int, end: int) -> Iterator[pa.RecordBatch]:
    """Anchors with each list that they visit in a span of their lists, from the highest upper bound down."""
    for batch in batches:
        blobs, windows = batch.column("vector").to_pylist(), batch.column("windows").to_pylist()
        sizes = np.array([length_of(b) for b in blobs])
        rows, lists = [], []
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            numbers, own = centres.of(size)
            there = [i for i, number in enumerate(numbers) if number in radius]
            if not there:
                continue
            numbers, own = np.array(numbers)[there], own[there]
            low, high = bounds(unpacked([blobs[i] for i in at]), own, np.array([radius[i] for i in numbers.tolist()]))
            order = np.argsort(-high, axis=1, kind="stable")[:, begin:end]
            for k, i in enumerate(at.tolist()):
                lo, hi = low[k, order[k]], high[k, order[k]]
                wanted = np.zeros(len(lo), bool)
                for w in windows[i]:
                    wanted |= (hi >= max(w["least"], w["kth"])) & (lo <= w["most"])
                lists += numbers[order[k][wanted]].tolist()
                rows += [i] * int(wanted.sum())
        for cut in range(0, len(rows), 10_000):
            part = batch.take(pa.array(rows[cut : cut + 10_000], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(lists[cut : cut + 10_000], pa.int64()), *part.columns], ["list", *part.schema.names])


def _best(found: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Of places in a row of scores the k best, of equal ones the first."""
    if len(found) <= k:
        return found
    own = row[found]
    cut = np.partition(own, len(own) - k)[len(own) - k]
    above = found[own > cut]
    return np.concatenate([above, found[own == cut][: k - len(above)]])


def _compared(batches: Iterator[pa.RecordBatch], same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """Units (anchors, rows) -> the k best rows of the unit for each anchor and window; same: rows of the anchor's label, else of others."""
    names = ["anchor", "positive_id", "positive_score", "vec_id", "score"]
    for batch in batches:
        for unit in range(batch.num_rows):
            anchors, rows = batch.column("anchors")[unit].as_py(), batch.column("rows")[unit].as_py()
            rows.sort(key=lambda r: r["vec_id"])
            codes = {label: i for i, label in enumerate({r["label"] for r in rows})}
            labels, ids = np.array([codes[r["label"]] for r in rows]), np.array([r["vec_id"] for r in rows])
            matrix, out = unpacked([r["vector"] for r in rows]), []
            for begin in range(0, len(anchors), 128):
                some = anchors[begin : begin + 128]
                for a, row in zip(some, scores(unpacked([a["vector"] for a in some]), matrix)):
                    fits = ((labels == codes.get(a["label"], -1)) == same) & (ids != a["anchor"])
                    for w in a["windows"]:
                        found = _best(np.flatnonzero(fits & (row >= max(w["least"], w["kth"])) & (row <= w["most"])), row, k)
                        out += [(a["anchor"], w["positive_id"], w["positive_score"], i, s) for i, s in zip(ids[found].tolist(), row[found].tolist())]
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


FOUND = "anchor long, positive_id long, positive_score long, vec_id long, score long"


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window, with their rank."""
    order = Window.partitionBy("anchor", "positive_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, anchors: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """Written: anchor, positive_id, positive_score, vec_id, score, rank: of each window the k rows with the highest scores in it, ties by vec_id.

    anchors: anchor, label, vector. windows: anchor, positive_id, positive_score, least, most (scores, both included). same: rows of the anchor's label, else of other labels."""
    spark = anchors.sparkSession
    found = spark.createDataFrame([], FOUND + ", rank int")
    chunks = max(1, ceil(anchors.count() / CHUNK))
    most_lists = max((len(c) for _, c in index.centres.by_length.values()), default=1)
    parts = spark.createDataFrame(list(index.parts.items()), "list long, parts long")  # a row per list
    begin, end = 0, FIRST
    while index.parts and begin < max(1, most_lists):
        kth = found.filter(F.col("rank") == k).select("anchor", "positive_id", F.col("score").alias("kth"))
        own = windows.join(kth, ["anchor", "positive_id"], "left").withColumn("kth", F.coalesce("kth", F.lit(LEAST)))
        own = own.groupBy("anchor").agg(F.collect_list(F.struct("positive_id", "positive_score", "least", "most", "kth")).alias("windows"))  # at most POSITIVES
        wanted = anchors.join(own, "anchor")
        kind = wanted.schema
        visits = wanted.mapInArrow(lambda b, c=index.centres, r=index.radius, i=begin, j=end: _visits(b, c, r, i, j), f"list long, {kind.simpleString()[7:-1]}")
        grouped = visits.groupBy("list", F.pmod(F.xxhash64("anchor"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("anchor", "label", "vector", "windows")).alias("anchors"))
        units = grouped.join(F.broadcast(parts), "list").withColumn("block", F.explode(F.expr("transform(sequence(0L, parts - 1), b -> CAST(b AS INT))"))).join(index.blocks, ["list", "block"])
        new = units.select("anchors", "rows").mapInArrow(lambda b: _compared(b, same, k), FOUND)
        found = written(_first(found.drop("rank").unionByName(new), k), "found")
        begin, end = end, end * GROWTH
    return found


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first positives (highest scores of its label) the first
    rows of other labels whose score is low to high percent of the positive's. is_anchor: a condition on vec_id."""
    index = build(vectors)
    anchors = index.rows.filter(is_anchor).groupBy(F.col("vec_id").alias("anchor")).agg(F.min(F.struct("label", "vector")).alias("a")).select("anchor", "a.label", "a.vector")
    anchors = written(anchors, "anchors")
    any_score = anchors.select("anchor", *(F.lit(v).cast("long").alias(c) for c, v in (("positive_id", 0), ("positive_score", 0), ("least", LEAST), ("most", MOST))))
    best = search(index, anchors, any_score, positives, same=True)
    share = lambda percent: F.col("positive_score").cast("decimal(38,0)") * percent / 100
    chosen = best.groupBy("anchor", F.col("vec_id").alias("positive_id")).agg(F.max("score").alias("positive_score"))
    windows = chosen.withColumn("least", F.ceil(share(low)).cast("long")).withColumn("most", F.floor(share(high)).cast("long")).filter("least <= most")
    found = search(index, anchors, windows, negatives, same=False)
    return found.select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
