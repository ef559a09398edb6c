"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosines.

Vectors are normalised, projected on random Gaussian directions and quantised; ``HASHES`` quantised
projections make a bucket, and ``tables_for`` chooses the number of tables so that a pair at the threshold
shares a bucket with the target recall (Datar et al.). Identical vectors of a label form one class first. The cosines in a
bucket are computed in full and in double precision, block by block (:mod:`terralex.llm.linkage`); a pair
that shares several buckets counts in the first. No pair is ever a row.

``WIDTH`` and ``HASHES`` are about the cheapest for the threshold and recall: with fewer hashes buckets hold more chance
neighbours, with more the tables, and so the rows, grow (16 of width 2 need 68 tables, 24 of width 2 need 254, 8 of width 1
need 87 with twice the rows).

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those without a
label, link with nothing. Each vector is first scaled by the power of two of its largest component, which changes no cosine, so squares neither overflow nor vanish. Vectors of different lengths don't link. Labels may be of any type with a text form. Repeated rows are copies of one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import erf, exp, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import written
from terralex.llm.linkage import linked_classes, links, shared_buckets

THRESHOLD, RECALL, WIDTH, HASHES, SEED = 0.93, 0.995, 2.0, 16, 5


def tables_for(threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH, hashes: int = HASHES) -> int:
    """Fewest tables with which unit vectors of this cosine share a bucket with the recall wanted."""
    r = width / sqrt(2 - 2 * threshold)
    one = erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))
    return int(np.ceil(np.log(1 - recall) / np.log(1 - one**hashes)))


@lru_cache
def _projections(size: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, size])
    return rng.standard_normal((size, tables * HASHES)), rng.uniform(0, WIDTH, tables * HASHES), rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def buckets_of(vectors: np.ndarray, labels: np.ndarray, tables: int) -> np.ndarray:
    """Vector x table: a 64-bit number of label, table and quantised projections."""
    directions, shifts, odd = _projections(vectors.shape[1], tables)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cells = np.floor((unit @ directions + shifts) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(vectors), tables, HASHES)
    out = (cells * odd).sum(axis=2, dtype=np.uint64) + np.arange(tables, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out ^= (labels * np.uint64(0x9E3779B97F4A7C15))[:, None]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def _number(label: str) -> int:
    return int.from_bytes(hashlib.blake2b(label.encode(), digest_size=8).digest(), "little")


def _sketched(batches: Iterator[pa.RecordBatch], tables: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, rows = batch.column("label").to_pylist(), batch.column("embedding").to_pylist()
        n = len(rows)
        keys, found, payload = [None] * n, [None] * n, [None] * n
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, (label, row) in enumerate(zip(labels, rows)):
            if label is None or not row or None in row:
                continue
            v = np.array(row, np.float64) + 0.0  # -0.0 is 0.0
            if np.isfinite(v).all() and v.any():
                v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))
                by_size.setdefault(len(v), []).append((i, v))
        for own in by_size.values():
            at = [i for i, _ in own]
            buckets = buckets_of(np.array([v for _, v in own]), np.array([_number(labels[i]) for i in at], np.uint64), tables)
            for (i, v), row in zip(own, buckets.tolist()):
                payload[i], found[i] = v.tobytes(), row
                keys[i] = hashlib.blake2b(f"{len(labels[i])}:{labels[i]}".encode() + payload[i], digest_size=16).digest()
        columns = [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(payload, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "node", "bands", "payload"])


def cosine_kernel(left: list[tuple], right: list[tuple] | None, bucket: int) -> np.ndarray:
    """Members as (vector, buckets): links of cosine THRESHOLD or more that no earlier table's bucket has."""
    a, mine = (np.array(x) for x in zip(*left))
    b, theirs = (a, mine) if right is None else (np.array(x) for x in zip(*right))
    link = (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]) >= THRESHOLD
    table = int(np.flatnonzero(mine[0] == bucket)[0])
    rows, columns = np.nonzero(link)
    for begin in range(0, len(rows), 20_000):
        r, c = rows[begin : begin + 20_000], columns[begin : begin + 20_000]
        earlier = (mine[r, :table] == theirs[c, :table]).any(axis=1)
        link[r[earlier], c[earlier]] = False
    return link


def _member(_node: bytes, payload: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(payload["vector"]), np.array(payload["bands"], np.int64)


def near_vectors(vectors: DataFrame, tables: int | None = None) -> DataFrame:
    """A row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = written(slim.mapInArrow(lambda b, k=tables or tables_for(): _sketched(b, k), "vec_id long, node binary, bands array<long>, payload binary"), "sketches")
    classes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.any_value("payload").alias("payload"))
    classes = written(classes, "classes")
    members = shared_buckets(classes).join(classes, "node").select("root", "node", "copies", F.struct(F.col("payload").alias("vector"), "bands").alias("payload"), "size")
    found = linked_classes(classes, links(members, cosine_kernel, _member))
    return rows.select("vec_id", "node").join(found, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("class_id", "vec_id")).alias("kept"),
    )
