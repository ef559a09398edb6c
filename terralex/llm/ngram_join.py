"""N-gram Jaccard join: MinHash banding, then full n-gram sets.

Documents with the same word sequence form one class. A class is sketched by MinHash over hashes of its
word n-grams; ``bands_for`` chooses the number of bands and rows so that a pair at the threshold shares a band
with the target recall. Classes are dealt by band hash; what shares one, directly or over others, is
one candidate group. Pairs are then verified on their full n-gram sets in blocks: all of a group of one
block, and of a larger one those whose blocks share a bucket (:mod:`terralex.llm.linkage`). No pair is ever a row.

Defined results: words are runs of digits, ASCII letters in lower case, and other characters. A text
with fewer words than n has one n-gram, all its words. Texts without words link with nothing, each its
own class. Rows that repeat doc_id and words are one document's copies. A null doc_id never stands for a
class that has another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import encoded, mark, numbered, parts, release, text_of, words, written
from terralex.llm.linkage import candidate_groups, linked_classes, links, partner_blocks

N, THRESHOLD, RECALL, ROWS, SEED = 5, 0.8, 0.995, 7, 11


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Fewest bands of so many rows with which a pair at the threshold shares one with the recall wanted."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


@lru_cache
def _constants(count: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    ahead, back = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    ahead[0] = back[0] = 1
    return np.cumprod(ahead, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def slices(b: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of b, each of all its bytes."""
    ahead, back = _powers(1 << max(12, (len(b) + 1).bit_length()))
    values = np.frombuffer(b, np.uint8)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_constants(256)[values] * ahead[: len(values)], dtype=np.uint64)))
    return mix((sums[stops] - sums[starts]) * back[starts])


def word_hashes(joined: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text whose words are parted by single spaces."""
    if not joined:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return slices(joined, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)])))


def shingles(hashes: np.ndarray, n: int = N) -> np.ndarray:
    """Hash of each n words in a row; of all, if there are fewer."""
    if not len(hashes):
        return hashes
    width = min(n, len(hashes))
    out = np.full(len(hashes) - width + 1, width, np.uint64)
    for k, c in enumerate(_constants(256)[:width]):
        out += mix(hashes[k : k + len(out)] + c)
        out *= c
    return mix(out)


def normal(text: bytes) -> bytes:
    return b" ".join(words(text))


def key_of(joined: bytes) -> bytes:
    return hashlib.blake2b(joined, digest_size=16).digest()


@lru_cache
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int = ROWS) -> np.ndarray:
    """Text x band; no set may be empty."""
    lengths = np.array([len(s) for s in sets])
    offsets = np.cumsum(lengths) - lengths
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    a, b = _permutations(bands * rows)
    out = np.zeros((len(sets), bands), np.uint64)
    scratch = np.empty_like(x)
    for band in range(bands):
        for k in range(band * rows, (band + 1) * rows):
            np.multiply(x, a[k], out=scratch)
            scratch += b[k]
            out[:, band] = mix(out[:, band] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(scratch, offsets) + np.uint64(k))
    return out


def _sketched(batches: Iterator[pa.RecordBatch], n: int, bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, "text", 250_000):
            joined = [normal(t) for t in encoded(part.column("text"))]
            filled = [i for i, j in enumerate(joined) if j]
            found: list = [None] * len(joined)
            if filled:
                for i, row in zip(filled, band_hashes([shingles(word_hashes(joined[i]), n) for i in filled], bands).view(np.int64).tolist()):
                    found[i] = row
            keys = pa.array([key_of(j) if j else None for j in joined], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), keys, pa.array(found, pa.list_(pa.int64()))], ["doc_id", "row", "node", "bands"])


def sketches(docs: DataFrame, n: int = N, bands: int | None = None, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """doc_id, row (its number, if given), node (of the word sequence; null without words), bands."""
    number = F.col(row) if row else F.lit(None)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), number.cast("long").alias("row"), text_of(text).alias("text"))
    return slim.mapInArrow(lambda b, k=bands or bands_for(): _sketched(b, n, k), "doc_id long, row long, node binary, bands array<long>")


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of sets of hashes (each sorted, without repeats)."""
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = (np.cumsum(shared) - 1)[number[keep := shared[number]]]
    owner = owner[keep]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    out, width = np.zeros((len(left), len(right if right is not None else left)), np.float32), 4096
    for start in range(0, int(shared.sum()), width):
        a, z = np.searchsorted(number, (start, start + width))
        x = np.zeros((len(sets), min(width, int(shared.sum()) - start)), np.float32)
        x[owner[a:z], number[a:z] - start] = 1
        out += x[: len(left)] @ (x if right is None else x[len(left) :]).T
    return out


def jaccard_kernel(left: list[np.ndarray], right: list[np.ndarray] | None, _root: bytes) -> np.ndarray:
    both = overlaps(left, right)
    sizes = np.array([len(s) for s in left], float)[:, None] + np.array([len(s) for s in (left if right is None else right)], float)[None, :]
    return both >= THRESHOLD * (sizes - both) - 1e-6


def _prepared(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The n-gram set of each text, once; rows whose text isn't the node's have none."""
    for batch in batches:
        for part in parts(batch, "text", 250_000):
            sets = []
            for node, text in zip(part.column("node").to_pylist(), encoded(part.column("text"))):
                joined = normal(text)
                sets.append(np.unique(shingles(word_hashes(joined), n)).tobytes() if key_of(joined) == node else None)
            out = part.set_column(part.schema.get_field_index("text"), pa.field("payload", pa.binary()), pa.array(sets, pa.binary()))
            yield out.filter(out.column("payload").is_valid())


def jaccard_classes(docs: DataFrame, n: int = N, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, row, node), (classes: node, n_links, class_id, class_node, first: the number of the row that stands for the node)."""
    rows = written(sketches(docs, n, None, text, doc_id, row), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    classes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.min(order)["row"].alias("first"))
    classes = written(classes, "classes")
    wanted = partner_blocks(classes, candidate_groups(classes)).join(classes.select("node", "rep", "first", "copies"), "node")
    if row:
        texts = docs.select(F.col(row).alias("number"), text_of(text).alias("text"))
        members = texts.join(wanted, texts["number"] == wanted["first"])
    else:
        texts = docs.select(F.col(doc_id).cast("long").alias("number"), text_of(text).alias("text"))
        members = texts.join(wanted, texts["number"].eqNullSafe(wanted["rep"]))
    members = members.select("root", "node", "copies", "size", "with", "text").mapInArrow(lambda b: _prepared(b, n), "root binary, node binary, copies long, size long, with array<int>, payload binary")
    found = linked_classes(classes, links(members, jaccard_kernel, lambda _node, payload: np.frombuffer(payload, np.uint64)))
    return rows.select("doc_id", "row", "node"), found.join(classes.select("node", "first"), "node") if row else found


def jaccard_join(docs: DataFrame, n: int = N, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per row of docs: doc_id, class_id (the smallest doc_id that links reach), n_links (other documents linked directly), kept."""
    rows, classes = jaccard_classes(docs, n, text, doc_id)
    return rows.join(classes, "node", "left").select(
        "doc_id",
        F.when(F.col("class_node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("class_node").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("class_node"))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, n: int = N, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each class stays, as it is: that of the smallest doc_id. Rows without words stay.

    Rows are numbered, and texts meet only the numbers of rows that go."""
    own, row = numbered(docs)
    begin = mark(docs.sparkSession)
    rows, classes = jaccard_classes(own, n, text, doc_id, row)
    stay = classes.filter("node = class_node").select(F.col("first").alias("row"))
    gone = written(rows.filter("node IS NOT NULL").join(stay, "row", "left_anti").select(F.col("row").alias(row)), "gone")
    release(docs.sparkSession, begin, mark(docs.sparkSession) - 1)
    return own.join(gone, row, "left_anti").drop(row)
