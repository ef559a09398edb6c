"""How the filters of a chain interact: what each removes in every order of them, from 32 numbers per part.

A document fails some of the filters A to E; its mask has a bit for each. For each set of filters the parity sum is the number of
documents that fail an even number of them less those that fail an odd number: the Walsh-Hadamard transform of the counts by mask. It is a plain sum of
signs, so partial aggregates of any cut of the data add up; the inverse transform (the same one, divided by 32) gives the counts by mask exactly. From these
follow all 120 orders, and a filter's removals summed over the orders: a document that fails k filters falls to each of them in 120 / k orders.

Texts are read once, by ``failures``: their words are compared chunk by chunk, so a long text needs memory for itself and its different
words. A large group of copies meets its smallest doc_id in a join that Spark can split.

Defined results: a null text is empty (no words: it fails A, not B; no characters: not C). Null languages and the empty one are one part. Without
a doc_id a row has no label, never fails E and makes no other row fail. Rows with one doc_id aren't copies of each other, each has the labels of the id;
labels repeated for an id count if any says 1. Other columns are not read. No documents give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import encoded, parts, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
FEWEST, DISTINCT, UPPER, MARKS = 200, 50, 3, b"#$%&*|"  # words; distinct words and capitals in percent
CHUNK = 1 << 20
_CAPITALS, _INNER = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0))  # the latter: bytes of UTF-8 that begin no code point


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and different words, between ASCII white space. Texts are cut at white space into chunks."""
    if len(text) <= CHUNK:
        own = text.split()
        return len(own), len(set(own))
    n, seen, begin, rest = 0, set(), 0, b""
    while begin < len(text):
        piece = rest + text[begin : begin + CHUNK]
        begin += CHUNK
        own = piece.split()
        rest = b""
        if begin < len(text) and own and not piece[-1:].isspace():
            rest = own.pop()  # it may go on
        n += len(own)
        seen.update(own)
    return n, len(seen)


def mask_of(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    n, distinct = word_counts(text)
    points = len(text.translate(None, _INNER))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    fails = (n < FEWEST, 100 * distinct < DISTINCT * n, 100 * capitals > UPPER * points, any(m in text for m in MARKS))
    return sum(f << k for k, f in enumerate(fails))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in parts(whole, "text"):
            texts = encoded(batch.column("text"))
            masks = pa.array([mask_of(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), masks, digests], ["doc_id", "part", "mask", "digest"])


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask: a row per document, with a bit for each filter that it fails."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    judged = written(slim.mapInArrow(_judged, "doc_id long, part string, mask int, digest binary"), "judged")
    copies = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    found = judged.join(written(copies, "copies"), "digest", "left")
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return found.select("doc_id", "part", F.col("mask").bitwiseOR(F.shiftleft(late, FILTERS.index("E"))).alias("mask"))


def parity_sums(failing: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, sums: for each part and label the 32 signed sums of the masks, one per set of filters."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    rows = failing.join(written(known.filter("good OR toxic"), "labelled"), "doc_id", "left").select("part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    sign = lambda s: F.lit(1) - 2 * (F.bit_count(F.col("mask").bitwiseAND(s)) % 2)
    sums = rows.groupBy("part", "good", "toxic").agg(*(F.sum(sign(s)).alias(f"s{s}") for s in range(32)))
    return sums.select("part", "good", "toxic", F.array(*(f"s{s}" for s in range(32))).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """part, n, good, toxic: arrays of the number of documents, good ones and toxic ones by mask."""
    inverse = "transform(sequence(0, 31), m -> aggregate(sequence(0, 31), 0L, (a, s) -> a + IF(bit_count(m & s) % 2 = 0, 1, -1) * sums[s]) div 32)"
    by_label = sums.select("part", "good", "toxic", F.expr(inverse).alias("cell"))
    added = lambda use: F.array(*(F.coalesce(F.sum(F.when(use, F.col("cell")[m])), F.lit(0)).cast("long") for m in range(32)))
    return by_label.groupBy("part").agg(added(F.lit(True)).alias("n"), added(F.col("good")).alias("good"), added(F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for each part and order."""
    counts = cells(parity_sums(failures(docs), labels))
    steps = counts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda place: f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {place}, 1)) - 1)"
    steps = steps.withColumn("own", F.expr(bit("step"))).withColumn("earlier", F.expr(f"aggregate(sequence(1, 5), 0, (a, k) -> a + IF(k < step, {bit('k')}, 0))"))
    total = lambda table, test, value="{}[m]": F.expr(f"aggregate(sequence(0, 31), 0L, (a, m) -> a + IF({test}, {value.format(table)}, 0L))")
    falls = "(m & own) <> 0 AND (m & earlier) = 0"
    return steps.select(
        "part", "filter_order", "step",
        total("n", "(m & (own | earlier)) = 0").alias("kept"),
        total("n", falls).alias("removed"),
        total("n", "(m & own) <> 0 AND (m & earlier) <> 0").alias("redundant"),
        F.col("n")[F.col("own")].alias("unique_fails"),
        total("good", falls).alias("good_lost"),
        total("toxic", falls).alias("toxic_lost"),
        total("n", "(m & own) <> 0", f"{len(ORDERS)} div bit_count(m) * {{}}[m]").alias("shapley"),
    )
