"""Exact dedup by recipes of content-defined chunks; DataFrame functions only.

A text is normalised (each run of white space becomes one space) and cut, at least ``MIN_CHUNK`` characters
after the last cut, behind the next window of ``WINDOW`` characters that a checksum of each marks: cuts depend on
the characters around them alone. Equal chunks get one identifier, which a dictionary of
all chunks verifies: a 64-bit hash and a length stand for a chunk only if all chunks that have them
share one SHA-256; else the SHA-256 itself is part of the identifier. Documents are then compared by
their ordered identifier lists; the SHA-256 of the whole text is only checked within a group. Only digests are shuffled; drop_copies() moves texts once at most.

Defined results: a null text is empty. Rows that repeat doc_id and text count as copies of one another
and one of them is kept. A null doc_id stays only where its group has no other. Rows that share a
doc_id but not the text are separate. An empty table gives an empty result.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import mark, numbered, release, text_of, written

MIN_CHUNK, MAX_CHUNK, WINDOW = 512, 4096, 3


def normalised(column: str = "text"):
    return F.regexp_replace(text_of(column), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _class(seed: int) -> str:
    """A regex class of about a quarter of all characters, by a checksum: single ones in ASCII, blocks elsewhere."""
    blocks = [(c, c) for c in range(0x20, 0x7F)] + [(c, c + 7) for c in range(0x80, 0x600, 8)]
    blocks += [(c, c + 255) for c in range(0x600, 0xD800, 256)] + [(c, c + 255) for c in range(0xE000, 0x10000, 256)] + [(c, c + 4095) for c in range(0x10000, 0x110000, 4096)]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in blocks if crc32(f"{seed}:{a}".encode()) % 4 == 0) + "]"


def cut_pattern() -> str:
    """A chunk: MIN_CHUNK characters or more, up to a window of which each character is in its class; where none comes, MAX_CHUNK."""
    window = "".join(map(_class, range(WINDOW)))
    return rf"(?s).{{{MIN_CHUNK - WINDOW},{MAX_CHUNK - WINDOW}}}?{window}|.{{1,{MAX_CHUNK}}}"


def chunk_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """A row per chunk: doc_id, row (if given), sha (of the text), pos, h, n, chunk_sha; a document without chunks has one with a null pos."""
    keys = ["doc_id", "row"] if row else ["doc_id"]
    norm = docs.select(F.col(doc_id).alias("doc_id"), *([F.col(row).alias("row")] if row else []), normalised(text).alias("norm"))
    cut = norm.select(*keys, F.unhex(F.sha2("norm", 256)).alias("sha"), F.regexp_extract_all("norm", F.lit(cut_pattern()), F.lit(0)).alias("chunks"))
    return cut.select(*keys, "sha", F.posexplode_outer("chunks").alias("pos", "chunk")).select(
        *keys, "sha", "pos", F.xxhash64("chunk").alias("h"), F.length("chunk").alias("n"), F.unhex(F.sha2("chunk", 256)).alias("chunk_sha")
    ).withColumn("h", F.when(F.col("pos").isNotNull(), F.col("h")))


def chunk_dictionary(chunks: DataFrame) -> DataFrame:
    """h, n and whether they stand for one chunk only."""
    return (
        chunks.filter("pos IS NOT NULL")
        .groupBy("h", "n")
        .agg(F.min("chunk_sha").alias("low"), F.max("chunk_sha").alias("high"))
        .select("h", "n", (F.col("low") == F.col("high")).alias("verified"))
    )


def recipes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """doc_id, row (if given), sha, recipe (the ordered identifiers), copies (rows that repeat all these)."""
    chunks = written(chunk_rows(docs, text, doc_id, row), "chunks")
    keys = [c for c in chunks.columns if c in ("doc_id", "row", "sha")]
    # All others are verified. The list is next to empty, so chunks meet it where they are and a hot chunk isn't dealt out.
    clashes = written(chunk_dictionary(chunks).filter("NOT verified"), "clashes")
    known = chunks.join(clashes, ["h", "n"], "left").withColumn("verified", F.coalesce("verified", F.lit(True))).select(
        *keys, "pos", F.when(F.col("pos").isNotNull(), F.struct("pos", "h", "n", F.when(~F.col("verified"), F.col("chunk_sha")).alias("full"))).alias("id")
    )
    return known.groupBy(*keys).agg(
        F.array_sort(F.collect_set("id")).alias("recipe"), F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, 1).otherwise(0)).alias("copies")
    )


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row per row of docs."""
    own = written(recipes(docs, text, doc_id), "recipes")
    # Written, so that the join gets rows as they are and Spark can split a large group of copies.
    found = own.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.min("sha").alias("low"), F.max("sha").alias("high"))
    one = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(F.lit("texts with equal recipes differ")))
    groups = written(found.select("recipe", "keep_id", "group_size", one.alias("sha")), "groups")
    return (
        own.drop("sha").join(groups, "recipe")
        .select("doc_id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, all columns as they are.

    Rows are numbered, recipes find the numbers that go, and texts meet only those: they move once, or not at all where Spark finds the written numbers small enough to send."""
    own, row = numbered(docs)
    begin = mark(docs.sparkSession)
    found = written(recipes(own, text, doc_id, row), "recipes")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    one = F.when(F.min("sha") == F.max("sha"), F.min(order)["row"]).otherwise(F.raise_error(F.lit("texts with equal recipes differ")))
    first = written(found.groupBy("recipe").agg(one.alias("first"), F.count("*").alias("n")).filter("n > 1").select("recipe", "first"), "groups")
    gone = written(found.join(first, "recipe").filter("row <> first").select(F.col("row").alias(row)), "gone")
    release(docs.sparkSession, begin, mark(docs.sparkSession) - 1)
    return own.join(gone, row, "left_anti").drop(row)
