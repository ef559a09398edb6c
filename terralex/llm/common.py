"""Helpers that the operators share: the shared folder, words, batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex.sources.scratch import mark, new_path, release, remove, shared_folder, written  # noqa: F401  the operators take them from here

#: Bytes that separate words (all ASCII but digits and letters) become a space, A-Z become a-z.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII digits and letters (lower-cased) and of all other non-ASCII characters."""
    return text.translate(WORD_BYTES).split()


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have yet."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs written with a number of each row, and the number's column. Rows are told apart by it, so texts needn't move to find repeated ones."""
    row = free_name(docs, "row")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def buckets_for(spark: SparkSession) -> int:
    """How many hash buckets a shuffle of packed rows uses: follows spark.sql.shuffle.partitions, which is set by the size of the data."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Settings of a session and the most that small_batches() leaves them: rows of an Arrow batch, its bytes, rows of a batch of the Parquet reader.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4_000_000, "spark.sql.parquet.columnarReaderBatchSize": 500}


def small_batches(spark: SparkSession) -> None:
    """Batches of texts are small, as the JVM holds them whole and an Arrow batch is held by its Python worker too; a session that asks for smaller ones keeps its settings."""
    for name, most in BATCHES.items():
        asked = spark.conf.get(name)
        now = int(asked) if asked.lstrip("-").isdigit() else spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(asked)
        if now <= 0 or now > most:
            spark.conf.set(name, most)


def parts(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of ``column``, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encoded(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes without decoding; null is empty."""
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in binary.to_pylist()]
