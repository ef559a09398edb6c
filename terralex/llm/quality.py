"""Quality classifier: supervised subword embeddings.

Words, pairs of words in a row (by the difference of their hashes, so all words that repeat at once share a bucket) and the byte n-grams inside words are hashed to buckets; a document is the average of its buckets'
learned vectors, a softmax layer gives its label's probability. Trained by stochastic gradient descent
in numpy on a bounded sample of the labelled rows (``SAMPLE`` rows with at most ``SAMPLE_CHARS``
characters each, taken by a hash of doc_id: documented parameters). With two labels the trained layers
fold into one weight per bucket, so scoring a document is a mean of table entries over its whole text.

Defined results: a null or empty text has no buckets and gets the bias alone; null labels and labels
other than 0 and 1 aren't learned from; of conflicting labels of a doc_id the smaller counts; without
both labels to learn from, each score is the share of label 1 (0.5 without any). Rows are scored each,
repeated or not; a null doc_id counts as not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralex.llm.common import encoded, free_name, parts, text_of
from terralex.llm.ngram_join import slices

BITS, DIM, EPOCHS, RATE, SEED = 17, 8, 6, 4.0, 7
SAMPLE, SAMPLE_CHARS = 3000, 32768
GRAMS = (3, 4)
THRESHOLD, FOLDS = 0.3, 5

_SPACES = bytes(0x20 if b in (0, 9, 10, 11, 12, 13, 32) else b for b in range(256))
_M = {n: np.uint32(m) for n, m in {3: 0x9E3779B1, 4: 0x85EBCA77}.items()}
_M64, _SHIFT, _SHIFT64 = np.uint64(0x9E3779B97F4A7C15), np.uint32(32 - BITS), np.uint64(64 - BITS)


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature: buckets, which of them count, and where each text's buckets begin."""
    joined = b"".join(b" " + t.translate(_SPACES) + b" " for t in texts) + b" " * 16
    sizes = np.array([len(t) + 2 for t in texts])
    begins = np.cumsum(sizes) - sizes
    b = np.frombuffer(joined, np.uint8)
    space = b == 32
    wide = b.astype(np.uint32)
    n = len(b) - 16
    two = wide[:-1] | wide[1:] << np.uint32(8)
    three = two[:n] | wide[2 : n + 2] << np.uint32(16)
    four = two[:-2] | two[2:] << np.uint32(16)
    inner = space[1 : n + 1]
    yield (three * _M[3]) >> _SHIFT, ~inner, begins  # a space may only be the first or last byte
    yield (four[:n] * _M[4]) >> _SHIFT, ~(inner | space[2 : n + 2]), begins
    edge = space[:n] & ~inner
    starts = np.flatnonzero(edge) + 1
    stops = np.flatnonzero(inner & ~space[:n]) + 1
    code = slices(joined, starts, stops)  # of all bytes of the word
    first = np.searchsorted(starts, begins)
    yield code >> _SHIFT64, np.ones(len(starts), bool), first
    pair = np.zeros(len(starts), np.uint64)  # of the difference of both words' hashes: a word and itself again are one bucket, whatever the word
    pair[1:] = (code[1:] - code[:-1]) * _M64
    both = np.ones(len(starts), bool)
    both[first[first < len(both)]] = False
    yield pair >> _SHIFT64, both, first


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    out = np.add.reduceat(np.append(values, 0), begins, dtype=np.float64)
    return np.where(np.append(begins[1:], len(values)) > begins, out, 0)


class Model:
    """score = sigmoid(mean of weights of a document's buckets + bias)."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, counts, begins in features(texts) if texts else ():
            total += _sums(self.weights[buckets] * counts, begins)
            count += _sums(counts, begins)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def train(texts: list[bytes], labels: list[int]) -> Model:
    y = np.array(labels, int)
    share = y.mean() if len(y) else 0.5
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share + 1e-6) - np.log(1 - share + 1e-6)))
    rng = np.random.default_rng(SEED)
    rows = []
    for t in texts:
        ids, n = np.unique(np.concatenate([x[counts] for x, counts, _ in features([t])]).astype(np.int64), return_counts=True)
        rows.append((ids, (n / max(n.sum(), 1)).astype(np.float32)))
    embedding = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.log(np.array([1 - share, share], np.float32))
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, share_of = rows[i]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = share_of @ embedding[ids]
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(hidden, p)
            bias -= 0.02 * rate * p
            embedding[ids] -= (rate * share_of)[:, None] * back
    return Model((embedding @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` labelled documents outside the held-out fold. What comes to the driver is bounded by sample x SAMPLE_CHARS."""
    order = F.xxhash64("doc_id")
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(order, "doc_id").limit(sample)
    texts = docs.select("doc_id", text_of().alias("text")).filter(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).collect()
    return train([r["text"].encode() for r in rows], [r["quality"] for r in rows])


def _scored(batches: Iterator[pa.RecordBatch], model, text_at: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, text_at, 250_000):
            yield part.append_column(pa.field(name, pa.float64()), pa.array(model.value.scores(encoded(part.column(text_at)))))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "__score") -> DataFrame:
    """docs and a column of scores, whose name docs must not have; the model is a table of 2 ** BITS floats, whatever the data."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(lambda b, m=docs.sparkSession.sparkContext.broadcast(model): _scored(b, m, text, name), schema)


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(slim, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score THRESHOLD or more, as they are."""
    name = free_name(docs, "__score")
    return score(docs, model, name=name).filter(F.col(name) >= THRESHOLD).drop(name)
