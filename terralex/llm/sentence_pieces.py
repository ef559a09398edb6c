"""SentencePiece encoding and decoding by a max-plus parallel scan.

Encoding is the best path of pieces (largest sum of scores, as in SentencePiece's unigram model; characters in no
piece cost ``UNKNOWN`` more than the worst piece and become byte pieces). Of paths with equal sums that with the
longest last piece counts, then the longest before it, and so on: one path, however a text is cut. Documents over
``GIANT`` characters are cut into chunks of ``CHUNK`` characters. The state at a chunk's edge is how many characters
the piece over it reaches behind it, so a chunk is a matrix of best scores from state to state. Matrices combine
associatively under (max, +): per segment of ``SEGMENT`` chunks in parallel, then over segments. That gives the best
sums at each edge, and with them each chunk tells from which state its path comes for any state it ends in; these
tables combine too, from the end. Then each chunk traces its own path back, independently. Inside a chunk, paths from
all states meet where no piece can cross (a word begins), so only its edges need all states; what lies between
two such places is coded once, when the chunk is cut, and its ids move on in place of its text.

The vocabulary is the public file named in ``MODEL`` (a parameter). Scores of a unigram model are taken as they are.
A BPE model has ranks instead: a piece of rank r gets ``-log(r + OFFSET)``, as its frequency falls about so (Zipf). The best
path by these scores is what is computed, not BPE's merges. Scores are multiples of ``1 / GRAIN``, so sums are exact
and don't depend on their order. Tests compare with brute force, and with the sentencepiece library reading the same
pieces as a unigram model, whose 32-bit sums may miss the best by a little.

Defined results: a null or empty text has no pieces. Rows that repeat doc_id and text give the same row each.
U+2581 in a text is read as a space, as SentencePiece does, so decoding doesn't give such a text back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from math import isqrt, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import parts, text_of, written

MODEL, GIANT, CHUNK, SEGMENT, UNKNOWN, CACHE = "piece_bpe_32k.model", 16_384, 4096, 256, 10.0, 200_000
OFFSET, GRAIN = 100, 1 << 20
#: Bytes of texts that a Python worker holds as strings at a time; a longer text is alone.
SLICE = 250_000
SPACE = "▁"
NEVER = float("-inf")
#: What lies between two places where every path has an edge.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def packed(*parts: np.ndarray) -> bytes:
    """A matrix, or a column and a row whose sum it is; the first byte tells which."""
    return bytes([len(parts)]) + b"".join(p.tobytes() for p in parts)


def unpacked(data: bytes) -> np.ndarray:
    values = np.frombuffer(data[1:])
    if data[0] == 2:
        column, row = values.reshape(2, -1)
        return column[:, None] + row[None, :]
    return values.reshape(isqrt(len(values)), -1)


def tree_of(pieces: dict[str, tuple[int, float]]) -> dict:
    """character -> (the same behind it, score, id); the id of what is no piece is -1."""
    inner: dict = {"": {}}
    for p in sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)}):
        i, score = pieces.get(p, (-1, NEVER))
        inner[p] = {}
        inner[p[:-1]][p[-1]] = inner[p], score, i
    return inner[""]


def graded(score: float) -> float:
    return round(score * GRAIN) / GRAIN


class Words(dict):
    """Best paths of words as (sum, ids in little-endian 32 bits, whether they decode to the word): a new one is worked out, and kept if it is short.
    At most ``CACHE`` words and as many of the time before, of which those met again stay."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.before = vocabulary, {}

    def __missing__(self, text: str) -> tuple[float, bytes, bool]:
        found = self.before.get(text) or self.vocabulary.coded(text)
        if len(text) <= 48:
            if len(self) >= CACHE:
                self.before = dict(self)
                self.clear()
            self[text] = found
        return found


class Vocabulary:
    """Pieces, scores, and best paths."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        plain, is_byte = model.SentencePiece.NORMAL, model.SentencePiece.BYTE
        ranked = model.trainer_spec.model_type == model.trainer_spec.BPE
        names, kinds = [p.piece for p in model.pieces], [p.type for p in model.pieces]
        self.pieces = {p.piece: (i, graded(-log(OFFSET - p.score) if ranked else p.score)) for i, p in enumerate(model.pieces) if p.type == plain}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(names, kinds)) if k == is_byte}
        self.raw = [bytes([int(p[3:5], 16)]) if k == is_byte else p.replace(SPACE, " ").encode() if k == plain else b"" for p, k in zip(names, kinds)]
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN
        self.longest = max(map(len, self.pieces))
        self.single = {p for p in self.pieces if len(p) == 1}
        self.coded_ids = [i.to_bytes(4, "little") for i in range(len(names))]
        self.tree = tree_of(self.pieces)
        self.parts_at_spaces = all(SPACE not in p.lstrip(SPACE) for p in self.pieces)
        self.words = Words(self)

    def steps(self, text: str, at: int) -> Iterator[tuple[int, float]]:
        """(end, score) of the pieces that begin here; a character that is no piece as an unknown one."""
        node, end = self.tree, at
        for c in text[at : at + self.longest]:
            if (found := node.get(c)) is None:
                break
            node, score, i = found
            end += 1
            if i >= 0:
                yield end, score
        if text[at] not in self.single:
            yield at + 1, self.unknown

    def path(self, text: str) -> tuple[float, list[int]]:
        """Best path from the text's begin to its end: sum and ids."""
        n, tree, single, unknown, longest = len(text), self.tree, self.single, self.unknown, self.longest
        best, back = [0.0] + [NEVER] * n, [None] * (n + 1)
        for at in range(n):
            sum_, node, end = best[at], tree, at
            for c in text[at : at + longest]:
                if (found := node.get(c)) is None:
                    break
                node, score, i = found
                end += 1
                if i >= 0 and sum_ + score > best[end]:
                    best[end], back[end] = sum_ + score, (at, i)
            if text[at] not in single and sum_ + unknown > best[at + 1]:
                best[at + 1], back[at + 1] = sum_ + unknown, (at, -1)
        ids, end = [], n
        while end:
            at, i = back[end]
            ids += (i,) if i >= 0 else [self.bytes[b] for b in reversed(text[at:end].encode())]
            end = at
        ids.reverse()
        return best[n], ids

    def coded(self, text: str) -> tuple[float, bytes, bool]:
        """The same with ids in little-endian 32 bits, and whether decoding them gives the text back."""
        score, ids = self.path(text)
        return score, b"".join(map(self.coded_ids.__getitem__, ids)), self.decode(ids) == text.replace(SPACE, " ").encode()

    def _words(self, text: str) -> list[tuple]:
        return list(map(self.words.__getitem__, WORD.findall(text) if self.parts_at_spaces else [text] * bool(text)))

    def encode(self, text: str) -> tuple[float, bytes, bool]:
        """Sum and ids of a stretch of text with edges at both ends, and whether they decode to it: ids decode one by one, so they do where each word's do."""
        if not text:
            return 0.0, b"", True
        scores, ids, exact = zip(*self._words(text))
        return sum(scores), b"".join(ids), all(exact)

    def packed(self, text: str, size: int) -> tuple[bytes, int, int, tuple[float, bytes, bool]]:
        """The matrix of a chunk, the first and last place where all paths meet, and what encode() gives between them.
        There the matrix is the sum of a column and a row, and they are kept instead; without such a place first is -1."""
        n = self.longest
        first, last = self._edge(text, n, size, text.find), self._edge(text, n, size, text.rfind)
        if first < 0:
            return packed(self._sweep(text, 0, size)), -1, -1, (0.0, b"", True)
        core = self.encode(text[first:last])
        return packed(self._head(text, first) + core[0], self._tail(text, last, size)), first, last, core

    def origins(self, text: str, size: int, sums: np.ndarray, meet: bool) -> np.ndarray:
        """For each state behind a chunk of ``size`` characters the state in front of it on the path that counts; -1: no path. sums: best sums up to the states in front.
        meet: all paths meet at the end of text, so there is only one."""
        n = self.longest
        best, back = [*sums.tolist(), *[NEVER] * size], [-1] * (n + size)  # a piece from in front of the chunk is longer than any in it
        for at in range(size):
            if best[at] > NEVER:
                for stop, score in self.steps(text, at):
                    if best[at] + score > best[stop]:
                        best[stop], back[stop] = best[at] + score, at
        out = np.full(n, -1, np.int16)
        for state in range(1 if meet else n):
            at = size + state
            if best[at] > NEVER:
                while back[at] >= 0:
                    at = back[at]
                out[state] = at
        return np.full(n, out[0], np.int16) if meet else out

    def _edge(self, text: str, least: int, most: int, find: Callable) -> int:
        """The first or last place from least to most where every path has an edge: before a space behind another character; else -1."""
        while self.parts_at_spaces and least <= most:
            at = find(SPACE, least, most + 1)
            if at <= 0 or text[at - 1] != SPACE:
                return at
            least, most = (at + 1, most) if find == text.find else (least, at - 1)
        return -1

    def _head(self, text: str, first: int) -> np.ndarray:
        """Best sums from each state in front to a place where all paths meet."""
        best = [NEVER] * first + [0.0]
        for at in range(first - 1, -1, -1):
            best[at] = max((score + best[stop] for stop, score in self.steps(text, at) if stop <= first), default=NEVER)
        return np.array(best[: self.longest])

    def _tail(self, text: str, last: int, size: int) -> np.ndarray:
        """Best sums from a place where all paths meet to each state behind."""
        best = [0.0] + [NEVER] * (size - last + self.longest)
        for at in range(size - last):
            if best[at] > NEVER:
                for stop, score in self.steps(text, last + at):
                    best[stop - last] = max(best[stop - last], best[at] + score)
        return np.array(best[size - last : size - last + self.longest])

    def _sweep(self, text: str, begin: int, end: int) -> np.ndarray:
        """Best sums from begin + i to end + j by pieces that begin before end."""
        n = self.longest
        best = np.full((n, end - begin + n), NEVER)
        for i in range(n):
            best[i, i] = 0.0
        for at in range(end - begin):
            for stop, score in self.steps(text, begin + at):
                np.maximum(best[:, stop - begin], best[:, at] + score, out=best[:, stop - begin])
        out = best[:, end - begin :]
        if begin == end:
            return out
        for i in range(n):  # a piece that reaches over the whole stretch
            for j in range(n):
                if i < end - begin:
                    continue
                out[i, j] = 0.0 if i == end - begin + j else NEVER
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


@lru_cache
def vocabulary(name: str) -> Vocabulary:
    import os

    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Vocabulary(name)


def prepared(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def decoded(ids: list[int], model: str = MODEL) -> str:
    """Text of a document's ids."""
    return vocabulary(model).decode(ids).decode("utf-8", "replace")[1:]


def _decoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if ids is None else decoded(np.frombuffer(ids, "<i4").tolist(), model) for ids in batch.column("ids").to_pylist()]
        yield batch.append_column(pa.field("decoded", pa.string()), pa.array(texts, pa.string()))


def decode(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """coded (ids, as of encode()) and a column decoded: the text of the ids."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(lambda b: _decoded(b, model), f"{schema}, decoded string")


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Max-plus product of all, in pairs."""
    while len(matrices) > 1:
        matrices = [times(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def behind(sums: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Best sums at the next edge."""
    return (sums[:, None] + matrix).max(axis=0)


def through(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    return np.where(state < 0, -1, table[np.maximum(state, 0)])


def _small(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(model)
    for batch in (part for whole in batches for part in parts(whole, "text", SLICE)):
        rows = []
        for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text"))):
            own = prepared(text)
            score, ids, exact = v.encode(own)
            rows.append((doc, mark, 0, len(own), score, ids, exact and SPACE not in text))
        yield _rows(rows)


CODED = "doc_id long, mark long, chunk int, n long, score double, ids binary, exact boolean"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def _rows(rows: list[tuple], schema: str = CODED) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], list(names))


def _by_key(batches: Iterator[pa.RecordBatch], keys: int, function: Callable[[list], list], schema: str) -> Iterator[pa.RecordBatch]:
    found = []
    for _, group in groupby((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[:keys]):
        found += function(list(group))
        if len(found) >= 256:
            yield _rows(found, schema)
            found = []
    yield _rows(found, schema)


def _grouped(df: DataFrame, keys: int, function: Callable[[list], list], schema: str) -> DataFrame:
    """What function makes of the rows with equal values in the first columns, in order of the next one.

    Groups are many and small, but not their work: so they are dealt by number, not by bytes, and meet as Arrow batches, without a pandas frame each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, *df.columns[:keys]).sortWithinPartitions(*df.columns[: keys + 1])
    return dealt.mapInArrow(lambda b: _by_key(b, keys, function, schema), schema)


CHUNKS = "doc_id long, mark long, chunk int, last boolean, odd boolean, n int, matrix binary, head string, meet boolean, core_n int, core_score double, core_ids binary, core_exact boolean, tail string"


def _chunks(batches: Iterator[pa.RecordBatch], model: str, size: int) -> Iterator[pa.RecordBatch]:
    """head: the text up to where all paths meet; core_*: what lies between the first and the last such place, coded; tail: the text behind.
    Without such a place head is the whole text, and the rest is empty."""
    v = vocabulary(model)
    for batch in (part for whole in batches for part in parts(whole, "text", SLICE)):
        for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text"))):
            odd, text, rows = SPACE in text, prepared(text), []
            for k, at in enumerate(range(0, len(text), size)):
                own = text[at : at + size + v.longest]
                n = min(size, len(text) - at)
                matrix, first, last, (score, ids, exact) = v.packed(own, n)
                core, tail = (own[first:last], own[last:]) if first >= 0 else ("", "")
                rows.append((doc, mark, k, at + n == len(text), odd, n, matrix, own[:first] if first >= 0 else own, first >= 0, len(core), score, ids, exact, tail))
                if len(rows) == 256 or rows[-1][3]:
                    yield _rows(rows, CHUNKS)
                    rows = []


SEGMENTS, ENTRIES = "doc_id long, mark long, segment int, matrix binary", "doc_id long, mark long, segment int, sums binary"
ORIGINS = "doc_id long, mark long, segment int, chunk int, tables binary, whole binary"
FINALS, EDGES = "doc_id long, mark long, segment int, final int", "doc_id long, mark long, chunk int, begin int, end int"


def _segment(rows: list[tuple]) -> list[tuple]:
    """rows (doc_id, mark, segment, chunk, matrix) of a segment."""
    return [(*rows[0][:3], packed(product([unpacked(r[4]) for r in rows])))]


def _entries(rows: list[tuple]) -> list[tuple]:
    """Best sums in front of each segment of a document; rows (doc_id, mark, segment, matrix)."""
    found, sums = [], None
    for *key, data in rows:
        m = unpacked(data)
        if sums is None:
            sums = np.full(len(m), NEVER)
            sums[0] = 0.0
        found.append((*key, sums.tobytes()))
        sums = behind(sums, m)
    return found


def _origins(rows: list[tuple], model: str) -> list[tuple]:
    """Of a segment: where each chunk's path comes from, for any state that it ends in, and the same for the whole segment.
    rows (doc_id, mark, segment, chunk, matrix, n, head, meet); the first has the sums in front in place of a matrix."""
    v, sums, tables = vocabulary(model), np.frombuffer(rows[0][4]), []
    for *_, data, n, head, meet in rows[1:]:
        tables.append(v.origins(head, len(head) if meet else n, sums, meet))
        sums = behind(sums, unpacked(data))
    whole = np.arange(v.longest, dtype=np.int16)
    for table in reversed(tables):
        whole = through(table, whole)
    return [(*rows[1][:4], np.array(tables, np.int16).tobytes(), whole.astype(np.int16).tobytes())]


def _finals(rows: list[tuple]) -> list[tuple]:
    """The state in which the path ends each segment of a document; rows (doc_id, mark, segment, whole)."""
    found, state = [], 0
    for *key, whole in reversed(rows):
        found.append((*key, state))
        state = int(np.frombuffer(whole, np.int16)[state])
    return found


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """begin and end state of each chunk."""
    for batch in batches:
        rows = []
        for doc, mark, chunk, tables, whole, state in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "chunk", "tables", "whole", "final"))):
            own = np.frombuffer(tables, np.int16).reshape(-1, len(whole) // 2)
            for k in range(len(own) - 1, -1, -1):
                begin = int(own[k][state])
                rows.append((doc, mark, chunk + k, begin, state))
                state = begin
        yield _rows(rows, EDGES)


TRACED = ["doc_id", "mark", "chunk", "odd", "n", "head", "meet", "core_n", "core_score", "core_ids", "core_exact", "tail"]


def _traced(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    """The path of each chunk from its begin to its end; between the places where all paths meet it is known."""
    v = vocabulary(model)
    for batch in (part for whole in batches for part in parts(whole, "core_ids", SLICE)):
        rows = []
        for doc, mark, chunk, odd, n, head, meet, core_n, core_score, core_ids, core_exact, tail, begin, end in zip(*(batch.column(c).to_pylist() for c in [*TRACED, "begin", "end"])):
            front, back = (head[begin:], tail[: n + end - len(head) - core_n]) if meet else (head[begin : n + end], "")
            (score, ids, exact), (more, others, also) = v.encode(front), v.encode(back)
            rows.append((doc, mark, chunk, n + end - begin, score + core_score + more, ids + core_ids + others, exact and core_exact and also and not odd))
        yield _rows(rows)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, mark, coded in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "coded"))):
            coded.sort(key=lambda c: c["chunk"])
            rows.append((doc, mark, len(coded), sum(c["n"] for c in coded), sum(c["score"] for c in coded), b"".join(c["ids"] for c in coded), all(c["exact"] for c in coded)))
        yield _rows(rows)


def encode(docs: DataFrame, model: str = MODEL, giant: int = GIANT, size: int = CHUNK, segment: int = SEGMENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per row of docs: doc_id, chunks (0: not cut), n (characters with the leading space), score, ids (little-endian 32-bit), exact (decoding gives the text back)."""
    number = F.col(doc_id).cast("long")  # a null id is 0 with an odd mark, so that joins need only plain equality
    slim = docs.select(F.coalesce(number, F.lit(0)).alias("doc_id"), number.isNull().cast("long").alias("absent"), text_of(text).alias("text"))
    slim = slim.select("doc_id", "text", F.shiftleft(F.xxhash64("text"), 1).bitwiseOR(F.col("absent")).alias("mark"))
    small = slim.filter(F.length("text") <= giant).mapInArrow(lambda b: _small(b, model), CODED)
    large = slim.filter(F.length("text") > giant)
    chunks = written(large.mapInArrow(lambda b: _chunks(b, model, size), CHUNKS).withColumn("segment", (F.col("chunk") / segment).cast("int")), "chunks")
    slices = chunks.select("doc_id", "mark", "segment", "chunk", "matrix", "n", "head", "meet").dropDuplicates(["doc_id", "mark", "chunk"])
    segments = _grouped(slices.select("doc_id", "mark", "segment", "chunk", "matrix"), 3, _segment, SEGMENTS)
    entries = _grouped(segments, 2, _entries, ENTRIES).select("doc_id", "mark", "segment", F.lit(-1).alias("chunk"), F.col("sums").alias("matrix"))
    origins = written(_grouped(slices.unionByName(entries, allowMissingColumns=True), 3, lambda rows: _origins(rows, model), ORIGINS), "origins")
    finals = _grouped(origins.select("doc_id", "mark", "segment", "whole"), 2, _finals, FINALS)
    inner = origins.join(finals, ["doc_id", "mark", "segment"]).mapInArrow(_edges, EDGES)
    bodies = chunks.select(*TRACED).dropDuplicates(["doc_id", "mark", "chunk"])
    coded = bodies.join(inner, ["doc_id", "mark", "chunk"]).mapInArrow(lambda b: _traced(b, model), CODED)
    whole = coded.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("chunk", "n", "score", "ids", "exact")).alias("coded"))
    again = chunks.filter("last").select("doc_id", "mark").join(whole, ["doc_id", "mark"]).mapInArrow(_joined, CODED)
    present = F.when(F.col("mark").bitwiseAND(F.lit(1)) == 0, F.col("doc_id"))
    return small.unionByName(again).select(present.alias("doc_id"), F.col("chunk").alias("chunks"), "n", "score", "ids", "exact")


def summary(coded: DataFrame) -> DataFrame:
    """doc_id, n_chunks, n_chars, n_tokens, score, ids_crc32, round_trip."""
    return coded.select(
        "doc_id", F.col("chunks").cast("long").alias("n_chunks"), "n", (F.length("ids") / 4).cast("long").alias("n_tokens"), "score", F.crc32("ids").alias("ids_crc32"), F.col("exact").alias("round_trip")
    ).withColumn("n", F.greatest(F.col("n") - 1, F.lit(0))).withColumnRenamed("n", "n_chars")
