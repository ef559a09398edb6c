"""Sum-of-squares online packing of token sequences into windows of fixed size.

Each document is cut into whole windows and a rest. A rest goes to the fill level for which the sum
of squares of the counts of partially filled windows, kept in one array over levels, grows least
(Csirik et al.: the Sum-of-Squares algorithm). Tasks pack what they scan, in order, so nothing is
shuffled and a task holds only its open windows. At its end a task cuts the pieces in its emptiest open
windows to fill the fullest ones, and cuts the last one to powers of two, at which a sequence needs no
padding.

Token ids: byte-level BPE of the ``tokenizers`` file named in ``TOKENIZER``. Its rank file, the same
vocabulary, gives the same ids (tests compare them) several times faster, and words are looked up in a
bounded cache: a space between two characters that aren't white space always starts a new pre-token. Tokens
that the ``tokenizers`` file adds (<|endoftext|>) are found inside texts too, and are one id each: texts are
split at them first.

Defined results: a null or empty text is the closing id alone; repeated rows are packed each; a null
doc_id stays null.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import text_of

WINDOW, CLOSING, CACHE = 2048, 1, 400_000
TOKENIZER = "byte_bpe_50k"


@lru_cache
def _encoding(name: str):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache
def _added(name: str) -> dict[str, bytes]:
    """Tokens that the ``tokenizers`` file adds to the vocabulary, and their ids as 32-bit words."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if odd := [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"]]:
        raise ValueError(f"added tokens that don't match plainly: {odd}")
    return {t["content"]: t["id"].to_bytes(4, "little") for t in added}


class Words(dict):
    """A word -> the ids of it and the space before it as little-endian 32-bit words; None where white space at its edges may join that space."""

    def __init__(self, name: str):
        self.ordinary, self.added = _encoding(name).encode_ordinary, _added(name)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def encode(self, text: str) -> bytes:
        return np.array(self.ordinary(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes | None:
        if len(self) >= CACHE:
            self.clear()
        ids = None if not word or word[0].isspace() or word[-1].isspace() else self.encode(" " + word)
        if len(word) <= 64:
            self[word] = ids
        return ids


#: A space that has other characters than white space on both sides.
_CUT = re.compile(r"(?<=\S)(?= \S)")


def token_bytes(text: str, known: Words) -> bytes:
    """The ids of the text and the closing id."""
    if any(map(text.__contains__, known.added)):
        ids = b"".join(known.added.get(part) or _plain_bytes(part, known) for part in known.split(text))
    else:
        ids = _plain_bytes(text, known)
    return ids + CLOSING.to_bytes(4, "little")


def _plain_bytes(text: str, known: Words) -> bytes:
    """The ids of a text without added tokens."""
    first, *rest = text.split(" ")
    try:
        if first and first[-1].isspace():
            raise TypeError
        return known.encode(first) + b"".join(map(known.__getitem__, rest))
    except TypeError:  # white space in a row
        return b"".join(map(known.encode, _CUT.split(text)))


class Packer:
    """Places rests; a full window is given out at once."""

    def __init__(self, first_id: int, window: int = WINDOW):
        self.window, self.next_id = window, first_id
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def new(self, pieces: list) -> list[tuple]:
        """pieces (doc, start, length, ids, doc_tokens) as one sequence."""
        out, offset, self.next_id = [], 0, self.next_id + 1
        for doc, start, length, ids, total in pieces:
            out.append((doc, start, length, zlib.crc32(ids), total, self.next_id - 1, offset))
            offset += length
        return out

    def level(self, size: int) -> int:
        """The level (0: a new window) at which a piece of this size adds least to the sum of squares; the fuller one on a tie."""
        counts, window = self.counts, self.window
        after = 2 * counts[size:] + 1
        after[-1] = 0  # full windows don't count
        before = 1 - 2 * counts[: window - size + 1]
        before[0] = 0
        change = after + before
        change[1:][counts[1 : window - size + 1] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def place(self, piece: tuple) -> list[tuple]:
        size = piece[2]
        level = self.level(size)
        pieces = self.open[level].pop() if level else []
        self.counts[level] -= level > 0
        pieces.append(piece)
        if level + size == self.window:
            return self.new(pieces)
        self.open[level + size].append(pieces)
        self.counts[level + size] += 1
        return []

    def document(self, doc, ids: bytes) -> list[tuple]:
        total, out, w = len(ids) // 4, [], self.window
        for start in range(0, total - total % w, w):
            out += self.new([(doc, start, w, ids[4 * start : 4 * (start + w)], total)])
        if rest := total % w:
            out += self.place((doc, total - rest, rest, ids[4 * (total - rest) :], total))
        return out

    def close(self) -> list[tuple]:
        """Open windows, fullest first: pieces of the emptiest are cut to fill them; the last is cut to powers of two."""
        left = [(level, pieces) for level in range(self.window, 0, -1) for pieces in self.open[level]]
        out, spare = [], []
        low, high = 0, len(left)
        while low < high:
            level, pieces = left[low]
            low += 1
            need = self.window - level
            while need and (spare or low < high):
                if not spare:
                    high -= 1
                    spare = left[high][1]
                head, rest = _cut(spare.pop(), need)
                pieces.append(head)
                need -= head[2]
                if rest:
                    spare.append(rest)
            out += self.new(pieces) if not need else self._powers(pieces)
        if spare:
            out += self._powers(spare)
        self.__init__(self.next_id, self.window)
        return out

    def _powers(self, pieces: list) -> list[tuple]:
        out, left = [], sum(p[2] for p in pieces)
        pieces = pieces[::-1]
        while left:
            need = 1 << (left.bit_length() - 1)
            left -= need
            own = []
            while need:
                head, rest = _cut(pieces.pop(), need)
                own.append(head)
                need -= head[2]
                if rest:
                    pieces.append(rest)
            out += self.new(own)
        return out


def _cut(piece: tuple, size: int) -> tuple:
    doc, start, length, ids, total = piece
    if length <= size:
        return piece, None
    return (doc, start, size, ids[: 4 * size], total), (doc, start + size, length - size, ids[4 * size :], total)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(batches: Iterator[pa.RecordBatch], name: str, window: int) -> Iterator[pa.RecordBatch]:
    known, packer = Words(name), Packer(TaskContext.get().partitionId() << 33, window)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names)

    rows = []
    for batch in batches:
        for doc, text in zip(batch.column("doc_id"), batch.column("text")):
            rows += packer.document(doc.as_py(), token_bytes(text.as_py(), known))
            if len(rows) >= 20_000:
                yield batch_of(rows)
                rows = []
    yield batch_of(rows + packer.close())


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per piece; sequence_id is unique over all tasks."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(lambda b: _pack(b, tokenizer, window), SCHEMA)
