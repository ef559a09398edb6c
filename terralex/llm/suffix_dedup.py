"""Suffix-array dedup: removes each byte of a string of ``LENGTH`` bytes that also starts earlier.

1. Scan: of each ``LENGTH`` consecutive bytes the smallest hash of ``GRAM`` bytes inside is their anchor
   (winnowing; hash, then place, whatever the length of the text), so equal strings have equal anchors at equal
   offsets. The strings of one anchor in a row are a context. Anchors are dealt by hash, packed: an anchor
   that stands once in all texts needs no more. Hashes only route; bytes decide what is equal. In a batch
   contexts with equal bytes are dealt once.
2. Contexts: the bytes of all contexts of the other anchors are dealt by anchor to buckets of about ``BUCKET``
   bytes, so many that each stays that small; their strings can be equal in whole or in part.
   An anchor with over ``HOT`` contexts is hot: its strings are dealt one by one, by their own hash, so no task
   holds a hot anchor; of equal strings in a slice only the earliest is dealt.
3. Shards: a bucket's contexts, those with equal bytes once, are cut into shards of ``SHARD`` bytes. A suffix array by Larsson-Sadakane refinement (only
   groups that aren't sorted yet are sorted again, by the rank half way), Kasai's common prefixes over neighbours,
   and the earliest start of each run of suffixes that share ``LENGTH`` bytes. Shards of a bucket are
   merged by binary search of one's strings in the other's suffix array. All repeats that a batch
   itself doesn't show are decided here.
4. Repeated starts go back to their documents, whose bytes are cut.

Rows move as packed arrays; texts are shuffled once, for two joins.

Defined results: a null text is empty. Rows that repeat doc_id and text are one document and get the same
result; rows that share only doc_id are ordered by the SHA-256 of the text; a null doc_id comes last. Cut text
is bytes, as a cut may fall inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import buckets_for, encoded, parts, text_of, written

LENGTH, GRAM, SHARD, BUCKET, BATCH = 100, 32, 1_000_000, 3_000_000, 8_000_000
HOT, SLICE = 4096, 8192
WINDOW = LENGTH - GRAM + 1
LAST = (1 << 63) - 1

SPOT = np.dtype([("hash", "<u4"), ("hash2", "<u2"), ("doc", "<i8"), ("mark", "<i8"), ("at", "<u4"), ("count", "u1")])
CONTEXT = np.dtype([("doc", "<i8"), ("mark", "<i8"), ("at", "<u4"), ("count", "u1")])
#: What packed spots are: anchors to be counted, or repeats that a batch shows.
COUNT, REPEATS = range(2)


@lru_cache
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base, rng = 0x9E3779B97F4A7C15, np.random.default_rng(3)
    ahead, back = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    ahead[0] = back[0] = 1
    return np.cumprod(ahead, dtype=np.uint64), np.cumprod(back, dtype=np.uint64), rng.integers(0, 1 << 63, 256, np.uint64)


def _sums(b: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any slice follows."""
    ahead, _, values = _tables(1 << max(12, len(b).bit_length()))
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(values[b] * ahead[: len(b)], out=out[1:], dtype=np.uint64)
    return out


def _slices(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    back = _tables(1 << max(12, (len(sums) - 1).bit_length()))[1]
    x = (sums[stops] - sums[starts]) * back[starts]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    out, have = v, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of LENGTH bytes or more: hash of each anchor, hash of its context, the start of its first string, and how many strings have it."""
    sums = _sums(b)
    starts = np.arange(len(b) - GRAM + 1)
    hashes = _slices(sums, starts, starts + GRAM)
    low = np.uint64(0xFFFFFFFF)
    at = (_sliding_min((hashes & ~low) | starts.astype(np.uint64), WINDOW) & low).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    count = np.diff(np.append(first, len(at)))
    return hashes[at[first]], _slices(sums, first, first + count + LENGTH - 1) ^ count.astype(np.uint64), first, count


def _batched(batches: Iterator[pa.RecordBatch], limit: int, *columns: str) -> Iterator[list[list]]:
    """Rows gathered to about ``limit`` bytes of text; texts as bytes, the rest as Python values."""
    held, size = [[] for _ in columns], 0
    for batch in batches:
        for part in parts(batch, "text", limit):
            for own, name in zip(held, columns):
                own += encoded(part.column(name)) if name == "text" else part.column(name).to_pylist()
            size = sum(map(len, held[columns.index("text")]))
            if size >= limit:
                yield held
                held, size = [[] for _ in columns], 0
    if held[0]:
        yield held


def _packed(bucket: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(rows)]))
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if z > a:
            yield int(bucket[a]), rows[a:z].tobytes()


def _whole(spots: np.ndarray) -> np.ndarray:
    return spots["hash"].astype(np.uint64) << np.uint64(16) | spots["hash2"].astype(np.uint64)


def _same_bytes(names: np.ndarray, order: np.ndarray, piece) -> tuple[list[int], list[int]]:
    """Places of pieces in order, the first of each different one and the later ones with its bytes. names: equal for equal pieces, and maybe for others."""
    first, later, heads = [], [], {}
    for i, name in zip(order.tolist(), names[order].tolist()):
        mine = heads.get(name)
        if mine is None:
            heads[name] = i
            first.append(i)
        elif piece(mine) == piece(i):
            later.append(i)
        else:  # another piece with the same hash
            first.append(i)
    return first, later


def _scan(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket, kind, packed spots."""
    for docs, marks, texts in _batched(batches, BATCH, "doc", "mark", "text"):
        found, names, which = [], [], []
        for number, (doc, mark, text) in enumerate(zip(docs, marks, texts)):
            if len(text) >= LENGTH:
                hashes, contents, first, count = anchors(np.frombuffer(text, np.uint8))
                own = np.empty(len(hashes), SPOT)
                own["hash"], own["hash2"] = hashes >> np.uint64(32), (hashes >> np.uint64(16)) & np.uint64(0xFFFF)
                own["doc"], own["mark"], own["at"], own["count"] = doc, mark, first, count
                found.append(own)
                names.append(contents)
                which.append(np.full(len(own), number))
        if not found:
            continue
        spots, names, which = np.concatenate(found), np.concatenate(names), np.concatenate(which)
        _, inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
        several = np.flatnonzero(counts[inverse] > 1)
        order = several[np.lexsort((spots["at"][several], spots["mark"][several], spots["doc"][several]))]
        at, size, text_of_spot = spots["at"].tolist(), (spots["count"].astype(np.int64) + LENGTH - 1).tolist(), which.tolist()
        first, later = _same_bytes(names, order, lambda i: texts[text_of_spot[i]][at[i] : at[i] + size[i]])
        one = np.ones(len(spots), bool)
        one[later] = False
        again = spots[later]
        # a row that is there twice isn't its own repeat
        heads = {names[i]: i for i in reversed(first)}
        its = spots[[heads[n] for n in names[later].tolist()]] if len(later) else again
        again = again[(again["doc"] != its["doc"]) | (again["mark"] != its["mark"]) | (again["at"] != its["at"])]
        rows = [(b, COUNT, x) for b, x in _packed((spots["hash"][one] % np.uint32(buckets)).astype(np.int64), spots[one])]
        if len(again):
            rows.append((int(again["hash"][0]) % buckets, REPEATS, again.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "spots"])


def _by_bucket(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, list[list]]]:
    current, held = None, [[] for _ in columns]
    for batch in batches:
        for bucket, *row in zip(batch.column("bucket").to_pylist(), *(batch.column(c).to_pylist() for c in columns)):
            if bucket != current:
                if held[0]:
                    yield current, held
                current, held = bucket, [[] for _ in columns]
            for own, x in zip(held, row):
                own.append(x)
    if held[0]:
        yield current, held


SPOT_SCHEMA = "doc long, mark long, `from` int, `to` int, hash long, hot boolean"


def _compared(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Ranges of starts that repeat (hash is null), and contexts whose bytes are wanted (hash of the anchor, whether it is hot)."""

    def repeats(spots: np.ndarray) -> pa.RecordBatch:
        begin = spots["at"].astype(np.int64)
        runs = _runs(spots["doc"], spots["mark"].astype(np.int64), begin, begin + spots["count"] - 1)
        return pa.RecordBatch.from_arrays([*runs.columns, pa.nulls(runs.num_rows, pa.int64()), pa.nulls(runs.num_rows, pa.bool_())], [*runs.schema.names, "hash", "hot"])

    for _, (kinds, blobs) in _by_bucket(batches, "kind", "spots"):
        for kind, blob in zip(kinds, blobs):
            if kind == REPEATS:
                yield repeats(np.frombuffer(blob, SPOT))
        if held := [np.frombuffer(x, SPOT) for kind, x in zip(kinds, blobs) if kind == COUNT]:
            spots = np.concatenate(held)
            _, inverse, counts = np.unique(_whole(spots), return_inverse=True, return_counts=True)
            stay = counts[inverse] > 1
            spots, hot = spots[stay], (counts > limit)[inverse[stay]]
            begin = spots["at"].astype(np.int64)
            columns = (spots["doc"], spots["mark"].astype(np.int64), begin.astype(np.int32), (begin + spots["count"] - 1).astype(np.int32), _whole(spots).view(np.int64), hot)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc", "mark", "from", "to", "hash", "hot"])


def _strings(flat: np.ndarray, which: np.ndarray, docs: np.ndarray, marks: np.ndarray, texts: list[bytes], buckets: int) -> Iterator[tuple]:
    """Rows of _contexts for contexts of hot anchors: each string is a context by itself; later ones of strings with equal bytes are starts that repeat."""
    for k in range(0, len(flat), SLICE):
        packed, names, owner = [], [], []
        for number in np.unique(which[k : k + SLICE]).tolist():
            own = flat[k : k + SLICE][which[k : k + SLICE] == number]
            counts = own[:, 2] - own[:, 1] + 1
            at = np.repeat(own[:, 1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            strings = np.empty(len(at), CONTEXT)
            strings["doc"], strings["mark"], strings["at"], strings["count"] = docs[number], marks[number], at, 1
            packed.append(strings)
            names.append(_slices(_sums(np.frombuffer(texts[number], np.uint8)), at, at + LENGTH))
            owner.append(np.full(len(at), number))
        strings, names, owner = np.concatenate(packed), np.concatenate(names), np.concatenate(owner).tolist()
        at = strings["at"].tolist()
        piece = lambda i: texts[owner[i]][at[i] : at[i] + LENGTH]
        first, later = _same_bytes(names, np.lexsort((strings["at"], strings["mark"], strings["doc"])), piece)
        for bucket, x in _packed((names[first] % np.uint64(buckets)).astype(np.int64), np.array(first)):
            chosen = np.frombuffer(x, np.int64)
            yield bucket, strings[chosen].tobytes(), b"".join(map(piece, chosen.tolist()))
        if later:
            heads = {names[i]: i for i in reversed(first)}
            its, again = strings[[heads[n] for n in names[later].tolist()]], strings[later]
            again = again[(again["doc"] != its["doc"]) | (again["mark"] != its["mark"]) | (again["at"] != its["at"])]
            yield int(names[later[0]] % np.uint64(buckets)), again.tobytes(), None


CONTEXT_SCHEMA = "bucket int, contexts binary, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed contexts and their bytes, by bucket; without bytes, starts that are known to repeat."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "contexts", "bytes"])

    for docs, marks, spots, texts in _batched(batches, BATCH, "doc", "mark", "spots", "text"):
        begins = np.cumsum([len(t) for t in texts]) - [len(t) for t in texts]
        b = b"".join(texts)
        which = np.repeat(np.arange(len(docs)), [len(s) for s in spots])
        flat = np.array([(x["hash"], x["from"], x["to"], x["hot"]) for s in spots for x in s], np.int64).reshape(-1, 4)
        hot = flat[:, 3] > 0
        if hot.any():
            held, size = [], 0
            for row in _strings(flat[hot], which[hot], np.array(docs, np.int64), np.array(marks, np.int64), texts, buckets):
                held.append(row)
                size += len(row[1]) + len(row[2] or b"")
                if size >= BATCH:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)
            flat, which = flat[~hot], which[~hot]
        bucket = ((flat[:, 0] >> 16) % buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        which, flat, bucket = which[order], flat[order], bucket[order]
        packed = np.empty(len(flat), CONTEXT)
        packed["doc"], packed["mark"] = np.array(docs, np.int64)[which], np.array(marks, np.int64)[which]
        packed["at"], packed["count"] = flat[:, 1], flat[:, 2] - flat[:, 1] + 1
        starts = (begins[which] + flat[:, 1]).tolist()
        stops = (begins[which] + flat[:, 2] + LENGTH).tolist()
        rows, size = [], 0
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(flat)]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                rows.append((int(bucket[a]), packed[a:z].tobytes(), b"".join(b[x:y] for x, y in zip(starts[a:z], stops[a:z]))))
                size += len(rows[-1][2])
                if size >= BATCH:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)


def _eights(b: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a big-endian number (zeros behind the end)."""
    wide = np.concatenate((b, np.zeros(8, np.uint8))).astype(np.uint64)
    two = wide[:-1] << np.uint64(8) | wide[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    return (four[:-4] << np.uint64(32) | four[4:])[: len(b)]


def suffix_array(eights: np.ndarray) -> np.ndarray:
    """Places in the order of their next LENGTH bytes, by Larsson-Sadakane refinement: a group is sorted again by the rank of what follows its common prefix."""
    n = len(eights)
    order = np.argsort(eights, kind="stable")
    new = np.ones(n, bool)
    new[1:] = eights[order][1:] != eights[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    have = 8
    while have < LENGTH:
        step = min(have, LENGTH - have)
        alone = new & np.append(new[1:], True)
        slots = np.flatnonzero(~alone)  # of groups that aren't sorted yet
        if not len(slots):
            break
        places = order[slots]
        following = rank[np.minimum(places + step, n - 1)]
        inner = np.lexsort((following, rank[places]))
        places, following = places[inner], following[inner]
        order[slots] = places
        groups = rank[places]
        split = np.ones(len(slots), bool)
        split[1:] = (groups[1:] != groups[:-1]) | (following[1:] != following[:-1])
        new[slots] = split
        rank[places] = np.maximum.accumulate(np.where(split, slots, 0))
        have += step
    return order


def common_prefixes(b: np.ndarray, eights: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Kasai: for each place in ``order`` the bytes, LENGTH at most, that it has in common with the place before it. All contexts advance together:
    the step from one place of a context to the next keeps all but one byte, if the neighbour's next place is in order before it too."""
    n = len(b)
    slot = np.full(n + 1, -1, np.int64)
    slot[order] = np.arange(len(order))
    out = np.zeros(len(order), np.int64)
    have, neighbour = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
    for t in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > t)
        i = starts[live] + t
        s = slot[i]
        j = np.where(s > 0, order[np.maximum(s - 1, 0)], -1)
        then = slot[np.minimum(neighbour[live] + 1, n)]
        kept = (neighbour[live] >= 0) & (then >= 0) & (then < s)
        h = np.where(kept, np.maximum(have[live] - 1, 0), 0)
        grow = np.flatnonzero(j >= 0)
        while len(grow):
            x, y = i[grow] + h[grow], j[grow] + h[grow]
            near = np.maximum(x, y) + 8 <= n
            whole = near & (eights[np.minimum(x, n - 1)] == eights[np.minimum(y, n - 1)])
            h[grow] += 8 * whole
            grow = grow[whole & (h[grow] < LENGTH)]
        grow = np.flatnonzero((j >= 0) & (h < LENGTH))
        while len(grow):
            x, y = i[grow] + h[grow], j[grow] + h[grow]
            same = (np.maximum(x, y) < n) & (b[np.minimum(x, n - 1)] == b[np.minimum(y, n - 1)])
            h[grow] += same
            grow = grow[same & (h[grow] < LENGTH)]
        out[s] = h = np.minimum(np.where(j >= 0, h, 0), LENGTH)
        have[live], neighbour[live] = h, j
    return out


class Part:
    """The suffix array of one part of a shard, cut to starts of strings: sorted distinct strings, and the earliest start of each."""

    def __init__(self, contexts: np.ndarray, data: bytes):
        self.b = np.frombuffer(data, np.uint8)
        self.eights = _eights(self.b)
        counts = contexts["count"].astype(np.int64)
        begins = np.cumsum(counts + LENGTH - 1) - counts - LENGTH + 1
        which = np.repeat(np.arange(len(contexts)), counts)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        context = np.full(len(self.b), -1, np.int64)
        context[begins[which] + inner] = which
        order = suffix_array(self.eights)
        order = order[context[order] >= 0]
        self.group = np.cumsum(common_prefixes(self.b, self.eights, order, begins, counts) < LENGTH) - 1
        which = context[order]
        self.doc, self.mark = contexts["doc"][which], contexts["mark"][which]
        self.at = contexts["at"][which].astype(np.int64) + order - begins[which]
        by = np.lexsort((self.at, self.mark, self.doc, self.group))
        first = np.ones(len(by), bool)
        first[1:] = self.group[by][1:] != self.group[by][:-1]
        self.first = by[first]  # slot of the earliest start of each group
        its_first = self.first[np.cumsum(first) - 1]
        self.repeats = np.zeros(len(by), bool)
        self.repeats[by] = (self.doc[by] != self.doc[its_first]) | (self.mark[by] != self.mark[its_first]) | (self.at[by] != self.at[its_first])
        self.place = order[self.first]

    def before(self, other: Part, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        a, b = self.first[mine], other.first[theirs]
        return np.where(self.doc[a] != other.doc[b], self.doc[a] < other.doc[b], np.where(self.mark[a] != other.mark[b], self.mark[a] < other.mark[b], self.at[a] < other.at[b]))

    def search(self, other: Part) -> tuple[np.ndarray, np.ndarray]:
        """Groups of self whose string other has too, and other's groups: binary search over sorted strings."""
        low, high = np.zeros(len(self.place), np.int64), np.full(len(self.place), len(other.place), np.int64)
        found = np.full(len(self.place), -1, np.int64)
        live = np.arange(len(self.place))
        while len(live := live[(low[live] < high[live]) & (found[live] < 0)]):
            middle = (low[live] + high[live]) // 2
            less, more, tied = np.zeros(len(live), bool), np.zeros(len(live), bool), np.arange(len(live))
            for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
                x, y = self.eights[self.place[live[tied]] + k], other.eights[other.place[middle[tied]] + k]
                less[tied], more[tied] = x < y, x > y
                tied = tied[x == y]
                if not len(tied):
                    break
            found[live[tied]] = middle[tied]
            high[live[less]] = middle[less]
            low[live[more]] = middle[more] + 1
        mine = np.flatnonzero(found >= 0)
        return mine, found[mine]


def _merge(parts_: list[Part]) -> None:
    """Marks the first starts that another part's earlier start repeats."""
    for i, a in enumerate(parts_):
        for b in parts_[:i]:
            mine, theirs = a.search(b)
            for one, two, own, its in ((a, b, mine, theirs), (b, a, theirs, mine)):
                one.repeats[one.first[own[two.before(one, its, own)]]] = True


def _runs(doc: np.ndarray, mark: np.ndarray, at: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Ranges of starts, joined where they touch within a document."""
    order = np.lexsort((at, mark, doc))
    doc, mark, at, last = doc[order], mark[order], at[order], last[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (at[1:] > last[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.maximum.reduceat(last, begin) if len(begin) else last
    columns = (doc[begin], mark[begin].astype(np.int64), at[begin].astype(np.int32), end.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "mark", "from", "to"])


def _distinct(contexts: np.ndarray, data: bytes, known: dict[bytes, int], at: int) -> np.ndarray:
    """A number for each context, equal for those with equal bytes, also among known ones, which begin at ``at``."""
    sizes = contexts["count"].astype(np.int64) + LENGTH - 1
    stops = np.cumsum(sizes).tolist()
    return np.array([known.setdefault(data[x:y], k) for k, (x, y) in enumerate(zip([0, *stops], stops), at)], np.int64)


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Contexts with equal bytes are sorted once, as the earliest of them; all of a later one's strings repeat."""
    for _, (blobs, texts) in _by_bucket(batches, "contexts", "bytes"):
        filled, numbers, pieces, at = [], [], {}, 0
        for blob, text in zip(blobs, texts):
            own = np.frombuffer(blob, CONTEXT)
            if text is None:
                start = own["at"].astype(np.int64)
                yield _runs(own["doc"], own["mark"].astype(np.int64), start, start)
                continue
            numbers.append(_distinct(own, text, pieces, at))
            filled.append(own)
            at += len(own)
        if not filled:
            continue
        contexts, numbers = np.concatenate(filled), np.concatenate(numbers)
        order = np.lexsort((contexts["at"], contexts["mark"], contexts["doc"], numbers))
        new = np.ones(len(order), bool)
        new[1:] = numbers[order][1:] != numbers[order][:-1]
        heads = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        again = order[(contexts[order] != contexts[heads])]
        start = contexts["at"][again].astype(np.int64)
        yield _runs(contexts["doc"][again], contexts["mark"][again].astype(np.int64), start, start + contexts["count"][again] - 1)
        firsts, texts = contexts[order[new]], list(pieces)  # both by number
        sizes, made = np.cumsum(firsts["count"].astype(np.int64) + LENGTH - 1), []
        cuts = [0, *np.searchsorted(sizes, np.arange(limit, sizes[-1], limit)).tolist(), len(firsts)]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                made.append(Part(firsts[a:z], b"".join(texts[a:z])))
        _merge(made)
        for part in made:
            start = part.at[part.repeats]
            yield _runs(part.doc[part.repeats], part.mark[part.repeats].astype(np.int64), start, start)


def _cut(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, "text"):
            rows = []
            for doc_id, text, ranges in zip(part.column("doc_id").to_pylist(), encoded(part.column("text")), part.column("ranges").to_pylist()):
                kept, end, removed, spans, digest = [], 0, 0, 0, hashlib.sha256()
                for r in sorted(ranges or [], key=lambda r: r["from"]):
                    begin, stop = r["from"], r["to"] + LENGTH
                    if begin > end or not removed:  # a new span; else the last one goes on
                        digest.update(own := text[end:begin])
                        kept.append(own)
                        spans += 1
                        removed += stop - begin
                        end = stop
                    elif stop > end:
                        removed += stop - end
                        end = stop
                digest.update(own := text[end:])
                kept.append(own)
                rows.append((doc_id, len(text), removed, spans, digest.hexdigest(), b"".join(kept) if keep_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def marked(slim: DataFrame) -> DataFrame:
    """doc_id, doc, text with mark: together with doc it tells different texts apart, in the order of their SHA-256. It is 0 throughout where no two rows share doc;
    else different pairs of doc and SHA-256 are numbered by a range sort, and the texts are written with their numbers."""
    shared = written(slim.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select("doc"), "shared")
    if shared.isEmpty():
        return slim.withColumn("mark", F.lit(0).cast("long")).select("doc_id", "doc", "mark", "text")
    hashed = slim.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    pairs = hashed.select("doc", "sha").join(shared, "doc", "left_semi").distinct()
    numbers = written(pairs.repartitionByRange("doc", "sha").sortWithinPartitions("doc", "sha").withColumn("mark", F.monotonically_increasing_id()), "marks")
    found = hashed.join(numbers, ["doc", "sha"], "left").select("doc_id", "doc", F.coalesce("mark", F.lit(0)).alias("mark"), "text")
    return written(found, "marked")


RANGE = "doc long, mark long, `from` int, `to` int"


def remove_repeats(docs: DataFrame, keep_text: bool = True, shard: int = SHARD, text: str = "text", doc_id: str = "doc_id", hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that are left)."""
    spark = docs.sparkSession
    buckets, n = buckets_for(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    named = marked(slim.withColumn("doc", F.coalesce("doc_id", F.lit(LAST))))

    scanned = named.select("doc", "mark", "text").mapInArrow(lambda b: _scan(b, buckets), "bucket int, kind int, spots binary")
    compared = scanned.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _compared(b, hot), SPOT_SCHEMA)
    spots = written(compared, "spots")

    starts, width = F.col("to") - F.col("from") + 1, F.when(F.col("hot"), F.lit(LENGTH)).otherwise(F.lit(1))
    size = spots.filter("hash IS NOT NULL").agg(F.sum(starts * width + F.when(F.col("hot"), 0).otherwise(LENGTH - 1))).first()[0] or 0
    many = max(n, -(-size // bucket))  # so that a bucket has so many bytes, and each task has one

    wanted = spots.filter("hash IS NOT NULL").groupBy("doc", "mark").agg(F.collect_set(F.struct("hash", "from", "to", "hot")).alias("spots"))
    with_text = named.join(wanted, ["doc", "mark"])  # doc_id comes along so that both joins share the shuffle of the texts
    contexts = with_text.select("doc_id", "doc", "mark", "spots", "text").mapInArrow(lambda b: _contexts(b, many), CONTEXT_SCHEMA)
    more = contexts.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _shards(b, shard), RANGE)

    ranges = spots.filter("hash IS NULL").select("doc", "mark", "from", "to").unionByName(more)
    by_doc = ranges.groupBy("doc", "mark").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    joined = named.join(by_doc, ["doc", "mark"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(lambda b: _cut(b, keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
