"""Secret scans over a trigram inverted index.

For each rule a Boolean trigram query is derived from its regex (Python's own regex parser gives the
syntax tree): a conjunction of alternatives of which a matching text must hold one each. Each batch of
documents is an index segment: the postings of the trigrams that the queries name. Postings are
intersected and united, and only candidates are run through the regex. Rules without a mandatory
trigram scan every text. Nothing is shuffled, and a task holds one segment at a time.

Defined results: a null text is empty and has no spans; repeated rows are scanned as they are. Spans are
in code points, end exclusive, leftmost and non-overlapping within a kind; kinds may overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import encoded, parts, text_of

#: Fixed values. kind: (pattern, ASCII letters in either case, group that is measured, its least length, group that is redacted)
BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6, 2),
    "access": (r"AKIA[A-Z0-9]+", False, 0, 20, 0),
    "hex": (r"[0-9a-f]+", False, 0, 24, 0),
}
#: Public formats of keys.
MORE = {
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", False, 0, 40, 0),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", False, 0, 15, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", False, 0, 30, 0),
    "private": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:[A-Za-z0-9+/=\s]|\\[nrt])*)", False, 0, 27, 0),
    "google": (r"AIza[A-Za-z0-9_-]{35,}", False, 0, 39, 0),
}
RULES = BASE | MORE
#: Alternatives of a part of a regex that are followed further.
MOST = 64


def _exact(tokens) -> list[str] | None:
    """The strings that the tokens can match, or None where they are too many."""
    out = [""]
    for op, arg in tokens:
        if op is sre.LITERAL:
            own = [chr(arg)]
        elif op is sre.IN:
            own = []
            for kind, value in arg:
                if kind is sre.LITERAL:
                    own.append(chr(value))
                elif kind is sre.RANGE and value[1] - value[0] < MOST:
                    own += map(chr, range(value[0], value[1] + 1))
                else:
                    return None
        elif op is sre.SUBPATTERN:
            own = _exact(arg[3])
        elif op is sre.BRANCH:
            branches = [_exact(b) for b in arg[1]]
            own = None if None in branches else [s for b in branches for s in b]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 2:
            one = _exact(arg[2])
            own = None if one is None else ["".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)]
        else:
            return None
        if own is None or len(out) * len(own) > MOST:
            return None
        out = [a + b for a in out for b in own]
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """A conjunction of disjunctions of sets of trigrams (lower-cased): each text that matches has, for each disjunction, all of one set."""
    tokens, query, i = list(_parser.parse(pattern)), [], 0
    while i < len(tokens):
        op, arg = tokens[i]
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1 and _exact(tokens[i : i + 1]) is None:
            tokens[i : i + 1] = list(arg[2]) * min(arg[0], 3)  # what has to be there at least
            op, arg = tokens[i]
            if _exact(tokens[i : i + 1]) is None:
                i += 1
                continue
        j = i
        while j < len(tokens) and _exact(tokens[i : j + 1]) is not None:
            j += 1
        strings = _exact(tokens[i:j]) or []
        if strings and min(map(len, strings)) >= 3:
            query.append([frozenset(s[k : k + 3].lower() for k in range(len(s) - 2)) for s in strings])
        i = max(j, i + 1)
    return query


@lru_cache
def _compiled():
    rules = {k: (re.compile(p, re.ASCII | (re.IGNORECASE if ci else 0)), group, least, out) for k, (p, ci, group, least, out) in RULES.items()}
    # the same spans, found without a stop at each single hex letter
    rules["hex"] = (re.compile(r"[0-9a-f]{24,}"), *rules["hex"][1:])
    queries = {k: trigram_query(p[0]) for k, p in RULES.items()}
    needed = sorted({t for q in queries.values() for alternatives in q for s in alternatives for t in s})
    return rules, queries, {t: i for i, t in enumerate(needed)}


@lru_cache
def _lookup():
    """Trigram code -> 1 + its number."""
    table = np.zeros(1 << 21, np.uint16)
    for t, i in _compiled()[2].items():
        a, b, c = t.encode()
        table[a << 14 | b << 7 | c] = i + 1
    return table


_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b < 128 else 0 for b in range(256)], np.uint32)


def postings(texts: list[bytes]) -> np.ndarray:
    """Number of trigram x document: True where the document holds it (in either case). The segment's inverted index."""
    out = np.zeros((len(_compiled()[2]) + 1, len(texts)), bool)
    sizes = np.array([len(t) + 2 for t in texts])
    b = _FOLD[np.frombuffer(b"".join(t + b"\0\0" for t in texts), np.uint8)]
    found = _lookup()[(b[:-2] << 14) | (b[1:-1] << 7) | b[2:]]
    at = np.flatnonzero(found)
    out[found[at], np.searchsorted(np.cumsum(sizes), at, "right")] = True
    return out[1:]


def candidates(index: np.ndarray, kind: str) -> np.ndarray:
    """Documents that can match: postings intersected within a set and over the query, united over alternatives."""
    _, queries, number = _compiled()
    fits = np.ones(index.shape[1], bool)
    for alternatives in queries[kind]:
        fits &= np.any([np.all(index[[number[t] for t in s]], axis=0) for s in alternatives], axis=0)
    return np.flatnonzero(fits)


def scan_segment(texts: list[bytes]) -> list[list[tuple[int, int, str, int, int]]]:
    """Per text: (start, end, kind, start and end of what is redacted) in order of start, then kind as listed."""
    rules, out = _compiled()[0], [[] for _ in texts]
    order, index, decoded = {k: i for i, k in enumerate(RULES)}, postings(texts), {}
    for kind, (regex, group, least, secret) in rules.items():
        for d in candidates(index, kind).tolist():
            text = decoded.get(d)
            if text is None:
                text = decoded[d] = texts[d].decode("utf-8", "replace")
            for m in regex.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    out[d].append((m.start(), m.end(), kind, m.start(secret), m.end(secret)))
    for spans in out:
        spans.sort(key=lambda s: (s[0], order[s[2]]))
    return out


SPANS = "array<struct<start:long,end:long,kind:string,secret_start:long,secret_end:long>>"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("secret_start", pa.int64()), ("secret_end", pa.int64())]))
    names = [f.name for f in kind.value_type]
    for batch in batches:
        for part in parts(batch, "text"):
            found = [[dict(zip(names, s)) for s in x] for x in scan_segment(encoded(part.column("text")))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])


def secret_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, spans: a row per row of docs."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(_spans, f"doc_id long, spans {SPANS}")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("spans").to_pylist()
        listed = [[(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in x] for x in rows]
        base = [",".join(t for k, t in x if k in BASE) for x in listed]
        columns = [batch.column("doc_id"), *(pa.array([sum(k == kind for k, _ in x) for x in listed], pa.int64()) for kind in BASE)]
        columns += [pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array([",".join(t for _, t in x) for x in listed])]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def digests(spans: DataFrame) -> DataFrame:
    return spans.mapInArrow(_digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redacted(batches: Iterator[pa.RecordBatch], text_at: str, mask: str, n_chars: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, text_at):
            column, at = part.column(text_at), part.schema.get_field_index(text_at)
            raw, out, changes = encoded(column), [], []
            for original, b, spans in zip(column.to_pylist(), raw, scan_segment(raw)):
                pieces, last = [], 0
                for a, z in sorted((s[3], s[4]) for s in spans):
                    if a >= last:
                        pieces += [original[last:a], mask]
                    last = max(last, z)
                out.append("".join([*pieces, original[last:]]) if pieces else original)
                changes.append(bool(pieces))
            done = part.set_column(at, part.schema.field(at), pa.array(out, column.type))
            if n_chars is not None:
                k = part.schema.get_field_index(n_chars)
                sizes = [len(t) if changed else n for t, changed, n in zip(out, changes, part.column(k).to_pylist())]
                done = done.set_column(k, part.schema.field(k), pa.array(sizes, part.schema.field(k).type))
            yield done


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]", n_chars: str = "n_chars") -> DataFrame:
    """docs with each secret replaced by mask; n_chars, if there is such a column, follows where the text has changed. No row is dropped."""
    counted = n_chars if n_chars in docs.columns else None
    return docs.mapInArrow(lambda batches: _redacted(batches, text, mask, counted), docs.schema)
