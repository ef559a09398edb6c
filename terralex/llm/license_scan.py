"""Licence scans with a generalised suffix automaton of licence words.

One automaton holds every word sequence of all templates. Each text is streamed through it, which gives
the matching statistics: the longest suffix of what was read that some template holds. Runs of words
that no template has are skipped, since they reset the automaton. For each template its maximal matches of at
least ``MIN_MATCH`` words, at all their places in it, are chained in order in both text and template with gaps of at
most ``GAP`` words: dynamic programming finds the chains, none over another's words, with the most words covered after
the costs of opening a chain and of gaps. A template of which a chain covers ``COVERED`` gives its label.
The automaton depends on the templates alone; the scan shuffles nothing and a task holds one batch.

Defined results: a null or empty text has no words, no labels and score 0. Repeated rows are scanned
each. Score is the largest covered share of any template, and 1 where a base phrase stands.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import encoded, parts, text_of, words

MIN_MATCH, GAP, COVERED = 4, 12, 0.75
OPEN, SKIP = 2.0, 0.05  # costs in words: of a chain, and of a word in a gap of text or template

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Wording of public licences and licence notices.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl-3": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by": ["This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "bsd-3": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}


class Automaton:
    """Suffix automaton of several word sequences; each state knows where its longest string ends in them."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for s, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].append((s, at + 1))
        self.ends = [set(e) for e in ends]  # a state also ends where the states that link to it do
        for state in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            self.ends[self.link[state]] |= self.ends[state]
        self.held = [self._held(state) for state in range(len(self.link))]

    def _held(self, state: int) -> dict[int, tuple[int | None, list[int]]]:
        """Of a state's strings, what each sequence holds at the end of them: at most so many words (None: all that is matched), and where they end."""
        out: dict[int, tuple[int | None, list[int]]] = {}
        most = None
        while state > 0 and self.length[state] >= MIN_MATCH:
            new: dict[int, list[int]] = {}
            for s, end in sorted(self.ends[state]):
                if s not in out:
                    new.setdefault(s, []).append(end)
            out |= {s: (most, places) for s, places in new.items()}
            state = self.link[state]
            most = self.length[state]
        return out

    def _new(self, length: int, link: int, following: dict[int, int], ends: list) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int, ends: list) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]), ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int, ends: list) -> int:
        q = self.next[last].get(word)
        if q is not None:  # another sequence has it already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word, ends)
        state, p = self._new(self.length[last] + 1, 0, {}, ends), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word, ends)
        return state

    def statistics(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state, and how many words up to here a template holds."""
        state = matched = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            yield state, matched


@lru_cache
def licences():
    """Vocabulary, automaton, template lengths, their labels, phrases as word numbers."""
    vocabulary: dict[bytes, int] = {}
    number = lambda text: [vocabulary.setdefault(w, len(vocabulary)) for w in words(text.encode())]
    listed = [(label, number(text)) for label, texts in TEMPLATES.items() for text in texts]
    phrases = [(number(p), label) for p, label in PHRASES.items()]
    return vocabulary, Automaton([s for _, s in listed]), [len(s) for _, s in listed], [label for label, _ in listed], phrases


def chains(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """matches (text start, template start, words) of one template -> chains (text start, text end, words covered) that share no words of the text.

    ``best[i]`` is the most that chains up to the end of match i are worth if i is the last match; a match goes on the chain of another that ends
    at most GAP words before it, in text and template, and gives up the words that both cover, or it opens a chain behind all that ended before."""
    matches = sorted(matches, key=lambda m: (m[0] + m[2], m[0], m[1]))
    ends = [m[0] + m[2] for m in matches]
    best, back, covered, top = [], [], [], []  # top: the match whose chain is worth most among the matches so far
    for i, (start, at, n) in enumerate(matches):
        before = bisect_right(ends, start, 0, i) - 1
        before = top[before] if before >= 0 else -1
        value, prior, own = (best[before] if before >= 0 else 0.0) + n - OPEN, (before, False), n
        for j in range(bisect_left(ends, start - GAP, 0, i), i):
            over = max(0, ends[j] - start, matches[j][1] + matches[j][2] - at)
            gap, skip = start + over - ends[j], at + over - matches[j][1] - matches[j][2]
            if over < n and ends[j] < ends[i] and 0 <= gap <= GAP and 0 <= skip <= GAP and (new := best[j] + n - over - SKIP * (gap + skip)) > value:
                value, prior, own = new, (j, True), n - over
        best.append(value)
        back.append(prior)
        covered.append(own)
        top.append(i if not i or value > best[top[-1]] else top[-1])
    out, i = [], top[-1] if matches else -1
    end = total = 0
    fresh = True
    while i >= 0:
        end, total = (ends[i], 0) if fresh else (end, total)
        total += covered[i]
        j, goes_on = back[i]
        if not goes_on:
            out.append((matches[i][0], end, total))
        i, fresh = j, not goes_on
    return out[::-1]


def matches_of(run: list[int], begin: int = 0) -> dict[int, list[tuple[int, int, int]]]:
    """Per template the maximal matches (text start, template start, words) of a run of known words that begins at a place of the text."""
    automaton, out, before = licences()[1], defaultdict(list), {}
    for i, (state, matched) in enumerate([*automaton.statistics(run), (0, 0)]):
        now = {} if matched < MIN_MATCH else {s: (most or matched, places) for s, (most, places) in automaton.held[state].items()}
        for s, (n, places) in before.items():
            if now.get(s, (0,))[0] != n + 1:  # can't be extended
                out[s] += [(begin + i - n, end - n, n) for end in places]
            elif len(places) > len(now[s][1]):  # some places can't
                going = set(now[s][1])
                out[s] += [(begin + i - n, end - n, n) for end in places if end + 1 not in going]
        before = now
    return out


def spans_of(known: np.ndarray) -> list[tuple[str, int, int, float]]:
    """(label, first word, end word, covered share) of the templates found in a text, at each place that is COVERED or else the best one, given as word numbers (-1: in no template)."""
    _, _, lengths, labels, _ = licences()
    matches = defaultdict(list)
    inside = np.flatnonzero(np.diff(np.concatenate(([0], known >= 0, [0]))))
    for a, b in inside.reshape(-1, 2).tolist():
        if b - a >= MIN_MATCH:
            for template, own in matches_of(known[a:b].tolist(), a).items():
                matches[template] += own
    found = []
    for template, own in matches.items():
        made = chains(own)
        best = max(made, key=lambda c: c[2], default=None)
        for begin, end, n in made:
            if n >= COVERED * lengths[template] or (begin, end, n) == best:
                found.append((labels[template], begin, end, min(1.0, n / lengths[template])))
    return found


def scan(texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, str]], list[tuple[str, int, int, float]]]]:
    """Per text: number of words, base places (first word, words, label), template spans."""
    vocabulary, _, _, _, phrases = licences()
    split = [words(t) for t in texts]
    sizes = [len(w) + 1 for w in split]  # -1 between texts
    known = np.full(sum(sizes), -1, np.int32)
    at, begins = 0, []
    for w, n in zip(split, sizes):
        known[at : at + n - 1] = np.fromiter(map(vocabulary.get, w, repeat(-1)), np.int32, n - 1)
        begins.append(at)
        at += n
    base = [[] for _ in texts]
    for phrase, label in phrases:
        hit = np.ones(max(0, len(known) - len(phrase) + 1), bool)
        for k, word in enumerate(phrase):
            hit &= known[k : k + len(hit)] == word
        for place in np.flatnonzero(hit).tolist():
            d = int(np.searchsorted(begins, place, "right")) - 1
            base[d].append((place - begins[d], len(phrase), label))
    # texts with a run of MIN_MATCH words that templates have
    run = np.ones(max(0, len(known) - MIN_MATCH + 1), bool)
    for k in range(MIN_MATCH):
        run &= known[k : k + len(run)] >= 0
    hot = set(np.unique(np.searchsorted(begins, np.flatnonzero(run), "right") - 1).tolist())
    for d, n in enumerate(sizes):
        yield n - 1, base[d], spans_of(known[begins[d] : begins[d] + n - 1]) if d in hot else []


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,covered:double>>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64())]))
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), span]
    for batch in batches:
        for part in parts(batch, "text", 2_000_000):
            rows = []
            for doc, (n, base, spans) in zip(part.column("doc_id").to_pylist(), scan(encoded(part.column("text")))):
                own = {label for *_, label in base}
                more = {label for label, _, _, covered in spans if covered >= COVERED}
                score = 1.0 if own else max((s[3] for s in spans), default=0.0)
                starts = [s for s, _, _ in base]
                listed = [dict(zip(("label", "first_word", "end_word", "covered"), s)) for s in sorted(spans, key=lambda s: s[1:])]
                rows.append((doc, n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | more)), score, listed))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.rpartition(":")[0] or x.split()[0] for x in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")])


def scan_licences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(_scanned, SCHEMA)
