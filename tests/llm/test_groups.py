"""Operators that compare documents or vectors, against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralex.llm import embedding_dedup, exact_dedup, linkage, ngram_join, suffix_dedup
from terralex.llm.common import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def odd_docs(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a"), (5, "a"), (6, "one two three"), (7, "One, two three!"), (None, "lost"), (8, long), (9, long + " end"), (10, "é" * 50), (11, "!!!")]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


def brute_jaccard(docs):
    sets = {}
    for i, t in docs:
        w = words((t or "").encode())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    index = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            index[g].add(i)
    links = set()
    for i, s in sets.items():
        for j in set().union(*(index[g] for g in s)) if s else ():
            if i < j and len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                links.add((i, j))
    return links


def test_jaccard_join_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    links = brute_jaccard(rows)
    want = roots([i for i, _ in rows], links)
    got = {r.doc_id: r for r in ngram_join.jaccard_join(docs).collect()}
    degree = defaultdict(int)
    for pair in links:
        for i in pair:
            degree[i] += 1
    assert len(links) > 3
    assert {i: r.class_id for i, r in got.items()} == want
    assert {i: r.n_links for i, r in got.items()} == {i: degree[i] for i, _ in rows}
    assert {i for i, r in got.items() if r.kept} == set(want.values())


def test_jaccard_join_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", 8)
    base = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(40) for k in [i % 60]]
    links = brute_jaccard(rows)
    got = {r.doc_id: r for r in ngram_join.jaccard_join(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)).collect()}
    assert {i: r.class_id for i, r in got.items()} == roots(range(40), links)
    assert sum(r.n_links for r in got.values()) == 2 * len(links) > 100


def test_jaccard_join_of_a_long_chain(spark, monkeypatch):
    """A group that only its neighbours connect: nodes go to the blocks of their candidates, and no link is lost."""
    monkeypatch.setattr(linkage, "BLOCK", 4)
    rows = [(i, " ".join(f"w{k}" for k in range(3 * i, 3 * i + 120))) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)
    links = brute_jaccard(rows)
    got = {r.doc_id: r for r in ngram_join.jaccard_join(docs).collect()}
    degree = [sum(i in pair for pair in links) for i, _ in rows]
    assert {r.class_id for r in got.values()} == {0} and [got[i].n_links for i, _ in rows] == degree
    classes = ngram_join.sketches(docs).select("node", "bands")
    groups = linkage.candidate_groups(classes)
    found = linkage.partner_blocks(classes, groups).collect()
    assert {r.size for r in found} == {400} and max(max(r["with"]) for r in found) < 100
    assert all(len(r["with"]) == len(set(r["with"])) for r in found) and sum(len(r["with"]) for r in found) < 400 * 100 / 3


def test_jaccard_join_odd_rows(spark):
    docs = odd_docs(spark)
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.kept) for r in ngram_join.jaccard_join(docs).collect()), key=str)
    want = [(1, 1, 0, True), (2, 2, 0, True), (3, 3, 0, True), (4, 4, 2, True), (5, 4, 2, False), (5, 4, 2, False), (6, 6, 1, True), (7, 6, 1, False), (8, 8, 1, True), (9, 8, 1, False), (10, 10, 0, True), (11, 11, 0, True), (None, None, 0, True)]
    assert got == sorted(want, key=str)
    stay = ngram_join.drop_near_copies(docs)
    assert stay.columns == docs.columns
    assert sorted((r.doc_id for r in stay.collect()), key=str) == sorted([1, 2, 3, 4, 6, 8, 10, 11, None], key=str)
    assert ngram_join.jaccard_join(docs.limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands = ngram_join.bands_for(0.8, 0.995, 7)
    assert 1 - (1 - 0.8**7) ** bands >= 0.995 > 1 - (1 - 0.8**7) ** (bands - 1)
    tables = embedding_dedup.tables_for()
    assert 20 < tables < 150


def test_near_vectors_against_brute_force(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    rng = np.random.default_rng(1)
    near = [(10_000 + 10 * r.vec_id + k, (np.array(r.embedding) * (k + 1) + rng.normal(0, scale, len(r.embedding)) * np.linalg.norm(r.embedding)).tolist(), r.label) for r in vectors.limit(60).collect() for k, scale in enumerate((0.02, 0.04, 0.05, 0.06))]
    vectors = vectors.unionByName(spark.createDataFrame(near, vectors.schema))
    rows = [(r.vec_id, np.array(r.embedding, float), r.label) for r in vectors.collect()]
    links = set()
    for n, (i, v, label) in enumerate(rows):
        for j, w, other in rows[n + 1 :]:
            if label == other and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links.add((min(i, j), max(i, j)))
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(vectors).collect()}
    want = roots([i for i, _, _ in rows], links)
    assert len(links) > 100
    assert {i: r.component_id for i, r in got.items()} == want
    assert sum(r.n_links for r in got.values()) == 2 * len(links)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_near_vectors_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, None], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (10, [1.0, 0.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    got = sorted((tuple(r) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)), (None, 0, None, True)]
    assert got == sorted(want, key=str)
    named = spark.createDataFrame([(r[0], r[1], None if r[2] is None else f"label {r[2]}", "x", 1, "y") for r in rows], "vec_id long, embedding array<float>, label string, node string, bands int, payload string")
    assert sorted((tuple(r) for r in embedding_dedup.near_vectors(named).collect()), key=str) == sorted(want, key=str)
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_connected_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in linkage.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).filter("doc_id IS NOT NULL").selectExpr("doc_id + 100000 AS doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    by = defaultdict(list)
    for i, t in rows:
        by[normal(t)].append(i)
    want = sorted((i, min(by[normal(t)]), len(by[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows)
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(by)
    stay = exact_dedup.drop_copies(docs)
    assert sorted(r.doc_id for r in stay.collect()) == sorted(min(v) for v in by.values())


def test_exact_groups_odd_rows(spark):
    docs = odd_docs(spark).union(spark.createDataFrame([(None, "lost", "", "", 0), (12, "lost", "", "", 0)], DOCS))
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert {(None, 12, 3, False), (12, 12, 3, True), (1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 3, True), (5, 4, 3, False)} <= got
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_hash_collision_of_chunks_does_not_merge(spark):
    """Two chunks with the same 64-bit hash and length but other bytes keep apart identifiers."""
    chunks = spark.createDataFrame([(1, 0, 7, 3, b"a"), (2, 0, 7, 3, b"b"), (3, 0, 9, 3, b"c")], "doc_id long, pos int, h long, n int, chunk_sha binary")
    assert {(r.h, r.verified) for r in exact_dedup.chunk_dictionary(chunks).collect()} == {(7, False), (9, True)}


def brute_repeats(docs, length=100):
    first = {}
    for i, t in sorted(docs):
        b = t.encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], (i, k))
    out = {}
    for i, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (i, k):
                gone[k : k + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("shard", [8_000_000, 3_000])
def test_remove_repeats_against_brute_force(spark, data, shard):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    more = [(1000, "x" * 150), (1001, "x" * 101), (1002, "ab" * 300), (1003, "Straße über " * 30), (1004, "z" * 99)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = brute_repeats([tuple(r) for r in docs.collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, shard=shard).collect()}
    assert sum(w[1] for w in want.values()) > 1000
    assert got == want


def test_remove_repeats_odd_rows(spark):
    a, b = "".join(map(chr, range(33, 127))) * 2, "".join(map(chr, range(126, 32, -1))) * 2
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (5, a + b, 0), (5, a + b, 0), (None, b, 0), (4, b, 0)], "doc_id long, text string, ranges int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect()), key=str)
    # 188 bytes with a period of 94: from 94 on a string of 100 bytes would be too long, so only covered bytes count
    alone = brute_repeats([(4, b), (5, a + b), (6, b)])
    assert got == sorted([(1, 0, 0, 0), (2, 0, 0, 0), (5, *alone[5][:3]), (5, *alone[5][:3]), (4, *alone[4][:3]), (None, *alone[6][:3])], key=str)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_recipes_decide_exact_groups(spark, monkeypatch):
    kind = "doc_id long, sha binary, recipe array<struct<pos:int,h:long,n:int,full:binary>>, copies long"
    rows = [(1, b"a", [(0, 5, 3, None)], 1), (2, b"a", [(0, 5, 3, None)], 2), (3, b"a", [(0, 6, 3, None)], 1)]
    monkeypatch.setattr(exact_dedup, "recipes", lambda *_: spark.createDataFrame(rows, kind))
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(spark.range(1)).collect())
    assert got == [(1, 1, 3, True), (2, 1, 3, False), (2, 1, 3, False), (3, 3, 1, True)]
    rows.append((4, b"b", [(0, 6, 3, None)], 1))
    with pytest.raises(Exception, match="equal recipes differ"):
        exact_dedup.exact_groups(spark.range(1)).collect()


def common_line(n):
    """Documents with one line in surroundings that differ, and some that don't."""
    rng = np.random.default_rng(5)
    letters = lambda k: "".join(map(chr, rng.integers(97, 123, k)))
    line, sides = "all rights reserved by the authors of this text", [letters(90) for _ in range(25)]
    return [(i, letters(120) + sides[rng.integers(25)] + line + sides[rng.integers(25)] + letters(120)) for i in range(n)]


@pytest.mark.parametrize("hot", [4096, 20])
def test_remove_repeats_of_hot_anchors(spark, data, hot):
    rows = common_line(120) + [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id") + 1000, "text").limit(40).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    want = brute_repeats(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, hot=hot).collect()}
    assert sum(w[1] for i, w in want.items() if i < 1000) > 1000
    assert got == want


def wanted_contexts(rows, buckets, hot=suffix_dedup.HOT):
    """What the rows' texts deal to the buckets of the last step, and the repeats known before."""
    import pyarrow as pa

    per = 50  # documents in a batch, so that batches have contexts in common
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in own]), pa.array([0] * len(own)), pa.array([t for _, t in own])], ["doc", "mark", "text"]) for own in (rows[k : k + per] for k in range(0, len(rows), per))]
    spots = pa.Table.from_batches([x for b in batches for x in suffix_dedup._scan(iter([b]), buckets)]).sort_by("bucket")
    found = pa.Table.from_batches(suffix_dedup._compared(iter(spots.to_batches()), hot)).to_pylist()
    by_doc = defaultdict(list)
    for r in found:
        if r["hash"] is not None:
            by_doc[r["doc"]].append(r)
    kept = [{"doc": i, "mark": 0, "spots": by_doc[i], "text": t} for i, t in rows if i in by_doc]
    batch = pa.RecordBatch.from_pylist(kept)
    return pa.Table.from_batches(suffix_dedup._contexts(iter([batch]), buckets)), [r for r in found if r["hash"] is None]


def test_contexts_of_a_hot_anchor_go_to_many_tasks():
    buckets, sizes = 16, defaultdict(int)
    for r in wanted_contexts(common_line(600), buckets, hot=100)[0].to_pylist():
        sizes[r["bucket"]] += len(r["contexts"]) + len(r["bytes"] or b"")
    assert len(sizes) == buckets and max(sizes.values()) < 3 * sum(sizes.values()) / buckets


def test_suffix_arrays_decide_repeats_of_other_batches():
    """Whole copies in other batches aren't known before the last step, and nothing is without its bytes."""
    r = np.random.default_rng(3)
    text = "".join(map(chr, r.integers(97, 123, 700)))
    rows = [(i, text if i in (10, 70, 130) else "".join(map(chr, r.integers(97, 123, 700)))) for i in range(150)]
    dealt, before = wanted_contexts(rows, 4)
    assert not before
    ranges = [x for b in [dealt.sort_by("bucket")] for x in suffix_dedup._shards(iter(b.to_batches()), 2_000)]
    found = {d: sorted((f, t) for x in ranges for doc, f, t in zip(*(x.column(c).to_pylist() for c in ("doc", "from", "to"))) if doc == d) for d in (10, 70, 130)}
    gone = {d: sum(t - f + 1 for f, t in x) for d, x in found.items()}
    assert gone == {10: 0, 70: 601, 130: 601}


def test_equal_hashes_of_other_bytes_remove_nothing(monkeypatch):
    """Contexts and strings whose hashes collide are told apart by their bytes."""
    monkeypatch.setattr(suffix_dedup, "_slices", lambda sums, starts, stops: (stops - starts).astype(np.uint64) * np.uint64(1 << 40))
    r = np.random.default_rng(4)
    rows = [(i, "".join(map(chr, r.integers(97, 123, 300)))) for i in range(16)] + [(99, "y" * 50 + "z" * 130)]
    for hot in (4096, 1):
        dealt, before = wanted_contexts(rows + [(100, rows[5][1])], 4, hot=hot)
        ranges = [x for x in suffix_dedup._shards(iter(dealt.sort_by("bucket").to_batches()), 3_000)]
        gone = defaultdict(set)
        for x in [*before, *(y for z in ranges for y in z.to_pylist())]:
            gone[x["doc"]] |= set(range(x["from"], x["to"] + 1))
        assert {d: len(x) for d, x in gone.items() if x} == {99: 30, 100: 201}


def test_anchors_do_not_depend_on_the_length_of_the_text():
    r = np.random.default_rng(9)
    piece = r.integers(97, 123, 400).astype(np.uint8)
    for size in (0, 3_000, 300_000):
        text = np.concatenate((r.integers(97, 123, size).astype(np.uint8), piece, r.integers(97, 123, size).astype(np.uint8)))
        hashes, _, first, count = suffix_dedup.anchors(text)
        own = {int(f) - size + d: int(h) for h, f, c in zip(hashes, first, count) for d in range(int(c)) if 0 <= int(f) - size + d <= 300}
        assert len(own) == 301 and (not size or own == before)
        before = own


def test_remove_repeats_of_a_very_long_text(spark):
    r = np.random.default_rng(2)
    passage = "".join(map(chr, r.integers(97, 123, 5_000)))
    rows = [(1, "".join(map(chr, r.integers(97, 123, 250_000))) + passage), (2, passage + "x" * 400), (3, "abc" + passage)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (255_000, 0, 0), 2: (5_400, 5_000 + 399, 2), 3: (5_003, 5_000, 1)}


def test_suffix_array_sorts_strings():
    rng = np.random.default_rng(0)
    data = bytes(rng.integers(97, 99, 4000).astype(np.uint8)) + b"ab" * 200
    order = suffix_dedup.suffix_array(suffix_dedup._eights(np.frombuffer(data, np.uint8)))
    whole = [i for i in order.tolist() if i + 100 <= len(data)]
    strings = [data[i : i + 100] for i in whole]
    assert strings == sorted(strings)


def test_near_vectors_of_extreme_lengths(spark):
    """Squares of these components overflow or vanish."""
    rows = [(1, [1e200, 0.0], 1), (2, [2e200, 0.0], 1), (3, [1e-200, 0.0], 1), (4, [1e308, 1e308], 2), (5, [1e-308, 1e-308], 2), (6, [5e-324, 0.0], 1), (7, [0.0, 3.0], 1)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert found == {1: (3, 1), 2: (3, 1), 3: (3, 1), 6: (3, 1), 4: (1, 4), 5: (1, 4), 7: (0, 7)}


def test_remove_repeats_of_texts_that_share_no_id(spark):
    """Different texts without an id, or with one id, are different documents, also where a short hash of them is the same."""
    tail = "y" * 16 + "shared words of a passage that is long enough to be found again " * 2
    words_of = spark.range(300_000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("head"))
    hashed = words_of.select("head", F.xxhash64(F.concat("head", F.lit(tail))).bitwiseAND(0xFFFFFFFF).alias("h"))
    pair = hashed.groupBy("h").agg(F.sort_array(F.collect_list("head")).alias("heads")).filter("size(heads) > 1").orderBy("h").first().heads
    texts = [pair[0] + tail, pair[1] + tail]
    for ids in ((None, None), (5, 5), (None, (1 << 63) - 1)):
        rows = [(0, tail), *zip(ids, texts)]
        order = {t: k for k, t in enumerate(sorted(texts, key=lambda t: hashlib.sha256(t.encode()).hexdigest()))}
        got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)).collect())
        assert sorted(r for _, r in got) == [0, len(tail), len(tail)] and len(order) == 2
    alone = [(i, t) for i, t in zip((None, None), texts)] + [(None, texts[0])]
    got = sorted(r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame([(i, t, "", "", 0) for i, t in alone], DOCS)).collect())
    assert got in ([0, 0, len(tail)], [0, len(tail), len(tail)])  # the repeated row is one document
