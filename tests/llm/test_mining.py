"""Hard negatives, the filter audit and the curriculum, against plain Python."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralex.llm import curriculum, filter_audit, hard_negatives, queries

VECTORS = "vec_id long, embedding array<double>, label long"
DOCS = "doc_id long, text string, lang string, source string"


# ---- hard negatives


def brute_mine(rows, is_anchor):
    taking = []
    for i, e, label in rows:
        if i is None or label is None or not e or None in e or not all(map(math.isfinite, e)):
            continue
        taking.append((i, [int(math.floor(256 * x)) for x in e], label))
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    score = lambda a, b: clip(sum(x * y for x, y in zip(a, b)))
    first = lambda found, k: sorted(found, key=lambda f: (-f[0], f[1]))[:k]
    anchors = {}
    for row in taking:
        if is_anchor(row[0]):
            anchors.setdefault(row[0], row)
    out = []
    for i, e, label in anchors.values():
        others = [(score(e, f), j, own) for j, f, own in taking if j != i and len(f) == len(e)]
        for p, j in {j: p for p, j, _ in reversed(first([o for o in others if o[2] == label], 5))}.items():
            out += [(i, p, k, n[1], j, n[0]) for k, n in enumerate(first([o for o in others if o[2] != label and 30 * j <= 100 * o[0] <= 90 * j], 10), 1)]
    return sorted(out)


def mined(spark, rows, condition, schema=VECTORS):
    found = hard_negatives.mine(spark.createDataFrame(rows, schema), F.expr(condition)).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found)


@pytest.fixture
def small_units(monkeypatch):
    for name, value in {"BLOCK": 16, "CHUNK": 4, "FIRST": 1, "GROWTH": 2, "PER_LIST": 20}.items():
        monkeypatch.setattr(hard_negatives, name, value)


def test_mining_against_brute_force(spark, small_units):
    r = np.random.default_rng(3)
    centres = r.normal(0, 1, (6, 5))
    rows = [(i, (centres[i % 6] + r.normal(0, 0.15, 5)).round(2).tolist(), int(i * 7 % 5)) for i in range(240)]
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(40)]  # ties, more than a block of them
    want = brute_mine(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows, "vec_id % 10 = 0") == want and len(want) > 300


def test_mining_odd_rows(spark, small_units):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (10, None, 1), (20, [], 1), (30, [1.0, None], 1), (40, [nan, 1.0], 1), (50, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (60, [1.0, 1.0], None)]
    rows += [(1, [1.0, 1.0], 1), (2, [0.5, 1.0], 2), (3, [0.5, 1.0], 2), (3, [0.5, 1.0], 2), (4, [1.0, 1.0, 1.0], 1), (5, [0.2, 0.5, 0.4], 2), (70, [1.0, 0.9, 0.8], 1), (80, [-1.0, -1.0], 1), (90, [0.0, 0.0], 1)]
    rows += [(100, [1e7, 1.0], 3), (101, [1e7, -1.0], 3), (102, [5e6, 5.0], 4), (103, [1e30, 5.0], 4), (110, [3e9, 1.0], 5), (111, [2e9, 2.0], 5), (112, [1e9, 3.0], 6)]
    want = brute_mine(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows, "vec_id % 10 = 0") == want and {a for a, *_ in want} >= {0, 70, 100}
    assert mined(spark, [], "vec_id % 10 = 0") == [] and mined(spark, [(10, None, 1)], "true") == [] and mined(spark, [(10, [1.0], 1)], "true") == []
    more = [(*row, "x", 1) for row in rows]
    assert mined(spark, more, "vec_id % 10 = 0", VECTORS + ", anchor string, list int") == want


def test_bounds_hold_and_stop_early(spark, small_units):
    r = np.random.default_rng(4)
    q, points = r.normal(0, 100, (5, 6)).round(), r.normal(0, 100, (50, 6)).round()
    centre = points.mean(axis=0)[None]
    low, high = hard_negatives.bounds(q, centre, np.array([np.linalg.norm(points - centre, axis=1).max()]))
    assert (q @ points.T <= high).all() and (q @ points.T >= low).all()
    rows = [(i, [float(i % 8 == k) * 4 + r.uniform(0, 0.1) for k in range(8)], 0) for i in range(400)]
    index = hard_negatives.build(spark.createDataFrame(rows, VECTORS))
    anchors = index.rows.filter("vec_id < 16").select(F.col("vec_id").alias("anchor"), "label", "vector")
    batches = anchors.withColumn("windows", F.expr("array(struct(0L AS positive_id, 0L AS positive_score, 0L AS least, 9999999L AS most, 900000L AS kth))")).toArrow().to_batches()
    visits = sum(b.num_rows for b in hard_negatives._visits(iter(batches), index.centres, index.radius, 0, 99))
    assert 16 <= visits <= 16 * len(index.parts) / 3  # the lists around the other axes are never visited


def test_exact_products():
    r = random.Random(5)
    a = [[r.choice([0, 1, -3, 2**40 + 1, -(2**55), 1e30]) for _ in range(4)] for _ in range(12)]
    b = [[r.choice([0, 5, 2**30, 2**52 + 1, 3]) for _ in range(4)] for _ in range(9)]
    want = [[max(-(1 << 63), min((1 << 63) - 1, sum(int(float(x)) * int(float(y)) for x, y in zip(p, q)))) for q in b] for p in a]
    assert hard_negatives.scores(np.array(a, float), np.array(b, float)).tolist() == want


# ---- the audit


def brute_audit(docs, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    parts = {}
    for i, text, lang, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs)
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), copy)
        parts.setdefault(lang or "", []).append(({f for f, bad in zip("ABCDE", tests) if bad}, i in good, i in toxic))
    out, totals = [], {}
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                redundant = sum(f in x[0] for x in rows) - len(here)
                out.append([part, "".join(order), step, len(left), len(here), redundant, sum(x[0] == {f} for x in rows), sum(x[1] for x in here), sum(x[2] for x in here)])
                totals[part, f] = totals.get((part, f), 0) + len(here)
    return sorted((*row, totals[row[0], row[1][row[2] - 1]]) for row in out)


def audited(spark, docs, labels, schema=DOCS):
    found = filter_audit.audit(spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return sorted(tuple(r[c] for c in columns) for r in found.collect())


def test_audit_against_filters_applied_in_turn(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(words[: r.choice([20, 300])], k=r.choice([5, 250]))) for _ in range(30)]
    docs = [(i, r.choice(texts) + r.choice(["", " $", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3]), r.choice(["en", "de"]), "s") for i in range(80)]
    docs += [(100, None, None, None), (101, "", "", None), (102, "", "en", None), (102, "", "en", None), (None, "", "en", None), (103, "\x1c é x" * 300, "xx", None), (104, "a b " * 400 + "#", "xx", None)]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 80, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (102, None, 1), (999, 1, 1)]
    assert audited(spark, docs, labels) == brute_audit(docs, labels)
    assert audited(spark, [], labels) == []
    more = [(*d, 1, "x", 2) for d in docs]
    assert audited(spark, more, [], DOCS + ", part int, digest string, mask int") == brute_audit(docs, [])


def test_words_of_long_texts(monkeypatch):
    monkeypatch.setattr(filter_audit, "CHUNK", 7)
    r = random.Random(8)
    for _ in range(300):
        text = bytes(r.choice(b"ab \n\x1c") for _ in range(r.randrange(60)))
        assert filter_audit.word_counts(text) == (len(text.split()), len(set(text.split())))


# ---- the curriculum


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, found, rest = set(names), {}, share * sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > repeats * sizes[s]}
        if not above:
            return found | {s: weight[s] * level for s in open_}
        for s in above:
            found[s] = repeats * sizes[s]
            rest -= found[s]
        open_ -= above
    return found


def some_docs(r, n):
    sources = ["b", "a", "Z", "é", "\U0001f600", "～", None, ""]
    return [(i, " ".join(["w"] * r.choice([0, 1, 7, 200])) if i % 9 else None, "en", r.choice(sources + ["b"] * 6)) for i in range(n)]


def test_mix_against_plain_targets(spark):
    for seed, n in ((1, 60), (2, 400)):
        docs = some_docs(random.Random(seed), n) + [(None, "x y", "en", "a"), (None, "x y", "en", "a"), (9007, "p q r", "en", "b"), (9007, "p q r", "en", "b")]
        sizes = {}
        for _, text, _, source in docs:
            sizes[source] = sizes.get(source, 0) + len((text or "").split())
        want = brute_targets(sizes)
        df = spark.createDataFrame(docs, DOCS)
        got = curriculum.mix(df).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, curriculum.mix(df.repartition(7)).collect())) and len(got) == len(docs)
        by_id = {d[0]: d[3] for d in docs if d[0] not in (None, 9007)}
        taken = dict.fromkeys(sizes, 0)
        for row in got:
            assert 0 <= row.taken <= 2 * row["size"]
            source = by_id.get(row.doc_id, "a" if row.doc_id is None else "b")
            if row.doc_id != 9007:
                assert row.source_size == sizes[source] and abs(row.target - want[source]) < 1e-6
                taken[source] += row.taken
        assert all(want[s] - 1 <= taken[s] <= want[s] + 1e-6 for s in sizes if s != "b" and s in by_id.values())
        assert sum(r.taken for r in got) >= 1.5 * sum(sizes.values()) - len(sizes)


def test_positions_have_no_gaps_and_follow_the_schedules(spark):
    docs = curriculum.sized(spark.createDataFrame([(i, "w " * (1 + i % 5), "en", f"s{i % 3}") for i in range(600)], DOCS))
    order = sorted(curriculum.training_order(docs, curriculum.targets(docs)).collect(), key=lambda r: r.position)
    at = 0
    for row in order:
        assert row.position == at
        at += row.words
    assert [r.time for r in order] == sorted(r.time for r in order) and 0 <= order[0].time and order[-1].time <= 1
    half = lambda s: sum(r.words for r in order if r.doc_id % 3 == s and r.time < 0.5) / sum(r.words for r in order if r.doc_id % 3 == s)
    assert abs(half(0) - 0.625) < 0.03 and abs(half(1) - 0.5) < 0.03 and abs(half(2) - 0.375) < 0.03


def test_inverse_of_schedules(spark):
    for knots in (*curriculum.SCHEDULES, ((0.0, 0.0), (1.0, 2.0)), ((0.0, 3.0), (0.2, 0.0), (0.6, 0.0), (0.6, 4.0), (1.0, 0.0))):
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]

        def demand(t):
            out = 0.0
            for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
                u = max(0.0, min(t, t1) - t0)
                out += area if t >= t1 else w0 * u + (w1 - w0) / (t1 - t0) * u * u / 2 if t1 > t0 else 0.0
            return out / sum(areas)

        found = spark.range(101).select((F.col("id") / 100).alias("part")).select("part", curriculum._due(F.col("part"), knots).alias("time")).collect()
        assert all(abs(demand(r.time) - r.part) < 1e-9 for r in found)
    with pytest.raises(ValueError):
        curriculum._due(F.lit(0.5), ((0.0, 0.0), (1.0, 0.0)))


def test_mix_of_nothing_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert curriculum.mix(empty).collect() == [] and curriculum.arranged(empty).collect() == []
    wordless = curriculum.mix(spark.createDataFrame([(1, None, None, None), (2, " \n", "en", "s")], DOCS)).collect()
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in wordless) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    more = spark.createDataFrame([(i, "a b c", "en", "s", "x", 1, 2.0, 3) for i in range(5)], DOCS + ", position string, row int, size double, bucket int")
    assert [(r["size"], r.taken) for r in curriculum.mix(more).collect() if r.taken] != []
    used = curriculum.arranged(more).collect()
    assert sum(r.words for r in used) == 22 and {r.position for r in used} == {"x"} and sorted(r.position_ for r in used)[0] == 0 and used[0].size == 2.0


def test_new_queries_run_over_whole_tables(spark, data):
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    assert queries.op13_curriculum(spark, data).count() == n
    assert queries.op12_filter_audit(spark, data).filter("filter_order = 'ABCDE'").agg(F.sum(F.expr("IF(step = 1, kept + removed, 0)"))).first()[0] == n
