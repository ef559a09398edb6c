"""The pipeline, stage by stage, against brute force."""

from __future__ import annotations

import re
from collections import defaultdict

import corpus_pipeline
from test_groups import brute_jaccard, roots
from test_texts import pieces_hold

from terralex.llm import common, quality, secret_scan
from terralex.llm.common import words, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    good = docs.filter("doc_id IN (1, 2, 4)").selectExpr("doc_id + 5000 AS doc_id", "concat(substring(text, 500, 900), ' token = \"0123456789abcdef0123456789abcdef', doc_id, '\" ', substring(text, 1400, 900)) AS text", "lang", "source", "n_chars")
    docs = docs.unionByName(good)
    made = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, data), name)
        assert docs.columns == COLUMNS
        made[name] = before, {r.doc_id: r for r in docs.collect()}
    before, after = made["quality_classifier"]
    source = spark.createDataFrame(list(before.values()), docs.schema)
    scores = {r.doc_id: r.score for r in quality.quality(source, quality.fit(source, spark.read.parquet(f"{data}/labels.parquet"))).collect()}
    assert after == {i: r for i, r in before.items() if scores[i] >= 0.3} and len(after) < len(before)
    before, after = made["exact_dedup"]
    groups = defaultdict(list)
    for i, r in before.items():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text)].append(i)
    assert after == {min(g): before[min(g)] for g in groups.values()}
    before, after = made["ngram_jaccard_join"]
    stay = set(roots(before, brute_jaccard([(i, r.text) for i, r in before.items()])).values())
    assert after == {i: before[i] for i in stay} and all(words(r.text.encode()) for r in after.values())
    before, after = made["secret_scan"]
    assert before.keys() == after.keys()
    spans = {i: secret_scan.scan_segment([r.text.encode()])[0] for i, r in before.items()}
    assert any(spans.values()) and all((after[i] == r) != bool(spans[i]) for i, r in before.items())
    assert all(r.n_chars == len(r.text) for i, r in after.items() if spans[i])
    rows = [(i, r.text) for i, r in after.items()]
    assert pieces_hold(corpus_pipeline.STAGES[-1][1](spark, docs, data).collect(), rows) == 0


def test_extra_columns_nulls_and_no_rows(spark, data):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, rep long, kept boolean, text_sha256 string, spans int"
    docs = spark.createDataFrame([(1, None, None, None, None, "a", 1, True, "b", 1), (None, "x", None, None, None, None, None, None, None, None), (1, "x", "", "", 0, "a", 1, True, "b", 1)], schema)
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            assert stage(spark, rows, data).columns == docs.columns
            stage(spark, rows, data).collect()
        corpus_pipeline.STAGES[-1][1](spark, rows, data).collect()
        assert corpus_pipeline.STAGES[0][1](spark, rows, data).columns == docs.columns


def test_small_batches_only_lower_what_a_session_asks_for(spark):
    before = {name: spark.conf.get(name) for name in common.BATCHES}
    try:
        common.small_batches(spark)
        assert all(int(spark.conf.get(name)) <= most for name, most in common.BATCHES.items())
        name = "spark.sql.execution.arrow.maxBytesPerBatch"
        for asked in ("1m", "1000", "67108864b"):
            spark.conf.set(name, asked)
            common.small_batches(spark)
            assert spark.conf.get(name) == (asked if asked != "67108864b" else str(common.BATCHES[name]))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
