"""Queries of the operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex.llm import curriculum, embedding_dedup, exact_dedup, filter_audit, hard_negatives, license_scan, ngram_join, packing, secret_scan, sentence_pieces, suffix_dedup, warc
from terralex.llm import quality as quality_model
from terralex.llm.common import new_path, small_batches, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.with_revisits(table(spark, sf_dir, "pages"))
    archives = written(warc.write_archives(records, new_path(spark, "warc")), "archives")
    read = written(warc.read_archives(archives, payloads=False), "records")
    return warc.resolved(read).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licences(table(spark, sf_dir, "documents")).drop("spans")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.quality(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sentence_pieces.summary(sentence_pieces.encode(table(spark, sf_dir, "documents")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.secret_spans(table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    shifted = vectors.withColumn("label", F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives.mine(shifted, F.col("vec_id") % 100 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_warc,
        op2_ngram_jaccard_join,
        op3_license_scan,
        op4_embedding_dedup,
        op5_exact_dedup,
        op6_quality_classifier,
        op7_packing,
        op8_sentence_pieces,
        op9_suffix_dedup,
        op10_secret_scan,
        op11_hard_negatives,
        op12_filter_audit,
        op13_curriculum,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
            g AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
            SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
            FROM g
        """,
        "op4_embedding_dedup": """
            WITH RECURSIVE v AS (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS e FROM embeddings
                WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
            l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
            r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
            n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
            SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(c.b, e.vec_id)) AS kept
            FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.a
        """,
        "op5_exact_dedup": r"""
            WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
            FROM d WINDOW w AS (PARTITION BY text_sha256)
        """,
        "op11_hard_negatives": """
            WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
                WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
            a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
            s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS alike, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score FROM a JOIN v ON a.vec_id <> v.vec_id),
            p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
            SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
        """,
        "op12_filter_audit": r"""
            WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
            d AS (SELECT part, doc_id, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c,
                  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
            l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
            f AS (SELECT d.part, [x for x in [CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END] if x IS NOT NULL] AS fails,
                  coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
            g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
            x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS y),
            o AS (SELECT p.y || q.y || r.y || s.y || t.y AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.y, q.y, r.y, s.y, t.y])) = 5),
            r AS (SELECT g.*, filter_order, CAST(step AS INT) AS step, filter_order[step] AS own, list_contains(fails, filter_order[step]) AS here, len([z for z in fails if strpos(filter_order, z) < step]) > 0 AS gone FROM g, o, range(1, 6) k(step)),
            e AS (SELECT part, filter_order, step, any_value(own) AS own, CAST(sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
                  CAST(sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN here AND len(fails) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                  CAST(sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM r GROUP BY part, filter_order, step)
            SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM e
        """,
        "op13_curriculum": r"""
            WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
            s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
            o AS (SELECT *, 2 * source_size AS most, row_number() OVER (ORDER BY 2 * source_size / weight, source) AS k FROM s),
            c AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS own FROM o WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            v AS (SELECT min_by(own, k) AS level FROM c WHERE most > weight * own),
            t AS (SELECT source, source_size, CASE WHEN level IS NULL OR most <= weight * level THEN CAST(most AS DOUBLE) ELSE weight * level END AS target FROM o, v),
            u AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS demand, sum(size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
            SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, demand - start)) + greatest(0, least(size, demand - start - source_size)) AS BIGINT) AS taken FROM u
        """,
    }
