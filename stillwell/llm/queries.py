"""The registered queries of the corpus operators on the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from stillwell.llm import chunk_bpe, token_files, toxicity
from stillwell.llm.ann import nearest_vectors
from stillwell.llm.centroids import cluster_vectors
from stillwell.llm.exact_dedup import exact_groups
from stillwell.llm.line_dedup import line_report
from stillwell.llm.lm import language_scores
from stillwell.llm.minhash import near_groups
from stillwell.llm.packing import pack_documents
from stillwell.llm.span_dedup import repeat_report
from stillwell.llm.warc import archived
from stillwell.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return register


@query("op1_exact_dedup", r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
         g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_warc", """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
         w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> last THEN last END AS refers_to FROM w""")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_chunk_bpe")
def op8_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_minhash", r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t
        FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(t) - 4, least(len(t), 1)) + 1), lambda i: array_to_string(t[i:i + 4], ' '))) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * m >= 75 * (u.k + v.k - m)),
    r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
    SELECT doc_id, coalesce(k, 0) AS n_shingles, c AS component_id, doc_id = c AS kept
    FROM (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) LEFT JOIN n USING (doc_id)""")
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"), search="letters")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op7_ann")
def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"))


@query("op10_language_model")
def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def _cluster_sql(clusters: int = 16, rounds: int = 3) -> str:
    gap = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
             f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INT AS cluster, v AS c FROM v
        QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= {clusters})"""]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT vec_id, v, min(struct_pack(d := d, k := cluster)) AS best FROM
        (SELECT vec_id, v, cluster, {gap} AS d FROM v CROSS JOIN c{n}) GROUP BY vec_id, v)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN (SELECT k, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM
        (SELECT best.k AS k, i, sum(v[i])::BIGINT AS t, count(*) AS n FROM a{n} CROSS JOIN range(1, 65) g(i) GROUP BY 1, 2) GROUP BY k) m ON m.k = cluster)""")
    return f"""WITH {', '.join(parts)}
    SELECT vec_id, best.k AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
        sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON cluster = best.k"""


@query("op13_centroids", _cluster_sql())
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op12_suffix_dedup")
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))
