"""The thin contract queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaguelens.llm import lm_score, quality
from leaguelens.llm.common import remainder, table
from leaguelens.llm.mixing import mix_documents
from leaguelens.llm.nn_descent import near_groups
from leaguelens.llm.packing import pack_documents
from leaguelens.llm.pii import find_personal_data
from leaguelens.llm.repeats import remove_repeats
from leaguelens.llm.simhash import simhash_components
from leaguelens.llm.sp_encode import encode_documents
from leaguelens.llm.topk import top_k


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    scored = quality.score_documents(docs, model)
    return scored.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op2_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), full=False)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), shingle_words=4)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm_score.score_documents(docs, remainder("doc_id", 10) != 0)
    return scored.withColumn("held_out", remainder("doc_id", 10) == 0)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_encode": op2_encode,
    "op3_mix": op3_mix,
    "op4_simhash": op4_simhash,
    "op5_topk": op5_topk,
    "op6_repeats": op6_repeats,
    "op7_pack": op7_pack,
    "op8_pii": op8_pii,
    "op9_near_vectors": op9_near_vectors,
    "op10_lm_score": op10_lm_score,
}

ORACLE_SQL: dict[str, str] = {
    "op5_topk": """
        WITH bad AS (
            SELECT DISTINCT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)
            WHERE x IS NULL OR isnan(x) OR isinf(x)
        ), v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings WHERE embedding IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM bad)
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    # every byte of every text, as two hex digits
    "op6_repeats": """
        WITH t AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), w AS (
            SELECT doc_id, i, row_number() OVER (PARTITION BY md5_number(substr(h, 2 * i + 1, 200)) ORDER BY doc_id, i) AS n
            FROM (SELECT doc_id, h, unnest(range(CAST(greatest(length(h) // 2 - 99, 0) AS BIGINT))) AS i FROM t)
        ), marked AS (
            SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM w WHERE n > 1
        ), numbered AS (
            SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
        ), spans AS (
            SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM numbered GROUP BY doc_id, run
        ), gaps AS (
            SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM spans
        ), cut AS (
            SELECT g.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept, sum(hi - lo) AS removed, count(*) AS n, max(hi) AS last
            FROM gaps g JOIN t ON g.doc_id = t.doc_id GROUP BY g.doc_id
        )
        SELECT t.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
               sha256(unhex(CASE WHEN cut.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
        FROM t LEFT JOIN cut ON t.doc_id = cut.doc_id
    """,
    "op9_near_vectors": """
        WITH RECURSIVE bad AS (
            SELECT DISTINCT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x IS NULL OR isnan(x) OR isinf(x)
        ), v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM bad)
        ), n AS (
            SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE list_dot_product(e, e) > 0
        ), links AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9
        ), reach AS (
            SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
        ), parts AS (
            SELECT u, min(v) AS component_id FROM reach GROUP BY u
        ), counts AS (
            SELECT u, count(*) AS n_links FROM links GROUP BY u
        )
        SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN parts ON vec_id = parts.u LEFT JOIN counts ON vec_id = counts.u
    """,
}
