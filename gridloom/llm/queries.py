"""Registered queries of the training-data operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of_kind(column: str, kind: str) -> Column:
    return F.size(F.filter(column, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.sharding import feistel_shards

    out = feistel_shards(_table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op10_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.warc import round_trip

    return round_trip(spark, _table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.packing import best_fit_sequences

    return best_fit_sequences(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.decontamination import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op1_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.pii import BASE, find_pii, span_text

    found = find_pii(_table(spark, sf_dir, "documents"))
    counts = [_of_kind("base", k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def op8_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.secrets import KINDS, find_secrets, span_text

    found = find_secrets(_table(spark, sf_dir, "documents"))
    counts = [_of_kind("base", k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def op6_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.vector_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_semi_markov_pii, op3_ngram_jaccard_join, op6_nnpu_toxicity, op7_product_quantisation, op8_randomness_secrets, op2_token_counts, op4_string_tiling, op5_feistel_shards, op9_best_fit_packing, op10_warc_zstd)}

_COMPONENTS = """both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(id, c) AS (SELECT id, id FROM ids UNION SELECT b.b, r.c FROM reached r JOIN both_ways b ON r.id = b.a),
component AS (SELECT id, min(c) AS component_id FROM reached GROUP BY id)"""

#: SQL for those whose whole result it can express; the others are tested against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": f"""WITH RECURSIVE words AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
ids AS (SELECT id FROM words),
grams AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM words WHERE len(w) > 0),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
met AS (SELECT x.id AS a, y.id AS b, count(*) AS o FROM grams x JOIN grams y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON a = x.id JOIN sizes y ON b = y.id WHERE 100 * o >= 75 * (x.n + y.n - o)),
{_COMPONENTS}
SELECT ids.id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM ids JOIN component USING (id) LEFT JOIN sizes USING (id)""",
    "op7_product_quantisation": f"""WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings),
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id < q.id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.95),
{_COMPONENTS},
counts AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
SELECT ids.id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = ids.id AS kept FROM ids JOIN component USING (id) LEFT JOIN counts USING (id)""",
    # Base 32 digits come four at a time from each five hexadecimal ones.
    "op10_warc_zstd": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS original FROM pages),
d AS (SELECT *, sha1(h) AS hex FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to FROM d""",
}
