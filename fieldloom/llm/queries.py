"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_blocks, huffman, language, quality
from .common import held_out, scratch_path
from .decontaminate import benchmark_hits
from .hamming import nearest_codes
from .jaccard_join import similar_documents
from .maxent import model_scores
from .packing import packed
from .token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op2_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 7, 2)
    return model_scores(table(spark, sf_dir, "documents"), out).withColumn("held_out", out)


def op3_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = huffman.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "shards"))
    return huffman.read_ids(spark, path)


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 3, 1)
    model = quality.learn(docs, labels.where(~out))
    return quality.scored(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extracted(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_codes(vectors, vectors.where("vec_id % 100 = 0"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = language.learn(docs.where(~out))
    return language.languages(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard_join, op2_maxent_scores, op3_huffman_ids, op4_quality_ranking, op5_html_blocks, op6_decontamination, op7_hamming_search, op8_packing, op9_token_counts, op10_language_spans)}


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x09-\x0D\x20]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9
), reach AS (
  SELECT doc_id AS node, doc_id AS low FROM documents
  UNION
  SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.node WHERE reach.low < links.b
)
SELECT d.doc_id, min(r.low) AS class_id, any_value(coalesce(l.n, 0)) AS n_links
FROM documents d JOIN reach r ON r.node = d.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = d.doc_id
GROUP BY d.doc_id
"""


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k:k + 9], ' ')) END) AS window FROM i
), places AS (
  SELECT doc_id, n, start, array_to_string(w[start:start + n - 1], ' ') AS window
  FROM d, (SELECT DISTINCT n FROM windows) s, LATERAL (SELECT unnest(range(1, greatest(len(w) - n + 2, 1))) AS start)
), found AS (SELECT doc_id, item_id, start, places.n AS n FROM places JOIN windows ON windows.window = places.window AND windows.n = places.n
), hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + n)) AS pos FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""


OP7_SQL = """
WITH most AS (SELECT len(embedding) AS size FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
codes AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0 AND NOT isnan(x)) AS bits FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = (SELECT size FROM most)),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.bits) + 1), lambda i: (q.bits[i] <> r.bits[i])::BIGINT))::BIGINT AS distance
  FROM codes q JOIN codes r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": OP1_SQL, "op6_decontamination": OP6_SQL, "op7_hamming_search": OP7_SQL}
