"""The operators of this subpackage as queries over whole tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import arrow_batches, table


def op1_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_to_weights

    return mix_to_weights(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiff import media_digests, text_media

    arrow_batches(spark, 500)
    return media_digests(text_media(table(spark, sf_dir, "documents")))


def op3_balanced_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"))


def op4_bucket_pointer_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_bytes

    arrow_batches(spark, 500)
    return dedup_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digests, find_pii

    arrow_batches(spark, 1000)
    return digests(find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    arrow_batches(spark, 1000)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_divide_skip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_documents

    arrow_batches(spark, 500)
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    arrow_batches(spark, 500)
    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_super_kmer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_windows

    arrow_batches(spark, 500)
    return dedup_windows(table(spark, sf_dir, "documents")).drop("kept")


def op10_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    arrow_batches(spark, 500)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).drop("ids")


#: The same mix in SQL: prefix sums over whole sources instead of ranges.
OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM sized GROUP BY source),
caps AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget,
         coalesce(sum(cap) OVER w, 0) AS spent, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest
  FROM caps WINDOW w AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, (budget - spent) / rest AS level, cap / weight <= (budget - spent) / rest AS is_full FROM levels),
targets AS (SELECT source, source_size, budget, CASE WHEN is_full THEN cap ELSE weight * max(CASE WHEN NOT is_full THEN level END) OVER () END AS target FROM filled),
queued AS (
  SELECT s.*, t.source_size, t.target, t.budget,
         sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum,
         row_number() OVER (ORDER BY h, doc_id, size) AS rid
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
served AS (
  SELECT q.*, sum(size) OVER (ORDER BY CASE WHEN target > 0 THEN (pass * source_size + cum) / target ELSE 0 END,
         coalesce('s' || source, 'n'), pass, h, rid ROWS UNBOUNDED PRECEDING) AS total
  FROM queued q, (VALUES (0), (1)) p(pass))
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN total <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM served GROUP BY rid, doc_id, size, source_size, target
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mix_to_weights, op2_tiff_pages, op3_balanced_postings, op4_bucket_pointer_suffixes, op5_contextual_pii, op6_noisy_or_toxicity, op7_divide_skip_join, op8_text_density, op9_super_kmer_windows, op10_rank_queue_bpe]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_to_weights": OP1_SQL}
