"""The registered queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fmindex, langid, lines, lm, packing, pii, secrets, simhash, topk
from .common import bounded_batches, read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents"))


def op4_attention_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_norm_bucket_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op6_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.substring_dedup(read(spark, sf_dir, "documents"))


def op7_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_fingerprints(read(spark, sf_dir, "documents"))


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(read(spark, sf_dir, "documents"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(langid.remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    done = langid.identify(docs.select("doc_id", "text", held), langid.fit(docs))
    return done.select("doc_id", "held_out", "lang_pred", "score")


def bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: bounded(f)
    for f in (
        op1_harmonic_packing, op2_benchmark_decontamination, op3_pii_anchors, op4_attention_scoring, op5_norm_bucket_top_k, op6_fm_index_dedup, op7_covering_simhash, op8_secret_ownership, op9_line_dedup, op10_byte_convnet,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op5_norm_bucket_top_k": r"""
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op6_fm_index_dedup": r"""
WITH w AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM w, unnest(range(1, len(ws) - 33)) AS t(i)
), dup AS (
  SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)
), cov AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM dup, unnest(range(i, i + 35)) AS t(p) GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(w.ws) AS n_words, coalesce(len(c.ps), 0) AS n_removed, w.ws, c.ps FROM w LEFT JOIN cov c ON w.doc_id = c.doc_id
), marked AS (
  SELECT doc_id, string_agg(ws[p], ' ' ORDER BY p) AS t FROM kept, unnest(range(1, len(ws) + 1)) AS u(p)
  WHERE ps IS NULL OR NOT list_contains(ps, p) GROUP BY doc_id
)
SELECT k.doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM kept k LEFT JOIN marked m ON k.doc_id = m.doc_id
""",
    "op9_line_dedup": r"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT l.doc_id, l.i, l.line, shared.k IS NOT NULL AND l.doc_id <> shared.keeper AS drop_it FROM l LEFT JOIN shared ON l.k = shared.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (drop_it)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT drop_it), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
