"""The queries of this subpackage over a folder of tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, minhash, packing, quality, repeats, tokencount, toxicity, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=75)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.identify(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(_table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_decontamination": op3_decontamination,
    "op4_warc_writer": op4_warc_writer,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_additive_quantisation": op8_additive_quantisation,
    "op9_language_id": op9_language_id,
    "op10_quality_crf": op10_quality_crf,
}

#: op4: base32 by fives of hexadecimal digits, 20 bits each.
OP4_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
  h AS (SELECT page_id, payload, octet_length(encode(payload))::BIGINT AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
  v AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (i * 5 + 1)::INT, 5))::INT) AS v FROM h)
  SELECT page_id, payload_bytes,
    array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> b) & 31) + 1, 1)), '')), '') AS payload_digest,
    CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
  FROM v"""

#: op6: all pairs that share a shingle, then everything each document reaches.
OP6_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) u(i) WHERE len(w) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT DISTINCT a AS id, a AS reached FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached),
  m AS (SELECT id, min(reached) AS component FROM r GROUP BY 1)
  SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
  FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.id = d.doc_id"""

#: op8: every inner product of the query set, added up component by component.
OP8_SQL = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), lambda a, b: a + b) AS score FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p QUALIFY rank <= 20"""

ORACLE_SQL: dict[str, str] = {"op4_warc_writer": OP4_SQL, "op6_minhash_near_dedup": OP6_SQL, "op8_additive_quantisation": OP8_SQL}
