"""The queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_crf as q

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = q.train(docs, table(spark, sf_dir, "labels"))
    return q.quality(docs, model).drop("text")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op3_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .parity_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .external_shuffle import digest, shuffle

    return digest(shuffle(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests, encode_documents

    return digests(encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()))


def op6_langid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid_crf import identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, train(docs))


def op7_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sparse_suffix import drop_repeats

    return drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_int8_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .int8_dedup import similar

    return similar(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentence_spans import drop_repeats

    return drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sanitise as q

    done = q.sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [q.count_kind(F.col("base"), k).alias(f"n_{k}") for k in q.KINDS]
    return done.select("doc_id", *counts, F.sha2(q.listed(F.col("base")), 256).alias("base_sha256"), q.listed(F.col("found")).alias("spans"), "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality_crf, op2_best_fit_packing, op3_parity_join, op4_external_shuffle, op5_bpe,
        op6_langid_crf, op7_sparse_suffix, op8_int8_dedup, op9_sentence_spans, op10_sanitise,
    )}


#: words as the contract cuts them; A-Z alone are lowered
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), x AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION
  SELECT r.u, p.v FROM reach r JOIN p ON r.v = p.u
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.v) AS component_id
FROM s JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id, s.s
"""

OP8_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS (
  SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS norm FROM e
  WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), p AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings
  UNION
  SELECT r.u, p.v FROM reach r JOIN p ON r.v = p.u
), least_id AS (
  SELECT u, min(v) AS component_id FROM reach GROUP BY u
), links AS (
  SELECT u, count(*) AS n FROM p GROUP BY u
)
SELECT e.vec_id, coalesce(links.n, 0) AS n_links, least_id.component_id, e.vec_id = least_id.component_id AS kept
FROM e JOIN least_id ON least_id.u = e.vec_id LEFT JOIN links ON links.u = e.vec_id
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of op3 and op8; the other methods are held against brute force, a library or held-out accuracy."""
    return {"op3_parity_join": OP3_SQL, "op8_int8_dedup": OP8_SQL}
