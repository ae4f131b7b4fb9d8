"""Training-corpus pipeline: quality, near duplicates, repeated spans, PII, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import packing, parity_join, quality_crf, sanitise, sentence_spans
from flowloom.llm.common import materialise
from flowloom.llm.queries import vocabulary

#: the stages trade SQL for models and hashes; tests hold them against brute force
ORACLE_SQL = None


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text and one column with all but the text, so that no operator's result can replace a column."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _unwrapped(done: DataFrame, names: list[str], **fresh) -> DataFrame:
    return done.select(*[(F.col("text") if c == "text" else fresh.get(c, F.col(f"row.`{c}`"))).alias(c) for c in names])


def _on_text(docs: DataFrame, operator) -> DataFrame:
    """``docs`` with the operator's texts; n_chars (where there is one) is counted anew."""
    return _unwrapped(operator(_wrapped(docs)), docs.columns, n_chars=F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line CRF or the base rules reject.

    Null, empty and blank texts are rejected; repeated rows fare alike; a null
    doc_id is judged like any other and never trained on; without labels the
    fixed weights judge; very long texts are read whole; an empty table stays
    empty; columns pass through unchanged, also those named like a result.
    """
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unwrapped(quality_crf.quality(_wrapped(docs), model).where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked documents: the first by doc_id (null last) and text.

    Rows equal in id and text become one; an id on two texts loses only the
    text that links; documents without a word stay; very long texts are read
    whole; an empty table stays empty; columns pass through unchanged.
    """
    return parity_join.keep_one(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes sentences of repeated spans; a document may be left with empty text.

    Null texts stay null and empty ones empty; null ids come last in the order
    of occurrences, ties go to the earlier position; rows equal in id and text
    are cut alike; an empty table stays empty; n_chars is counted anew, other
    columns, also those named like a count, pass through unchanged.
    """
    return _on_text(docs, sentence_spans.drop_repeats)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data and the terms that disclose it.

    Null texts stay null and empty ones empty; repeated rows are masked alike;
    very long texts are read whole; an empty table stays empty; n_chars is
    counted anew, other columns pass through unchanged.
    """
    return _on_text(docs, sanitise.sanitise)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs token pieces into sequences; a null or empty text is its closing id alone, each repeated row is packed."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_spans),
    ("PII", pii),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
