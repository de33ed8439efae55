"""From raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, where ``docs`` is what its predecessor kept, and
returns a DataFrame that is written as Parquet and read again before the next one. All
but the last return the columns of ``documents``.

1. ``quality``: the classifier's word vectors and network are fitted on what there is
   (labels from ``sf_dir``); documents that it rejects go.
2. ``near_duplicates``: of each component of near duplicates the one with the smallest
   doc_id stays. Rows that share a doc_id are one document; rows with a null id stay.
3. ``decontamination``: documents in which a benchmark window occurs go.
4. ``personal_data``: personal data becomes its kind in brackets, and terms that give it
   away become a label or go; ``n_chars`` follows the new text.
5. ``tokens``: each text's token ids and the digest of their decoding.

No DuckDB SQL can express the fitted stages, so ``ORACLE_SQL`` is None; the stages are
tested against brute force instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import byte_bpe, decontamination, near_duplicates, pii, quality_classifier
from shelfscope.llm.common import shared_dir, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels")
    vectors = quality_classifier.word_vectors(docs)
    # the texts that the fit reads are looked up by the sample's ids, so the others don't move
    ids = F.broadcast(quality_classifier.sample(labels).select("__id"))
    pooled = quality_classifier.pooled(docs.join(ids, F.col("doc_id") == F.col("__id"), "left_semi"), vectors)
    return quality_classifier.accepted(docs.select(*COLUMNS), vectors, quality_classifier.train(pooled, labels))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    small_batches(spark)
    gone = near_duplicates.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    small_batches(spark)
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data taken out."""
    return (pii.sanitised(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
            .select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids' digest, the decoded bytes' digest."""
    small_batches(spark)
    return byte_bpe.round_trip(docs, keep=False)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``; each result is Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
