"""Corpus preparation: language ID, quality rules, near-duplicate removal, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet in
the shared folder and reads it again, as the next one's docs. All stages but the last return the
columns of ``documents``; the last returns the packed pieces with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm import langid, neardup, packing, quality, secret_scan
from weirflow.llm.common import discard, in_class, materialise


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language isn't told clearly (null and letterless texts too)."""
    model = langid.fit(docs.where(~in_class("doc_id", 3, 1)))
    return langid.keep_identified(docs, model)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the counting rules or the line chain reject."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return neardup.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    return secret_scan.redact_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token sequences of what is left; ``packing.sequences`` joins the pieces."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language_stage), ("quality rules", quality_stage), ("near duplicates", duplicates_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: The stages' models and signatures are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents: the places and checksums of the packed pieces that were written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        made = materialise(stage(spark, docs, sf_dir), f"stage{k}")
        discard(docs)  # what a stage wrote goes when the next one has
        docs = made
    return docs.drop("ids")
