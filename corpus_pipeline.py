"""A training-data pipeline over ``documents``: five operators, each stage's Parquet the next one's input.

quality_classifier  rejected documents go (score under 0.5)
near_duplicates     of each class of near copies the smallest doc_id stays
line_dedup          passages seen before in rank order (doc_id, unit) go from the texts
pseudonyms          private values become format-preserving pseudonyms
packing             pieces in sequences of at most 2048 tokens

All stages but the last return the columns of their input, whatever else it has beside ``doc_id`` and
``text``; ``n_chars`` follows a changed text.  An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.line_dedup import dedup_lines
from siltstone.llm.near_join import near_duplicates
from siltstone.llm.packing import pack_documents
from siltstone.llm.pseudonyms import pseudonymise, session_key
from siltstone.llm.quality_classifier import classify, fit_classifier
from siltstone.llm.storage import stored


def _like(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars counted anew."""
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels of ``docs`` (none of them held out) and keep what scores 0.5 or more.

    A null text is scored as an empty one; repeated rows get equal scores and go or stay together; a null
    id is only never learned from; without labels every score is 0.5 and all rows stay.
    """
    score = "quality score"
    while score in docs.columns:
        score += "_"
    model = fit_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model, score_col=score).where(F.col(score) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest id.

    Rows without an id stay, as do null texts and texts without words, which are like no other; rows
    that repeat an id stay or go together.
    """
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has (or an earlier place of the same one) go from the texts.

    No row goes.  A null id or text is left as it is; rows equal in id and text are one document; of
    rows with one id and different texts the order is that of a hash of the text.
    """
    return _like(dedup_lines(docs), docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values of every text become pseudonyms; null and empty texts stay, repeated rows get equal texts."""
    return _like(pseudonymise(docs, session_key(spark)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is packed, with a null or empty text as the end id alone; repeated rows and null ids are documents of their own."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicate_join),
    ("line_dedup", line_dedup),
    ("pseudonyms", pseudonyms),
    ("packing", packing),
]

#: The first stage's learned scores can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
