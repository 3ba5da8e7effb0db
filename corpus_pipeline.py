"""Documents to training tokens in five stages, each on all that the one before kept.

Toxic documents go, one document of each class of near duplicates stays, documents that hold
benchmark passages go, live credentials are masked, and what is left is encoded. Every stage
but the last returns the columns of the documents it gets.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantlake.llm import bpe, credentials, decontaminate, neardup, toxicity
from tenantlake.llm.frame import row_key, settled, table

VOCABULARY = "byte_bpe_50k.json"


def without_rows(docs: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The documents whose row key over `columns` is not in `keys`."""
    keyed = docs.select(F.struct("*").alias("doc"), row_key(*columns).alias("row_key"))
    return keyed.join(keys.select("row_key").distinct(), "row_key", "left_anti").select("doc.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict as toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id."""
    return neardup.one_of_each(docs, neardup.near_duplicates(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without_rows(docs, found.filter("n_hit > 0"), "doc_id", "text")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, credentials that are no widely copied examples masked by their kind;
    n_chars is that of the new text."""
    clean = credentials.masked(docs, credentials.secrets(docs))
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(kind))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids."""
    ids = bpe.encoded(docs, public_tokenizers.path(VOCABULARY))
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("secrets", mask_secrets),
          ("bpe", encode)]

#: The classifier, the signatures and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
