"""A training-data pipeline: each stage calls one corpus operator and works on all that is left."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm import copies, packing, quality, secrets, toxicity
from urlsieve.llm.common import fence, read
from urlsieve.session import run_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and read like trusted text."""
    ratio = quality.fit_ratio(docs, read(spark, sf_dir, "labels"))
    judged = quality.with_quality(docs.select(*COLUMNS), ratio)
    return fence(judged, *COLUMNS, "kept").where("kept").select(*COLUMNS)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not call toxic."""
    model = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return toxicity.with_toxicity(docs.select(*COLUMNS), model).where(~F.col("toxic")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word Jaccard of 0.8), that of the smallest doc_id."""
    return copies.one_per_copy(docs.select(*COLUMNS))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked that few owners or few texts carry; n_chars follows the text."""
    judged = secrets.with_secrets(docs.select(*COLUMNS), max_owners=secrets.FEW, max_texts=secrets.FEW)
    clean = secrets.masked(judged)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences for training."""
    return packing.pack(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_spans),
    ("packing", packed),
]

# The stages fit models and follow links of any length, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is stored in the shared folder and read again."""
    docs, home = read(spark, sf_dir, "documents"), run_dir(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{i}-{name}")
        docs = spark.read.parquet(f"{home}/{i}-{name}")
    return docs
