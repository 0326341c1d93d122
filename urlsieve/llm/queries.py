"""The named queries of the corpus operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm import (
    alignment, html_text, licenses, manifest, neighbours, packing, pieces, prefix_bpe, quality, secrets, simhash, token_counts, toxicity,
)
from urlsieve.llm.common import read
from urlsieve.session import run_dir

BYTE_BPE, PIECES = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
RANKS = tokenizers.path("byte_bpe_50k.tiktoken")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn

    return add


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ratio = quality.fit_ratio(docs, read(spark, sf_dir, "labels"))
    return quality.with_quality(docs, ratio).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.col("ratio").alias("mean_log_ratio"))


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return toxicity.with_toxicity(docs, model).drop("text")


@query("op6_secret_scans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secrets.digest(secrets.with_secrets(docs))


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, tokenizers.PATTERN)


@query("op5_license_scans")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.with_licenses(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


#: session setting that names a lasting cache of token counts; without it a run starts with an empty one
COUNT_CACHE = "spark.urlsieve.tokenCountCache"


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cache = spark.conf.get(COUNT_CACHE, None) or run_dir(spark, "token-counts")
    return token_counts.with_token_counts(docs, BYTE_BPE, tokenizers.PATTERN, cache).drop("text")


@query("op3_nearest_neighbours")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@query("op8_html_extraction")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(read(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)


@query("op11_prefix_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return prefix_bpe.round_trips(docs, RANKS, tokenizers.PATTERN).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = alignment.align(docs, BYTE_BPE, tokenizers.PATTERN, PIECES)
    slim = aligned.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"),
        "pairs", "pair_links", F.monotonically_increasing_id().alias("row"))
    counted = alignment.with_corpus_counts(alignment.stored(slim, spark, "alignment"), "row")
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_merkle_manifest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return manifest.verified(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
