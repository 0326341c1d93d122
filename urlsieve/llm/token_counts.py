"""Token counts with a digest cache.

A text is known by the digest of its normalised content together with the digest of the tokenizer's file.
Digests that the cache lacks are the misses; one text of each distinct miss is encoded, the counts are
appended to the cache, and all rows read their counts from it by a join on the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm.bpe import cached_bpe
from urlsieve.llm.common import free_names
from urlsieve.operators.lookups import fits_broadcast, lookup_join
from urlsieve.session import cut_lineage

LIMIT = 1024
SCHEMA = "digest binary, n_tokens long"


def tokenizer_version(path: str, library: str) -> str:
    """Digest of a tokenizer's file and of the library that runs it."""
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\0" + f.read()).hexdigest()


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The stored counts of one tokenizer version; empty where nothing is stored yet."""
    home = f"{cache}/version={version}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(SCHEMA).parquet(home) if there else spark.createDataFrame([], SCHEMA)


def first_rows(each: DataFrame, version: str, cache: str, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Of ``_digest, _key, _n`` (rows per digest and key): the pairs to encode, and those that need not be.

    Digests that the cache lacks are encoded once each: at the smallest key that has them.
    """
    first = each.groupBy("_digest").agg(F.min("_key").alias("_first"))
    known = cached_counts(spark, cache, version).select("digest").distinct()
    todo = first.join(known, first["_digest"] == known["digest"], "left_anti")
    marked = each.join(todo.withColumnRenamed("_digest", "_d"), (F.col("_digest") == F.col("_d")) & F.col("_key").eqNullSafe(F.col("_first")), "left")
    state = F.when(F.col("_d").isNull(), "skip").when(F.col("_n") > 1, "many").otherwise("one")
    marked = cut_lineage(marked.select(pair_of(F.col("_digest"), F.col("_key")).alias("_pair"), state.alias("_state")))
    return marked.where("_state <> 'skip'"), marked.where("_state <> 'one'")


def pair_of(digest: Column, key: Column) -> Column:
    return F.concat_ws(":", F.hex(digest), key)


def with_token_counts(
    docs: DataFrame, tokenizer: str, pattern: str, cache: str, text: str = "text", limit: int = LIMIT, key: str = "doc_id",
) -> DataFrame:
    """All rows and columns of ``docs`` plus ``n_bytes, n_tokens`` (long) and ``over_limit``.

    ``cache`` is a folder that all executors share; it gains the counts of the misses, and later runs find
    them there. The normalised content of a null is the empty text (0 bytes, 0 tokens); every other text
    stands as it is. Copies are encoded once. A failed run appends nothing; two runs at a time may append
    the same digest twice, so counts are read as a maximum per digest. Columns of the result's names are
    replaced; null and repeated keys only decide which copy is encoded.

    What is shuffled are digests. Texts stay where they are read as long as either the list of rows to
    encode or that of rows to pass over is measured to fit a broadcast.
    """
    import tokenizers

    spark = docs.sparkSession
    version = tokenizer_version(tokenizer, f"tokenizers {tokenizers.__version__}")
    own = ["n_bytes", "n_tokens", "over_limit"]
    keep = [c for c in docs.columns if c not in own]
    (digest,) = free_names(docs, "_digest")
    body = F.coalesce(F.col(text), F.lit(""))
    # digest of content digest and tokenizer version
    mark = F.unhex(F.sha2(F.concat(F.unhex(F.sha2(body, 256)), F.unhex(F.lit(version))), 256))
    texts = docs.select(mark.alias("_digest"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), body.alias("_text"))
    each = texts.groupBy("_digest", "_key").agg(F.count("*").alias("_n"))
    encode_list, skip_list = first_rows(each, version, cache, spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = cached_bpe(tokenizer, pattern)
        for b in batches:
            counts = [bpe.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    paired = texts.withColumn("_pair", pair_of(F.col("_digest"), F.col("_key")))
    if fits_broadcast(encode_list):
        met = paired.join(F.broadcast(encode_list), "_pair")
    else:  # where most rows are misses, the others are named instead
        met = lookup_join(paired, skip_list, "_pair").where("_state IS DISTINCT FROM 'skip'")
    once = met.where("_state IS DISTINCT FROM 'many'").unionByName(met.where("_state = 'many'").dropDuplicates(["_pair"]))
    once.select("_digest", "_text").mapInArrow(encode, SCHEMA).write.mode("append").parquet(f"{cache}/version={version}")
    counts = cached_counts(spark, cache, version).groupBy(F.col("digest").alias(digest)).agg(F.max("n_tokens").alias("n_tokens"))
    rows = docs.select(*keep, mark.alias(digest), F.octet_length(body).cast("long").alias("n_bytes"))
    return rows.join(counts, digest).select(*keep, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
