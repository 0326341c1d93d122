"""Writers. All of them write in parallel, one file per task."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_quoted_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(header=True, quoteAll=True, escape='"').csv(path)


def write_feed(winners: DataFrame, path: str, mode: str = "overwrite") -> None:
    """All rows, partitioned by the target flag: the flagged subset is a partition, not a copy."""
    winners.write.mode(mode).partitionBy("is_vn_target").options(header=True, escape='"').csv(path)


def append_rows(df: DataFrame, path: str, separate: bool = False) -> None:
    """Append to a table, or start it afresh with ``separate``."""
    df.write.mode("overwrite" if separate else "append").parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Split datasets as ``mode=.../split=...`` partitions.

    Rows are dealt by partition value and a hash of the row, so a split is as many files as it needs
    and no task writes to every partition.
    """
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(max(1, df.rdd.getNumPartitions() // 6)))
    df.repartition("mode", "split", spread).write.mode("overwrite").partitionBy("mode", "split").parquet(path)


def read_table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def merge_artifacts(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, the fresh one winning."""
    both = stored.withColumn("_age", F.lit(1)).unionByName(fresh.withColumn("_age", F.lit(0)))
    first = Window.partitionBy(key).orderBy("_age")
    return both.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_age")


def write_artifact(df: DataFrame, path: str) -> None:
    """A small result table as one JSON-lines file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def store_results(fresh: DataFrame, path: str) -> None:
    """Merge an evaluation table by (mode, split) into the stored one: those of ``fresh`` are replaced, all others stay.

    A (mode, split) is a partition that is overwritten whole, so a repeated write changes nothing.
    """
    fresh.repartition("mode", "split").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "mode", "split").parquet(path)


def config_key(config: Mapping[str, Any]) -> str:
    return hashlib.md5(json.dumps(dict(config), sort_keys=True).encode()).hexdigest()[:12]


def cached(df: DataFrame, root: str, config: Mapping[str, Any]) -> DataFrame:
    """Features stored under the hash of their configuration: computed once, read back later."""
    path = f"{root.rstrip('/')}/{config_key(config)}"
    found = read_table_or_none(df.sparkSession, path)
    if found is None:
        df.write.mode("overwrite").parquet(path)
        found = df.sparkSession.read.parquet(path)
    return found


def pending_seeds(seeds: DataFrame, processed: DataFrame) -> DataFrame:
    """Seeds not processed yet."""
    return seeds.select("seed").distinct().join(processed.select("seed").distinct(), "seed", "left_anti")


def processed_seeds(spark: SparkSession, state: str, output: str) -> DataFrame:
    """Seeds done so far; the first time, recovered from the crawl output and stored."""
    known = read_table_or_none(spark, state)
    if known is not None:
        return known
    rows = read_table_or_none(spark, output)
    if rows is None:
        return spark.createDataFrame([], "seed string")
    rows.select("seed").where("seed <> ''").distinct().write.mode("overwrite").parquet(state)
    return spark.read.parquet(state)
