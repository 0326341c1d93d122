"""Session defaults and the two places where a job touches shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that matter at scale. Shuffle partitions start high and AQE coalesces them down, which
# is the right direction: coalescing is cheap, splitting an overfull partition is not.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # recording a call site for every column expression doubles the time to build wide frames
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app: str = "urlsieve", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SCALE_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may go without one; it then gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    known = getattr(spark, "_urlsieve_shared_dir", None)
    if known is None:
        known = tempfile.mkdtemp(prefix="spark-urlsieve-")
        spark._urlsieve_shared_dir = known
    return known


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the shared folder, for one run of a job."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of the executors that computed it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def inline_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A small fixed table as an expression, which needs no Python worker to read."""
    structs = [
        F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, row, strict=True))) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Give CPU-heavy work at least one partition per core when the input is only a few files.

    ``rows`` is for rows that grow manyfold (a page into URLs, texts into pieces, URLs into vectors that
    training keeps): partitions then hold about that many of them, however large the input. It costs a count,
    which Parquet answers from its footers. Inputs in enough partitions pass through unchanged, so no
    shuffle is added where it would cost something.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        wanted = max(wanted, -(-df.count() // rows))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Bring keys together in as many partitions as there were.

    The number is named because adaptive execution would join parts by the size they have before they grow.
    """
    parts = max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)
