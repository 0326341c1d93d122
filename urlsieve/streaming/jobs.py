"""Structured Streaming jobs.

Each job is exactly-once by construction: offsets live in the checkpoint, and every micro-batch
writes its own ``batch_id`` partition with overwrite, so a replayed batch replaces itself. Tables that
batches update are kept small by compaction (``state``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from urlsieve.functions import urls as U
from urlsieve.operators import models as MD
from urlsieve.operators.scanlog import validate_requests
from urlsieve.streaming.state import StateTable, UrlHistory


def read_stream(
    spark: SparkSession, path: str, schema: StructType | str, format: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """New files of a folder, or of a path pattern, as a stream."""
    reader = spark.readStream.format(format).schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def start_batches(
    stream: DataFrame, checkpoint: str, store: Callable[[DataFrame, int], None], mode: str = "append", available_now: bool = True,
) -> StreamingQuery:
    """Run ``store`` on each micro-batch; it must write so that a replay of the batch replaces it."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(store)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def write_batches(
    stream: DataFrame, out: str, checkpoint: str, make: Callable[[DataFrame, int], DataFrame],
    mode: str = "append", available_now: bool = True,
) -> StreamingQuery:
    """Run ``make`` on each micro-batch and store the result as its ``batch_id`` partition."""

    def write(batch: DataFrame, batch_id: int) -> None:
        make(batch, batch_id).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return start_batches(stream, checkpoint, write, mode, available_now)


def write_state(stream: DataFrame, table: StateTable, checkpoint: str) -> StreamingQuery:
    """Store what each micro-batch changed as a delta of a state table."""
    return start_batches(stream, checkpoint, table.write, mode="update")


def ingest_feed(
    lines: DataFrame, parser: Callable[[DataFrame], DataFrame], source: str, out: str, checkpoint: str,
    stored: DataFrame | None = None, fetched_at: Column | None = None, history: UrlHistory | None = None,
) -> StreamingQuery:
    """Parse arriving feed lines and store the URLs that neither earlier batches nor ``stored`` have.

    History is a table by hash bucket with filters (``state.UrlHistory``), not streaming state: it may
    grow without limit, and a batch opens only the buckets that may hold one of its URLs. ``stored`` is
    taken in once, when the table is new.
    """
    when = F.current_timestamp() if fetched_at is None else fetched_at
    history = history or UrlHistory(lines.sparkSession, out)
    if stored is not None:
        history.seed(stored)

    def store(batch: DataFrame, batch_id: int) -> None:
        # partial aggregation collapses copies before the shuffle
        urls = parser(batch).groupBy("url").agg(F.count("*").alias("copies")).persist()
        known = history.known(urls.select("url"), batch_id)
        fresh = urls if known is None else urls.join(known, "url", "left_anti")
        history.add(fresh.select(
            "url", F.lit(source).alias("source"), when.alias("fetched_at"),
            U.is_vn_target(F.col("url")).cast("int").alias("is_vn_target"), "copies"), batch_id)
        urls.unpersist()

    return start_batches(lines, checkpoint, store)


def distinct_within(urls: DataFrame, ts: str, delay: str) -> DataFrame:
    """Streaming de-duplication that remembers a URL only until the watermark passes it.

    For a stream of (url, time) rows whose repeats come close together; state stays bounded.
    """
    return urls.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["url"])


def score_requests(
    requests: DataFrame, featurize: Callable[[DataFrame], DataFrame], model: PipelineModel, out: str,
    checkpoint: str, threshold: float = 0.5, keep: tuple[str, ...] = ("url",),
) -> StreamingQuery:
    """Validate, featurise and score arriving URLs into a log of (url hash, verdict) records.

    The log table deliberately holds a URL's hash and short form, not the URL. Refused requests get a
    record with their status and no score.
    """

    def scored(batch: DataFrame, batch_id: int) -> DataFrame:
        checked = validate_requests(batch)
        frame = MD.score_frame(model.transform(featurize(checked.where("status = 'accepted'"))), threshold, keep)
        refused = checked.where("status IS DISTINCT FROM 'accepted'").select(*keep, "status")
        both = frame.withColumn("status", F.lit("accepted")).unionByName(refused, allowMissingColumns=True)
        return both.withColumns({
            "url_hash": U.url_hash(F.col("url")), "url_display": U.display_url(F.col("url")),
        }).drop("url")

    return write_batches(requests, out, checkpoint, scored)


def running_profile(
    stream: DataFrame, out: str, checkpoint: str, groups: tuple[str, ...], sums: dict[str, Column], every: int = 20,
) -> StreamingQuery:
    """Counts and sums per group over everything seen so far; each batch stores what changed."""
    totals = stream.groupBy(*groups).agg(
        F.count("*").alias("n"), *(F.sum(c).alias(name) for name, c in sums.items()))
    return write_state(totals, StateTable(stream.sparkSession, out, groups, every=every), checkpoint)


def windowed_requests(
    stream: DataFrame, out: str, checkpoint: str, client: str = "client", ts: str = "ts",
    window: str = "1 minute", delay: str = "10 minutes", every: int = 20,
) -> StreamingQuery:
    """Requests per client and tumbling window, kept up to date until the watermark passes."""
    counts = stream.withWatermark(ts, delay).groupBy(
        F.window(ts, window).alias("w"), F.col(client).alias("client")
    ).agg(F.count("*").alias("requests"))
    flat = counts.select("client", F.col("w.start").alias("window_start"), "requests")
    return write_state(flat, StateTable(stream.sparkSession, out, ("client", "window_start"), every=every), checkpoint)


def latest(spark: SparkSession, out: str, groups: tuple[str, ...]) -> DataFrame:
    """Current rows of an updating table: its snapshot and what came after."""
    return StateTable(spark, out, groups).read()
