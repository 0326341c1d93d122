"""Requests, scan records and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions import risk
from urlsieve.functions import urls as U
from urlsieve.functions.text import strip, text



def validate_requests(df: DataFrame, url: str = "url") -> DataFrame:
    """Strip the URL and add ``status``: accepted, empty or too_long."""
    bare = strip(F.coalesce(F.col(url), text("")))
    return df.withColumn(url, bare).withColumn(
        "status",
        F.when(F.col(url) == "", "empty")
        .when(F.length(url) > K.MAX_REQUEST_LENGTH, "too_long").otherwise("accepted"),
    )


def scan_rows(
    scored: DataFrame, first: str, second: str, created_at: Column, page: Column | None = None,
    threshold: float = 0.5, url: str = "url",
) -> DataFrame:
    """Log records of scored URLs: hash and short form instead of the URL itself.

    The verdict is the mean of the two URL models; a page probability is stored beside it.
    """
    ensemble = risk.ensemble(F.col(first), F.col(second))
    page_prob = F.lit(None).cast("double") if page is None else page
    return scored.select(
        U.url_hash(F.col(url)).alias("url_hash"), U.display_url(F.col(url)).alias("url_display"),
        F.col(first).alias("cnn_prob"), F.col(second).alias("xgb_prob"),
        ensemble.alias("ensemble_prob"), risk.verdict(ensemble, threshold).alias("ensemble_verdict"),
        page_prob.isNotNull().cast("int").alias("sgd_enabled"), page_prob.alias("sgd_prob"),
        created_at.alias("created_at"),
    )


def append_scans(scans: DataFrame, path: str) -> None:
    """Append log records, partitioned by day so that recent history prunes old files."""
    scans.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def recent(scans: DataFrame, limit: int = 50, tie: str = "id") -> DataFrame:
    """The ``limit`` newest records, newest first; times cut to seconds."""
    newest = scans.orderBy(F.desc("created_at"), F.desc(tie)).limit(limit)
    return newest.withColumn("created_at", F.substring(F.col("created_at").cast("string"), 1, 19))


def scan_summary(results: DataFrame, prediction: str = "prediction", error: str = "error") -> DataFrame:
    """Totals of a batch scan: files, verdicts, errors."""
    fine = F.col(error).isNull()

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0))

    return results.agg(
        F.count("*").alias("total"), count(fine & (F.col(prediction) == "benign")).alias("benign"),
        count(fine & (F.col(prediction) == "phish")).alias("phish"), count(~fine).alias("errors"),
    )


def rate_limit_violations(
    requests: DataFrame, client: str = "client", ts: str = "ts", per_window: int = K.REQUESTS_PER_MINUTE,
    window: str = "1 minute",
) -> DataFrame:
    """Clients that exceed their requests in a tumbling window, with the rejected number.

    Works on tables and on streams (set a watermark on ``ts`` first).
    """
    counts = requests.groupBy(F.window(ts, window).alias("w"), F.col(client).alias("client")).agg(
        F.count("*").alias("requests"))
    return counts.where(F.col("requests") > per_window).select(
        "client", F.col("w.start").alias("window_start"), "requests",
        (F.col("requests") - per_window).alias("rejected"))
