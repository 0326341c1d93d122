"""Request, scan-log and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.operators import models as MD
from urlsieve.operators import scanlog as L
from urlsieve.plans import sqlkit as Q
from urlsieve.plans.model_queries import LINEAR_BITS, _url_model
from urlsieve.plans.registry import query
from urlsieve.plans.tables import BAD_HOST, URLS_SQL, table, urls
from urlsieve.session import run_dir
from urlsieve.sources import feeds
from urlsieve.streaming import jobs

KEYS = ("page_id", "variant")
_REQUEST = "CASE WHEN variant = 14 THEN repeat(url, 10) WHEN variant = 15 THEN '  ' || url || chr(10) WHEN variant = 16 THEN chr(9) || ' ' WHEN variant <> 20 THEN url END"


@query("validate_requests", f"""WITH {URLS_SQL}, q AS (SELECT page_id, variant, {Q.strip(f"coalesce({_REQUEST}, '')")} AS url FROM urls)
SELECT page_id, variant, length(url) AS length, CASE WHEN url = '' THEN 'empty' WHEN length(url) > {K.MAX_REQUEST_LENGTH} THEN 'too_long' ELSE 'accepted' END AS status FROM q""")
def validate_requests(spark, sf):
    requests = urls(spark, sf).selectExpr(*KEYS, f"{_REQUEST} AS url")
    return L.validate_requests(requests).select(*KEYS, F.length("url").alias("length"), "status")


# one scan per event: the page it names, two probabilities, sometimes a page probability
SCANS = f"""scans AS (SELECT event_id AS id, url, least(value / 100, 1.0) AS p1, (user_id % 100) / 100.0::DOUBLE AS p2,
  CASE WHEN event_id % 3 = 0 THEN (event_id % 10) / 10.0::DOUBLE END AS p3, ts FROM events
  JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages)),
{Q.split_cte('scan_parts', 'scans', 'url')},
log AS (SELECT id, sha256(url) AS url_hash, left(scheme || '://' || netloc || left(path, 40) || CASE WHEN length(path) > 40 THEN '…' ELSE '' END, 120) AS url_display,
  round(p1, 6) AS cnn_prob, round(p2, 6) AS xgb_prob, round((p1 + p2) / 2, 8) AS ensemble_prob, CASE WHEN (p1 + p2) / 2 >= 0.5 THEN 'MAL' ELSE 'BEN' END AS ensemble_verdict,
  (p3 IS NOT NULL)::INT AS sgd_enabled, p3 AS sgd_prob, ts AS created_at FROM scan_parts)"""


def scans(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    n = pages.agg(F.count("*").alias("pages"))
    events = table(spark, sf, "events").crossJoin(F.broadcast(n)).withColumn("page_id", F.col("event_id") % F.col("pages"))
    rows = events.join(pages, "page_id").select(
        F.col("event_id").alias("id"), "url", F.least(F.col("value") / 100, F.lit(1.0)).alias("p1"),
        ((F.col("user_id") % 100) / 100).alias("p2"), "ts",
        F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 10) / 10).alias("p3"))
    logged = L.scan_rows(rows.withColumn("created_at", F.struct("id", "ts")), "p1", "p2", F.col("created_at"), F.col("p3"))
    return logged.select(
        F.col("created_at.id").alias("id"), *(c for c in logged.columns if c != "created_at"), F.col("created_at.ts").alias("created_at")
    ).withColumns({"cnn_prob": F.round("cnn_prob", 6), "xgb_prob": F.round("xgb_prob", 6), "ensemble_prob": F.round("ensemble_prob", 8)})


_LOG = "id, url_hash, url_display, cnn_prob, xgb_prob, ensemble_prob, ensemble_verdict, sgd_enabled, sgd_prob"


@query("scan_log", f"WITH {SCANS} SELECT {_LOG} FROM log")
def scan_log(spark, sf):
    return scans(spark, sf).drop("created_at")


@query("scan_history", f"""WITH {SCANS} SELECT {_LOG}, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM log ORDER BY log.created_at DESC, id DESC LIMIT 50""")
def scan_history(spark, sf):
    return L.recent(scans(spark, sf))


@query("scan_summary", f"""SELECT count(*) AS total, count(*) FILTER (page_id % 10 <> 0 AND NOT regexp_matches(url, '{BAD_HOST}')) AS benign,
  count(*) FILTER (page_id % 10 <> 0 AND regexp_matches(url, '{BAD_HOST}')) AS phish, count(*) FILTER (page_id % 10 = 0) AS errors FROM pages""")
def scan_summary(spark, sf):
    failed = F.col("page_id") % 10 == 0
    results = table(spark, sf, "pages").select(
        F.when(failed, "ValueError").alias("error"),
        F.when(~failed, F.when(F.col("url").rlike(BAD_HOST), "phish").otherwise("benign")).alias("prediction"))
    return L.scan_summary(results)


# requests: the events squeezed to twenty per second
VIOLATIONS = f"""SELECT user_id AS client, date_trunc('minute', to_timestamp(event_id // 20)::TIMESTAMP) AS window_start, count(*) AS requests,
  count(*) - {K.REQUESTS_PER_MINUTE} AS rejected FROM events GROUP BY ALL HAVING count(*) > {K.REQUESTS_PER_MINUTE}"""


def _requests(events):
    return events.select(F.col("user_id").alias("client"), F.timestamp_seconds(F.floor(F.col("event_id") / 20)).alias("ts"))


@query("rate_limit_violations", VIOLATIONS)
def rate_limit_violations(spark, sf):
    return L.rate_limit_violations(_requests(table(spark, sf, "events")))


# --- streams ------------------------------------------------------------------------------

def stream(spark, sf, name, files_per_batch=None):
    # a pattern, so that the table may be a single file or a folder
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return jobs.read_stream(spark, f"{sf}/{name}*.parquet", schema, files_per_batch=files_per_batch)


@query("stream_rate_limit", VIOLATIONS)
def stream_rate_limit(spark, sf):
    folder = run_dir(spark, "rate")
    jobs.windowed_requests(_requests(stream(spark, sf, "events")), f"{folder}/out", f"{folder}/state").awaitTermination()
    counts = jobs.latest(spark, f"{folder}/out", ("client", "window_start"))
    return counts.where(F.col("requests") > K.REQUESTS_PER_MINUTE).withColumn("rejected", F.col("requests") - K.REQUESTS_PER_MINUTE)


@query("stream_profile", """SELECT event_type, count(*) AS n, sum(length(props))::BIGINT AS chars FROM events GROUP BY event_type""")
def stream_profile(spark, sf):
    folder = run_dir(spark, "profile")
    jobs.running_profile(stream(spark, sf, "events"), f"{folder}/out", f"{folder}/state", ("event_type",),
                         {"chars": F.length("props")}).awaitTermination()
    return jobs.latest(spark, f"{folder}/out", ("event_type",))


@query("stream_feed_ingest", f"""SELECT url, 'pages' AS source, count(*) AS copies FROM
  (SELECT unnest([url, url || '#again', url]) AS url FROM pages) WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 10 = 0) GROUP BY url""")
def stream_feed_ingest(spark, sf):
    folder = run_dir(spark, "ingest")
    lines = stream(spark, sf, "pages").select(F.explode(F.array(
        F.concat(F.lit(" "), "url"), F.concat("url", F.lit("#again")), F.lit("# comment"), F.col("url"))).alias("value"))
    stored = table(spark, sf, "pages").where("page_id % 10 = 0")
    jobs.ingest_feed(lines, feeds.txt_lines, "pages", f"{folder}/out", f"{folder}/state", stored).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("url", "source", "copies")


@query("stream_score")
def stream_score(spark, sf):
    folder = run_dir(spark, "score")
    _, stats, model = _url_model(spark, sf)
    jobs.score_requests(
        stream(spark, sf, "pages").select("page_id", "url"),
        lambda batch: MD.url_sequence_features(batch, stats, "url", ("page_id",), bits=LINEAR_BITS),
        model, f"{folder}/out", f"{folder}/state", keep=("page_id", "url"),
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch_id")


