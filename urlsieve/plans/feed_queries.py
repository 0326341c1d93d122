"""Feed parsing, merging and de-duplication queries; the feed lines are made from ``pages``."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from urlsieve.functions import urls as U
from urlsieve.plans import sqlkit as Q
from urlsieve.plans.registry import query
from urlsieve.plans.tables import URLS_SQL, table, urls
from urlsieve.sources import feeds as S
from urlsieve.sources import readers, writers

WITH = "WITH " + URLS_SQL


def lines(spark, sf, expression: str):
    return urls(spark, sf).selectExpr(f"{expression} AS value")


def page_lines(spark, sf, expression: str):
    return table(spark, sf, "pages").selectExpr(f"{expression} AS value")


def lines_sql(expression: str) -> str:
    return f"{WITH}, lines AS (SELECT {expression} AS value FROM urls)"


def norm_sql(x: str) -> str:
    bare = f"trim(trim({Q.strip(x)}, '\"'), '''')"
    return f"(CASE WHEN regexp_matches({bare}, '(?i)^https?://') THEN {bare} END)"


TXT = "CASE WHEN variant % 9 = 0 THEN '# ' || url WHEN variant % 9 = 1 THEN '   ' ELSE '  ' || url || chr(9) END"


@query("feed_txt_lines", f"""{lines_sql(TXT)} SELECT {Q.strip('value')} AS url FROM lines
WHERE {Q.strip('value')} <> '' AND NOT starts_with({Q.strip('value')}, '#')""")
def feed_txt_lines(spark, sf):
    return S.txt_lines(lines(spark, sf, TXT))


HOSTS = ("CASE WHEN variant % 5 = 0 THEN '! note ' || page_id WHEN variant % 5 = 1 THEN '0.0.0.0  Ads' || page_id || '.Example.com ' "
         "WHEN variant % 5 = 2 THEN '#x.y' WHEN variant % 5 = 3 THEN 'localhost' ELSE 'site-' || page_id || '.vn' END")


@query("feed_domain_list", f"""{lines_sql(HOSTS)},
w AS (SELECT {Q.strip('value')} AS l, string_split_regex({Q.strip('value')}, '\\s+')[-1] AS d FROM lines)
SELECT 'https://' || d || '/' AS url FROM w WHERE left(l, 1) NOT IN ('#', '!') AND contains(d, '.')""")
def feed_domain_list(spark, sf):
    return S.domain_list(lines(spark, sf, HOSTS))


WRAP = ("CASE WHEN variant % 8 = 0 THEN '; note.x' WHEN variant % 8 = 1 THEN '127.0.0.1 LocalHost' WHEN variant % 8 = 2 THEN '*.x' || page_id || '.org' "
        "WHEN variant % 8 = 3 THEN 'a/b.c' WHEN variant % 8 = 4 THEN 'h.x:80' WHEN variant % 8 = 5 THEN ' UPPER-' || page_id || '.Com' "
        "WHEN variant % 8 = 6 THEN '0.0.0.0 bad-' || page_id || '.top' ELSE '!z.y' END")
_WRAPPED = f"""w AS (SELECT {Q.strip('value')} AS l, lower(string_split_regex({Q.strip('value')}, '\\s+')[-1]) AS d FROM lines)
SELECT 'https://' || d || '/' AS url FROM w WHERE left(l, 1) NOT IN ('#', '!', ';') AND contains(d, '.')
AND NOT contains(d, '/') AND NOT contains(d, ':') AND NOT contains(d, '*') AND d NOT IN ('localhost', 'broadcasthost')"""


@query("feed_wrap_domain", f"{lines_sql(WRAP)}, {_WRAPPED}")
def feed_wrap_domain(spark, sf):
    return S.strict_domain_list(lines(spark, sf, WRAP))


@query("feed_multi_list", f"""{lines_sql(WRAP)}, c AS (SELECT unnest(['phishing', 'scam']) AS category),
w AS (SELECT DISTINCT {Q.strip('value')} AS l, lower(string_split_regex({Q.strip('value')}, '\\s+')[-1]) AS d FROM lines)
SELECT 'https://' || d || '/' AS url, category FROM w, c WHERE left(l, 1) NOT IN ('#', '!', ';') AND contains(d, '.')
AND NOT contains(d, '/') AND NOT contains(d, ':') AND NOT contains(d, '*')""")
def feed_multi_list(spark, sf):
    """Several category lists read as one, each row with its category."""
    both = lines(spark, sf, WRAP).select("value", F.explode(F.array(F.lit("phishing"), F.lit("scam"))).alias("category"))
    return both.select(U.wrap_domain(F.col("value")).alias("url"), "category").where("url IS NOT NULL").distinct()


CSV = ("CASE WHEN page_id % 6 = 0 THEN '# \"broken, quote' WHEN page_id % 6 = 1 THEN '\"1\",\"2024-01-01\"' "
       "WHEN page_id % 6 = 2 THEN '\"1\",\"a, b\",\" ' || url || ' \",\"online\"' WHEN page_id % 6 = 3 THEN '1,2,ftp://x/y,url' "
       "WHEN page_id % 6 = 4 THEN '\"1\",\"2\",\"' || url || '\",\"URL\",\"t\"' ELSE '1,say \"\"hi\"\",' || upper(url) || ',domain' END")


@query("feed_comment_csv", "SELECT CASE WHEN page_id % 6 = 5 THEN upper(url) ELSE url END AS url FROM pages WHERE page_id % 6 IN (2, 4, 5)")
def feed_comment_csv(spark, sf):
    return S.comment_csv(page_lines(spark, sf, CSV))


@query("feed_ioc_csv", "SELECT url FROM pages WHERE page_id % 6 = 4")
def feed_ioc_csv(spark, sf):
    return S.ioc_csv(page_lines(spark, sf, CSV))


JSON = ("CASE WHEN page_id % 7 = 0 THEN '[{bad' ELSE '[{\"value\": \" ' || url || '\", \"type\": \"url\"}, {\"url\": \"' || url || '/b\"}, 5, \"x\", "
        "{\"value\": \"\", \"url\": \"' || url || '/c\"}, {\"value\": 7, \"url\": \"' || url || '/no\"}, {\"value\": null, \"url\": \"' || url || '/d\"}, {\"other\": 1}]' END")


@query("feed_json", "SELECT unnest([url, url || '/b', url || '/c', url || '/d']) AS url FROM pages WHERE page_id % 7 <> 0")
def feed_json(spark, sf):
    return S.json_feed(page_lines(spark, sf, JSON))


NESTED = ("'{\"results\": [{\"indicators\": [{\"type\": \"URL\", \"indicator\": \"' || url || '\"}, {\"type\": \"domain\", \"indicator\": \"http://x/\"}, "
          "{\"type\": \"URI\", \"indicator\": \"ftp://x/\"}]}, {\"indicators\": [{\"type\": \"URI\", \"indicator\": \" ' || url || '#2 \"}]}, {}], \"next\": null}'")


@query("feed_nested_json", "SELECT unnest([url, url || '#2']) AS url FROM pages")
def feed_nested_json(spark, sf):
    return S.nested_indicators(page_lines(spark, sf, NESTED))


HITS = ("'{\"results\": [{\"task\": {\"url\": \"' || url || '\"}, \"page\": {\"url\": \"http://no/\"}}, {\"task\": {\"url\": \"\"}, \"page\": {\"url\": \"' || url || '/p\"}}, "
        "{\"page\": {\"url\": \"' || url || '/q\"}}, {\"task\": {}}], \"has_more\": false}'")


@query("feed_hits_json", "SELECT unnest([url, url || '/p', url || '/q']) AS url FROM pages")
def feed_hits_json(spark, sf):
    return S.search_hits(page_lines(spark, sf, HITS))


INDICATORS = "'{\"results\": [{\"indicator\": \"' || url || '\"}, {\"indicator\": \"not a url\"}, {}]}'"


@query("feed_indicator_json", "SELECT url FROM pages")
def feed_indicator_json(spark, sf):
    return S.indicator_pages(page_lines(spark, sf, INDICATORS))


@query("feed_header_csv", f"{WITH} SELECT u AS url FROM (SELECT {norm_sql('url')} AS u FROM urls) WHERE u IS NOT NULL")
def feed_header_csv(spark, sf):
    rows = urls(spark, sf).select(F.col("page_id").alias("id"), F.lit("x").alias("family"), F.col("url").alias(" URL "))
    return S.header_csv(rows)


@query("feed_url_lines", f"{WITH} SELECT u AS url FROM (SELECT {norm_sql('url')} AS u FROM urls) WHERE u IS NOT NULL")
def feed_url_lines(spark, sf):
    return S.url_lines(lines(spark, sf, "url"))


@query("feed_zip")
def feed_zip(spark, sf):
    """Pages packed into ZIP archives and read back line by line."""

    def pack(batches):
        for batch in batches:
            contents = []
            for url in batch["url"]:
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as archive:
                    archive.writestr("first.csv", f"# head\n\"1\",\"d\",\"{url}\"\n")
                    archive.writestr("second.csv", "not read")
                contents.append(buffer.getvalue())
            yield pd.DataFrame({"path": batch["page_id"].astype(str) + ".zip", "content": contents})

    files = table(spark, sf, "pages").select("page_id", "url").mapInPandas(pack, "path string, content binary")
    return S.comment_csv(readers.archive_lines(files))


# --- several sources ----------------------------------------------------------------------

SOURCES = (
    S.Source("links", "txt_lines"), S.Source("hosts", "domain_list"), S.Source("wrapped", "strict_domain_list"),
    S.Source("quoted", "url_lines"), S.Source("objects", "json_feed"), S.Source("slow", "indicator_pages", default_on=False),
)
ACTIVE = S.active_sources(SOURCES)
FETCHED_AT = "2024-05-01 00:00:00"


def _frames(spark, sf):
    family = urls(spark, sf)
    made = {"links": TXT, "hosts": HOSTS, "wrapped": WRAP, "quoted": "url"}
    return {name: family.selectExpr(f"{expression} AS value") for name, expression in made.items()} | {
        "objects": page_lines(spark, sf, JSON)}


UNION = f"""{WITH},
l1 AS (SELECT {Q.strip(TXT)} AS v FROM urls), l2 AS (SELECT {Q.strip(HOSTS)} AS v, string_split_regex({Q.strip(HOSTS)}, '\\s+')[-1] AS d FROM urls),
l3 AS (SELECT {Q.strip(WRAP)} AS v, lower(string_split_regex({Q.strip(WRAP)}, '\\s+')[-1]) AS d FROM urls),
feed AS MATERIALIZED (
  SELECT v AS url, 'links' AS source, 0 AS priority FROM l1 WHERE v <> '' AND NOT starts_with(v, '#')
  UNION ALL SELECT 'https://' || d || '/', 'hosts', 1 FROM l2 WHERE left(v, 1) NOT IN ('#', '!') AND contains(d, '.')
  UNION ALL SELECT 'https://' || d || '/', 'wrapped', 2 FROM l3 WHERE left(v, 1) NOT IN ('#', '!', ';') AND contains(d, '.')
    AND NOT contains(d, '/') AND NOT contains(d, ':') AND NOT contains(d, '*')
  UNION ALL SELECT u, 'quoted', 3 FROM (SELECT {norm_sql('url')} AS u FROM urls) WHERE u IS NOT NULL
  UNION ALL SELECT unnest([url, url || '/b', url || '/c', url || '/d']), 'objects', 4 FROM pages WHERE page_id % 7 <> 0),
win0 AS (SELECT url, arg_min(source, priority) AS source FROM feed GROUP BY url),
{Q.split_cte('win1', 'win0', 'url')},
win AS MATERIALIZED (SELECT url, source, TIMESTAMP '{FETCHED_AT}' AS fetched_at,
   (regexp_matches(url, '{Q.VN_TLD}') OR regexp_matches(url, '{Q.brand_pattern()}') OR ends_with({Q.hostname('netloc')}, '.vn'))::INT AS is_vn_target FROM win1)"""


def _union(spark, sf):
    return S.union_sources(ACTIVE, _frames(spark, sf))


def _winners(spark, sf):
    return S.first_wins(_union(spark, sf), ACTIVE, F.lit(FETCHED_AT).cast("timestamp"))


@query("feed_union", f"{UNION} SELECT url, source, priority FROM feed")
def feed_union(spark, sf):
    return _union(spark, sf)


@query("dedupe_first_wins", f"{UNION} SELECT url, source, strftime(fetched_at, '%Y-%m-%dT%H:%M:%S+00:00') AS fetched_at, is_vn_target FROM win")
def dedupe_first_wins(spark, sf):
    return _winners(spark, sf).withColumn(
        "fetched_at", F.date_format(F.date_trunc("second", "fetched_at"), "yyyy-MM-dd'T'HH:mm:ssxxx"))


_ADDED = "(SELECT count(*) FROM win w WHERE w.source = s.source)"
_VN = "(SELECT coalesce(sum(is_vn_target), 0)::BIGINT FROM win w WHERE w.source = s.source)"


@query("source_summary", f"""{UNION}, s(source, status) AS (VALUES {', '.join(f"('{s.name}', '{'OK' if s in ACTIVE else 'skipped'}')" for s in SOURCES)}),
r AS (SELECT s.source, s.status, (SELECT count(*) FROM feed f WHERE f.source = s.source) AS raw, {_ADDED} AS added, {_VN} AS vn FROM s),
t AS (SELECT * FROM r UNION ALL SELECT 'TOTAL', '', sum(raw)::BIGINT, sum(added)::BIGINT, sum(vn)::BIGINT FROM r)
SELECT *, {Q.percent('vn', 'added')} AS vn_pct FROM t""")
def source_summary(spark, sf):
    return S.source_summary(_union(spark, sf), SOURCES, ACTIVE)


@query("dedupe_against_existing", f"""{UNION} SELECT url, source FROM win
WHERE url NOT IN (SELECT url FROM pages UNION ALL SELECT url || '/b' FROM pages)""")
def dedupe_against_existing(spark, sf):
    pages = table(spark, sf, "pages")
    stored = pages.select("url").unionByName(pages.select(F.concat("url", F.lit("/b")).alias("url")))
    return S.only_new(_winners(spark, sf), stored).select("url", "source")


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query("pending_seeds", f"""SELECT DISTINCT {_HOST} AS seed FROM pages
EXCEPT SELECT {_HOST} FROM pages WHERE contains(url, '#top')""")
def pending_seeds(spark, sf):
    seeds = table(spark, sf, "pages").select("url", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("seed"))
    return writers.pending_seeds(seeds, seeds.where(F.contains("url", F.lit("#top"))))


@query("merge_artifacts", """WITH old AS (SELECT event_type AS key, count(*) AS n, 'old' AS origin FROM events GROUP BY 1),
new AS (SELECT event_type AS key, count(DISTINCT user_id) AS n, 'new' AS origin FROM events WHERE value > 50 OR event_type LIKE 'c%' GROUP BY 1)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE key NOT IN (SELECT key FROM new)""")
def merge_artifacts(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("event_type", "key")
    old = events.groupBy("key").agg(F.count("*").alias("n"), F.lit("old").alias("origin"))
    new = events.where("value > 50 OR key LIKE 'c%'").groupBy("key").agg(
        F.countDistinct("user_id").alias("n"), F.lit("new").alias("origin"))
    return writers.merge_artifacts(old, new, "key")
