"""Balancing and splitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions import urls as U
from urlsieve.operators import splits as S
from urlsieve.plans import sqlkit as Q
from urlsieve.plans.registry import query
from urlsieve.plans.tables import URLS_SQL, table, urls
from urlsieve.plans.url_queries import split_domain_ctes

KEYS = ("page_id", "variant")
WITH = "WITH " + URLS_SQL
SHARES = [s for _, s in K.SPLIT_SHARES]


def _hash(seed: int, *keys: str) -> str:
    return "md5(" + " || '|' || ".join([*(f"{k}::VARCHAR" for k in keys), f"'{seed}'"]) + ")"


@query("balance_4to1", f"""{WITH}, r AS (
  SELECT *, row_number() OVER (ORDER BY {_hash(42, *KEYS)}) AS k FROM urls WHERE label = 0)
SELECT page_id, variant, url, label FROM r WHERE k <= 4 * (SELECT count(*) FROM urls WHERE label = 1)
UNION ALL SELECT page_id, variant, url, label FROM urls WHERE label = 1""")
def balance_4to1(spark, sf):
    return S.shuffled(S.balance(urls(spark, sf), KEYS), KEYS)


RANDOM = f"""r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_hash(42, *KEYS)}) AS k,
             count(*) OVER (PARTITION BY label) AS n FROM urls),
random_split AS MATERIALIZED (SELECT page_id, variant, label, CASE WHEN k <= floor(0.8 * n) THEN 'train'
       WHEN k <= floor(0.8 * n) + floor(0.1 * n) THEN 'val' ELSE 'test' END AS split FROM r)"""


@query("random_split", f"{WITH}, {RANDOM} SELECT page_id, variant, label, split FROM random_split")
def random_split(spark, sf):
    return S.random_split(urls(spark, sf), KEYS).select(*KEYS, "label", "split")


def greedy_ctes(rows: str, domain: str, label: str) -> str:
    """Domain-by-domain greedy packing, the long way: recursion over domains by falling size."""
    hashed = _hash(42, domain)
    return f"""
g0 AS (SELECT {domain}, count(*) AS size, sum({label})::BIGINT AS mal FROM {rows} GROUP BY {domain}),
g1 AS (SELECT {domain}, size, (mal > size - mal)::INT AS majority FROM g0),
g2 AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY majority ORDER BY size DESC, {hashed}) AS k,
         sum(size) OVER (PARTITION BY majority) AS whole FROM g1),
walk AS (
  SELECT majority, 0::BIGINT AS k, 0::BIGINT AS size, -1 AS part, 0.8 * whole::DOUBLE AS a, 0.1 * whole::DOUBLE AS b,
         0.1 * whole::DOUBLE AS c FROM (SELECT DISTINCT majority, whole FROM g2)
  UNION ALL
  SELECT majority, k, size, part, a - CASE WHEN part = 0 THEN size ELSE 0 END,
         b - CASE WHEN part = 1 THEN size ELSE 0 END, c - CASE WHEN part = 2 THEN size ELSE 0 END
  FROM (SELECT w.majority, g2.k, g2.size, w.a, w.b, w.c,
               CASE WHEN w.a >= w.b AND w.a >= w.c THEN 0 WHEN w.b >= w.c THEN 1 ELSE 2 END AS part
        FROM walk w JOIN g2 ON g2.majority = w.majority AND g2.k = w.k + 1)),
sized AS (SELECT majority, size, count(*) FILTER (part = 0) AS n0, count(*) FILTER (part = 1) AS n1
          FROM walk WHERE part >= 0 GROUP BY ALL),
placed AS MATERIALIZED (
  SELECT {domain}, size, majority, CASE WHEN j <= n0 THEN 'train' WHEN j <= n0 + n1 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY majority, size ORDER BY {hashed}) AS j FROM g1)
  JOIN sized USING (majority, size))"""


DOMAIN = split_domain_ctes().replace("WITH ", "WITH RECURSIVE ", 1) + "," + greedy_ctes("sd", "domain", "label")


def labelled_domains(spark, sf):
    return urls(spark, sf).withColumn("domain", U.split_domain(F.col("url")))


@query("domain_assignment", f"{DOMAIN} SELECT domain, size, majority, split FROM placed")
def domain_assignment(spark, sf):
    return S.domain_assignment(labelled_domains(spark, sf))


@query("domain_split", f"""{DOMAIN}
SELECT page_id, variant, domain, label, split FROM sd JOIN placed USING (domain)""")
def domain_split(spark, sf):
    return S.domain_split(labelled_domains(spark, sf)).select(*KEYS, "domain", "label", "split")


@query("domain_split_events", f"""WITH RECURSIVE ev AS (
  SELECT event_id, user_id, (event_type = 'error')::INT AS label FROM events), {greedy_ctes('ev', 'user_id', 'label')}
SELECT event_id, user_id, label, split FROM ev JOIN placed USING (user_id)""")
def domain_split_events(spark, sf):
    """The same packing with users in the place of domains: many groups of many sizes."""
    rows = table(spark, sf, "events").select(
        "event_id", "user_id", (F.col("event_type") == "error").cast("int").alias("label"))
    return S.domain_split(rows, "user_id")


BOTH = f"""{DOMAIN}, {RANDOM},
both_modes AS MATERIALIZED (
  SELECT 'random' AS mode, s.split, sd.domain, sd.label FROM sd JOIN random_split s USING (page_id, variant)
  UNION ALL SELECT 'domain', split, domain, label FROM sd JOIN placed USING (domain))"""


def both_modes(spark, sf):
    rows = labelled_domains(spark, sf)
    cols = ("split", "domain", "label")
    return S.random_split(rows, KEYS).select(F.lit("random").alias("mode"), *cols).unionByName(
        S.domain_split(rows).select(F.lit("domain").alias("mode"), *cols))


@query("split_stats", f"""{BOTH}
SELECT mode, split, count(*) AS n, {Q.percent('count(*)', 'sum(count(*)) OVER (PARTITION BY mode)')} AS pct,
       count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1,
       count(DISTINCT domain) AS domains, {Q.percent('count(*) FILTER (label = 1)', 'count(*)')} AS label_1_pct
FROM both_modes GROUP BY mode, split""")
def split_stats(spark, sf):
    return S.split_stats(both_modes(spark, sf))


_PAIRS = [("train", "val"), ("train", "test"), ("val", "test")]
_OVERLAP = " UNION ALL ".join(
    f"""SELECT m.mode, '{a}/{b}' AS pair, (SELECT count(*) FROM (
      SELECT domain FROM both_modes WHERE mode = m.mode AND split = '{a}'
      INTERSECT SELECT domain FROM both_modes WHERE mode = m.mode AND split = '{b}')) AS shared_domains
      FROM (SELECT DISTINCT mode FROM both_modes) m""" for a, b in _PAIRS)


@query("split_overlap", f"{BOTH} {_OVERLAP}")
def split_overlap(spark, sf):
    return S.split_overlap(both_modes(spark, sf))
