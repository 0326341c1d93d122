"""Profiling queries over the labelled URL table."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.operators import profile as P
from urlsieve.plans import sqlkit as Q
from urlsieve.plans.registry import query
from urlsieve.plans.tables import URLS_SQL, table, urls

WITH = "WITH " + URLS_SQL
HOSTS = f"""{WITH}, {Q.profile_ctes('p0', 'urls')},
p1 AS (SELECT *, {Q.profile_tld('host')} AS tld FROM p0),
p AS MATERIALIZED (SELECT *, {Q.profile_domain('host', 'tld')} AS domain FROM p1)"""


# --- validation ---------------------------------------------------------------------------

RAW_LABELS = (None, "2", "abc", " 1 ", "", "1.0", "-1", "0", "1", "+0", "1_0", "00")


def raw_rows(spark, sf):
    """URL rows as they come from files: some URLs missing, labels as text of mixed quality."""
    k = F.col("page_id") * 29 + F.col("variant")
    raw = F.when(k % 5 == 0, F.get(F.array(*map(F.lit, RAW_LABELS)), (k % 12).cast("int"))).otherwise(
        F.col("label").cast("string"))
    return urls(spark, sf).select(
        "page_id", "variant", F.when(k % 31 != 0, F.col("url")).alias("url"), raw.alias("label"))


_RAW = ", ".join("NULL" if x is None else Q.lit(x) for x in RAW_LABELS)
RAW_SQL = f"""{WITH},
raw AS (SELECT page_id, variant, CASE WHEN (page_id * 29 + variant) % 31 <> 0 THEN url END AS url,
               CASE WHEN (page_id * 29 + variant) % 5 = 0
                    THEN ([{_RAW}])[1 + (page_id * 29 + variant) % 12]
                    ELSE label::VARCHAR END AS label FROM urls),
checked AS (SELECT *, CASE
    WHEN coalesce(url, '') = '' THEN 'missing_url'
    WHEN label IS NULL OR NOT regexp_matches({Q.strip('label')}, '^[+-]?[0-9](_?[0-9])*$') THEN 'invalid_label'
    WHEN replace({Q.strip('label')}, '_', '')::BIGINT NOT IN (0, 1) THEN 'invalid_label'
    ELSE 'valid' END AS status FROM raw)"""


@query("validate_rows", f"{RAW_SQL} SELECT page_id, variant, status FROM checked")
def validate_rows(spark, sf):
    return P.validate_rows(raw_rows(spark, sf)).select("page_id", "variant", "status")


@query("labelled_urls", f"""{RAW_SQL}
SELECT url, replace({Q.strip('label')}, '_', '')::TINYINT AS label FROM checked WHERE status = 'valid'""")
def labelled_urls(spark, sf):
    return P.keep_valid(raw_rows(spark, sf)).select("url", "label")


@query("dataset_overview", f"""{RAW_SQL},
c AS (SELECT count(*) AS total, count(*) FILTER (status = 'missing_url') AS missing_url,
             count(*) FILTER (status = 'invalid_label') AS invalid_label,
             count(*) FILTER (status = 'valid') AS valid,
             count(*) FILTER (status = 'valid' AND TRY_CAST(replace({Q.strip('label')}, '_', '') AS BIGINT) = 0) AS benign,
             count(*) FILTER (status = 'valid' AND TRY_CAST(replace({Q.strip('label')}, '_', '') AS BIGINT) = 1) AS malicious
      FROM checked)
SELECT *, {Q.percent('benign', 'valid')} AS benign_pct, {Q.percent('malicious', 'valid')} AS malicious_pct FROM c""")
def dataset_overview(spark, sf):
    return P.overview(raw_rows(spark, sf))


# --- lengths ------------------------------------------------------------------------------

@query("length_histogram", f"{WITH} SELECT label, length(url) AS length, count(*) AS n FROM urls GROUP BY ALL")
def length_histogram(spark, sf):
    return P.length_histogram(urls(spark, sf), F.length("url"), ("label",))


def _label_hist(spark, sf):
    hist = P.length_histogram(urls(spark, sf), F.length("url"), ("label",))
    return P.with_all_labels(hist, ("length",)).withColumn("label", P.label_name(F.col("label")))


_BOTH = f"""{WITH}, v AS (SELECT label::VARCHAR AS label, length(url) AS len FROM urls
  UNION ALL SELECT 'all', length(url) FROM urls)"""


@query("length_stats", f"""{_BOTH}
SELECT label, count(*) AS count, min(len) AS min, max(len) AS max, round(avg(len), 6) AS mean,
       round(stddev_pop(len), 6) AS std FROM v GROUP BY label""")
def length_stats(spark, sf):
    stats = P.stats_from_histogram(_label_hist(spark, sf), ("label",))
    return stats.select("label", "count", "min", "max", F.round("mean", 6).alias("mean"),
                        F.round("std", 6).alias("std"))


def _percentile_sql(col: str, percents=K.PERCENTILES) -> str:
    return ", ".join(f"quantile_disc({col}, {p / 100!r}) AS {P.percentile_column(p)}" for p in percents)


@query("length_percentiles", f"{_BOTH} SELECT label, {_percentile_sql('len')} FROM v GROUP BY label")
def length_percentiles(spark, sf):
    return P.percentiles_from_histogram(_label_hist(spark, sf), ("label",))


_COMPONENTS = " UNION ALL ".join(f"SELECT '{c}' AS component, length({c}) AS len FROM p" for c in P.COMPONENTS)


@query("component_lengths", f"""{HOSTS}, v AS ({_COMPONENTS})
SELECT component, count(*) AS count, min(len) AS min, max(len) AS max, round(avg(len), 6) AS mean,
       round(stddev_pop(len), 6) AS std, {_percentile_sql('len')} FROM v GROUP BY component""")
def component_lengths(spark, sf):
    hist = P.component_histogram(urls(spark, sf))
    stats = P.stats_from_histogram(hist, ("component",)).select(
        "component", "count", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))
    return stats.join(P.percentiles_from_histogram(hist, ("component",)), "component")


_CUT = ", ".join(
    f"(SELECT {Q.percent(f'count(*) FILTER (length(url) > {c})', 'count(*)')} FROM urls) AS cut_pct_{c}"
    for c in ("length_at", "up_to_32", "up_to_64"))


@query("max_len_advice", f"""{WITH},
q AS (SELECT unnest([99.0, 99.5, 99.9])::DOUBLE AS percentile,
             unnest((SELECT quantile_disc(length(url), [0.99, 0.995, 0.999]) FROM urls)) AS length_at),
a AS (SELECT *, (ceil(length_at / 32) * 32)::BIGINT AS up_to_32, (ceil(length_at / 64) * 64)::BIGINT AS up_to_64 FROM q)
SELECT *, {_CUT} FROM a""")
def max_len_advice(spark, sf):
    return P.max_length_advice(urls(spark, sf))


# --- characters ---------------------------------------------------------------------------

CHARS = f"""{WITH}, c AS (SELECT label, unnest(string_split(url, '')) AS ch FROM urls),
n AS MATERIALIZED (SELECT label, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL)"""


def top_sql(source: str, key: str, tops: dict[str, int]) -> str:
    return f"""
b AS (SELECT label::VARCHAR AS label, {key}, n FROM {source}
      UNION ALL SELECT 'all', {key}, sum(n)::BIGINT FROM {source} GROUP BY {key}),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, {key}) AS rank,
             sum(n) OVER (PARTITION BY label) AS whole FROM b)
SELECT label, rank, {key}, n, {Q.percent('n', 'whole')} AS pct FROM r
WHERE rank <= CASE WHEN label = 'all' THEN {tops['all']} ELSE {tops['label']} END"""


CHAR_TOPS = {"all": 100, "label": 100}
SCHEME_TOPS = {"all": 10, "label": 10}
TLD_TOPS = {"all": 50, "label": 20}


@query("char_frequency", f"{CHARS}, {top_sql('n', 'ch', CHAR_TOPS)}")
def char_frequency(spark, sf):
    counts = P.with_all_labels(P.char_counts(urls(spark, sf)), ("ch",))
    return P.top_counts(counts, "ch", CHAR_TOPS)


@query("char_frequency_text", """
WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents)
SELECT ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch""")
def char_frequency_text(spark, sf):
    """Character counts of whole multilingual texts."""
    docs = table(spark, sf, "documents").select("text", F.lit(0).alias("label"))
    return P.char_counts(docs, "text").select("ch", "n")


@query("exclusive_chars", f"""{CHARS}
SELECT ch, CASE WHEN min(label) = 1 THEN 'malicious' ELSE 'benign' END AS only_in, sum(n)::BIGINT AS n
FROM n GROUP BY ch HAVING min(label) = max(label)""")
def exclusive_chars(spark, sf):
    return P.exclusive_chars(urls(spark, sf))


def _coverage(vocab: str, name: str) -> str:
    unknown = f"sum(CASE WHEN contains({Q.lit(vocab)}, ch) THEN 0 ELSE n END)::BIGINT"
    return (f"SELECT '{name}' AS vocabulary, {len(vocab)} AS size, sum(n)::BIGINT AS chars, "
            f"{unknown} AS unknown, {Q.percent(unknown, 'sum(n)')} AS unknown_pct FROM n")


@query("vocab_coverage", f"{CHARS} {_coverage(K.VOCAB_OLD, 'old')} UNION ALL {_coverage(K.VOCAB, 'current')}")
def vocab_coverage(spark, sf):
    return P.vocab_coverage(urls(spark, sf))


@query("case_stats", f"""{WITH}, k AS (SELECT label, CASE
    WHEN regexp_matches(url, '[a-z]') AND regexp_matches(url, '[A-Z]') THEN 'mixed'
    WHEN regexp_matches(url, '[a-z]') THEN 'lower' WHEN regexp_matches(url, '[A-Z]') THEN 'upper'
    ELSE 'none' END AS case_class FROM urls), g AS (SELECT label, case_class, count(*) AS n FROM k GROUP BY ALL)
SELECT label, case_class, n, {Q.percent('n', 'sum(n) OVER (PARTITION BY label)')} AS pct FROM g""")
def case_stats(spark, sf):
    return P.case_stats(urls(spark, sf))


# --- hosts and domains --------------------------------------------------------------------

def _parts(spark, sf):
    return P.host_profile(urls(spark, sf))


@query("scheme_distribution", f"""{HOSTS},
n AS (SELECT label, CASE WHEN scheme = '' THEN '<none>' ELSE scheme END AS scheme, count(*) AS n FROM p GROUP BY ALL),
{top_sql('n', 'scheme', SCHEME_TOPS)}""")
def scheme_distribution(spark, sf):
    counts = P.with_all_labels(P.scheme_counts(_parts(spark, sf)), ("scheme",))
    return P.top_counts(counts, "scheme", SCHEME_TOPS)


@query("tld_distribution", f"""{HOSTS}, n AS (SELECT label, tld, count(*) AS n FROM p GROUP BY ALL),
{top_sql('n', 'tld', TLD_TOPS)}""")
def tld_distribution(spark, sf):
    counts = _parts(spark, sf).groupBy("label", "tld").agg(F.count("*").alias("n"))
    return P.top_counts(P.with_all_labels(counts, ("tld",)), "tld", TLD_TOPS)


@query("ip_hosts", f"""{HOSTS}
SELECT label, count(*) AS n, count(*) FILTER (tld = '<ip>') AS ip_hosts,
       {Q.percent("count(*) FILTER (tld = '<ip>')", 'count(*)')} AS ip_pct FROM p GROUP BY label""")
def ip_hosts(spark, sf):
    return P.ip_hosts(_parts(spark, sf))


@query("port_counts", f"""{HOSTS}
SELECT port, count(*) AS n FROM p WHERE port IS NOT NULL GROUP BY port ORDER BY n DESC, port LIMIT 15""")
def port_counts(spark, sf):
    return P.port_counts(_parts(spark, sf))


POOL = f"""{HOSTS},
pool0 AS (SELECT domain, count(*) AS n, count(*) FILTER (label = 0) AS n_benign,
                 count(*) FILTER (label = 1) AS n_malicious FROM p GROUP BY domain),
pool AS MATERIALIZED (SELECT *, CASE WHEN n_benign > n_malicious THEN 'benign' WHEN n_benign < n_malicious THEN 'mal'
                ELSE 'tie' END AS majority FROM pool0)"""


def _pool(spark, sf):
    return P.domain_pool(_parts(spark, sf))


@query("domain_pool", f"{POOL} SELECT * FROM pool")
def domain_pool(spark, sf):
    return _pool(spark, sf)


@query("domain_purity", f"""{POOL}, k AS (SELECT CASE WHEN n_benign > 0 AND n_malicious > 0 THEN 'mixed'
  WHEN n_benign > 0 THEN 'only_benign' ELSE 'only_malicious' END AS purity, n FROM pool),
g AS (SELECT purity, count(*) AS domains, sum(n)::BIGINT AS urls FROM k GROUP BY purity)
SELECT *, {Q.percent('domains', 'sum(domains) OVER ()')} AS domain_pct FROM g""")
def domain_purity(spark, sf):
    return P.domain_purity(_pool(spark, sf))


_BUCKETS = ", ".join(
    f"({i}, '{name}', {lo}, {hi if hi is not None else 10**15})"
    for i, (name, lo, hi) in enumerate(K.DOMAIN_SIZE_BUCKETS))


@query("domain_size_buckets", f"""{POOL}, b(position, bucket, lo, hi) AS (VALUES {_BUCKETS}),
g AS (SELECT position, bucket, count(pool.n) AS domains FROM b LEFT JOIN pool ON pool.n BETWEEN lo AND hi GROUP BY ALL)
SELECT *, {Q.percent('domains', 'sum(domains) OVER ()')} AS pct FROM g""")
def domain_size_buckets(spark, sf):
    return P.domain_size_buckets(_pool(spark, sf))


@query("top_domains", f"{POOL} SELECT * FROM pool ORDER BY n DESC, domain LIMIT 30")
def top_domains(spark, sf):
    return P.top_domains(_pool(spark, sf))


_VN = {
    "vn_tld": "ends_with(host, '.vn')",
    "vn_brand": f"regexp_matches(url, '{Q.brand_pattern()}')",
    "vn_either": f"(ends_with(host, '.vn') OR regexp_matches(url, '{Q.brand_pattern()}') OR regexp_matches(url, '{Q.VN_TLD}'))",
}


@query("vn_by_label", f"""{HOSTS} SELECT label, count(*) AS n,
{', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in _VN.items())},
{', '.join(f"{Q.percent(f'count(*) FILTER ({c})', 'count(*)')} AS {n}_pct" for n, c in _VN.items())}
FROM p GROUP BY label""")
def vn_by_label(spark, sf):
    return P.vn_by_label(_parts(spark, sf))


@query("class_balance", f"""{WITH}, c AS (SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM urls)
SELECT n_pos, n_neg, round(n_neg / greatest(n_pos, 1), 4) AS pos_weight,
       round((n_pos + n_neg) / (2.0::DOUBLE * n_neg), 6) AS weight_0,
       round((n_pos + n_neg) / (2.0::DOUBLE * n_pos), 6) AS weight_1 FROM c""")
def class_balance(spark, sf):
    return P.class_balance(urls(spark, sf)).select(
        "n_pos", "n_neg", F.round("pos_weight", 4).alias("pos_weight"),
        F.round("weight_0", 6).alias("weight_0"), F.round("weight_1", 6).alias("weight_1"))
