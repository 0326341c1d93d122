"""Training, scoring and explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions import registry
from urlsieve.functions.text import strip
from urlsieve.operators import explain as X
from urlsieve.operators import features as FE
from urlsieve.operators import metrics as M
from urlsieve.operators import models as MD
from urlsieve.operators import splits as S
from urlsieve.plans import sqlkit as Q
from urlsieve.plans.page_queries import html_scan
from urlsieve.plans.profile_queries import HOSTS
from urlsieve.plans.registry import query
from urlsieve.plans.tables import TEXT_PAGES, URLS_SQL, urls
from urlsieve.plans.url_queries import STATS_CTE, held_out_rows, training_rows, z_sql
from urlsieve.session import cut_lineage, spread

KEYS = ("page_id", "variant")
# Cells and iterations of the linear models in these queries; the operators' defaults take eight times as long (README).
LINEAR_BITS, LINEAR_ITERATIONS = 14, 10
WITH = "WITH " + URLS_SQL


def split_features(spark, sf):
    """The tabular features with label and split; a table that training reads many times.

    The split reads its rows three times, so URLs are taken apart after it.
    """
    parts = S.random_split(urls(spark, sf), KEYS)
    return cut_lineage(FE.tabular_features(parts, "url", (*KEYS, "label", "split")))


def evaluation(scored, groups=()):
    """Threshold metrics and areas of scored rows, which are scored once."""
    rows = cut_lineage(scored.select(F.col("label").cast("int").alias("label"), MD.probability_of().alias("score"), *groups))
    return M.confusion(rows, groups=groups).crossJoin(F.broadcast(M.curve_areas(rows).select("roc_auc", "pr_auc")))


def _trees(rows):
    return MD.train_trees(rows.where("split <> 'test'").withColumn("held_out", F.col("split") == "val"),
                          validation="held_out")


@query("train_gbt")
def train_gbt(spark, sf):
    rows = split_features(spark, sf)
    return evaluation(_trees(rows).transform(rows.where("split = 'test'")))


@query("feature_importance")
def feature_importance(spark, sf):
    rows = split_features(spark, sf)
    return MD.tree_importance(_trees(rows), rows)


@query("permutation_importance")
def permutation_importance(spark, sf):
    rows = split_features(spark, sf)
    return MD.permutation_importance(_trees(rows), rows.where("split = 'test'").drop("split"))


@query("train_html_lr")
def train_html_lr(spark, sf):
    pages = spread(html_scan(spark, sf), TEXT_PAGES).withColumn("label", (F.col("label") == "phish").cast("int"))
    model = MD.train_page_model(training_rows(pages), bits=LINEAR_BITS, iterations=LINEAR_ITERATIONS)
    return evaluation(model.transform(MD.page_features(held_out_rows(pages), bits=LINEAR_BITS)))


@query("html_hashed")
def html_hashed(spark, sf):
    """Hashed page vectors: distinct cells and norm of each (the norm is 1 by construction).

    Vectors of 2^20 cells stay sparse: the two numbers are taken from the stored entries.
    """
    vectors = MD.page_features(spread(html_scan(spark, sf).select("page_id", "html"), TEXT_PAGES))
    sizes = F.arrow_udf(MD.vector_sizes, "cells int, norm double")
    return vectors.select("page_id", sizes("features").alias("v")).select("page_id", "v.cells", F.round("v.norm", 6).alias("norm"))


def _url_model(spark, sf):
    """Stripped URLs with their lexical features, which are read from many times, their statistics and the fitted model."""
    bare = strip(F.col("url"))
    rows = urls(spark, sf).select(*KEYS, "label", "url", bare.alias("bare"), (F.col("url") == bare).alias("as_is"))
    keep = (*KEYS, "label")
    stripped = rows.select(*keep, "as_is", F.col("bare").alias("url"))
    lexical = cut_lineage(FE.lexical_features(stripped, "url", (*keep, "as_is", "url")))
    # the statistics are of URLs as they come, so those that stripping changes are parsed again
    seen = lexical.where("as_is").drop("as_is", "url").unionByName(FE.lexical_features(rows.where("NOT as_is"), "url", keep))
    stats = cut_lineage(FE.feature_stats(training_rows(seen)))
    vectors = MD.vectors_of(training_rows(lexical), stats, "url", ("label",), bits=LINEAR_BITS)
    model = MD.train_on_vectors(vectors, iterations=LINEAR_ITERATIONS)
    return lexical, stats, model


@query("train_char_lr")
def train_char_lr(spark, sf):
    rows, stats, model = _url_model(spark, sf)
    return evaluation(model.transform(MD.vectors_of(held_out_rows(rows), stats, "url", ("label",), bits=LINEAR_BITS)))


@query("score_urls")
def score_urls(spark, sf):
    rows, stats, model = _url_model(spark, sf)
    scored = model.transform(MD.vectors_of(rows, stats, "url", KEYS, bits=LINEAR_BITS))
    return MD.score_frame(scored, 0.5, (*KEYS, "url"))


# --- explanations -------------------------------------------------------------------------

@query("explain_url_model")
def explain_url_model(spark, sf):
    """Every attribution of the fitted URL model; with the base value they add up to the log-odds."""
    rows, stats, model = _url_model(spark, sf)
    return X.explain_lexical(model, rows, stats, KEYS, bits=LINEAR_BITS)


_TALL = " UNION ALL ".join(
    f"SELECT page_id, variant, {i} AS position, '{n}' AS feature, round({z_sql(n)}, 6) AS z FROM lex" for i, n in enumerate(K.LEXICAL_FEATURES))


@query("top_zscores", f"""{STATS_CTE}, tall AS ({_TALL}),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, variant ORDER BY abs(z) DESC, position) AS rank FROM tall)
SELECT page_id, variant, rank, feature, z AS z_score, CASE WHEN z > 0 THEN 'ABOVE train mean' ELSE 'BELOW train mean' END AS direction
FROM r WHERE rank <= 5""")
def top_zscores(spark, sf):
    lex = FE.lexical_features(urls(spark, sf), "url", (*KEYS, "label"))
    z = FE.normalize_features(lex, FE.feature_stats(training_rows(lex)), KEYS)
    near = z.select(*KEYS, *(F.round(n, 6).alias(n) for n in K.LEXICAL_FEATURES))
    return X.top_zscores(near, KEYS)


WEIGHTS = {n: ((i * 7) % 11 - 5) / 10 for i, n in enumerate(K.LEXICAL_FEATURES)}
_SHIFTS = " UNION ALL ".join(
    f"SELECT page_id, variant, {i} AS position, '{n}' AS name, {n} AS feature_value, {WEIGHTS[n]!r}::DOUBLE * ({n} - (SELECT avg({n}) FROM train)) AS v FROM lex"
    for i, n in enumerate(K.LEXICAL_FEATURES))
_BASE = " + ".join(f"{w!r}::DOUBLE * avg({n})" for n, w in WEIGHTS.items())


@query("explain_linear", f"""{STATS_CTE}, tall AS ({_SHIFTS}),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, variant ORDER BY abs(v) DESC, position) AS rank, max(abs(v)) OVER (PARTITION BY page_id, variant) AS widest FROM tall)
SELECT page_id, variant, (SELECT round({_BASE} + 0.25, 6) FROM train) AS base_value, rank, name, round(v, 6) AS attribution,
       round(feature_value, 6) AS feature_value, CASE WHEN v > 0 THEN 'MAL' ELSE 'BEN' END AS direction, round(abs(v) / widest * 100, 1) AS bar_width_pct
FROM r WHERE rank <= 5""")
def explain_linear(spark, sf):
    lex = FE.lexical_features(urls(spark, sf), "url", (*KEYS, "label"))
    means = training_rows(lex).agg(*(F.avg(n).alias(f"mean_{n}") for n in K.LEXICAL_FEATURES))
    out = X.explain_linear(lex, WEIGHTS, means, KEYS, intercept=0.25, k=5)
    return out.withColumns({c: F.round(c, 6) for c in ("base_value", "attribution", "feature_value")})


# a weight per three-character piece: how many more malicious than benign URLs it occurs in
_GRAMS = """grams AS (SELECT page_id, variant, label, url, unnest(list_transform(range(1, length(url) - 1), lambda i: url[i:i+2])) AS gram,
  unnest(range(0, length(url) - 2)) AS position FROM urls WHERE length(url) >= 3),
weights AS MATERIALIZED (SELECT gram, (sum(label) * 2 - count(*))::DOUBLE AS weight FROM grams GROUP BY gram),
blocks AS MATERIALIZED (SELECT page_id, variant, url, (position // 4)::INT AS block, sum(weight) AS weight FROM grams JOIN weights USING (gram) GROUP BY ALL)"""


def gram_weights(rows):
    from urlsieve.operators.pages import char_ngrams

    pieces = rows.select("label", F.explode(char_ngrams(F.col("url"), 3)).alias("gram"))
    return pieces.groupBy("gram").agg((F.sum("label") * 2 - F.count("*")).cast("double").alias("weight"))


@query("explain_blocks", f"{WITH}, {_GRAMS} SELECT page_id, variant, block, weight FROM blocks")
def explain_blocks(spark, sf):
    rows = urls(spark, sf)
    return X.block_weights(rows, gram_weights(rows), KEYS).drop("url")


@query("top_blocks", f"""{WITH}, {_GRAMS}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id, variant ORDER BY weight DESC, block) AS rank FROM blocks)
SELECT page_id, variant, rank, block, block * 4 AS position, substr(url, block * 4 + 1, 4) AS snippet, weight FROM r WHERE rank <= 5""")
def top_blocks(spark, sf):
    rows = urls(spark, sf)
    return X.top_blocks(X.block_weights(rows, gram_weights(rows), KEYS), KEYS)


# --- SQL functions ------------------------------------------------------------------------

@query("sql_functions", f"""{HOSTS}
SELECT page_id, variant, host, tld, domain, round({Q.entropy('url')}, 6) AS entropy,
  (regexp_matches(url, '{Q.VN_TLD}') OR regexp_matches(url, '{Q.brand_pattern()}') OR ends_with(host, '.vn')) AS is_vn,
  CASE WHEN variant <= 6 THEN 'Low Risk' WHEN variant <= 13 THEN 'Caution' WHEN variant <= 20 THEN 'Suspicious' ELSE 'High Risk' END AS risk
FROM p""")
def sql_functions(spark, sf):
    registry.register_sql_functions(spark)
    urls(spark, sf).createOrReplaceTempView("urlsieve_urls")
    return spark.sql("""
        SELECT page_id, variant, url_host(url) AS host, url_tld(url) AS tld, url_reg_domain(url) AS domain,
               round(url_entropy(url), 6) AS entropy, url_is_vn(url) AS is_vn,
               url_risk(CASE WHEN variant <= 6 THEN 0.25D WHEN variant <= 13 THEN 0.5D WHEN variant <= 20 THEN 0.75D ELSE 1D END) AS risk
        FROM urlsieve_urls""")


@query("sql_table_function", f"""{WITH}, k AS (SELECT page_id, variant, unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) AS piece FROM urls)
SELECT page_id, variant, split_part(piece, '=', 1) AS key, substr(piece, length(split_part(piece, '=', 1)) + 2) AS value FROM k WHERE piece <> ''""")
def sql_table_function(spark, sf):
    registry.register_sql_functions(spark)
    urls(spark, sf).createOrReplaceTempView("urlsieve_urls")
    return spark.sql("SELECT page_id, variant, q.key, q.value FROM urlsieve_urls, LATERAL url_query_params(url) AS q")
