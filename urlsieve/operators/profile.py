"""Exact profiling of a labelled URL table.

Everything reduces the data to small aggregates first (histograms, counts per domain); percentages,
percentiles and rankings are computed on those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions import text as T
from urlsieve.functions import urls as U
from urlsieve.functions.text import percent, text
from urlsieve.operators.ranks import running
from urlsieve.session import inline_table

LABEL_ALL = "all"


def label_name(label: Column) -> Column:
    return F.coalesce(label.cast("string"), text(LABEL_ALL))


def parse_label(raw: Column) -> Column:
    """Integer value of a label field, NULL when it is not an integer."""
    bare = T.strip(raw)
    whole = bare.rlike("^[+-]?[0-9](?:_?[0-9])*$")
    return F.when(whole, F.translate(bare, "_", "").try_cast("bigint"))


def validate_rows(df: DataFrame, url: str = "url", label: str = "label") -> DataFrame:
    """Add ``status``: the first problem of a row in a fixed order, or ``valid``."""
    number = parse_label(F.col(label))
    return df.withColumn(
        "status",
        F.when(F.coalesce(F.col(url), text("")) == "", "missing_url")
        .when(number.isNull() | ~number.isin(0, 1), "invalid_label")
        .otherwise("valid"),
    )


def keep_valid(df: DataFrame, url: str = "url", label: str = "label") -> DataFrame:
    checked = validate_rows(df, url, label).where("status = 'valid'").drop("status")
    return checked.withColumn(label, parse_label(F.col(label)).cast("tinyint"))


def overview(df: DataFrame, url: str = "url", label: str = "label") -> DataFrame:
    """Row counts: total, by status, and valid rows per label with percentages."""
    number = parse_label(F.col(label))

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0))

    status = F.col("status")
    counts = validate_rows(df, url, label).agg(
        F.count("*").alias("total"),
        count(status == "missing_url").alias("missing_url"),
        count(status == "invalid_label").alias("invalid_label"),
        count(status == "valid").alias("valid"),
        count((status == "valid") & (number == 0)).alias("benign"),
        count((status == "valid") & (number == 1)).alias("malicious"),
    )
    return counts.select(
        "*", percent(F.col("benign"), F.col("valid")).alias("benign_pct"),
        percent(F.col("malicious"), F.col("valid")).alias("malicious_pct"),
    )


# --- lengths ------------------------------------------------------------------------------

def length_histogram(df: DataFrame, value: Column, groups: Sequence[str] = ()) -> DataFrame:
    """How many rows have each length, per group."""
    return df.groupBy(*groups, value.alias("length")).agg(F.count("*").alias("n"))


def with_all_labels(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the rows of all labels together (NULL label) to counts per label."""
    both = hist.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn(
        "label", F.lit(None).cast(hist.schema["label"].dataType)
    )
    return hist.select("label", *keys, "n").unionByName(both.select("label", *keys, "n"))


def stats_from_histogram(hist: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Count, minimum, maximum, mean and population deviation from a length histogram."""
    length, n = F.col("length").cast("double"), F.col("n")
    raw = hist.groupBy(*groups).agg(
        F.sum("n").alias("count"), F.min("length").alias("min"), F.max("length").alias("max"),
        F.sum(length * n).alias("_s"), F.sum(length * length * n).alias("_q"),
    )
    mean = F.col("_s") / F.col("count")
    variance = F.greatest(F.col("_q") / F.col("count") - mean * mean, F.lit(0.0))
    return raw.select(
        *groups, "count", "min", "max", mean.alias("mean"), F.sqrt(variance).alias("std")
    )


def percentile_column(p: float) -> str:
    return "p" + f"{p:g}".replace(".", "_")


def percentiles_from_histogram(
    hist: DataFrame, groups: Sequence[str], percents: Sequence[float] = K.PERCENTILES
) -> DataFrame:
    """Smallest length at which the running count reaches each percentage of the total."""
    totals = hist.groupBy(*groups).agg(F.sum("n").alias("_total"))
    filled = running(
        hist, [F.col("length")], F.floor(F.col("length") / 1024), groups, {"_upto": F.col("n")}
    )
    joined = filled.join(totals, list(groups)) if groups else filled.crossJoin(F.broadcast(totals))
    return joined.groupBy(*groups).agg(*(
        F.min(F.when(F.col("_upto") >= F.lit(p / 100.0) * F.col("_total"), F.col("length")))
        .alias(percentile_column(p))
        for p in percents
    ))


def max_length_advice(df: DataFrame, url: str = "url") -> DataFrame:
    """Candidate sequence lengths from high percentiles, rounded up, with the share they cut."""
    hist = length_histogram(df, F.length(url))
    wide = percentiles_from_histogram(hist, (), (99.0, 99.5, 99.9))
    tall = wide.select(F.inline(F.array(*(
        F.struct(F.lit(p).alias("percentile"), F.col(percentile_column(p)).alias("length_at"))
        for p in (99.0, 99.5, 99.9)
    ))))

    def up(step: int) -> Column:
        return (F.ceil(F.col("length_at") / step) * step).cast("long")

    advice = tall.select("percentile", "length_at", up(32).alias("up_to_32"), up(64).alias("up_to_64"))
    crossed = hist.crossJoin(F.broadcast(advice))
    cut = {c: F.sum(F.when(F.col("length") > F.col(c), F.col("n")).otherwise(0))
           for c in ("length_at", "up_to_32", "up_to_64")}
    return crossed.groupBy("percentile", "length_at", "up_to_32", "up_to_64").agg(
        *(percent(expr, F.sum("n")).alias(f"cut_pct_{c}") for c, expr in cut.items())
    )


COMPONENTS = ("scheme", "host", "path", "query", "fragment")


def component_histogram(df: DataFrame, url: str = "url") -> DataFrame:
    parts = U.with_profile_parts(df.select(url), url)
    lengths = F.array(*(
        F.struct(F.lit(c).alias("component"), F.length(c).alias("length")) for c in COMPONENTS
    ))
    return length_histogram(parts.select(F.inline(lengths)), F.col("length"), ("component",))


# --- characters ---------------------------------------------------------------------------

def char_counts(df: DataFrame, url: str = "url", label: str = "label") -> DataFrame:
    """label, ch, n: occurrences of each character. Partial sums leave few rows to shuffle."""
    return (
        df.select(F.col(label).alias("label"), F.explode(T.characters(F.col(url))).alias("ch"))
        .groupBy("label", "ch").agg(F.count("*").alias("n"))
    )


def top_counts(counts: DataFrame, key: str, tops: dict[str, int]) -> DataFrame:
    """Rank values per label by count (ties by value), keep the report's top rows, add shares.

    ``counts`` has label (NULL for all), ``key`` and n; ``tops`` gives the limit for ``all`` rows
    and for each label's rows.
    """
    named = counts.withColumn("label_name", label_name(F.col("label")))
    totals = named.groupBy("label_name").agg(F.sum("n").alias("_whole"))
    order = Window.partitionBy("label_name").orderBy(F.desc("n"), F.asc(key))
    ranked = named.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= max(tops.values())
    )
    limit = F.when(F.col("label_name") == LABEL_ALL, tops["all"]).otherwise(tops["label"])
    return (
        ranked.where(F.col("rank") <= limit)
        .join(F.broadcast(totals), "label_name")
        .select(F.col("label_name").alias("label"), "rank", key, "n",
                percent(F.col("n"), F.col("_whole")).alias("pct"))
    )


def exclusive_chars(df: DataFrame, url: str = "url", label: str = "label") -> DataFrame:
    """Characters seen under one label only. One grouped pass does both set differences."""
    seen = char_counts(df, url, label).groupBy("ch").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("n")
    )
    return seen.where("lo = hi").select(
        "ch", F.when(F.col("lo") == 1, "malicious").otherwise("benign").alias("only_in"), "n"
    )


def vocab_coverage(df: DataFrame, url: str = "url") -> DataFrame:
    """Characters outside the old and the current vocabulary, counted and as a percentage."""
    sums = df.agg(
        F.sum(F.length(url)).alias("chars"),
        F.sum(F.length(F.translate(F.col(url), K.VOCAB_OLD, ""))).alias("old"),
        F.sum(F.length(F.translate(F.col(url), K.VOCAB, ""))).alias("current"),
    )
    rows = F.array(*(
        F.struct(F.lit(name).alias("vocabulary"), F.lit(len(vocab)).alias("size"), F.col("chars"),
                 F.col(name).alias("unknown"),
                 percent(F.col(name), F.col("chars")).alias("unknown_pct"))
        for name, vocab in (("old", K.VOCAB_OLD), ("current", K.VOCAB))
    ))
    return sums.select(F.inline(rows))


def case_stats(df: DataFrame, url: str = "url", label: str = "label") -> DataFrame:
    counts = df.groupBy(label, T.case_class(F.col(url)).alias("case_class")).agg(
        F.count("*").alias("n")
    )
    whole = F.sum("n").over(Window.partitionBy(label))
    return counts.select(label, "case_class", "n", percent(F.col("n"), whole).alias("pct"))


# --- hosts and domains --------------------------------------------------------------------

def host_profile(df: DataFrame, url: str = "url", label: str = "label") -> DataFrame:
    """Parsed parts plus tld and registered domain, the base of the host-level reports."""
    return (
        U.with_profile_parts(df.select(url, label), url)
        .withColumn("tld", U.profile_tld(F.col("host")))
        .withColumn("domain", U.profile_domain(F.col("host"), F.col("tld")))
    )


def scheme_counts(parts: DataFrame, label: str = "label") -> DataFrame:
    scheme = F.when(F.col("scheme") == "", text("<none>")).otherwise(F.col("scheme"))
    return parts.groupBy(F.col(label).alias("label"), scheme.alias("scheme")).agg(
        F.count("*").alias("n"))


def ip_hosts(parts: DataFrame, label: str = "label") -> DataFrame:
    ips = F.sum((F.col("tld") == "<ip>").cast("long"))
    return parts.groupBy(label).agg(
        F.count("*").alias("n"), ips.alias("ip_hosts"), percent(ips, F.count("*")).alias("ip_pct")
    )


def port_counts(parts: DataFrame, top: int = 15) -> DataFrame:
    counts = parts.where("port IS NOT NULL").groupBy("port").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("port")).limit(top)


def domain_pool(parts: DataFrame, label: str = "label") -> DataFrame:
    """URLs per registered domain and label, with the majority label."""
    mal = F.sum((F.col(label) == 1).cast("long"))
    pool = parts.groupBy("domain").agg(F.count("*").alias("n"), mal.alias("n_malicious"))
    benign = F.col("n") - F.col("n_malicious")
    return pool.select(
        "domain", "n", benign.alias("n_benign"), "n_malicious",
        F.when(benign > F.col("n_malicious"), "benign")
        .when(benign < F.col("n_malicious"), "mal").otherwise("tie").alias("majority"),
    )


def domain_purity(pool: DataFrame) -> DataFrame:
    """Domains that are all benign, all malicious or mixed, and the URLs in each kind."""
    kind = (
        F.when((F.col("n_benign") > 0) & (F.col("n_malicious") > 0), "mixed")
        .when(F.col("n_benign") > 0, "only_benign").otherwise("only_malicious")
    )
    counts = pool.groupBy(kind.alias("purity")).agg(
        F.count("*").alias("domains"), F.sum("n").alias("urls"))
    whole = F.sum("domains").over(Window.partitionBy(F.lit(1)))
    return counts.select("purity", "domains", "urls",
                         percent(F.col("domains"), whole).alias("domain_pct"))


def domain_size_buckets(pool: DataFrame) -> DataFrame:
    """Domains per size class; size classes without a domain are listed with 0."""
    name = F
    for bucket, _, last in K.DOMAIN_SIZE_BUCKETS:
        name = name.otherwise(bucket) if last is None else name.when(F.col("n") <= last, bucket)
    counts = pool.groupBy(name.alias("bucket")).agg(F.count("*").alias("domains"))
    frame = inline_table(
        pool.sparkSession, ["position", "bucket"],
        [(i, b[0]) for i, b in enumerate(K.DOMAIN_SIZE_BUCKETS)],
    )
    filled = frame.join(counts, "bucket", "left").fillna(0, ["domains"])
    whole = F.sum("domains").over(Window.partitionBy(F.lit(1)))
    return filled.select("position", "bucket", "domains",
                         percent(F.col("domains"), whole).alias("pct"))


def top_domains(pool: DataFrame, top: int = 30) -> DataFrame:
    return pool.orderBy(F.desc("n"), F.asc("domain")).limit(top)


def vn_by_label(parts: DataFrame, url: str = "url", label: str = "label") -> DataFrame:
    flags = U.vn_flags(F.col(url), F.col("host"))
    sums = {name: F.sum(col.cast("long")) for name, col in flags.items()}
    return parts.groupBy(label).agg(
        F.count("*").alias("n"),
        *(s.alias(name) for name, s in sums.items()),
        *(percent(s, F.count("*")).alias(f"{name}_pct") for name, s in sums.items()),
    )


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Counts, pos_weight = negatives / max(positives, 1), balanced class weights n / (2 n_c)."""
    pos = F.sum((F.col(label) == 1).cast("long"))
    neg = F.sum((F.col(label) == 0).cast("long"))
    counts = df.agg(pos.alias("n_pos"), neg.alias("n_neg"))
    n = (F.col("n_pos") + F.col("n_neg")).cast("double")
    return counts.select(
        "n_pos", "n_neg",
        (F.col("n_neg") / F.greatest("n_pos", F.lit(1))).alias("pos_weight"),
        T.ratio(n, 2 * F.col("n_neg")).alias("weight_0"),
        T.ratio(n, 2 * F.col("n_pos")).alias("weight_1"),
    )
