"""URL feature frames: 105 tabular and 30 lexical features, and their standardisation.

Each frame is built in a few stacked projections. A projection that is referenced more than once
by the next one is kept apart by the optimizer, so the URL is parsed once per row although a
hundred features read the parts. There is no shuffle anywhere in this module except the one-row
aggregate of ``feature_stats``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions import text as T
from urlsieve.functions import urls as U
from urlsieve.functions.text import flag, occurrences, ratio, text
from urlsieve.session import inline_table


def query_keys(query: Column) -> Column:
    """Distinct decoded keys of a query string; blank values count, empty pieces do not."""
    pieces = F.filter(F.split(query, "&"), lambda piece: piece != "")

    def decode(piece: Column) -> Column:
        key = F.substring_index(piece, "=", 1)
        return F.coalesce(F.try_url_decode(key), F.replace(key, text("+"), text(" ")))

    return F.array_distinct(F.transform(pieces, decode))


def last_segment(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def extension(segment: Column) -> Column:
    """Extension of a path segment without its dot, NULL when there is none."""
    return F.when(F.contains(segment, text(".")), F.substring_index(segment, ".", -1))


def tabular_parts(df: DataFrame, url: str = "url", rules: U.Rules | None = None) -> DataFrame:
    """Parsed columns behind the tabular features, prefixed ``t_``."""
    df = df.withColumns({"t_raw": T.strip(F.coalesce(F.col(url), text("")))})
    df = df.withColumns({"t_url": F.lower("t_raw")})
    df = U.with_split(df, F.col("t_url"), "t_")
    df = U.with_suffix_parts(df, U.lenient_host(F.col("t_url")), "t_", rules)
    df = df.withColumns({
        "t_host": U.hostname(F.col("t_netloc")),
        "t_port": U.valid_port(F.col("t_netloc")),
        "t_path": U.cut_path_parameters(F.col("t_scheme"), F.col("t_path")),
    })
    raw, url_low, host = F.col("t_raw"), F.col("t_url"), F.col("t_host")
    # counts that several features share
    df = df.withColumns({
        "t_last": last_segment(F.col("t_path")),
        "t_words": F.concat_ws("?", "t_path", "t_query"),
        "t_digits": T.digits(url_low),
        "t_upper": T.occurrences_of_class(raw, "[A-Z]"),
        "t_ascii": T.occurrences_of_class(raw, "[A-Za-z]"),
        "t_foreign": T.occurrences_of_class(raw, "[^\\x00-\\x7F]"),
        "t_host_digits": T.digits(host),
        "t_host_letters": T.letters(host),
    })
    keywords = sum(
        (F.contains(F.col("t_words"), text(w)).cast("int") for w in K.PHISHING_KEYWORDS), F.lit(0)
    )
    return df.withColumns({"t_ext": extension(F.col("t_last")), "t_keywords": keywords})


def _tabular_columns() -> dict[str, Column]:
    raw, url, host, path, query = (F.col("t_" + c) for c in ("raw", "url", "host", "path", "query"))
    fragment, suffix, sub, ext = (F.col("t_" + c) for c in ("fragment", "suffix", "subdomain", "ext"))
    n_raw, n_url, n_host = F.length(raw), F.length(url), F.length(host)
    n_digits, upper, non_ascii = F.col("t_digits"), F.col("t_upper"), F.col("t_foreign")
    host_digits, host_letters = F.col("t_host_digits"), F.col("t_host_letters")
    keywords = F.col("t_keywords")
    out = {
        "url_len": n_raw,
        "host_len": n_host,
        "path_len": F.length(path),
        "query_len": F.length(query),
        "fragment_len": F.length(fragment),
        "path_depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")),
        "num_query_params": F.when(query == "", F.lit(0)).otherwise(F.size(query_keys(query))),
        "has_query": flag(query != ""),
        "has_fragment": flag(fragment != ""),
        "has_port": flag(F.col("t_port").isNotNull()),
        "path_to_url_ratio": ratio(F.length(path), n_raw),
        "is_bare_hostname": flag(path.isin("", "/")),
        "digit_count_url": n_digits,
        "digit_density_url": ratio(n_digits, n_url),
        "hyphen_count_url": occurrences(url, "-"),
        "dot_count_url": occurrences(url, "."),
        "at_count": occurrences(url, "@"),
        "pct_count": occurrences(url, "%"),
        "amp_count": occurrences(url, "&"),
        "eq_count": occurrences(url, "="),
        "qmark_count": occurrences(url, "?"),
        "has_double_slash_in_path": flag(F.contains(path, text("//"))),
        "mixed_case_ratio": ratio(upper, F.col("t_ascii")),
        "has_upper": flag(upper > 0),
        "has_control_chars": flag(raw.rlike("[\\x00-\\x1f\\x7f]")),
        "has_non_ascii": flag(non_ascii > 0),
        "non_ascii_ratio": ratio(non_ascii, n_raw),
        "has_punycode": flag(F.contains(host, text("xn--"))),
        "host_digit_count": host_digits,
        "host_digit_density": ratio(host_digits, n_host),
        "host_hyphen_count": occurrences(host, "-"),
        "host_dot_count": occurrences(host, "."),
        "host_num_subdomains": F.size(F.filter(F.split(sub, "\\."), lambda s: s != "")),
        "host_starts_with_www": flag(host.startswith("www.")),
        "host_longest_digit_run": T.longest_run(host, "[0-9]"),
        "host_longest_consonant_run": T.longest_run(host, "[b-df-hj-np-tv-z]"),
        "host_vowel_ratio": ratio(T.occurrences_of_class(host, "[aeiou]"), host_letters),
        "host_letter_count": host_letters,
        "entropy_url": T.entropy(url),
        "entropy_host": T.entropy(host),
        "entropy_path": T.entropy(path),
        "is_http": flag(F.col("t_scheme") == "http"),
        "is_https": flag(F.col("t_scheme") == "https"),
        "is_ip_host": flag(U.is_ip_loose(host)),
        "tld_other": flag((suffix != "") & ~suffix.isin(*K.INDICATOR_SUFFIXES)),
        "tld_missing": flag(suffix == ""),
        "tld_label_count": F.when(suffix == "", F.lit(0)).otherwise(occurrences(suffix, ".") + 1),
        "tld_is_vn": flag(suffix.isin(*K.VN_SUFFIXES)),
        "tld_is_suspicious": flag(suffix.isin(*K.SUSPICIOUS_SUFFIXES)),
        "tld_is_common": flag(suffix.isin(*K.COMMON_SUFFIXES)),
        "num_phishing_keywords": keywords,
        "has_phishing_keyword": flag(keywords > 0),
        "has_malware_ext": flag(ext.isin(*K.MALWARE_EXTENSIONS)),
        "has_cdn_ext": flag(ext.isin(*K.CDN_EXTENSIONS)),
        "has_any_ext": flag(ext.isNotNull()),
    }
    for s in K.INDICATOR_SUFFIXES:
        out["tld_" + s.replace(".", "_")] = flag(suffix == s)
    return out


def tabular_features(
    df: DataFrame, url: str = "url", keep: tuple[str, ...] = (), rules: U.Rules | None = None,
) -> DataFrame:
    """The 105 tabular features in their declared order, after the columns named in ``keep``.

    Suffixes are those of ``rules``, else of the fixed list.
    """
    made = _tabular_columns()
    return tabular_parts(df.select(*dict.fromkeys([*keep, url])), url, rules).select(
        *keep, *(made[name].alias(name) for name in K.TABULAR_FEATURES)
    )


def _lexical_columns(url: Column) -> dict[str, Column]:
    host, path, query = F.col("x_host"), F.col("x_path"), F.col("x_query")
    n = F.length(url)
    n_digits, n_letters, host_is_ip = F.col("x_digits"), F.col("x_letters"), F.col("x_ip")
    labels = F.filter(F.split(host, "\\."), lambda part: part != "")
    n_sub = F.when(host_is_ip, F.lit(0)).otherwise(F.greatest(F.size(labels) - 2, F.lit(0)))
    sub_lengths = F.transform(F.slice(labels, F.lit(1), n_sub), F.length)
    last = F.when(F.contains(host, text(".")), U.last_label(host))
    out = {
        "url_length": n,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "query_length": F.length(query),
        "num_dots": occurrences(url, "."),
        "num_hyphens": occurrences(url, "-"),
        "num_underscores": occurrences(url, "_"),
        "num_slashes": occurrences(url, "/"),
        "num_question_marks": occurrences(url, "?"),
        "num_equals": occurrences(url, "="),
        "num_amps": occurrences(url, "&"),
        "num_ats": occurrences(url, "@"),
        "num_percents": occurrences(url, "%"),
        "num_digits": n_digits,
        "digit_ratio": ratio(n_digits, n),
        "letter_ratio": ratio(n_letters, n),
        "vowel_ratio": ratio(T.occurrences_of_class(url, "[aeiouAEIOU]"), n_letters),
        "special_char_ratio": ratio(n - n_digits - n_letters, n),
        "has_ip_host": flag(host_is_ip),
        "has_port": flag(F.col("x_port").isNotNull()),
        "is_https": flag(F.col("x_scheme") == "https"),
        "num_subdomains": n_sub,
        "subdomain_length_max": F.coalesce(F.array_max(sub_lengths), F.lit(0)),
        "tld_is_vn": flag(host.endswith(".vn")),
        "tld_is_common": flag(last.isin(*K.LEXICAL_COMMON_SUFFIXES)),
        "host_entropy": T.entropy(host),
        "has_punycode": flag(F.contains(host, text("xn--"))),
        "path_depth": occurrences(path, "/"),
        "has_double_slash_in_path": flag(F.contains(path, text("//"))),
        "query_param_count": F.when(query == "", F.lit(0)).otherwise(occurrences(query, "&") + 1),
    }
    return {name: out[name].cast("double") for name in K.LEXICAL_FEATURES}


def lexical_features(df: DataFrame, url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """The 30 lexical features in their declared order, after the columns named in ``keep``."""
    base = df.select(*dict.fromkeys([*keep, url])).withColumns(
        {"x_url": F.coalesce(F.col(url), text(""))}
    )
    # an empty URL has no parts, so its features are all zero
    split = U.with_split(base, U.read_as_http(F.col("x_url")), "x_")
    netloc = F.lower(F.col("x_netloc"))
    bare = ~F.contains(F.col("x_url"), text("://"))
    parts = split.withColumns({
        "x_scheme": F.when(bare, text("")).otherwise(F.col("x_scheme")),
        "x_host": U.host_of_netloc(netloc),
        "x_port": U.port_of_netloc(netloc),
    })
    counted = parts.withColumns({
        "x_digits": T.digits(F.col("x_url")),
        "x_letters": T.letters(F.col("x_url")),
        "x_ip": U.is_ip(F.col("x_host")),
    })
    made = _lexical_columns(F.col("x_url"))
    return counted.select(*keep, *(made[name].alias(name) for name in K.LEXICAL_FEATURES))


def _scaled(name: str) -> Column:
    return F.log1p(F.col(name)) if name in K.LOG_FEATURES else F.col(name)


def feature_stats(features: DataFrame) -> DataFrame:
    """One row per lexical feature: mean and population deviation after the log step.

    Call it on training rows only. A constant feature gets deviation 1.
    """
    aggregates = []
    for name in K.LEXICAL_FEATURES:
        aggregates += [F.avg(_scaled(name)).alias(f"{name}__mean"),
                       F.stddev_pop(_scaled(name)).alias(f"{name}__std")]
    wide = features.agg(*aggregates)
    rows = [
        F.struct(
            F.lit(name).alias("feature"),
            F.lit(name in K.LOG_FEATURES).alias("log1p"),
            F.col(f"{name}__mean").alias("mean"),
            F.when(F.col(f"{name}__std") < 1e-8, F.lit(1.0))
            .otherwise(F.col(f"{name}__std")).alias("std"),
        )
        for name in K.LEXICAL_FEATURES
    ]
    return wide.select(F.inline(F.array(*rows)))


def stats_row(stats: DataFrame) -> DataFrame:
    """The long statistics (30 rows) as one row of ``mean_*`` and ``std_*`` columns."""
    picks = []
    for name in K.LEXICAL_FEATURES:
        here = F.col("feature") == name
        picks += [F.max(F.when(here, F.col("mean"))).alias(f"mean_{name}"),
                  F.max(F.when(here, F.col("std"))).alias(f"std_{name}")]
    return stats.agg(*picks)


def normalize_features(
    features: DataFrame, stats: DataFrame, keep: tuple[str, ...] = (), repair: bool = True
) -> DataFrame:
    """Standardise the lexical features with given statistics.

    The statistics are one row, so the broadcast is bounded by construction. Values that are not
    finite become 0 (NaN) or +-10 (infinite); with ``repair=False`` they raise instead.
    """
    joined = features.crossJoin(F.broadcast(stats_row(stats)))

    def z(name: str) -> Column:
        score = (_scaled(name) - F.col(f"mean_{name}")) / F.col(f"std_{name}")
        infinite = F.abs(score) == F.lit(float("inf"))
        if repair:
            return (
                F.when(score.isNull() | F.isnan(score), F.lit(0.0))
                .when(infinite, F.signum(score) * 10.0)
                .otherwise(score)
            )
        bad = score.isNull() | F.isnan(score) | infinite
        return F.when(bad, F.raise_error(text(f"{name} is not finite")).cast("double")).otherwise(
            score
        )

    return joined.select(*keep, *(z(name).alias(name) for name in K.LEXICAL_FEATURES))


def query_pairs(df: DataFrame, query: str, keep: tuple[str, ...]) -> DataFrame:
    """One row per non-empty ``key=value`` piece of a query string."""
    pieces = df.select(*keep, F.explode(F.split(query, "&")).alias("piece")).where("piece <> ''")
    key = F.substring_index("piece", "=", 1)
    return pieces.select(
        *keep, key.alias("key"),
        F.substring(F.col("piece"), F.length(key) + 2, F.lit(1 << 30)).alias("value"),
    )


def build_vocab(df: DataFrame, url: str = "url") -> DataFrame:
    """Character ids learned from data: padding 0, unknown 1, then the characters in order.

    The distinct characters are at most the Unicode code points, so ranking them in one task is
    bounded whatever the size of the input.
    """
    chars = df.select(F.explode(T.characters(F.col(url))).alias("ch")).distinct()
    ranked = chars.select(
        "ch", (F.row_number().over(Window.orderBy("ch")) + 1).cast("int").alias("id")
    )
    fixed = inline_table(
        df.sparkSession, ["ch", "id"], [("<PAD>", K.PAD_ID), ("<UNK>", K.UNKNOWN_ID)]
    )
    return fixed.unionByName(ranked)
