"""URL-level queries: parsing, rewriting, predicates and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions import risk, suffixes, text as T, urls as U
from urlsieve.operators import features as FE
from urlsieve.operators import lookups
from urlsieve.plans import sqlkit as Q
from urlsieve.plans.registry import query
from urlsieve.plans.tables import URLS_SQL, table, urls
from urlsieve.session import inline_table

KEYS = ("page_id", "variant")
WITH = "WITH " + URLS_SQL


@query("norm_url", f"""{WITH}
SELECT page_id, variant, CASE WHEN regexp_matches(u, '(?i)^https?://') THEN u END AS norm
FROM (SELECT page_id, variant, trim(trim({Q.strip('url')}, '"'), '''') AS u FROM urls)""")
def norm_url(spark, sf):
    return urls(spark, sf).select(*KEYS, U.norm_url(F.col("url")).alias("norm"))


@query("parse_url", f"""{WITH}, {Q.profile_ctes('p', 'urls')}
SELECT page_id, variant, scheme, host, port, path, query, fragment FROM p""")
def parse_url(spark, sf):
    return U.with_profile_parts(urls(spark, sf)).select(
        *KEYS, "scheme", "host", "port", "path", "query", "fragment"
    )


def tabular_ctes() -> str:
    schemes = Q.in_list(K.PARAMETER_SCHEMES)
    bare = r"regexp_replace(low, '^([a-z0-9+.\-]*:)?//', '')"
    netloc = f"regexp_extract(regexp_extract({bare}, '^[^/?#]*'), '([^@]*)$', 1)"
    lookup = (
        rf"CASE WHEN starts_with({netloc}, '[') THEN regexp_extract({netloc}, '^(\[[^\]]*\]?)', 1) "
        rf"ELSE regexp_replace({Q.strip(f'regexp_extract({netloc}, {Q.lit("^[^:]*")})')}, '\.+$', '') END"
    )
    return f"""{WITH},
t_low AS (SELECT page_id, variant, {Q.strip('url')} AS raw, lower({Q.strip('url')}) AS low FROM urls),
{Q.split_cte('t_split', 't_low', 'low')},
t_host AS (
  SELECT * EXCLUDE (path), {Q.hostname('netloc')} AS host, {Q.port('netloc')} AS port, {lookup} AS lookup,
         CASE WHEN scheme IN {schemes} THEN regexp_replace(path, ';[^/]*$', '') ELSE path END AS path
  FROM t_split),
t_sfx AS (
  SELECT *, CASE WHEN {Q.is_ip('lookup')} THEN ''
                 ELSE coalesce({Q.suffix_of('lookup', K.ALL_SUFFIXES, whole=True)}, '') END AS suffix
  FROM t_host),
t_front AS (
  SELECT *, CASE WHEN {Q.is_ip('lookup')} THEN '' WHEN suffix = '' THEN lookup
                 WHEN suffix = lookup THEN '' ELSE {Q.front('lookup', 'suffix')} END AS front
  FROM t_sfx),
t AS (
  SELECT *, CASE WHEN {Q.is_ip('lookup')} THEN lookup ELSE {Q.last_label('front')} END AS domain,
         CASE WHEN contains(front, '.') THEN regexp_replace(front, '\\.[^.]*$', '') ELSE '' END AS subdomain,
         regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1) AS last_seg
  FROM t_front)"""


@query("parse_url_tab", f"""{tabular_ctes()}
SELECT page_id, variant, scheme, host, port, path, query, fragment FROM t""")
def parse_url_tab(spark, sf):
    return FE.tabular_parts(urls(spark, sf)).select(
        *KEYS, *(F.col("t_" + c).alias(c) for c in ("scheme", "host", "port", "path", "query", "fragment"))
    )


@query("psl_parts", f"""{tabular_ctes()}
SELECT page_id, variant, suffix, domain, subdomain FROM t""")
def psl_parts(spark, sf):
    return FE.tabular_parts(urls(spark, sf)).select(
        *KEYS, F.col("t_suffix").alias("suffix"), F.col("t_domain").alias("domain"),
        F.col("t_subdomain").alias("subdomain"),
    )


# Rules with three labels, a wildcard and its exception; .tk, .unlisted and others have no rule.
RULES = ("com", "net", "org", "vn", "com.vn", "uk", "co.uk", "io", "github.io", "ththed.example.org", "*.example.net", "!ththan.example.net",
         "*.b.c", "xyz")


def rule_suffix_ctes(hosts: str) -> str:
    """CTEs ``ruled(host, suffix)`` for the distinct hosts of a query."""
    kinds = [("wild", r[2:]) if r.startswith("*.") else ("except", r[1:]) if r.startswith("!") else ("plain", r) for r in RULES]
    values = ", ".join(f"('{kind}', '{name}', {name.count('.') + 1})" for kind, name in kinds)
    return f"""rule(kind, tail, n) AS (VALUES {values}),
rh AS (SELECT DISTINCT host FROM ({hosts}) WHERE host <> ''),
hit AS (SELECT host, arg_max(n + CASE kind WHEN 'wild' THEN 1 WHEN 'except' THEN -1 ELSE 0 END,
               CASE kind WHEN 'except' THEN 1000 WHEN 'wild' THEN n + 1 ELSE n END) AS labels
        FROM rh JOIN rule ON (host = tail AND kind <> 'wild') OR ends_with(host, '.' || tail) GROUP BY host),
ruled AS MATERIALIZED (SELECT host, array_to_string(string_split(host, '.')[-coalesce(labels, 1):], '.') AS suffix FROM rh LEFT JOIN hit USING (host))"""


def _rule_parts_sql() -> str:
    base = tabular_ctes()
    start = base.index("t_sfx AS (")
    head, parts = base[:start], base[base.index("t_front AS ("):]
    return f"""{head}{rule_suffix_ctes('SELECT lookup AS host FROM t_host')},
t_sfx AS (SELECT t_host.*, CASE WHEN {Q.is_ip('lookup')} OR lookup = '' THEN '' ELSE r.suffix END AS suffix
          FROM t_host LEFT JOIN ruled r ON r.host = lookup),
{parts}"""


@query("psl_rules", f"""{_rule_parts_sql()}
SELECT page_id, variant, suffix, domain, subdomain FROM t""")
def psl_rules(spark, sf):
    return _rule_parts(spark, sf, suffixes.SuffixRules(RULES))


@query("psl_rule_table", f"""{_rule_parts_sql()}
SELECT page_id, variant, suffix, domain, subdomain FROM t""")
def psl_rule_table(spark, sf):
    return _rule_parts(spark, sf, suffixes.SuffixTable(inline_table(spark, ["rule"], [(r,) for r in RULES])))


def _rule_parts(spark, sf, rules):
    return FE.tabular_parts(urls(spark, sf), rules=rules).select(
        *KEYS, *(F.col(f"t_{c}").alias(c) for c in ("suffix", "domain", "subdomain")))


_SUFFIX_TABLE = ", ".join(f"({Q.lit(s)})" for s in K.ALL_SUFFIXES)


@query("suffix_lookup", f"""{WITH}, {Q.profile_ctes('p', 'urls')},
sfx(suffix) AS (VALUES {_SUFFIX_TABLE}),
hit AS (SELECT h.host, arg_max(suffix, length(suffix)) AS suffix
        FROM (SELECT DISTINCT host FROM p) h
        JOIN sfx ON h.host = sfx.suffix OR ends_with(h.host, '.' || sfx.suffix) GROUP BY h.host)
SELECT page_id, variant, p.host, hit.suffix FROM p LEFT JOIN hit ON p.host = hit.host""")
def suffix_lookup(spark, sf):
    suffixes = inline_table(spark, ["suffix"], [(s,) for s in K.ALL_SUFFIXES])
    hosts = U.with_profile_parts(urls(spark, sf)).select(*KEYS, "host")
    return lookups.longest_suffix(hosts, "host", suffixes)


@query("registered_domain", f"""{WITH}, {Q.profile_ctes('p', 'urls')},
d AS (SELECT *, {Q.profile_tld('host')} AS tld FROM p)
SELECT page_id, variant, tld, {Q.profile_domain('host', 'tld')} AS domain FROM d""")
def registered_domain(spark, sf):
    df = U.with_profile_parts(urls(spark, sf)).withColumn("tld", U.profile_tld(F.col("host")))
    return df.select(*KEYS, "tld", U.profile_domain(F.col("host"), F.col("tld")).alias("domain"))


def split_domain_ctes() -> str:
    after = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE url END"
    return f"""{WITH},
sd0 AS (SELECT *, {Q.strip(f"lower(regexp_replace(regexp_extract(regexp_extract({after}, '^[^/?#]*'), '([^@]*)$', 1), ':[^:]*$', ''))")} AS sd_host FROM urls),
sd1 AS (SELECT *, {Q.suffix_of('sd_host', K.PROFILE_SUFFIXES)} AS sd_suffix FROM sd0),
sd AS (
  SELECT page_id, variant, url, label,
         CASE WHEN sd_host = '' THEN '<unknown>' WHEN {Q.is_ip('sd_host')} THEN sd_host
              WHEN sd_suffix IS NOT NULL AND {Q.front('sd_host', 'sd_suffix')} = '' THEN sd_host
              WHEN sd_suffix IS NOT NULL
                THEN {Q.last_label(Q.front('sd_host', 'sd_suffix'))} || '.' || sd_suffix
              ELSE regexp_extract(sd_host, '([^.]*\\.)?[^.]*$') END AS domain
  FROM sd1)"""


@query("reg_domain_raw", f"{split_domain_ctes()} SELECT page_id, variant, domain FROM sd")
def reg_domain_raw(spark, sf):
    return urls(spark, sf).select(*KEYS, U.split_domain(F.col("url")).alias("domain"))


@query("vn_target", f"""{WITH}, {Q.split_cte('s', 'urls', 'url')}
SELECT page_id, variant,
       (regexp_matches(url, '{Q.VN_TLD}') OR regexp_matches(url, '{Q.brand_pattern()}')
        OR ends_with({Q.hostname('netloc')}, '.vn'))::INT AS is_vn_target
FROM s""")
def vn_target(spark, sf):
    return urls(spark, sf).select(
        *KEYS, U.is_vn_target(F.col("url")).cast("int").alias("is_vn_target")
    )


@query("encode_url", f"""{WITH}
SELECT page_id, variant, array_to_string(list_transform(range(1, {K.SEQUENCE_LENGTH + 1}),
         lambda i: CASE WHEN i > length(url) THEN {K.PAD_ID}
                        ELSE strpos({Q.lit(K.VOCAB)}, substr(url, i, 1)) + 1 END), ' ') AS ids
FROM urls""")
def encode_url(spark, sf):
    ids = T.encode(F.col("url"))
    return urls(spark, sf).select(*KEYS, F.concat_ws(" ", ids.cast("array<string>")).alias("ids"))


@query("display_url", f"""{WITH}, {Q.split_cte('s', 'urls', 'url')}
SELECT page_id, variant,
       left(CASE WHEN contains(url, '[') <> contains(url, ']') THEN url ELSE
            CASE WHEN scheme <> '' THEN scheme || '://' || netloc ELSE netloc END
            || left(path, {K.DISPLAY_PATH})
            || CASE WHEN length(path) > {K.DISPLAY_PATH} THEN '…' ELSE '' END END,
            {K.DISPLAY_TOTAL}) AS display
FROM s""")
def display_url(spark, sf):
    return urls(spark, sf).select(*KEYS, U.display_url(F.col("url")).alias("display"))


@query("url_hash", f"{WITH} SELECT page_id, variant, sha256(url) AS url_hash FROM urls")
def url_hash(spark, sf):
    return urls(spark, sf).select(*KEYS, U.url_hash(F.col("url")).alias("url_hash"))


def _private_sql(host: str) -> str:
    ranges = " OR ".join(
        "ip BETWEEN {} AND {}".format(*U.network_range(c)) for c in K.PRIVATE_NETWORKS
    )
    strict = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
    number = " + ".join(
        f"TRY_CAST(split_part({host}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5)
    )
    return f"""CASE WHEN {host} IN {Q.in_list(K.LOCALHOST_NAMES)} THEN 1
        WHEN regexp_matches({host}, '{strict}') THEN
             (SELECT ({ranges})::INT FROM (SELECT {number} AS ip))
        WHEN contains({host}, ':') AND (starts_with({host}, 'fe8') OR starts_with({host}, 'fc')
             OR starts_with({host}, 'fd') OR {host} = '::1') THEN 1 ELSE 0 END"""


@query("private_hosts", f"""{tabular_ctes()}
SELECT page_id, variant, host, {_private_sql('host')} AS is_private FROM t""")
def private_hosts(spark, sf):
    return FE.tabular_parts(urls(spark, sf)).select(
        *KEYS, F.col("t_host").alias("host"),
        U.is_private_host(F.col("t_host")).cast("int").alias("is_private"),
    )


_NETS = ", ".join("('{}', {}, {})".format(c, *U.network_range(c)) for c in K.PRIVATE_NETWORKS)


@query("network_match", f"""{tabular_ctes()}, nets(cidr, lo, hi) AS (VALUES {_NETS}),
ips AS (SELECT page_id, variant, host, split_part(host, '.', 1)::BIGINT * 16777216
          + split_part(host, '.', 2)::BIGINT * 65536 + split_part(host, '.', 3)::BIGINT * 256
          + split_part(host, '.', 4)::BIGINT AS ip
        FROM t WHERE {Q.is_ip('host')})
SELECT page_id, variant, host, cidr FROM ips JOIN nets ON ip BETWEEN lo AND hi""")
def network_match(spark, sf):
    nets = inline_table(spark, ["cidr"], [(c,) for c in K.PRIVATE_NETWORKS])
    hosts = FE.tabular_parts(urls(spark, sf)).select(*KEYS, F.col("t_host").alias("host"))
    return lookups.match_networks(hosts, "host", nets)


# --- scalar feature functions -------------------------------------------------------------

@query("url_entropy", f"{WITH} SELECT page_id, variant, round({Q.entropy('url')}, 6) AS entropy FROM urls")
def url_entropy(spark, sf):
    return urls(spark, sf).select(*KEYS, F.round(T.entropy(F.col("url")), 6).alias("entropy"))


@query("longest_runs", f"""{WITH}
SELECT page_id, variant, {Q.longest_run('url', '[0-9]')} AS digit_run,
       {Q.longest_run('url', '[b-df-hj-np-tv-z]')} AS consonant_run FROM urls""")
def longest_runs(spark, sf):
    url = F.col("url")
    return urls(spark, sf).select(
        *KEYS, T.longest_run(url, "[0-9]").alias("digit_run"),
        T.longest_run(url, "[b-df-hj-np-tv-z]").alias("consonant_run"),
    )


_DECODE = "replace(split_part(k, '=', 1), '+', ' ')"
_KEY_SQL = f"(CASE WHEN regexp_matches({_DECODE}, '%([^0-9a-fA-F]|.[^0-9a-fA-F]|.?$)') THEN {_DECODE} ELSE url_decode({_DECODE}) END)"
_KEYS_SQL = f"list_transform(list_filter(string_split(query, '&'), lambda k: k <> ''), lambda k: {_KEY_SQL})"
_N_KEYS = f"CASE WHEN query = '' THEN 0 ELSE len(list_distinct({_KEYS_SQL})) END"


@query("query_params", f"{tabular_ctes()} SELECT page_id, variant, {_N_KEYS} AS n_keys FROM t")
def query_params(spark, sf):
    q = F.col("t_query")
    return FE.tabular_parts(urls(spark, sf)).select(
        *KEYS, F.when(q == "", 0).otherwise(F.size(FE.query_keys(q))).alias("n_keys")
    )


@query("query_params_long", f"""{tabular_ctes()}
SELECT page_id, variant, split_part(k, '=', 1) AS key,
       CASE WHEN contains(k, '=') THEN substr(k, strpos(k, '=') + 1) ELSE '' END AS value
FROM (SELECT page_id, variant, unnest(string_split(query, '&')) AS k FROM t) WHERE k <> ''""")
def query_params_long(spark, sf):
    pairs = FE.tabular_parts(urls(spark, sf)).select(*KEYS, "t_query")
    return FE.query_pairs(pairs, "t_query", KEYS)


@query("path_ext", f"""{tabular_ctes()}
SELECT page_id, variant, len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS depth,
       last_seg AS last_segment,
       CASE WHEN contains(last_seg, '.') THEN {Q.last_label('last_seg')} END AS ext FROM t""")
def path_ext(spark, sf):
    return FE.tabular_parts(urls(spark, sf)).select(
        *KEYS, F.size(F.filter(F.split("t_path", "/"), lambda s: s != "")).alias("depth"),
        F.col("t_last").alias("last_segment"), F.col("t_ext").alias("ext"),
    )


_COUNTED = {"dots": ".", "hyphens": "-", "underscores": "_", "slashes": "/", "questions": "?",
            "equals": "=", "amps": "&", "ats": "@", "percents": "%"}


@query("char_counts", f"""{WITH} SELECT page_id, variant,
{', '.join(f"{Q.count_char('url', c)} AS {n}" for n, c in _COUNTED.items())} FROM urls""")
def char_counts(spark, sf):
    return urls(spark, sf).select(
        *KEYS, *(T.occurrences(F.col("url"), c).alias(n) for n, c in _COUNTED.items())
    )


@query("char_ratios", f"""{WITH} SELECT page_id, variant, {Q.digits('url')} AS n_digits,
  {Q.letters('url')} AS n_letters, round({Q.ratio(Q.digits('url'), 'length(url)')}, 6) AS digit_ratio,
  round({Q.ratio(Q.letters('url'), 'length(url)')}, 6) AS letter_ratio FROM urls""")
def char_ratios(spark, sf):
    url = F.col("url")
    return urls(spark, sf).select(
        *KEYS, T.digits(url).alias("n_digits"), T.letters(url).alias("n_letters"),
        F.round(T.ratio(T.digits(url), F.length(url)), 6).alias("digit_ratio"),
        F.round(T.ratio(T.letters(url), F.length(url)), 6).alias("letter_ratio"),
    )


# --- feature frames -----------------------------------------------------------------------

def _tabular_sql() -> dict[str, str]:
    n_url, n_host = "length(raw)", "length(host)"
    upper = Q.count_class("raw", "[A-Z]")
    ascii_letters = Q.count_class("raw", "[A-Za-z]")
    foreign = Q.count_class("raw", r"[^\x00-\x7F]")
    words = " + ".join(f"contains(path || '?' || query, {Q.lit(w)})::INT" for w in K.PHISHING_KEYWORDS)
    ext = f"(CASE WHEN contains(last_seg, '.') THEN {Q.last_label('last_seg')} END)"
    out = {
        "url_len": n_url, "host_len": n_host, "path_len": "length(path)",
        "query_len": "length(query)", "fragment_len": "length(fragment)",
        "path_depth": "len(list_filter(string_split(path, '/'), lambda s: s <> ''))",
        "num_query_params": _N_KEYS, "has_query": Q.flag("query <> ''"),
        "has_fragment": Q.flag("fragment <> ''"), "has_port": Q.flag("port IS NOT NULL"),
        "path_to_url_ratio": Q.ratio("length(path)", n_url),
        "is_bare_hostname": Q.flag("path IN ('', '/')"),
        "digit_count_url": Q.digits("low"), "digit_density_url": Q.ratio(Q.digits("low"), "length(low)"),
        "hyphen_count_url": Q.count_char("low", "-"), "dot_count_url": Q.count_char("low", "."),
        "at_count": Q.count_char("low", "@"), "pct_count": Q.count_char("low", "%"),
        "amp_count": Q.count_char("low", "&"), "eq_count": Q.count_char("low", "="),
        "qmark_count": Q.count_char("low", "?"),
        "has_double_slash_in_path": Q.flag("contains(path, '//')"),
        "mixed_case_ratio": Q.ratio(upper, ascii_letters), "has_upper": Q.flag(f"{upper} > 0"),
        "has_control_chars": Q.flag(r"regexp_matches(raw, '[\x00-\x1f\x7f]')"),
        "has_non_ascii": Q.flag(f"{foreign} > 0"), "non_ascii_ratio": Q.ratio(foreign, n_url),
        "has_punycode": Q.flag("contains(host, 'xn--')"),
        "host_digit_count": Q.digits("host"), "host_digit_density": Q.ratio(Q.digits("host"), n_host),
        "host_hyphen_count": Q.count_char("host", "-"), "host_dot_count": Q.count_char("host", "."),
        "host_num_subdomains": "len(list_filter(string_split(subdomain, '.'), lambda s: s <> ''))",
        "host_starts_with_www": Q.flag("starts_with(host, 'www.')"),
        "host_longest_digit_run": Q.longest_run("host", "[0-9]"),
        "host_longest_consonant_run": Q.longest_run("host", "[b-df-hj-np-tv-z]"),
        "host_vowel_ratio": Q.ratio(Q.count_class("host", "[aeiou]"), Q.letters("host")),
        "host_letter_count": Q.letters("host"),
        "entropy_url": Q.entropy("low"), "entropy_host": Q.entropy("host"), "entropy_path": Q.entropy("path"),
        "is_http": Q.flag("scheme = 'http'"), "is_https": Q.flag("scheme = 'https'"),
        "is_ip_host": Q.flag(r"regexp_matches(host, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$')"),
        "tld_other": Q.flag(f"suffix <> '' AND suffix NOT IN {Q.in_list(K.INDICATOR_SUFFIXES)}"),
        "tld_missing": Q.flag("suffix = ''"),
        "tld_label_count": f"CASE WHEN suffix = '' THEN 0 ELSE {Q.count_char('suffix', '.')} + 1 END",
        "tld_is_vn": Q.flag(f"suffix IN {Q.in_list(K.VN_SUFFIXES)}"),
        "tld_is_suspicious": Q.flag(f"suffix IN {Q.in_list(K.SUSPICIOUS_SUFFIXES)}"),
        "tld_is_common": Q.flag(f"suffix IN {Q.in_list(K.COMMON_SUFFIXES)}"),
        "num_phishing_keywords": f"({words})", "has_phishing_keyword": Q.flag(f"({words}) > 0"),
        "has_malware_ext": Q.flag(f"{ext} IN {Q.in_list(K.MALWARE_EXTENSIONS)}"),
        "has_cdn_ext": Q.flag(f"{ext} IN {Q.in_list(K.CDN_EXTENSIONS)}"),
        "has_any_ext": Q.flag(f"{ext} IS NOT NULL"),
    }
    for s in K.INDICATOR_SUFFIXES:
        out["tld_" + s.replace(".", "_")] = Q.flag(f"suffix = {Q.lit(s)}")
    return {n: f"round({out[n]}::DOUBLE, 6)" for n in K.TABULAR_FEATURES}


_TLD_COLUMNS = [n for n in K.TABULAR_FEATURES if n.startswith("tld_")]
_OTHER_COLUMNS = [n for n in K.TABULAR_FEATURES if not n.startswith("tld_")]


def _pick(sql: dict[str, str], names) -> str:
    return ", ".join(f"{sql[n]} AS {n}" for n in names)


@query("xgb_features", f"""{tabular_ctes()}
SELECT page_id, variant, {_pick(_tabular_sql(), _OTHER_COLUMNS)} FROM t""")
def xgb_features(spark, sf):
    return FE.tabular_features(urls(spark, sf), "url", KEYS).select(
        *KEYS, *(F.round(F.col(n).cast("double"), 6).alias(n) for n in _OTHER_COLUMNS)
    )


@query("xgb_features_tld", f"""{tabular_ctes()}
SELECT page_id, variant, {_pick(_tabular_sql(), _TLD_COLUMNS)} FROM t""")
def xgb_features_tld(spark, sf):
    return FE.tabular_features(urls(spark, sf), "url", KEYS).select(
        *KEYS, *(F.col(n).cast("double").alias(n) for n in _TLD_COLUMNS)
    )


def lexical_ctes() -> str:
    return f"""{WITH},
{Q.split_cte('l0', 'urls', "CASE WHEN contains(url, '://') THEN url ELSE 'http://' || url END", 'p_')},
l AS (SELECT page_id, variant, label, url, CASE WHEN contains(url, '://') THEN p_scheme ELSE '' END AS scheme,
             regexp_replace(lower(p_netloc), ':[0-9]+$', '') AS host,
             regexp_matches(lower(p_netloc), ':[0-9]+$') AS ported,
             p_path AS path, p_query AS query,
             list_filter(string_split(regexp_replace(lower(p_netloc), ':[0-9]+$', ''), '.'), lambda s: s <> '') AS labels
      FROM l0)"""


def lexical_sql() -> dict[str, str]:
    ip = Q.is_ip("host")
    subs = f"(CASE WHEN {ip} THEN 0 ELSE greatest(len(labels) - 2, 0) END)"
    n = "length(url)"
    return {
        "url_length": n, "host_length": "length(host)", "path_length": "length(path)",
        "query_length": "length(query)",
        "num_dots": Q.count_char("url", "."), "num_hyphens": Q.count_char("url", "-"),
        "num_underscores": Q.count_char("url", "_"), "num_slashes": Q.count_char("url", "/"),
        "num_question_marks": Q.count_char("url", "?"), "num_equals": Q.count_char("url", "="),
        "num_amps": Q.count_char("url", "&"), "num_ats": Q.count_char("url", "@"),
        "num_percents": Q.count_char("url", "%"), "num_digits": Q.digits("url"),
        "digit_ratio": Q.ratio(Q.digits("url"), n), "letter_ratio": Q.ratio(Q.letters("url"), n),
        "vowel_ratio": Q.ratio(Q.count_class("url", "[aeiouAEIOU]"), Q.letters("url")),
        "special_char_ratio": Q.ratio(f"{n} - {Q.digits('url')} - {Q.letters('url')}", n),
        "has_ip_host": Q.flag(ip), "has_port": Q.flag("ported"), "is_https": Q.flag("scheme = 'https'"),
        "num_subdomains": subs,
        "subdomain_length_max": f"coalesce(list_max(list_transform(labels[1:{subs}], lambda s: length(s))), 0)",
        "tld_is_vn": Q.flag("ends_with(host, '.vn')"),
        "tld_is_common": Q.flag(f"contains(host, '.') AND {Q.last_label('host')} IN {Q.in_list(K.LEXICAL_COMMON_SUFFIXES)}"),
        "host_entropy": Q.entropy("host"), "has_punycode": Q.flag("contains(host, 'xn--')"),
        "path_depth": Q.count_char("path", "/"),
        "has_double_slash_in_path": Q.flag("contains(path, '//')"),
        "query_param_count": f"CASE WHEN query = '' THEN 0 ELSE {Q.count_char('query', '&')} + 1 END",
    }


def _lexical_raw_cte() -> str:
    made = lexical_sql()
    return lexical_ctes() + f""",
lex AS (SELECT page_id, variant, label, {', '.join(f'({made[n]})::DOUBLE AS {n}' for n in K.LEXICAL_FEATURES)} FROM l)"""


@query("lexical_features", f"""{_lexical_raw_cte()}
SELECT page_id, variant, {', '.join(f'round({n}, 6) AS {n}' for n in K.LEXICAL_FEATURES)} FROM lex""")
def lexical_features(spark, sf):
    return FE.lexical_features(urls(spark, sf), "url", KEYS).select(
        *KEYS, *(F.round(n, 6).alias(n) for n in K.LEXICAL_FEATURES)
    )


def _lex(spark, sf):
    return FE.lexical_features(urls(spark, sf), "url", (*KEYS, "label"))


def _log(n: str) -> str:
    return f"ln(1 + {n})" if n in K.LOG_FEATURES else n


_STATS_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, {str(n in K.LOG_FEATURES).lower()} AS log1p, avg({_log(n)}) AS mean, "
    f"CASE WHEN stddev_pop({_log(n)}) < 1e-8 THEN 1.0 ELSE stddev_pop({_log(n)}) END AS std FROM train"
    for n in K.LEXICAL_FEATURES
)
# the training split: about four pages in five, by a hash of the page, with all their URLs
TRAINING = "substring(md5(CAST(page_id AS VARCHAR(20))), 1, 1) < 'd'"
STATS_CTE = f"{_lexical_raw_cte()}, train AS MATERIALIZED (SELECT * FROM lex WHERE {TRAINING}), stats AS MATERIALIZED ({_STATS_SQL})"


def training_rows(df):
    """The training split, both labels; a page's URLs stay together."""
    return df.where(TRAINING)


def held_out_rows(df):
    """The rows outside the training split."""
    return df.where(f"NOT ({TRAINING})")


@query("lexical_stats", f"""{STATS_CTE}
SELECT feature, log1p, round(mean, 6) AS mean, round(std, 6) AS std FROM stats""")
def lexical_stats(spark, sf):
    return FE.feature_stats(training_rows(_lex(spark, sf))).select(
        "feature", "log1p", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")
    )


def z_sql(n: str) -> str:
    return (f"(({_log(n)}) - (SELECT mean FROM stats WHERE feature = '{n}')) "
            f"/ (SELECT std FROM stats WHERE feature = '{n}')")


@query("lexical_normalized", f"""{STATS_CTE}
SELECT page_id, variant, {', '.join(f'round({z_sql(n)}, 4) AS {n}' for n in K.LEXICAL_FEATURES)} FROM lex""")
def lexical_normalized(spark, sf):
    lex = _lex(spark, sf)
    z = FE.normalize_features(lex, FE.feature_stats(training_rows(lex)), KEYS)
    return z.select(*KEYS, *(F.round(n, 4).alias(n) for n in K.LEXICAL_FEATURES))


@query("risk_tiers", f"""
SELECT l_orderkey, l_linenumber, l_quantity / 50 AS probability,
       CASE WHEN l_quantity / 50 * 100 <= 25 THEN 'Low Risk' WHEN l_quantity / 50 * 100 <= 50 THEN 'Caution'
            WHEN l_quantity / 50 * 100 <= 75 THEN 'Suspicious' ELSE 'High Risk' END AS risk_level,
       CASE WHEN l_quantity / 50 >= 0.5 THEN 'MAL' ELSE 'BEN' END AS verdict
FROM lineitem""")
def risk_tiers(spark, sf):
    p = F.col("l_quantity") / 50
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", p.alias("probability"),
        risk.risk_level(p).alias("risk_level"), risk.verdict(p).alias("verdict"),
    )


@query("build_vocab", f"""{WITH}, c AS (SELECT DISTINCT unnest(string_split(url, '')) AS ch FROM urls)
SELECT ch, (row_number() OVER (ORDER BY ascii(ch)) + 1)::INT AS id FROM c WHERE ch <> ''
UNION ALL SELECT '<PAD>', 0 UNION ALL SELECT '<UNK>', 1""")
def build_vocab(spark, sf):
    return FE.build_vocab(urls(spark, sf), "url")


