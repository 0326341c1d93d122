"""Small text builders for the SQL twins (ANSI SQL as DuckDB runs it)."""

from __future__ import annotations

from collections.abc import Iterable

from urlsieve import constants as K


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values: Iterable[str]) -> str:
    return "(" + ", ".join(map(lit, values)) + ")"


def array(values: Iterable[str]) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {lit(K.WHITESPACE)})"


def count_class(x: str, char_class: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '{char_class}', '', 'g')))"


def digits(x: str) -> str:
    return count_class(x, K.DIGIT_CLASS)


def letters(x: str) -> str:
    return count_class(x, r"\p{L}")


def count_char(x: str, ch: str) -> str:
    return f"(length({x}) - length(replace({x}, {lit(ch)}, '')))"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END)"


def percent(a: str, b: str) -> str:
    return f"round({ratio(f'({a}) * 100', b)}, 6)"


def flag(condition: str) -> str:
    return f"coalesce(({condition})::INT, 0)"


def entropy(x: str) -> str:
    share = f"(len(list_filter(string_split({x}, ''), lambda y: y = c))::DOUBLE / length({x}))"
    return (
        f"(CASE WHEN {x} = '' THEN 0.0::DOUBLE ELSE list_sum(list_transform("
        f"list_distinct(string_split({x}, '')), lambda c: -{share} * log2({share}))) END)"
    )


def longest_run(x: str, char_class: str) -> str:
    return (
        f"coalesce(list_max(list_transform(regexp_extract_all({x}, '{char_class}+'), "
        f"lambda r: length(r))), 0)"
    )


SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
CONTROLS = "".join(map(chr, range(1, 0x21)))
OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def split_cte(name: str, source: str, url: str, prefix: str = "") -> str:
    """CTE that adds scheme, netloc, path, query, fragment (empty when malformed) to a source."""
    names = ("scheme", "netloc", "path", "query", "fragment")
    groups = ", ".join(
        f"regexp_extract(clean_, '{SPLIT}', {i}) AS g_{n}" for i, n in enumerate(names, 1)
    )
    picks = ", ".join(
        f"CASE WHEN bad_ THEN '' ELSE {'lower(g_scheme)' if n == 'scheme' else 'g_' + n} END"
        f" AS {prefix}{n}" for n in names
    )
    drop = ", ".join(["clean_", "bad_"] + ["g_" + n for n in names])
    return f"""
{name} AS (
  SELECT * EXCLUDE ({drop}), {picks}
  FROM (SELECT *, contains(g_netloc, '[') <> contains(g_netloc, ']') AS bad_
        FROM (SELECT *, {groups}
              FROM (SELECT *, ltrim(translate({url}, chr(9) || chr(10) || chr(13), ''),
                                    {lit(CONTROLS)}) AS clean_ FROM {source}))))"""


def tail(netloc: str) -> str:
    return f"regexp_extract({netloc}, '([^@]*)$', 1)"


def hostname(netloc: str) -> str:
    t = f"lower({tail(netloc)})"
    return (
        rf"(CASE WHEN contains({t}, '[') THEN regexp_extract({t}, '\[([^\]]*)', 1) "
        rf"ELSE regexp_extract({t}, '^[^:]*') END)"
    )


def port(netloc: str) -> str:
    t = tail(netloc)
    number = (
        rf"TRY_CAST(CASE WHEN contains({t}, '[') THEN regexp_extract({t}, '\]:([0-9]{{1,9}})$', 1) "
        rf"ELSE regexp_extract({t}, '^[^:]*:([0-9]{{1,9}})$', 1) END AS INT)"
    )
    return f"(CASE WHEN {number} <= 65535 THEN {number} END)"


def bad_port(netloc: str) -> str:
    t = tail(netloc)
    given = (
        rf"(CASE WHEN contains({t}, '[') THEN regexp_extract({t}, '\]:(.+)$', 1) "
        rf"ELSE regexp_extract({t}, '^[^:]*:(.+)$', 1) END)"
    )
    return f"({given} <> '' AND {port(netloc)} IS NULL)"


def is_ip(host: str) -> str:
    return rf"regexp_matches({host}, '^{OCTET}(\.{OCTET}){{3}}$')"


def suffix_of(host: str, suffixes: Iterable[str], whole: bool = False) -> str:
    ordered = sorted(suffixes, key=lambda s: (-len(s), s))
    same = f"{host} = s OR " if whole else ""
    return f"(list_filter({array(ordered)}, lambda s: {same}ends_with({host}, '.' || s)))[1]"


def last_label(x: str) -> str:
    return f"regexp_extract({x}, '([^.]*)$', 1)"


def front(host: str, suffix: str) -> str:
    """Host without ``.suffix``."""
    return f"left({host}, greatest(length({host}) - length({suffix}) - 1, 0))"


def brand_pattern() -> str:
    left, right = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
    words = [left + w + right for w in K.VN_BRAND_WORDS]
    starts = [left + w for w in K.VN_BRAND_WORD_STARTS]
    return "(?i)" + "|".join([*K.VN_BRANDS, *words, *starts])


VN_TLD = r"(?i)\.vn([:/?#]|$)"


def profile_ctes(name: str, source: str, url: str = "url") -> str:
    """CTEs ending in ``name``: scheme, host, port, path, query, fragment as profiling reads them."""
    stripped = strip(url)
    http = f"CASE WHEN contains({stripped}, '://') THEN {stripped} ELSE 'http://' || {stripped} END"
    return split_cte(name + "_s", source, http, "p_") + f""",
{name} AS (
  SELECT * EXCLUDE (p_scheme, p_netloc, p_path, p_query, p_fragment),
         CASE WHEN contains({url}, '://') THEN p_scheme ELSE '' END AS scheme,
         regexp_replace(lower(p_netloc), ':[0-9]+$', '') AS host,
         nullif(regexp_extract(lower(p_netloc), ':([0-9]+)$', 1), '') AS port,
         p_path AS path, p_query AS query, p_fragment AS fragment
  FROM {name}_s)"""


def profile_tld(host: str) -> str:
    return (
        f"(CASE WHEN {host} = '' THEN '<none>' WHEN {is_ip(host)} THEN '<ip>' "
        f"WHEN {suffix_of(host, K.PROFILE_SUFFIXES)} IS NOT NULL "
        f"THEN '.' || {suffix_of(host, K.PROFILE_SUFFIXES)} "
        f"WHEN contains({host}, '.') THEN '.' || {last_label(host)} ELSE '<none>' END)"
    )


def profile_domain(host: str, tld: str) -> str:
    bare = f"substr({tld}, 2)"
    rest = front(host, bare)
    return (
        f"(CASE WHEN {host} = '' THEN '<none>' WHEN {tld} IN ('<none>', '<ip>') THEN {host} "
        f"WHEN {rest} = '' THEN {host} ELSE {last_label(rest)} || '.' || {bare} END)"
    )
