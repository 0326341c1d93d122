"""The URL functions as SQL functions of a session, written in SQL so that they inline."""

from __future__ import annotations

from pyspark.sql import SparkSession

from urlsieve import constants as K
from urlsieve.functions.urls import CONTROLS, IPV4, VN_TLD_PATTERN, brand_pattern


def _quoted(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _raw(pattern: str) -> str:
    return 'r"' + pattern + '"'


def _escaped(characters: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in characters) + "'"


_SINGLE = _quoted(s for s in K.PROFILE_SUFFIXES if "." not in s)
_DOUBLE = _quoted(s for s in K.PROFILE_SUFFIXES if "." in s)

SCALARS = {
    "url_netloc": ("u STRING", "STRING", rf"""regexp_extract(trim(LEADING {_escaped(CONTROLS)} FROM translate(
        CASE WHEN contains(u, '://') THEN btrim(u, {_escaped(K.WHITESPACE)})
             ELSE concat('http://', btrim(u, {_escaped(K.WHITESPACE)})) END, {_escaped(chr(9) + chr(13) + chr(10))}, '')),
        {_raw('(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?')}, 1)"""),
    "url_host": ("u STRING", "STRING", rf"""CASE WHEN contains(url_netloc(u), '[') <> contains(url_netloc(u), ']') THEN ''
        ELSE regexp_replace(lower(url_netloc(u)), {_raw(':[0-9]+$')}, '') END"""),
    "host_tld": ("h STRING", "STRING", rf"""CASE WHEN h = '' THEN '<none>' WHEN h RLIKE {_raw(IPV4)} THEN '<ip>'
        WHEN regexp_extract(h, {_raw('[.]([^.]*[.][^.]*)$')}, 1) IN {_DOUBLE} THEN regexp_extract(h, {_raw('[.][^.]*[.][^.]*$')}, 0)
        WHEN regexp_extract(h, {_raw('[.]([^.]*)$')}, 1) IN {_SINGLE} THEN regexp_extract(h, {_raw('[.][^.]*$')}, 0)
        WHEN contains(h, '.') THEN regexp_extract(h, {_raw('[.][^.]*$')}, 0) ELSE '<none>' END"""),
    "host_domain": ("h STRING", "STRING", """CASE WHEN h = '' THEN '<none>'
        WHEN host_tld(h) IN ('<none>', '<ip>') OR length(h) = length(host_tld(h)) THEN h
        ELSE concat(substring_index(left(h, length(h) - length(host_tld(h))), '.', -1), host_tld(h)) END"""),
    "url_tld": ("u STRING", "STRING", "host_tld(url_host(u))"),
    "url_reg_domain": ("u STRING", "STRING", "host_domain(url_host(u))"),
    "url_entropy": ("u STRING", "DOUBLE", """CASE WHEN u = '' THEN 0D ELSE log2(length(u)) - aggregate(
        regexp_extract_all(array_join(sort_array(split(u, '')), ''), r"(?s)(.)\\1*", 0), 0D,
        (acc, run) -> acc + length(run) * log2(length(run))) / length(u) END""".replace("\\\\1", "\\1")),
    "url_is_vn": ("u STRING", "BOOLEAN", f"""u RLIKE {_raw(VN_TLD_PATTERN)} OR u RLIKE {_raw(brand_pattern())}
        OR endswith(url_host(u), '.vn')"""),
    "url_risk": ("p DOUBLE", "STRING", "CASE " + " ".join(
        f"WHEN p * 100 <= {bound} THEN '{name}'" if bound is not None else f"ELSE '{name}' END"
        for bound, name in K.RISK_TIERS)),
}
TABLES = {
    "url_query_params": ("u STRING", "key STRING, value STRING", """SELECT split_part(piece, '=', 1) AS key,
        substring(piece, length(split_part(piece, '=', 1)) + 2) AS value
        FROM explode(split(regexp_extract(u, r"[?]([^#]*)", 1), '&')) AS t(piece) WHERE piece <> ''"""),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the temporary functions; returns their names."""
    for name, (arguments, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    for name, (arguments, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {body}")
    return [*SCALARS, *TABLES]
