"""Line parsers for threat feeds, and the pipeline from many sources to one URL table.

Every parser takes a frame with a ``value`` text column (a line, or a whole document for JSON) and
returns a frame with one ``url`` column, so a feed can come from files, a table or a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.functions import urls as U
from urlsieve.functions.text import percent, strip, text

Parser = Callable[[DataFrame], DataFrame]


def _present(df: DataFrame, url: Column) -> DataFrame:
    # the fence keeps the filter from repeating the whole parser in each of its conditions
    parsed = U.fenced(df.select(url.alias("parsed")), {"url": F.col("parsed")}).select("url")
    return parsed.where(F.col("url").isNotNull() & (F.col("url") != ""))


def txt_lines(lines: DataFrame) -> DataFrame:
    """One URL per line; blank and ``#`` lines are dropped, nothing else is checked."""
    line = strip(F.col("value"))
    return _present(lines, F.when(~line.startswith("#"), line))


def domain_list(lines: DataFrame) -> DataFrame:
    """Domain or hosts-file lines; the last word, when it has a dot, becomes ``https://word/``."""
    line = strip(F.col("value"))
    word = U.last_word(line)
    keep = ~line.startswith("#") & ~line.startswith("!") & F.contains(word, text("."))
    return _present(lines, F.when(keep, F.concat(text("https://"), word, text("/"))))


def strict_domain_list(lines: DataFrame) -> DataFrame:
    """Like ``domain_list``, but lower-cased and only for plain public domain names."""
    return _present(lines, U.wrap_domain(F.col("value")))


def url_lines(lines: DataFrame) -> DataFrame:
    """Lines that are http(s) URLs once white space and quotes are stripped."""
    return _present(lines, U.norm_url(F.col("value")))


def _csv_fields(lines: DataFrame, width: int) -> DataFrame:
    # comment lines carry unbalanced quotes, so they go before the CSV parser sees them
    schema = ", ".join(f"c{i} string" for i in range(width))
    body = lines.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return body.select(F.from_csv("value", schema, {"quote": '"', "escape": '"'}).alias("f"))


def _http_field(field: Column) -> Column:
    bare = F.btrim(strip(field), text('"'))
    return F.when(bare.rlike("(?i)^https?://"), bare)


def comment_csv(lines: DataFrame, url_index: int = 2) -> DataFrame:
    """CSV with ``#`` comments; the URL is one column and must be http(s)."""
    return _present(_csv_fields(lines, url_index + 1), _http_field(F.col("f")[f"c{url_index}"]))


def ioc_csv(lines: DataFrame) -> DataFrame:
    """Indicator CSV: column 2 where column 3 says ``url``."""
    kind = F.lower(F.btrim(strip(F.col("f.c3")), text('"')))
    return _present(_csv_fields(lines, 4).where(kind == "url"), _http_field(F.col("f.c2")))


def header_csv(table: DataFrame) -> DataFrame:
    """A CSV read with its header: the column called ``url`` in any case, else the second one."""
    names = [c.strip().lower() for c in table.columns]
    if "url" not in names and len(names) < 2:
        return table.select(F.lit(None).cast("string").alias("url")).where("false")
    picked = table.columns[names.index("url") if "url" in names else 1]
    return _present(table, U.norm_url(F.col(f"`{picked}`")))


def json_feed(documents: DataFrame) -> DataFrame:
    """JSON arrays of objects: ``value``, or ``url`` when that is missing or empty.

    Items that are no objects, values that are no strings and documents that do not parse give
    nothing.
    """
    items = documents.select(F.explode(F.expr(
        "try_variant_get(try_parse_json(value), '$', 'array<variant>')")).alias("item"))

    def kind(path: str) -> Column:
        return F.expr(f"schema_of_variant(try_variant_get(item, '{path}', 'variant'))")

    def string(path: str) -> Column:
        return F.when(kind(path) == "STRING", F.expr(f"try_variant_get(item, '{path}', 'string')"))

    empty = (
        F.coalesce(kind("$.value") == "VOID", F.lit(True))
        | F.coalesce(F.expr("try_variant_get(item, '$.value', 'string')").isin("", "0", "false"),
                     F.lit(False))
    )
    return _present(items, strip(F.when(empty, string("$.url")).otherwise(string("$.value"))))


def nested_indicators(documents: DataFrame) -> DataFrame:
    """``results[].indicators[]`` of type URL or URI."""
    schema = "results array<struct<indicators: array<struct<type: string, indicator: string>>>>"
    pulses = documents.select(F.explode(F.from_json("value", schema)["results"]).alias("r"))
    found = pulses.select(F.inline("r.indicators")).where(F.col("type").isin("URL", "URI"))
    return _present(found, U.norm_url(F.col("indicator")))


def search_hits(documents: DataFrame) -> DataFrame:
    """``results[]``: the scanned task's URL, else the page's."""
    schema = "results array<struct<task: struct<url: string>, page: struct<url: string>>>"
    hits = documents.select(F.explode(F.from_json("value", schema)["results"]).alias("r"))
    either = F.coalesce(F.nullif(F.col("r.task.url"), text("")), F.col("r.page.url"))
    return _present(hits, U.norm_url(either))


def indicator_pages(documents: DataFrame) -> DataFrame:
    """``results[].indicator``."""
    schema = "results array<struct<indicator: string>>"
    found = documents.select(F.inline(F.from_json("value", schema)["results"]))
    return _present(found, U.norm_url(F.col("indicator")))


PARSERS: dict[str, Parser] = {
    "txt_lines": txt_lines,
    "domain_list": domain_list,
    "strict_domain_list": strict_domain_list,
    "url_lines": url_lines,
    "comment_csv": comment_csv,
    "ioc_csv": ioc_csv,
    "json_feed": json_feed,
    "nested_indicators": nested_indicators,
    "search_hits": search_hits,
    "indicator_pages": indicator_pages,
    "header_csv": header_csv,
}


@dataclass(frozen=True)
class Source:
    """A named feed: which parser reads it, and whether it runs without being asked for."""

    name: str
    kind: str
    default_on: bool = True


def active_sources(
    sources: Iterable[Source], include: Iterable[str] = (), skip: Iterable[str] = ()
) -> list[Source]:
    include, skip = set(include), set(skip)
    return [s for s in sources if s.name not in skip and (s.default_on or s.name in include)]


def union_sources(sources: Iterable[Source], frames: Mapping[str, DataFrame]) -> DataFrame:
    """url, source, priority of all sources, in the order in which sources win."""
    union = None
    for priority, source in enumerate(sources):
        urls = PARSERS[source.kind](frames[source.name]).select(
            "url", F.lit(source.name).alias("source"), F.lit(priority).alias("priority"))
        union = urls if union is None else union.unionByName(urls)
    if union is None:
        raise ValueError("no active source")
    return union


def first_wins(union: DataFrame, sources: Iterable[Source], fetched_at: Column) -> DataFrame:
    """url, source, fetched_at, is_vn_target: each URL once, for the first source that has it.

    The winner is a minimum of integers, so copies collapse before the shuffle and a URL that
    holds a third of all rows is no hot spot.
    """
    names = F.array(*(F.lit(s.name) for s in sources))
    winners = union.groupBy("url").agg(F.min("priority").alias("p"))
    return winners.select(
        "url", F.get(names, F.col("p")).alias("source"), fetched_at.alias("fetched_at"),
        U.is_vn_target(F.col("url")).cast("int").alias("is_vn_target"),
    )


def source_summary(
    union: DataFrame, registered: Iterable[Source], active: Iterable[Source]
) -> DataFrame:
    """raw, added, vn per source, sources that did not run included, and a ``TOTAL`` row.

    ``union`` and its priorities are those of ``active``; added and vn count the URLs that ``first_wins`` gives
    to a source. The feeds are read once: a URL carries how often each source has it, next to its winner.
    """
    active = list(active)
    url = union.groupBy("url").agg(F.min("priority").alias("p"), *(
        F.count_if(F.col("priority") == i).alias(f"raw{i}") for i in range(len(active))))
    url = url.withColumn("vn", U.is_vn_target(F.col("url")))
    sums = url.agg(*(column for i in range(len(active)) for column in (
        F.coalesce(F.sum(f"raw{i}"), F.lit(0)).alias(f"raw{i}"),
        F.count_if(F.col("p") == i).alias(f"added{i}"),
        F.count_if((F.col("p") == i) & F.col("vn")).alias(f"vn{i}"))))

    def total(kind: str, names: Iterable[str]) -> Column:
        parts = [F.col(f"{kind}{i}") for name in names for i, s in enumerate(active) if s.name == name]
        return sum(parts, F.lit(0).cast("bigint")).alias(kind)

    def row(source: str, status: str, names: Iterable[str]) -> Column:
        return F.struct(F.lit(source).alias("source"), F.lit(status).alias("status"),
                        *(total(kind, names) for kind in ("raw", "added", "vn")))

    registered, running = list(registered), {s.name for s in active}
    rows = [row(s.name, "OK" if s.name in running else "skipped", [s.name]) for s in registered]
    rows.append(row("TOTAL", "", [s.name for s in registered]))
    return sums.select(F.inline(F.array(*rows))).withColumn(
        "vn_pct", percent(F.col("vn"), F.col("added")))


def only_new(winners: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose URL is not stored yet. Both sides hold each URL once, so no key is hot."""
    return winners.join(stored.select("url").distinct(), "url", "left_anti")
