"""Operators over page HTML: clean-up, character n-grams, links, sitemaps, robots rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions import urls as U
from urlsieve.functions.text import strip, text
from urlsieve.operators.lookups import lookup_join
from urlsieve.session import spread_by

WS = K.WHITESPACE_CLASS


def normalize_html(html: Column, window: int | None = None) -> Column:
    """Drop white space between tags, collapse the rest, strip.

    By default the whole page is kept. A ``window`` cuts it to that many characters, as the page
    model's input is; the text is then cut to five windows first, which bounds the regex work.
    """
    source = F.coalesce(html, text(""))
    if window is not None:
        source = F.substring(source, 1, window * 5)
    tight = strip(F.regexp_replace(F.regexp_replace(source, f">{WS}+<", "><"), f"{WS}+", " "))
    return tight if window is None else F.substring(tight, 1, window)


def char_ngrams(col: Column, n: int) -> Column:
    """All overlapping n-character pieces, in order.

    One regex pass: the look-ahead captures n code points, then one is consumed.
    """
    return F.regexp_extract_all(col, text(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def all_ngrams(col: Column, sizes: Sequence[int] = K.NGRAM_SIZES) -> Column:
    return F.concat(*(char_ngrams(col, n) for n in sizes))


# Pages are cut into pieces of this many characters before their grams are listed, so that no row
# ever holds all grams of a large page; neighbouring pieces overlap by n - 1 characters.
PIECE = 1 << 14


def exploded_ngrams(
    df: DataFrame, keep: Sequence[str], content: str, sizes: Sequence[int] = K.NGRAM_SIZES
) -> DataFrame:
    """One row per gram (column ``gram``) of whole texts of any length."""
    body = F.col(content)
    last = F.floor((F.greatest(F.length(body), F.lit(1)) - 1) / PIECE).cast("int")

    def pieces(n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
            F.lit(n).alias("size"),
            F.substring(body, i * PIECE + 1, F.lit(PIECE + n - 1)).alias("piece")))

    cut = df.select(*keep, F.inline(F.concat(*map(pieces, sizes))))
    grams = F
    for n in sizes:
        grams = grams.when(F.col("size") == n, char_ngrams(F.col("piece"), n))
    return cut.select(*keep, F.explode(grams).alias("gram"))


def ngram_counts(df: DataFrame, key: str, content: str, sizes: Sequence[int] = K.NGRAM_SIZES) -> DataFrame:
    """key, gram, n per row. Rows are spread by key before they are blown up, so the many grams
    of a page are counted where they are and never cross the network."""
    spread = spread_by(df.select(key, content), key)
    return exploded_ngrams(spread, (key,), content, sizes).groupBy(key, "gram").agg(
        F.count("*").alias("n"))


def top_ngrams(df: DataFrame, content: str, top: int, sizes: Sequence[int] = K.NGRAM_SIZES) -> DataFrame:
    counts = exploded_ngrams(df, (), content, sizes).groupBy("gram").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("gram")).limit(top)


def ngram_norms(df: DataFrame, key: str, content: str, sizes: Sequence[int] = K.NGRAM_SIZES) -> DataFrame:
    """Distinct grams and Euclidean norm of the gram counts per row."""
    n = F.col("n").cast("double")
    return ngram_counts(df, key, content, sizes).groupBy(key).agg(
        F.count("*").alias("grams"), F.sqrt(F.sum(n * n)).alias("norm"))


# --- links --------------------------------------------------------------------------------

COMMENT = "(?s)<!--.*?-->"
SCRIPT = "(?is)<script\\b.*?</script>"
ANCHOR = "(?i)<a\\b[^>]*?[\\s]href[\\s]*=[\\s]*(\"[^\"]*\"|'[^']*'|[^\\s>]+)"


def unescape(col: Column) -> Column:
    """The character references that occur in attribute values."""
    for reference, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        col = F.replace(col, text(reference), text(plain))
    return col


def hrefs(html: Column) -> Column:
    """Anchor targets of a page in document order; comments and scripts do not count."""
    visible = F.regexp_replace(F.regexp_replace(html, COMMENT, ""), SCRIPT, "")
    found = F.regexp_extract_all(visible, text(ANCHOR), F.lit(1))
    return F.transform(found, lambda raw: unescape(F.btrim(raw, text("\"'"))))


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, position, src, href, dst: every anchor with its resolved, normalised target."""
    raw = pages.select(key, F.col(url).alias("src"), F.posexplode(hrefs(F.col(html))).alias("position", "href"))
    return U.with_normal_url(raw, "href", "dst", base="src")


def same_site(links: DataFrame, src: str = "src", dst: str = "dst", rules: U.Rules | None = None) -> DataFrame:
    """Links that stay on the registered site of their page."""
    known = links.where(F.col(dst).isNotNull())
    sites = U.with_site(U.with_site(known, src, "_a", rules), dst, "_b", rules)
    return sites.where("_a = _b").drop("_a", "_b")


# --- sitemaps -----------------------------------------------------------------------------

LOC = "(?i)<loc>[\\s]*([^<\\s]+)[\\s]*</loc>"


def sitemap_locs(maps: DataFrame, url: str = "sitemap_url", xml: str = "xml") -> DataFrame:
    """sitemap_url, loc, is_child: entries of sitemaps, and whether they are sitemaps themselves."""
    index = F.contains(F.lower(xml), text("<sitemapindex"))
    found = maps.select(
        F.col(url).alias("sitemap_url"), index.alias("_index"),
        F.explode(F.regexp_extract_all(F.col(xml), text(LOC), F.lit(1))).alias("_raw"),
    )
    loc = U.with_normal_url(found, "_raw", "loc")
    child = F.col("_index") | F.lower("loc").rlike("[.]xml([.]gz)?$")
    return loc.where("loc IS NOT NULL").select("sitemap_url", "loc", child.alias("is_child"))


def crawl_minus_sitemap(crawled: DataFrame, sitemap: DataFrame) -> DataFrame:
    """(host, url) pairs found by crawling that no sitemap lists."""
    return crawled.select("host", "url").subtract(sitemap.select("host", "url"))


# --- certificate names --------------------------------------------------------------------

def certificate_names(
    log: DataFrame, root: str = "root", entries: str = "entries", cap: int | None = None, rules: U.Rules | None = None,
) -> DataFrame:
    """root, name: host names below a root domain from certificate-log entries.

    Wildcards lose their prefix, names of other sites and names with odd characters are dropped.
    All names stay unless ``cap`` asks for the first ones of each root in order.
    """
    parsed = log.select(
        F.col(root).alias("root"),
        F.explode(F.from_json(entries, "array<struct<name_value: string>>")).alias("e"))
    names = parsed.select("root", F.explode(F.split(strip(F.lower("e.name_value")), "\n")).alias("n"))
    clean = names.select("root", F.ltrim(strip(F.col("n")), text("*.")).alias("name"))
    plain = clean.where(F.col("name").rlike("^[a-z0-9.-]+$"))
    sited = U.with_site_of_host(
        U.with_site_of_host(plain, F.col("root"), "_root", rules), F.col("name"), "_own", rules)
    kept = sited.where("_own = _root AND name <> _root").select("root", "name").distinct()
    return kept if cap is None else cap_per_group(kept, ["root"], ["name"], cap)


def cap_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group; each task drops the surplus before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


# --- robots rules -------------------------------------------------------------------------

def robots_rules(files: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """host, grp, agent, line_no, allow, prefix: the rules of robots files, in order.

    A group is a run of user-agent lines and the rules below it; an empty line ends it, and rules
    outside a group count for nobody.
    """
    lines = files.select(F.col(host).alias("host"), F.posexplode(F.split(body, "\r?\n")).alias("line_no", "raw"))
    bare = strip(F.regexp_replace("raw", "#.*$", ""))
    field = F.when(F.col("raw") == "", "end").otherwise(F.lower(strip(F.substring_index(bare, ":", 1))))
    value = strip(F.regexp_extract(bare, "^[^:]*:(.*)$", 1))
    rows = lines.select("host", "line_no", field.alias("field"), value.alias("value")).where(
        F.col("field").isin("user-agent", "allow", "disallow", "end"))
    # a robots file is one small document, so ordering its lines is bounded
    in_file = Window.partitionBy("host").orderBy("line_no")
    is_agent, is_end = F.col("field") == "user-agent", F.col("field") == "end"
    starts = is_end | (is_agent & ~F.coalesce(F.lag(is_agent).over(in_file), F.lit(False)))
    grouped = rows.withColumn("start", starts).withColumn(
        "grp", F.sum(F.col("start").cast("int")).over(in_file))
    agents = grouped.where(is_agent).select("host", "grp", F.lower("value").alias("agent"))
    rules = grouped.where(~is_agent & ~is_end).select(
        "host", "grp", "line_no",
        ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"),
        F.col("value").alias("prefix"))
    return agents.join(rules, ["host", "grp"]).select("host", "grp", "agent", "line_no", "allow", "prefix")


def robots_sitemaps(files: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """host, sitemap_url: the sitemaps that robots files name, in any group."""
    lines = files.select(F.col(host).alias("host"), F.explode(F.split(body, "\r?\n")).alias("raw"))
    bare = strip(F.regexp_replace("raw", "#.*$", ""))
    named = lines.where(F.lower(strip(F.substring_index(bare, ":", 1))) == "sitemap")
    return named.select("host", strip(F.regexp_extract(bare, "^[^:]*:(.*)$", 1)).alias("sitemap_url"))


def robots_filter(urls: DataFrame, rules: DataFrame, agent: str, host: str = "host", path: str = "path") -> DataFrame:
    """Add ``allowed``: the first rule of the agent's group that a path starts with decides.

    The first group that names the agent is used, else the first ``*`` group; no rule that fits, or
    no robots file, allows. The
    rules of a host are folded into one array, so a URL meets one row and is never multiplied.
    """
    name = agent.split("/")[0].lower()
    fits = F.when(F.col("agent") == "*", 1).when(F.contains(text(name), F.col("agent")), 0)
    ranked = rules.withColumn("_fit", fits).where("_fit IS NOT NULL")
    best = ranked.groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("_fit", "grp", "line_no", "allow", "prefix"))).alias("_rules"))
    dim = best.select(F.col("host").alias(host), F.filter(
        "_rules", lambda r: (r["_fit"] == F.col("_rules")[0]["_fit"])
        & (r["grp"] == F.col("_rules")[0]["grp"])).alias("_rules"))
    joined = lookup_join(urls, dim, host)
    hit = F.filter("_rules", lambda r: F.startswith(F.col(path), r["prefix"]) | (r["prefix"] == "*"))
    return joined.withColumn("allowed", F.coalesce(F.get(hit, 0)["allow"], F.lit(True))).drop("_rules")


def is_challenge(html: Column, status: Column | None = None, headers: Column | None = None) -> Column:
    """Anti-bot interstitials: by their text, or by status 403 with the mitigation header."""
    found = F.contains(html, text("Just a moment")) & F.contains(F.lower(html), text("cloudflare"))
    if status is not None and headers is not None:
        names = F.transform(F.map_keys(headers), F.lower)
        found = found | ((status == 403) & F.array_contains(names, "cf-mitigated"))
    return F.coalesce(found, F.lit(False))
