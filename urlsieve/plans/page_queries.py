"""Page and crawl queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions import urls as U
from urlsieve.functions.suffixes import SuffixRules
from urlsieve.operators import crawl as C
from urlsieve.operators import pages as P
from urlsieve.plans import sqlkit as Q
from urlsieve.plans.registry import query
from urlsieve.plans.tables import BAD_HOST, TEXT_PAGES, pages_table, table
from urlsieve.plans.url_queries import RULES, rule_suffix_ctes
from urlsieve.session import spread

WSC = K.WHITESPACE_CLASS


def clean_sql(html: str) -> str:
    return Q.strip(f"regexp_replace(regexp_replace(coalesce({html}, ''), '>{WSC}+<', '><', 'g'), '{WSC}+', ' ', 'g')")


def _clean(spark, sf):
    return spread(table(spark, sf, "pages").select("page_id", "html"), TEXT_PAGES).select("page_id", P.normalize_html(F.col("html")).alias("h"))


@query("html_scan", f"""SELECT page_id, html, CASE WHEN regexp_matches(regexp_extract(url, '://([^/?#]*)', 1), '{BAD_HOST}') THEN 'phish' ELSE 'benign' END AS label FROM pages""")
def html_scan(spark, sf):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", "html", F.when(host.rlike(BAD_HOST), "phish").otherwise("benign").alias("label"))


@query("normalize_html", f"SELECT page_id, {clean_sql('html')} AS h FROM pages")
def normalize_html(spark, sf):
    return _clean(spark, sf)


@query("normalize_html_window", f"SELECT page_id, left({clean_sql(f'left(html, {5 * K.HTML_WINDOW})')}, {K.HTML_WINDOW}) AS h FROM pages")
def normalize_html_window(spark, sf):
    """The page model's input: the clean page up to its fixed window."""
    return table(spark, sf, "pages").select("page_id", P.normalize_html(F.col("html"), K.HTML_WINDOW).alias("h"))


GRAMS = f"""WITH c AS MATERIALIZED (SELECT page_id, {clean_sql('html')} AS h FROM pages),
g AS (SELECT page_id, unnest(list_transform(range(1, length(h) - 1), lambda i: h[i:i+2])) AS gram FROM c
      UNION ALL SELECT page_id, unnest(list_transform(range(1, length(h) - 2), lambda i: h[i:i+3])) FROM c)"""


@query("html_char_ngrams", f"{GRAMS}, n AS (SELECT page_id, gram, count(*) AS n FROM g GROUP BY ALL) SELECT page_id, count(*) AS grams, sum(n)::BIGINT AS total, max(n) AS most FROM n GROUP BY page_id")
def html_char_ngrams(spark, sf):
    return P.ngram_counts(_clean(spark, sf), "page_id", "h").groupBy("page_id").agg(
        F.count("*").alias("grams"), F.sum("n").alias("total"), F.max("n").alias("most"))


@query("html_top_ngrams", f"{GRAMS} SELECT gram, count(*) AS n FROM g GROUP BY gram ORDER BY n DESC, gram LIMIT 100")
def html_top_ngrams(spark, sf):
    return P.top_ngrams(_clean(spark, sf), "h", 100)


@query("html_l2_norms", f"{GRAMS}, n AS (SELECT page_id, gram, count(*)::DOUBLE AS n FROM g GROUP BY ALL) SELECT page_id, count(*) AS grams, round(sqrt(sum(n * n)), 6) AS norm FROM n GROUP BY page_id")
def html_l2_norms(spark, sf):
    return P.ngram_norms(_clean(spark, sf), "page_id", "h").withColumn("norm", F.round("norm", 6))


_CHALLENGE = "'<p>Just a moment... ' || CASE WHEN page_id % 3 = 0 THEN 'CloudFlare' ELSE 'x' END || '</p>'"
_HTML = f"CASE WHEN page_id % 4 = 0 THEN html || {_CHALLENGE} ELSE html END"


@query("challenge_pages", f"""SELECT page_id, ((contains({_HTML}, 'Just a moment') AND contains(lower({_HTML}), 'cloudflare'))
  OR (page_id % 11 = 0 AND page_id % 2 = 0))::INT AS challenged FROM pages""")
def challenge_pages(spark, sf):
    pages = table(spark, sf, "pages").selectExpr(
        "page_id", f"{_HTML} AS html", "CASE WHEN page_id % 11 = 0 THEN 403 ELSE 200 END AS status",
        "CASE WHEN page_id % 2 = 0 THEN map('CF-Mitigated', 'challenge') ELSE map('server', 'x') END AS headers")
    return pages.select("page_id", P.is_challenge(F.col("html"), F.col("status"), F.col("headers")).cast("int").alias("challenged"))


# --- links --------------------------------------------------------------------------------

ANCHOR = r"(?i)<a\b[^>]*?[\s]href[\s]*=[\s]*(\"[^\"]*\"|''[^'']*''|[^\s>]+)".replace(r'\"', '"')


def _unescape(x: str) -> str:
    for ref, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{ref}', '{plain}')"
    return x


_VISIBLE = r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script>', '', 'g')"
_TRIMMED = "trim(r, '\"''')"
HREFS = f"""hrefs AS (SELECT page_id, url AS src, list_transform(regexp_extract_all({_VISIBLE}, '{ANCHOR}', 1), lambda r: {_unescape(_TRIMMED)}) AS l FROM pages),
links0 AS (SELECT page_id, src, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS position FROM hrefs)"""


def resolved_ctes(source: str, name: str) -> str:
    """CTEs that resolve ``href`` against ``src`` and normalise the result into ``dst``."""
    squeeze = "regexp_replace(regexp_extract(b_path, '^(.*)/[^/]*$', 1) || '/' || h_path, '/{2,}', '/', 'g')"
    base_query = "CASE WHEN b_query <> '' THEN '?' || b_query ELSE '' END"
    own_query = "CASE WHEN h_query <> '' THEN '?' || h_query ELSE '' END"
    root = "b_scheme || '://' || b_netloc"
    # the walk keeps a path as text: each segment appends to it or drops its last piece
    walk = ("list_reduce(list_prepend('', string_split(full_path, '/')[2:]), lambda acc, seg: CASE WHEN seg = '.' THEN acc "
            "WHEN seg = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || seg END)")
    open_end = "CASE WHEN regexp_matches(full_path, '/[.]{1,2}$') THEN '/' ELSE '' END"
    return f"""{Q.split_cte(name + '_h', source, 'href', 'h_')},
{Q.split_cte(name + '_b', name + '_h', 'src', 'b_')},
{name}_p AS (SELECT *, CASE WHEN starts_with(h_path, '/') THEN h_path ELSE {squeeze} END AS full_path FROM {name}_b),
{name}_a AS (SELECT * EXCLUDE (full_path), CASE
   WHEN {Q.strip('href')} = '' THEN src
   WHEN h_scheme <> '' AND h_scheme <> b_scheme THEN href
   WHEN h_netloc <> '' THEN b_scheme || '://' || h_netloc || h_path || {own_query}
   WHEN h_path = '' AND h_query <> '' THEN {root} || b_path || '?' || h_query
   WHEN h_path = '' THEN {root} || b_path || {base_query}
   ELSE {root} || CASE WHEN {walk} || {open_end} = '' THEN '/' ELSE {walk} || {open_end} END || {own_query} END AS absolute FROM {name}_p),
{normal_ctes(name + '_a', name, 'absolute', 'dst', "coalesce(href, '') <> ''")}"""


def normal_ctes(source: str, name: str, url: str, out: str, keep: str = "true") -> str:
    return f"""{Q.split_cte(name + '_n', source, Q.strip(url), 'n_')},
{name} AS MATERIALIZED (SELECT * EXCLUDE (n_scheme, n_netloc, n_path, n_query, n_fragment), CASE
   WHEN {keep} AND n_scheme IN ('http', 'https') AND {Q.hostname('n_netloc')} <> '' AND NOT {Q.bad_port('n_netloc')} THEN
     n_scheme || '://' || {Q.hostname('n_netloc')} || CASE WHEN {Q.port('n_netloc')} > 0 THEN ':' || {Q.port('n_netloc')} ELSE '' END
     || CASE WHEN regexp_replace(n_path, ';$', '') = '' THEN '/' ELSE regexp_replace(n_path, ';$', '') END
     || CASE WHEN n_query <> '' THEN '?' || n_query ELSE '' END END AS {out} FROM {name}_n)"""


@query("page_links", f"""WITH {HREFS}, {resolved_ctes('links0', 'links')} SELECT page_id, position, src, href, dst FROM links""")
def page_links(spark, sf):
    return P.page_links(pages_table(spark, sf))


# Link forms that the pages' own anchors do not have, made from each anchor.
FORMS = ("href", "'//CDN.Example.org:0' || href", "'?p=' || position", "'#top'", "'rel/' || position || '.html'", "'../up' || href",
         "'./a/./b/../c' || href || '/..'", "'mailto:x@y.z'", "'HTTP://U:P@Host.Example.COM:8080' || href || ';v=1?q=1#f'", "''",
         "'https://h.example.com:99999' || href", "'../../../../x'", "src || '/deep//er;'", "'  /padded' || href || ' '")
_FORMS_SQL = ", ".join(FORMS)


@query("normalize_url", f"""WITH {HREFS},
forms AS (SELECT page_id, position, src, unnest([{_FORMS_SQL}]) AS href, unnest(range({len(FORMS)}))::INT AS form FROM links0),
{resolved_ctes('forms', 'links')} SELECT page_id, position, form, href, dst FROM links""")
def normalize_url(spark, sf):
    raw = table(spark, sf, "pages").select("page_id", F.col("url").alias("src"), F.posexplode(P.hrefs(F.col("html"))).alias("position", "href"))
    forms = raw.select("page_id", "position", "src", F.posexplode(F.array(*map(F.expr, FORMS))).alias("form", "href"))
    return U.with_normal_url(forms, "href", "dst", base="src").select("page_id", "position", "form", "href", "dst")


def site_sql(url: str) -> str:
    # every host that occurs in links is below a one-label suffix
    return f"regexp_extract(regexp_extract({url}, '^[a-z]+://([^/:?#]*)', 1), '[^.]+[.][^.]+$')"


@query("same_site_links", f"""WITH {HREFS}, {resolved_ctes('links0', 'links')}
SELECT page_id, position, dst FROM links WHERE dst IS NOT NULL AND {site_sql('src')} = {site_sql('dst')}""")
def same_site_links(spark, sf):
    return P.same_site(P.page_links(pages_table(spark, sf))).select("page_id", "position", "dst")


def ruled_ctes(hosts: str) -> str:
    """CTE ``sites(host, site)`` under the test rules."""
    front = Q.front("host", "suffix")
    return f"""{rule_suffix_ctes(hosts)},
sites AS MATERIALIZED (SELECT host, CASE WHEN suffix = host THEN host ELSE {Q.last_label(front)} || '.' || suffix END AS site FROM ruled)"""


_HOST_OF = "regexp_extract({}, '^[a-z]+://([^/:?#]*)', 1)"


@query("same_site_rules", f"""WITH {HREFS}, {resolved_ctes('links0', 'links')},
k AS MATERIALIZED (SELECT page_id, position, dst, {_HOST_OF.format('src')} AS a, {_HOST_OF.format('dst')} AS b FROM links WHERE dst IS NOT NULL),
{ruled_ctes('SELECT a AS host FROM k UNION SELECT b FROM k')}
SELECT page_id, position, dst FROM k JOIN sites x ON x.host = a JOIN sites y ON y.host = b WHERE x.site = y.site""")
def same_site_rules(spark, sf):
    return P.same_site(P.page_links(pages_table(spark, sf)), rules=SuffixRules(RULES)).select("page_id", "position", "dst")


# A link graph with depth: host roots link to their pages, pages to their anchors and to the page
# with the next number.
GRAPH = f"""WITH RECURSIVE {HREFS}, {resolved_ctes('links0', 'links')}, {normal_ctes('pages', 'np', 'url', 'norm')},
edges AS MATERIALIZED (SELECT DISTINCT * FROM (
  SELECT n.norm AS src, l.dst FROM links l JOIN np n USING (page_id)
  UNION ALL SELECT regexp_extract(norm, '^[a-z]+://[^/]*') || '/', norm FROM np
  UNION ALL SELECT a.norm, b.norm FROM np a JOIN np b ON b.page_id = a.page_id + 1) WHERE dst IS NOT NULL AND src <> dst),
seeds AS MATERIALIZED (SELECT DISTINCT regexp_extract(norm, '^[a-z]+://[^/]*') || '/' AS seed FROM np)"""


def graph(spark, sf):
    pages = table(spark, sf, "pages")
    norm = U.with_normal_url(pages.select("page_id", "url"), "url", "norm").select("page_id", "norm")
    root = F.concat(F.regexp_extract("norm", "^[a-z]+://[^/]*", 0), F.lit("/"))
    anchors = P.page_links(spread(pages)).join(norm, "page_id").select(F.col("norm").alias("src"), "dst")
    tops = norm.select(root.alias("src"), F.col("norm").alias("dst"))
    after = norm.select((F.col("page_id") - 1).alias("page_id"), F.col("norm").alias("dst"))
    chain = norm.join(after, "page_id").select(F.col("norm").alias("src"), "dst")
    seeds = norm.select(root.alias("seed"), root.alias("url")).distinct()
    return anchors.unionByName(tops).unionByName(chain), seeds


@query("link_reach", f"""{GRAPH},
walk AS (SELECT seed, seed AS url, 0 AS depth FROM seeds
  UNION SELECT w.seed, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.url
  WHERE w.depth < {K.MAX_LINK_DEPTH} AND {site_sql('e.dst')} = {site_sql('w.seed')})
SELECT seed, url, min(depth) AS depth FROM walk GROUP BY seed, url""")
def link_reach(spark, sf):
    edges, seeds = graph(spark, sf)
    return C.reach(edges, seeds, K.MAX_LINK_DEPTH)


@query("link_reach_rules", f"""{GRAPH},
{ruled_ctes(f"SELECT {_HOST_OF.format('dst')} AS host FROM edges UNION SELECT {_HOST_OF.format('seed')} FROM seeds")},
sited AS MATERIALIZED (SELECT src, dst, site FROM edges JOIN sites ON sites.host = {_HOST_OF.format('dst')}),
walk AS (SELECT seed, seed AS url, 0 AS depth, site AS own FROM seeds JOIN sites ON sites.host = {_HOST_OF.format('seed')}
  UNION SELECT w.seed, e.dst, w.depth + 1, w.own FROM walk w JOIN sited e ON e.src = w.url AND e.site = w.own WHERE w.depth < {K.MAX_LINK_DEPTH})
SELECT seed, url, min(depth) AS depth FROM walk GROUP BY seed, url""")
def link_reach_rules(spark, sf):
    edges, seeds = graph(spark, sf)
    return C.reach(edges, seeds, K.MAX_LINK_DEPTH, rules=SuffixRules(RULES))


# --- sitemaps -----------------------------------------------------------------------------

# Every page becomes a sitemap document: an index of the next ones when its number ends in 0 or 5,
# else a list of its anchors.
_HOSTROOT = "regexp_extract(url, '^[a-z]+://[^/?#]*')"
MAPS = f"""maps AS MATERIALIZED (SELECT page_id, 'https://sitemaps.example.org/' || page_id || '.xml' AS sitemap_url, CASE WHEN page_id % 5 = 0 THEN
  '<?xml version="1.0"?><SitemapIndex><sitemap><loc> https://sitemaps.example.org/' || (page_id + 1) || '.xml </loc></sitemap><loc>https://sitemaps.example.org/' || (page_id + 5)
  || '.xml</loc><loc>https://sitemaps.example.org/' || (page_id * 2 + 5) || '.xml</loc></SitemapIndex>'
  ELSE '<urlset>' || array_to_string(list_transform(l, lambda h: '<url><loc>' || {_HOSTROOT.replace('url', 'src')} || replace(h, ' ', '') || '</loc></url>'), '')
  || '<loc>https://x.example.org/more-' || page_id || '.XML.gz</loc></urlset>' END AS xml FROM hrefs)"""
LOCS = f"""{MAPS}, raw_locs AS (SELECT sitemap_url, contains(lower(xml), '<sitemapindex') AS is_index, unnest(regexp_extract_all(xml, '(?i)<loc>[\\s]*([^<\\s]+)[\\s]*</loc>', 1)) AS raw FROM maps),
{normal_ctes('raw_locs', 'locs0', 'raw', 'loc')},
locs AS MATERIALIZED (SELECT sitemap_url, loc, is_index OR regexp_matches(lower(loc), '[.]xml([.]gz)?$') AS is_child FROM locs0 WHERE loc IS NOT NULL)"""


def maps(spark, sf):
    pages = table(spark, sf, "pages")
    i = F.col("page_id")
    base = F.lit("https://sitemaps.example.org/")
    address = lambda n: F.concat(base, n.cast("string"), F.lit(".xml"))
    index = F.concat(F.lit('<?xml version="1.0"?><SitemapIndex><sitemap><loc> '), address(i + 1), F.lit(" </loc></sitemap><loc>"),
                     address(i + 5), F.lit("</loc><loc>"), address(i * 2 + 5), F.lit("</loc></SitemapIndex>"))
    root = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)
    entries = F.transform(P.hrefs(F.col("html")), lambda h: F.concat(F.lit("<url><loc>"), root, F.replace(h, F.lit(" "), F.lit("")), F.lit("</loc></url>")))
    leaf = F.concat(F.lit("<urlset>"), F.array_join(entries, ""), F.lit("<loc>https://x.example.org/more-"), i.cast("string"), F.lit(".XML.gz</loc></urlset>"))
    return pages.select("page_id", "url", address(i).alias("sitemap_url"), F.when(i % 5 == 0, index).otherwise(leaf).alias("xml"))


@query("sitemap_locs", f"WITH {HREFS}, {LOCS} SELECT sitemap_url, loc, is_child FROM locs")
def sitemap_locs(spark, sf):
    return P.sitemap_locs(maps(spark, sf))


@query("sitemap_tree", f"""WITH RECURSIVE {HREFS}, {LOCS},
kids AS (SELECT DISTINCT sitemap_url AS src, loc AS dst FROM locs WHERE is_child AND loc <> sitemap_url),
tree AS (SELECT 'https://sitemaps.example.org/' || page_id || '.xml' AS seed, 'https://sitemaps.example.org/' || page_id || '.xml' AS url, 0 AS depth FROM pages WHERE page_id % 50 = 0
  UNION SELECT t.seed, k.dst, t.depth + 1 FROM tree t JOIN kids k ON k.src = t.url),
best AS (SELECT seed, url, min(depth) AS depth FROM tree GROUP BY ALL)
SELECT seed, url AS sitemap_url, depth FROM best WHERE url IN (SELECT sitemap_url FROM maps)""")
def sitemap_tree(spark, sf):
    documents = maps(spark, sf)
    kids = P.sitemap_locs(documents).where("is_child").select(F.col("sitemap_url").alias("src"), F.col("loc").alias("dst"))
    roots = documents.where("page_id % 50 = 0").select(F.col("sitemap_url").alias("seed"), F.col("sitemap_url").alias("url"))
    return C.sitemap_tree(documents, roots, kids)


# crawl rows: entries of leaf sitemaps, and anchors found on the pages of a host
CRAWL = f"""{LOCS}, {resolved_ctes('links0', 'links')},
crawl AS MATERIALIZED (
  SELECT {site_sql('loc')} AS seed, regexp_extract(loc, '://([^/]*)', 1) AS host, loc AS url, 'sitemap' AS source FROM locs WHERE NOT is_child
  UNION ALL SELECT {site_sql('dst')}, regexp_extract(dst, '://([^/]*)', 1), dst, 'crawl' FROM links WHERE dst IS NOT NULL)"""


def crawl_rows(spark, sf):
    host = F.regexp_extract("url", "://([^/]*)", 1)
    listed = P.sitemap_locs(maps(spark, sf)).where("NOT is_child").select(F.col("loc").alias("url"), F.lit("sitemap").alias("source"))
    found = P.page_links(pages_table(spark, sf)).where("dst IS NOT NULL").select(F.col("dst").alias("url"), F.lit("crawl").alias("source"))
    return U.with_site(listed.unionByName(found), "url", "seed").select("seed", host.alias("host"), "url", "source")


@query("crawl_minus_sitemap", f"""WITH {HREFS}, {CRAWL} SELECT host, url FROM crawl WHERE source = 'crawl'
EXCEPT SELECT host, url FROM crawl WHERE source = 'sitemap'""")
def crawl_minus_sitemap(spark, sf):
    rows = crawl_rows(spark, sf)
    return P.crawl_minus_sitemap(rows.where("source = 'crawl'"), rows.where("source = 'sitemap'"))


@query("seed_summary", f"""WITH {HREFS}, {CRAWL},
u AS (SELECT seed, host, url, bool_or(source = 'sitemap') AS listed FROM crawl GROUP BY ALL),
o AS (SELECT url, min(seed) AS seed FROM crawl GROUP BY url)
SELECT seed, count(DISTINCT host) AS hosts_processed, count(*) FILTER (listed) AS sitemap_urls, count(*) FILTER (NOT listed) AS crawl_urls,
       (SELECT count(*) FROM o WHERE o.seed = u.seed) AS new_urls_written FROM u GROUP BY seed""")
def seed_summary(spark, sf):
    return C.seed_summary(crawl_rows(spark, sf))


@query("crawl_fallback", f"""WITH {HREFS}, {CRAWL}, n AS (SELECT host, count(DISTINCT url) FILTER (source = 'sitemap') AS sitemap_urls FROM crawl GROUP BY host)
SELECT host, sitemap_urls FROM n WHERE sitemap_urls < 100""")
def crawl_fallback(spark, sf):
    rows = crawl_rows(spark, sf)
    return C.needs_crawl(rows, rows.where("source = 'sitemap'"), 100)


@query("cap_per_host", f"""WITH {HREFS}, {CRAWL}, d AS (SELECT DISTINCT host, url FROM crawl),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url) AS k FROM d) SELECT host, url FROM r WHERE k <= {K.MAX_SUBDOMAINS}""")
def cap_per_host(spark, sf):
    return P.cap_per_group(crawl_rows(spark, sf).select("host", "url").distinct(), ["host"], ["url"], K.MAX_SUBDOMAINS)


# --- certificates and robots --------------------------------------------------------------

_LOG = ("'[{\"name_value\": \"*.' || h || '\\\\n' || upper(h) || '\\\\nwww' || page_id || '.' || h || '\"}, {\"name_value\": \"bad_name.' || h || '\\\\nother.test\"}, {\"name_value\": null}]'")


@query("ct_subdomains", f"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages),
n AS (SELECT regexp_extract(h, '[^.]+[.][^.]+$') AS root, unnest([h, 'www' || page_id || '.' || h]) AS name FROM p),
d AS (SELECT DISTINCT root, name FROM n WHERE name <> root)
SELECT root, name FROM d""")
def ct_subdomains(spark, sf):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    pages = table(spark, sf, "pages").select("page_id", host.alias("h"))
    entry = F.concat(
        F.lit('[{"name_value": "*.'), "h", F.lit("\\n"), F.upper("h"), F.lit("\\nwww"), F.col("page_id").cast("string"), F.lit("."), "h",
        F.lit('"}, {"name_value": "bad_name.'), "h", F.lit('\\nother.test"}, {"name_value": null}]'))
    sited = U.with_site_of_host(pages, F.col("h"), "root")
    return P.certificate_names(sited.select("root", entry.alias("entries")))


@query("ct_names_rules", f"""WITH n AS MATERIALIZED (SELECT h, unnest([h, 'www' || page_id || '.' || h]) AS name
  FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages)),
{ruled_ctes('SELECT h AS host FROM n UNION SELECT name FROM n')}
SELECT DISTINCT x.site AS root, name FROM n JOIN sites x ON x.host = h JOIN sites y ON y.host = name WHERE x.site = y.site AND name <> x.site""")
def ct_names_rules(spark, sf):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    rules = SuffixRules(RULES)
    pages = table(spark, sf, "pages").select("page_id", host.alias("h"))
    entry = F.concat(
        F.lit('[{"name_value": "*.'), "h", F.lit("\\n"), F.upper("h"), F.lit("\\nwww"), F.col("page_id").cast("string"), F.lit("."), "h",
        F.lit('"}, {"name_value": "bad_name.'), "h", F.lit('\\nother.test"}, {"name_value": null}]'))
    sited = U.with_site_of_host(pages, F.col("h"), "root", rules)
    return P.certificate_names(sited.select("root", entry.alias("entries")), rules=rules)


AGENT = "ResearchBot/0.1"
_ROBOTS = ("'User-agent: *' || chr(10) || 'Disallow: /en/' || substr(h, length(h), 1) || chr(10) || 'Allow: /' || chr(10) || chr(10) "
           "|| CASE WHEN length(h) % 2 = 0 THEN 'User-Agent: other' || chr(10) || 'user-agent: researchbot # us' || chr(10) || 'Allow: /en/1' || chr(10) || 'Disallow: /en' || chr(10) || 'Disallow: /d' ELSE 'Disallow:' END")


@query("robots_filter", """WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS h, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS path FROM pages)
SELECT page_id, h AS host, path, CASE WHEN length(h) % 5 = 0 THEN true
  WHEN length(h) % 2 = 0 THEN starts_with(path, '/en/1') OR NOT (starts_with(path, '/en') OR starts_with(path, '/d'))
  ELSE NOT starts_with(path, '/en/' || substr(h, length(h), 1)) END AS allowed FROM p""")
def robots_filter(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/?#]*([^#]*)", 1).alias("path"))
    files = pages.select(F.col("host").alias("h")).distinct().where("length(h) % 5 <> 0").selectExpr("h AS host", f"{_ROBOTS} AS body")
    return P.robots_filter(pages, P.robots_rules(files), AGENT)


_NAMED = "'User-agent: *' || chr(10) || ' SiteMap:  https://' || h || '/map-' || page_id || '.xml # main' || chr(10) || 'Disallow: /x'"


@query("robots_sitemaps", """SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host,
  'https://' || regexp_extract(url, '://([^/?#]*)', 1) || '/map-' || page_id || '.xml' AS sitemap_url FROM pages""")
def robots_sitemaps(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("h"))
    return P.robots_sitemaps(pages.selectExpr("h AS host", f"{_NAMED} AS body"))


_ARRIVE = "epoch(date_trunc('hour', ts))"


@query("polite_schedule", f"""WITH r AS (SELECT event_id, user_id, {_ARRIVE}::DOUBLE AS arrival FROM events),
k AS (SELECT *, row_number() OVER w AS k FROM r WINDOW w AS (PARTITION BY user_id ORDER BY arrival, event_id)),
s AS (SELECT *, k * 1200.0::DOUBLE + max(arrival - k * 1200.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS start FROM k)
SELECT event_id, user_id, arrival, start, start - arrival AS wait FROM s""")
def polite_schedule(spark, sf):
    requests = table(spark, sf, "events").select("event_id", "user_id", F.date_trunc("hour", "ts").cast("double").alias("arrival"))
    return C.polite_schedule(requests, "event_id", "user_id", gap=1200.0)
