"""HTML main text by template deduction from equivalence classes of tokens.

A page's tokens are its element paths (names and classes) and its text blocks with their paths. Over the
distinct pages of one host every token has an occurrence vector (how often it stands on each page);
tokens that share a vector form an equivalence class. Classes of two tokens or more that enough pages
support, and whose spans nest in each other or lie apart, are valid and make up the host's template. What
remains between template tokens are the slots, and text that belongs to the template is no content,
wherever it stands. Slots vary in menus and adverts too, so names and whole class tokens of the elements
around a slot are evidence against it; an element that only wraps the article is not believed.

Vectors travel as one hash per (host, token) with map-side combination, so a host with a third of all
pages costs each task one row per token. Copies of a page count once. Templates join back by host; pages
are not shuffled as long as the templates, whose size is measured, can be broadcast.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlsieve.llm.common import free_names
from urlsieve.operators.lookups import lookup_join
from urlsieve.session import cut_lineage

# Element names and class words with a plain meaning in HTML.
UNSEEN = frozenset("script style noscript template head title button select option textarea iframe svg canvas object menu dialog".split())
SILENT = frozenset("nav header footer aside form".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn del em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var img br wbr input".split())
# Elements that do not part the text around them.
FLOW = INLINE | frozenset("script style noscript template button select option textarea iframe svg canvas".split())
BAD_CLASS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner sidebar side aside menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert comment comments "
    "discussion reply replies share sharing social related recommended subscribe subscription newsletter popup "
    "modal overlay widget toolbar pagination pager login signup search form".split())
# Words that say what an element lacks or holds, not what it is.
SAYS_WITH = frozenset("has have no not without with is".split())
# Reader comments are no content whatever they hold.
FIRM_WORDS = frozenset("nav header footer comment comments discussion reply replies".split())
# Elements and words that often only wrap a page's content.
WRAPS = frozenset("form sidebar side search related notice notices login signup widget header aside".split())
CONTENT = frozenset(("article", "main"))
KEEP_CLASS = frozenset(("html", "body", "article", "main"))
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
PART = re.compile(r"[^\W_]+")
MIN_SUPPORT, MIN_PAGES = 0.5, 3  # share of a host's distinct pages, and their least number
FIRM, BELIEVED, DOUBTED = 3, 2, 1


def attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name, the first of each."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m.group(1).lower(), next((g for g in m.groups()[1:] if g is not None), ""))
    return out


def bad_words(value: str) -> set[str]:
    """Words of boilerplate in class tokens: a token that is one, or that starts or ends with one.

    ``site-footer`` and ``comment-list`` are such tokens; ``has-sidebar`` is not.
    """
    found = set()
    for token in value.lower().split():
        parts = PART.findall(token)
        if parts and parts[0] not in SAYS_WITH:
            found |= {parts[0], parts[-1]} & BAD_CLASS
    return found


@dataclass
class Element:
    name: str
    token: str
    parent: int
    unseen: bool  # its text is never content: by its kind, or because it is hidden
    against: int  # FIRM, BELIEVED (unless it wraps the article), DOUBTED (may be the content itself), or 0


@dataclass
class Block:
    element: int
    path: str
    text: str


def classified(name: str, raw: str, parent: int) -> Element:
    found = attributes(raw) if raw and not raw.isspace() else {}
    classes = " ".join(found.get("class", "").split())
    unseen = name in UNSEEN or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    words = bad_words(f"{classes} {found.get('id', '')} {found.get('role', '')}") if found and name not in KEEP_CLASS else set()
    against = 0
    if (name in SILENT and name != "form") or words & FIRM_WORDS:
        against = FIRM
    elif words or name == "form":
        against = DOUBTED if words <= WRAPS else BELIEVED
    return Element(name, f"{name}.{classes}" if classes else name, parent, unseen, against)


def parsed(page: str) -> tuple[list[Element], list[Block], Counter, dict[str, int]]:
    """Elements and text blocks in page order, then counts and first places of element paths."""
    elements: list[Element] = []
    blocks: list[Block] = []
    counts: Counter = Counter()
    first: dict[str, int] = {}
    stack: list[int] = []
    unseen: list[bool] = []
    paths: list[str] = []
    held: list[str] = []

    def block_of() -> int:
        return next((i for i in reversed(stack) if elements[i].name not in FLOW), -1)

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                at = block_of()
                blocks.append(Block(at, paths[at] if at >= 0 else "", text))
            held.clear()

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        end = m.start() if m else size
        # text of an inline element with evidence against it is left out alone; what is around it stays
        if end > at and not (unseen and unseen[-1]):
            held.append(page[at:end])
        if not m:
            break
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if name == "br":
            held.append(" ")
            continue
        if name not in FLOW:
            flush()
        if m.group(1):
            for i in range(len(stack) - 1, -1, -1):
                if elements[stack[i]].name == name:
                    del stack[i:], unseen[i:]
                    break
                if name in FLOW and elements[stack[i]].name not in FLOW:
                    break  # a stray inline end tag closes no block
            continue
        if name in VOID:
            continue
        if name == "p":
            for i in range(len(stack) - 1, -1, -1):  # a new paragraph ends the open one
                if elements[stack[i]].name == "p":
                    del stack[i:], unseen[i:]
                    break
                if elements[stack[i]].name not in FLOW:
                    break
        raw = m.group(3)
        if raw.endswith("/") and name not in RAW:
            continue
        element = classified(name, raw, stack[-1] if stack else -1)
        elements.append(element)
        stack.append(len(elements) - 1)
        unseen.append(bool(unseen and unseen[-1]) or element.unseen or (name in INLINE and element.against >= BELIEVED))
        if name in FLOW:
            paths.append("")
        else:
            above = next((paths[i] for i in reversed(stack[:-1]) if elements[i].name not in FLOW), "")
            path = f"{above}>{element.token}" if above else element.token
            paths.append(path)
            counts[path] += 1
            first.setdefault(path, len(first))
        if name in RAW:
            close = re.compile(rf"</{name}", re.I).search(page, at)
            at = close.start() if close else size
    flush()
    return elements, blocks, counts, first


def token_id(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "replace")) - (1 << 63)


def text_token(block: Block) -> str:
    return f"{block.path}|{block.text}"


def page_tokens(page: str) -> list[tuple[int, int, int]]:
    """(token, times, place) of a page: element paths, then text blocks."""
    _, blocks, counts, first = parsed(page)
    texts = Counter(map(text_token, blocks))
    n = len(first)
    out = [(token_id(t), c, first[t]) for t, c in counts.items()]
    return out + [(token_id(t), c, n + i) for i, (t, c) in enumerate(texts.items())]


def main_text(page: str | None, template: frozenset[int]) -> str:
    """Blocks of the content slots, joined by line breaks.

    A slot is content unless its text belongs to the template or an element around it is boilerplate by
    name or class. Elements that hold a ``main``, or an article with at least half of the page's text, only
    wrap it (but for menus, page headers and footers, and comments). Where a page has neither, and nothing
    else is left, doubtful elements (a form, a ``search`` section) are taken for content.
    """
    elements, blocks, _, _ = parsed(page or "")
    slots = [b for b in blocks if token_id(text_token(b)) not in template]
    if not slots:
        return ""
    size = [0] * len(elements)
    for b in slots:
        at = b.element
        while at >= 0:
            size[at] += len(b.text)
            at = elements[at].parent
    whole = sum(len(b.text) for b in slots)
    wraps = set()
    for i, e in enumerate(elements):
        if e.name == "main" or (e.name == "article" and 2 * size[i] >= whole):
            at = e.parent
            while at >= 0:
                wraps.add(at)
                at = elements[at].parent

    def judged(doubts: bool) -> list[str]:
        bad: list[bool] = []  # parents come before their children
        for i, e in enumerate(elements):
            own = e.against == FIRM or (e.against > 0 and i not in wraps and (doubts or e.against == BELIEVED))
            bad.append((e.parent >= 0 and bad[e.parent]) or own)
        return [b.text for b in slots if b.element < 0 or not bad[b.element]]

    chosen = judged(True)
    if not chosen and not any(e.name in CONTENT for e in elements):
        chosen = judged(False)
    return "\n".join(chosen)


def page_rows(pages: DataFrame, host: str, body: str) -> DataFrame:
    """``_host, _page, _ids, _counts, _places``: the tokens of the distinct pages of each host, a row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [page_tokens(t or "") for t in b.column(2).to_pylist()]
            lists = [pa.array([[r[i] for r in rows] for rows in found], pa.list_(pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["_host", "_page", "_ids", "_counts", "_places"])

    slim = pages.where(F.col(host).isNotNull()).select(F.col(host).alias("_host"), F.xxhash64(body).alias("_page"), F.col(body).alias("_body"))
    rows = slim.mapInArrow(run, "_host string, _page long, _ids array<long>, _counts array<long>, _places array<long>")
    # copies of a page are one page; what travels is token numbers, not pages
    return rows.groupBy("_host", "_page").agg(*(F.first(c).alias(c) for c in ("_ids", "_counts", "_places")))


def templates(pages: DataFrame, min_support: float = MIN_SUPPORT, min_pages: int = MIN_PAGES) -> DataFrame:
    """``_host, _template`` (token ids): tokens of the valid equivalence classes of each host, from stored page rows."""
    tokens = pages.select("_host", "_page", F.inline(F.arrays_zip("_ids", "_counts", "_places"))).toDF("_host", "_page", "_token", "_count", "_place")
    vectors = tokens.groupBy("_host", "_token").agg(
        F.count("*").alias("_support"), F.expr("bit_xor(xxhash64(_page, _count))").alias("_vector"), F.avg("_place").alias("_at"))
    sizes = pages.groupBy("_host").agg(F.count("*").alias("_pages"))
    sized = lookup_join(vectors.where(F.col("_support") >= min_pages), sizes, "_host")
    supported = sized.where(F.col("_support") >= min_support * F.col("_pages"))
    same = ["_host", "_vector", "_support"]
    classes = supported.groupBy(*same).agg(
        F.collect_list("_token").alias("_tokens"), F.min("_at").alias("_from"), F.max("_at").alias("_to"))
    # spans must nest or lie apart from every wider class of the host that starts before them; at half support
    # a host has at most twice as many tokens as its pages have on average
    wide = Window.partitionBy("_host").orderBy("_from", F.desc("_to")).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.collect_list("_to").over(wide)
    crosses = F.exists(ends, lambda e: (e >= F.col("_from")) & (e < F.col("_to")))
    valid = classes.withColumn("_bad", crosses).where((F.size("_tokens") >= 2) & ~F.col("_bad"))
    return valid.groupBy("_host").agg(F.array_distinct(F.flatten(F.collect_list("_tokens"))).alias("_template"))


def extract(
    pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", min_support: float = MIN_SUPPORT,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """All rows and columns of ``pages`` plus ``text`` (empty if none) and ``n_chars`` (code points).

    Null pages count as empty. Pages without a host in their URL, and hosts of fewer than ``min_pages``
    distinct pages, have no template: element names and classes alone decide there. Rows that repeat give
    one row each and count as one page. Columns ``text`` and ``n_chars`` of ``pages`` are replaced.
    """
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    host, found, known = free_names(pages, "_host", "_text", "_template")
    name = F.lower(F.regexp_extract(F.col(url), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(*keep, F.when(name != "", name).alias(host))
    table = templates(cut_lineage(page_rows(rows, host, body)), min_support, min_pages).toDF(host, known)
    joined = lookup_join(rows, table, host)

    @F.arrow_udf("string")
    def text(bodies: pa.Array, known_ids: pa.Array) -> pa.Array:
        ready: dict[tuple, frozenset[int]] = {}
        out = []
        for b, t in zip(bodies.to_pylist(), known_ids.to_pylist(), strict=True):
            ids = tuple(t or ())
            if ids not in ready:
                ready[ids] = frozenset(ids)
            out.append(main_text(b, ready[ids]))
        return pa.array(out, pa.string())

    return joined.select(*keep, text(F.col(body), F.col(known)).alias(found)).select(
        *keep, F.col(found).alias("text"), F.length(found).cast("long").alias("n_chars"))
