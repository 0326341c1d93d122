"""HTML main text: evidence of names and classes, and templates against brute-force deduction."""

from collections import Counter, defaultdict

import pytest

from urlsieve.llm import html_text as H

LONG = "The real body text is long enough to be most of the page"


@pytest.mark.parametrize("page,want", [
    ('<article><p>Hello <span class="ad">x</span> world</p></article>', "Hello world"),
    ("<article><p>Hello <span hidden>x</span> world</p></article>", "Hello world"),
    ('<div class="content has-sidebar"><article>A b</article></div>', "A b"),
    ('<div class="layout sidebar-right"><main>A b</main><div class="sidebar">s</div></div>', "A b"),
    ("<form><article>A b</article><select><option>1</select></form>", "A b"),
    ('<div title="the hidden truth" class="content">T</div>', "T"),
    ('<div class="search-results"><p>R</p></div>', "R"),
    ("<form><p>whole page</p></form>", "whole page"),
    (f"<article>Card</article><div><p>{LONG}</p></div>", f"Card\n{LONG}"),
    (f'<h1>Head</h1><article>{LONG}</article>', f"Head\n{LONG}"),
    (f'<div class="menu-page"><article>{LONG}</article></div>', LONG),
    (f'<article>{LONG}</article><section class="comments"><article>reader {LONG} {LONG}</article></section>', LONG),
    ('<nav>m</nav><div class="ad-slot">x</div><article></article><div class="site-footer">f</div>', ""),
    ('<nav>m</nav><div class="cookie-notice">x</div><aside>y</aside><header>h</header>', ""),
    ("<p>a<script>if (1 < 2) x()</script>b</p><p>c &amp; &#233; &nope;</p>", "ab\nc & é &nope;"),
    ("<p>one<p>two<br>three</p>\n\n four", "one\ntwo three\nfour"),
    ('<p class=x hidden=until-found>gone<div aria-hidden="TRUE">gone</div>', ""),
    ("<!-- <p>no</p> --><p>yes<!-- --> and", "yes and"), ("<p>unclosed <b>tag", "unclosed tag"), ("", ""), (None, ""),
])
def test_one_page(page, want):
    assert H.main_text(page, frozenset()) == want


def test_class_tokens_are_whole_words():
    assert H.bad_words("site-footer Ad cookie-bar comment_list") == {"footer", "ad", "cookie", "comment"}
    assert H.bad_words("has-sidebar no-ads header2 adsorption main-content reform") == set()


def brute_template(bodies):
    """Valid equivalence classes of one host by comparing whole occurrence vectors."""
    bodies = list(dict.fromkeys(b or "" for b in bodies))
    vectors, places = defaultdict(lambda: [0] * len(bodies)), defaultdict(list)
    for i, body in enumerate(bodies):
        for token, count, place in H.page_tokens(body):
            vectors[token][i] = count
            places[token].append(place)
    classes = defaultdict(list)
    for token, v in vectors.items():
        support = sum(c > 0 for c in v)
        if support >= H.MIN_PAGES and support >= H.MIN_SUPPORT * len(bodies):
            classes[tuple(v)].append(token)
    spans = []
    for tokens in classes.values():
        at = [sum(places[t]) / len(places[t]) for t in tokens]
        spans.append((min(at), -max(at), tokens))
    out, ends = set(), []
    for start, end, tokens in sorted(spans, key=lambda s: s[:2]):
        if len(tokens) >= 2 and not any(start <= e < -end for e in ends):
            out |= set(tokens)
        ends.append(-end)
    return frozenset(out)


def host_pages():
    rows = []
    for i in range(6):  # a notice without a listed class stands in every article
        extra = "<p>only here</p>" * (i % 3)
        rows.append(("h.example", f"<body><div class=top>Shop</div><article><p>Own {i}</p>{extra}<p>Please call us</p></article><div>Made by us</div></body>"))
    rows += [("h.example", rows[0][1])] * 3  # copies count once
    rows += [("two.example", "<body><p>Copy of a page</p><p>with two texts</p></body>")] * 8
    rows += [("pair.example", f"<body><p>Same words</p><p>own {i}</p></body>") for i in range(2)]  # too few to tell
    rows += [("mix.example", f"<body><p>{'ab'[i % 2]} text</p><div>{i}</div><p>{'x' * (i % 4)}</p></body>") for i in range(9)]
    return rows + [("odd.example", None), ("odd.example", ""), (None, "<p>no host</p>")]


def test_templates_equal_brute_force(spark):
    rows = host_pages()
    pages = spark.createDataFrame([(i, h and f"https://{h}/{i}", b) for i, (h, b) in enumerate(rows)], "page_id long, url string, html string")
    pages = pages.selectExpr("*", "'clash' as _template", "1 as _host", "2 as _page", "'old' as text").repartition(4)
    hosts = defaultdict(list)
    for h, b in rows:
        hosts[h].append(b)
    known = {h: brute_template(bodies) if h else frozenset() for h, bodies in hosts.items()}
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in H.extract(pages).collect())
    want = [H.main_text(b, known[h]) for h, b in rows]
    assert got == Counter((i, t, len(t)) for i, t in enumerate(want))
    assert want[0] == "Own 0" and want[2] == "Own 2\nonly here\nonly here" and want[9] == "Copy of a page\nwith two texts"
    assert want[17] == "Same words\nown 0" and len(known["h.example"]) > 4
    assert H.extract(pages.limit(0)).count() == 0
