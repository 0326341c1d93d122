"""Column functions that take URLs apart.

Three flavours of parsing exist on purpose, because their results differ on dirty input:
``split_url`` and ``with_split`` are the generic splitter, ``with_profile_parts`` feeds profiling
(a URL without a scheme is read as http); the tabular features read a URL as it is, so there no
scheme means no host.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions.suffixes import SuffixRules, SuffixTable
from urlsieve.functions.text import strip, text

Rules = SuffixRules | SuffixTable

OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
IPV4_LOOSE = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"


# --- generic splitting --------------------------------------------------------------------

CONTROLS = "".join(map(chr, range(0x21)))


def _drop_unsafe(url: Column) -> Column:
    """Browsers ignore tabs and line breaks inside a URL and controls in front of it."""
    return F.ltrim(F.translate(url, "\t\r\n", ""), text(CONTROLS))


def _rest(col: Column, taken: Column, extra: int = 0) -> Column:
    """What follows the first ``taken`` characters (and ``extra`` more)."""
    return F.substring(col, F.length(taken) + (1 + extra), F.lit(1 << 30))


def _unbalanced(netloc: Column) -> Column:
    return F.contains(netloc, text("[")) != F.contains(netloc, text("]"))


def split_url(url: Column) -> dict[str, Column]:
    """Scheme, netloc, path, query and fragment of a URL, all empty when it is malformed.

    A URL is malformed when its netloc has unbalanced brackets. Use ``with_split`` where several
    columns are derived from the parts: it does the same work once per row.
    """
    clean = _drop_unsafe(url)
    pattern = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    part = {
        name: F.regexp_extract(clean, pattern, i)
        for i, name in enumerate(("scheme", "netloc", "path", "query", "fragment"), start=1)
    }
    bad = _unbalanced(part["netloc"])
    part["scheme"] = F.lower(part["scheme"])
    return {name: F.when(bad, text("")).otherwise(col) for name, col in part.items()}


def fenced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that filters are never pushed through.

    A filter that moves below stacked projections has every column in it replaced by its
    definition, at each level again, and grows exponentially. The output of a generator cannot be
    replaced, so a one-element ``inline`` keeps filters on parsed parts above the parsing.
    """
    made = F.struct(*(col.alias(name) for name, col in columns.items()))
    old = [c for c in df.columns if c not in columns]
    return df.select(*old, F.inline(F.array(made)))


def with_split(df: DataFrame, url: Column, prefix: str) -> DataFrame:
    """Add ``<prefix>scheme``, ``netloc``, ``path``, ``query`` and ``fragment`` columns.

    Same result as ``split_url``, in stacked projections of plain string functions: each stage is
    read more than once by the next, so the optimizer keeps them apart and nothing is recomputed.
    """
    c = {name: F.col(f"{prefix}_{name}") for name in ("all", "head", "tree", "spec", "auth")}
    scheme, netloc = F.col(prefix + "scheme"), F.col(prefix + "netloc")
    slashes = c["spec"].startswith("//")
    staged = (
        df.withColumns({f"{prefix}_all": _drop_unsafe(url)})
        .withColumns({
            f"{prefix}_head": F.substring_index(c["all"], "#", 1),
            f"{prefix}scheme": F.regexp_extract(c["all"], "^([A-Za-z][A-Za-z0-9+.\\-]*):", 1),
        })
        .withColumns({
            f"{prefix}fragment": _rest(c["all"], c["head"], 1),
            f"{prefix}_tree": F.substring_index(c["head"], "?", 1),
        })
        .withColumns({
            f"{prefix}query": _rest(c["head"], c["tree"], 1),
            f"{prefix}_spec": F.when(scheme == "", c["tree"]).otherwise(
                _rest(c["tree"], scheme, 1)),
        })
        .withColumns({
            f"{prefix}netloc": F.when(
                slashes, F.substring_index(F.substring(c["spec"], 3, 1 << 30), "/", 1)
            ).otherwise(text("")),
        })
        .withColumns({
            f"{prefix}path": F.when(slashes, _rest(c["spec"], netloc, 2)).otherwise(c["spec"]),
        })
    )
    bad = _unbalanced(netloc)
    final = {
        prefix + name: F.when(bad, text("")).otherwise(F.col(prefix + name))
        for name in ("scheme", "netloc", "path", "query", "fragment")
    }
    final[prefix + "scheme"] = F.lower(final[prefix + "scheme"])
    return fenced(staged, final).drop(*(f"{prefix}_{name}" for name in c))


def has_port_suffix(netloc: Column) -> Column:
    return netloc.rlike(":[0-9]+$")


def host_of_netloc(netloc: Column) -> Column:
    """Netloc without a trailing ``:digits``; user info stays."""
    return F.regexp_replace(netloc, ":[0-9]+$", "")


def port_of_netloc(netloc: Column) -> Column:
    """Digits after the last colon, NULL when there are none."""
    return F.nullif(F.regexp_extract(netloc, ":([0-9]+)$", 1), text(""))


def hostname(netloc: Column) -> Column:
    """Host without user info, port and brackets, in lower case."""
    tail = F.lower(F.substring_index(netloc, "@", -1))
    return F.when(
        F.contains(tail, text("[")), F.regexp_extract(tail, r"\[([^\]]*)", 1)
    ).otherwise(F.substring_index(tail, ":", 1))


def valid_port(netloc: Column) -> Column:
    """Port number when it is made of digits and fits 16 bits, else NULL."""
    tail = F.substring_index(netloc, "@", -1)
    digits = F.when(
        F.contains(tail, text("[")), F.regexp_extract(tail, r"\]:([0-9]{1,9})$", 1)
    ).otherwise(F.regexp_extract(tail, "^[^:]*:([0-9]{1,9})$", 1))
    number = F.nullif(digits, text("")).cast("int")
    return F.when(number <= 65535, number)


def port_is_invalid(netloc: Column) -> Column:
    """True when something follows the port colon that is not a valid port number."""
    tail = F.substring_index(netloc, "@", -1)
    given = F.when(
        F.contains(tail, text("[")), F.regexp_extract(tail, r"\]:(.+)$", 1)
    ).otherwise(F.regexp_extract(tail, "^[^:]*:(.+)$", 1))
    return (given != "") & valid_port(netloc).isNull()


# --- hosts --------------------------------------------------------------------------------

def is_ip(host: Column) -> Column:
    """Four dotted decimal numbers, each at most 255."""
    return host.rlike(IPV4)


def is_ip_loose(host: Column) -> Column:
    """Looks like an IPv4 address; the range of the numbers is not checked."""
    return host.rlike(IPV4_LOOSE)


def ip_number(host: Column) -> Column:
    """IPv4 address as a long, NULL when it is not one (leading zeros are not accepted)."""
    strict = host.rlike(r"^(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
                        r"(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$")
    parts = F.split(F.when(strict, host), r"\.")
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p.cast("long"))


def network_range(cidr: str) -> tuple[int, int]:
    """First and last address of an IPv4 network as numbers."""
    address, bits = cidr.split("/")
    first = sum(int(p) << (24 - 8 * i) for i, p in enumerate(address.split(".")))
    return first, first + (1 << (32 - int(bits))) - 1


def is_private_host(host: Column) -> Column:
    """Local names, private IPv4 networks and private IPv6 prefixes (address forms only)."""
    low = F.lower(host)
    number = ip_number(low)
    v4 = F.lit(False)
    for cidr in K.PRIVATE_NETWORKS:
        first, last = network_range(cidr)
        v4 = v4 | number.between(F.lit(first).cast("long"), F.lit(last).cast("long"))
    v6_shape = low.rlike("^[0-9a-f]*:[0-9a-f:]*:?[0-9a-f.%]*$") & low.rlike(":.*:")
    v6 = v6_shape & low.rlike("^(?:[0:]*:0*1$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)")
    return F.coalesce(low.isin(*K.LOCALHOST_NAMES) | v4 | v6, F.lit(False))


def listed_suffix(host: Column, suffixes: Iterable[str], whole: bool = False) -> Column:
    """Longest listed suffix of a host, without its leading dot; NULL when none is listed.

    Suffixes have one or two labels, so the answer is decided by two hash-set lookups per row;
    no join and no scan over the list is needed. ``whole`` also lets the host be a suffix itself.
    """
    suffixes = list(suffixes)
    if any(s.count(".") > 1 for s in suffixes):
        raise ValueError("suffixes of three labels or more need the table join, lookups.longest_suffix")
    double = [s for s in suffixes if s.count(".") == 1]
    single = [s for s in suffixes if "." not in s]
    start = "(?:^|\\.)" if whole else "\\."
    last_two = F.regexp_extract(host, start + r"([^.]*\.[^.]*)$", 1)
    last_one = F.regexp_extract(host, start + r"([^.]*)$", 1)
    return F.when(last_two.isin(*double), last_two).when(last_one.isin(*single), last_one)


def last_label(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def profile_tld(host: Column) -> Column:
    """Listed suffix with its dot, else the last label, ``<ip>`` or ``<none>``."""
    low = F.lower(host)
    listed = listed_suffix(low, K.PROFILE_SUFFIXES)
    return (
        F.when(low == "", text("<none>"))
        .when(is_ip(low), text("<ip>"))
        .when(listed.isNotNull(), F.concat(text("."), listed))
        .when(F.contains(low, text(".")), F.concat(text("."), last_label(low)))
        .otherwise(text("<none>"))
    )


def profile_domain(host: Column, tld: Column) -> Column:
    """Registered domain used for profiling: one label plus the suffix."""
    bare = F.substring(tld, 2, 1 << 20)
    front = F.substring(host, F.lit(1), F.length(host) - F.length(tld))
    return (
        F.when(host == "", text("<none>"))
        .when(tld.isin("<none>", "<ip>"), host)
        .when(front == "", host)
        .otherwise(F.concat(last_label(front), text("."), bare))
    )


def split_domain(url: Column) -> Column:
    """Registered domain used for domain-honest splits, straight from the raw URL."""
    after_scheme = F.when(
        F.contains(url, text("://")), F.substring(url, F.instr(url, "://") + 3, F.lit(1 << 30))
    ).otherwise(url)
    netloc = F.substring_index(F.regexp_extract(after_scheme, "^[^/?#]*", 0), "@", -1)
    host = strip(F.lower(F.regexp_replace(netloc, ":[^:]*$", "")))
    suffix = listed_suffix(host, K.PROFILE_SUFFIXES)
    front = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    return (
        F.when(F.coalesce(host, text("")) == "", text("<unknown>"))
        .when(is_ip(host), host)
        .when(suffix.isNotNull() & (front == ""), host)
        .when(suffix.isNotNull(), F.concat(last_label(front), text("."), suffix))
        .otherwise(F.substring_index(host, ".", -2))
    )


def with_suffix_parts(df: DataFrame, host: Column, prefix: str, rules: Rules | None = None) -> DataFrame:
    """Add ``<prefix>suffix``, ``domain`` and ``subdomain`` of a host, each computed once per row.

    Suffixes are those of ``rules``, else of the fixed list.
    """
    lookup, is_address = F.col(prefix + "_lookup"), F.col(prefix + "_ip")
    suffix, front = F.col(prefix + "suffix"), F.col(prefix + "_front")
    domain = F.col(prefix + "domain")
    df = df.withColumns({prefix + "_lookup": host})
    if rules is None:
        listed, rule = listed_suffix(lookup, K.ALL_SUFFIXES, whole=True), None
    else:
        rule = prefix + "_rule"
        df = rules.with_suffix(df, prefix + "_lookup", rule)
        listed = F.col(rule)
    staged = (
        df.withColumns({
            prefix + "_ip": is_ip(lookup),
            prefix + "suffix": F.when(is_ip(lookup), text("")).otherwise(F.coalesce(listed, text(""))),
        })
        .withColumns({
            prefix + "_front": F.when(is_address | (suffix == ""), lookup)
            .when(suffix == lookup, text(""))
            .otherwise(F.substring(lookup, F.lit(1), F.length(lookup) - F.length(suffix) - 1))
        })
        .withColumns({prefix + "domain": F.when(is_address, lookup).otherwise(last_label(front))})
    )
    subdomain = F.when(
        ~is_address & F.contains(front, text(".")),
        F.substring(front, F.lit(1), F.length(front) - F.length(domain) - 1),
    ).otherwise(text(""))
    return fenced(staged, {
        prefix + "suffix": suffix, prefix + "domain": domain, prefix + "subdomain": subdomain,
    }).drop(prefix + "_lookup", prefix + "_ip", prefix + "_front", *filter(None, [rule]))


def lenient_host(url: Column) -> Column:
    """Host of a lower-cased URL even when the scheme is missing; used for suffix lookup."""
    bare = F.regexp_replace(url, "^(?:[a-z0-9+.\\-]*:)?//", "")
    netloc = F.substring_index(F.regexp_extract(bare, "^[^/?#]*", 0), "@", -1)
    plain = F.regexp_replace(strip(F.substring_index(netloc, ":", 1)), "\\.+$", "")
    return F.when(netloc.startswith("["), F.regexp_extract(netloc, r"^(\[[^\]]*\]?)", 1)).otherwise(
        plain
    )


# --- flavours -----------------------------------------------------------------------------

def read_as_http(url: Column) -> Column:
    """Prefix ``http://`` where a URL has no ``://``."""
    return F.when(F.contains(url, text("://")), url).otherwise(F.concat(text("http://"), url))


def with_profile_parts(df: DataFrame, url: str = "url", prefix: str = "") -> DataFrame:
    """Add scheme, host, port, path, query and fragment as profiling reads them.

    A URL without ``://`` is read as http but keeps an empty scheme; user info stays in the host.
    """
    bare = ~F.contains(F.col(url), text("://"))
    netloc = F.col("_p_netloc")
    parsed = with_split(df, read_as_http(strip(F.col(url))), "_p_").withColumns({
        "_p_netloc": F.lower(netloc)
    })
    return parsed.withColumns({
        prefix + "scheme": F.when(bare, text("")).otherwise(F.col("_p_scheme")),
        prefix + "host": host_of_netloc(netloc),
        prefix + "port": port_of_netloc(netloc),
        prefix + "path": F.col("_p_path"),
        prefix + "query": F.col("_p_query"),
        prefix + "fragment": F.col("_p_fragment"),
    }).drop(*("_p_" + n for n in ("scheme", "netloc", "path", "query", "fragment")))


def cut_path_parameters(scheme: Column, path: Column) -> Column:
    """Drop ``;parameters`` of the last path segment for the schemes that have them."""
    return F.when(
        scheme.isin(*K.PARAMETER_SCHEMES), F.regexp_replace(path, ";[^/]*$", "")
    ).otherwise(path)


# --- predicates and rewriting -------------------------------------------------------------

def norm_url(raw: Column) -> Column:
    """Strip white space and quotes; NULL unless the rest starts with http:// or https://."""
    bare = F.btrim(F.btrim(strip(raw), text('"')), text("'"))
    return F.when(bare.rlike("(?i)^https?://"), bare)


def last_word(line: Column) -> Column:
    """What follows the last white space."""
    return F.regexp_replace(line, f"(?s)^.*{K.WHITESPACE_CLASS}", "")


def wrap_domain(raw: Column) -> Column:
    """Hosts-file or domain-list line to a URL, NULL when the line holds no plain domain."""
    line = strip(raw)
    domain = F.lower(last_word(line))
    keep = (
        (line != "")
        & ~line.rlike("^[#!;]")
        & F.contains(domain, text("."))
        & ~domain.rlike("[/:*]")
        & ~domain.isin(*K.HOSTS_FILE_NAMES)
    )
    return F.when(keep, F.concat(text("https://"), domain, text("/")))


def brand_pattern() -> str:
    """One pattern for all brand names; word edges are spelled out so every engine agrees.

    Names are grouped by their first letter and share their edge, so a place in the URL is tried against
    some 20 branches instead of one for each name.
    """
    edge_left, edge_right = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
    names = [
        f"{letter}(?:{'|'.join(b[1:] for b in same)})"
        for letter, same in groupby(sorted(K.VN_BRANDS), key=lambda b: b[0])
    ]
    words = f"(?:{'|'.join(K.VN_BRAND_WORDS)}){edge_right}"
    return "(?i)" + "|".join([*names, edge_left + f"(?:{'|'.join([words, *K.VN_BRAND_WORD_STARTS])})"])


VN_TLD_PATTERN = "(?i)\\.vn(?:[:/?#]|$)"


def vn_flags(url: Column, host: Column) -> dict[str, Column]:
    tld = F.coalesce(F.endswith(host, text(".vn")), F.lit(False))
    brand = url.rlike(brand_pattern())
    return {
        "vn_tld": tld,
        "vn_brand": brand,
        "vn_either": tld | brand | url.rlike(VN_TLD_PATTERN),
    }


def is_vn_target(url: Column) -> Column:
    """``.vn`` before a delimiter or the end, or a brand name, or a host that ends in ``.vn``.

    A host stands in the URL as it is, with a delimiter or the end behind it, unless it holds characters that
    browsers drop, or brackets; only then is the URL taken apart.
    """
    by_host = F.endswith(hostname(split_url(url)["netloc"]), text(".vn"))
    return F.coalesce(
        url.rlike(VN_TLD_PATTERN) | F.when(url.rlike(r"[\t\r\n\[]"), by_host) | url.rlike(brand_pattern()),
        F.lit(False),
    )


def remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in an absolute path."""
    segments = F.split(path, "/")

    def step(done: Column, seg: Column) -> Column:
        return (
            F.when(seg == ".", done)
            .when((seg == "..") & (F.size(done) > 0), F.slice(done, 1, F.size(done) - 1))
            .when(seg == "..", done)
            .otherwise(F.concat(done, F.array(seg)))
        )

    walked = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends_open = F.element_at(segments, -1).isin(".", "..")
    kept = F.when(ends_open, F.concat(walked, F.array(text("")))).otherwise(walked)
    joined = F.array_join(kept, "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(text("/"), joined))


def _mark(sign: str, col: Column) -> Column:
    return F.when(col != "", F.concat(text(sign), col)).otherwise(text(""))


def with_resolved(df: DataFrame, link: str, base: str, out: str) -> DataFrame:
    """Add the absolute form of a link found on the page ``base``, in stacked projections."""
    own = {n: F.col("_o_" + n) for n in ("scheme", "netloc", "path", "query", "fragment")}
    page = {n: F.col("_b_" + n) for n in own}
    folder = F.regexp_extract(page["path"], "^(.*)/[^/]*$", 1)
    # empty segments inside a relative path vanish when it is merged with the base path
    merged = F.regexp_replace(F.concat(folder, text("/"), own["path"]), "/{2,}", "/")
    tail = F.concat(F.col("_o_q"), F.col("_o_f"))
    staged = (
        with_split(with_split(df, F.col(link), "_o_"), F.col(base), "_b_")
        .withColumns({
            "_root": F.concat(page["scheme"], text("://"), page["netloc"]),
            "_o_q": _mark("?", own["query"]), "_o_f": _mark("#", own["fragment"]),
            "_b_q": _mark("?", page["query"]),
            "_full": F.when(own["path"].startswith("/"), own["path"]).otherwise(merged),
        })
        .withColumns({"_full": remove_dot_segments(F.col("_full"))})
        .withColumns({
            out: F.when(strip(F.col(link)) == "", F.col(base))
            .when((own["scheme"] != "") & (own["scheme"] != page["scheme"]), F.col(link))
            .when(own["netloc"] != "", F.concat(page["scheme"], text("://"), own["netloc"],
                                                own["path"], tail))
            .when((own["path"] == "") & (own["query"] != ""),
                  F.concat(F.col("_root"), page["path"], tail))
            .when(own["path"] == "", F.concat(F.col("_root"), page["path"], F.col("_b_q"), tail))
            .otherwise(F.concat(F.col("_root"), F.col("_full"), tail))
        })
    )
    helpers = [p + n for p in ("_o_", "_b_") for n in own]
    return staged.drop(*helpers, "_root", "_o_q", "_o_f", "_b_q", "_full")


def with_normal_url(df: DataFrame, url: str, out: str, base: str | None = None) -> DataFrame:
    """Add the canonical form for link graphs: absolute, lower-case scheme and host, no user info,
    no fragment. NULL unless the URL is http(s) with a host and a sane port."""
    source = url if base is None else "_abs"
    if base is not None:
        df = with_resolved(df, url, base, "_abs")
    names = ("scheme", "netloc", "path", "query", "fragment")
    part = {n: F.col("_n_" + n) for n in names}
    keep = (
        (F.coalesce(F.col(url), text("")) != "")
        & part["scheme"].isin("http", "https") & (F.col("_host") != "") & ~F.col("_odd")
    )
    port = F.when(F.col("_port") > 0, F.concat(text(":"), F.col("_port").cast("string")))
    path = F.col("_path")
    staged = with_split(df, strip(F.col(source)), "_n_").withColumns({
        "_host": hostname(part["netloc"]), "_port": valid_port(part["netloc"]),
        "_odd": port_is_invalid(part["netloc"]), "_path": F.regexp_replace(part["path"], ";$", ""),
    })
    normal = F.when(keep, F.concat(
        part["scheme"], text("://"), F.col("_host"), F.coalesce(port, text("")),
        F.when(path == "", text("/")).otherwise(path), _mark("?", part["query"])))
    return fenced(staged, {out: normal}).drop(*("_n_" + n for n in names), "_host", "_port", "_odd", "_path", "_abs")


def with_site_of_host(df: DataFrame, host: Column, out: str, rules: Rules | None = None) -> DataFrame:
    """Add the registered site of a host: domain label plus suffix, else the domain, else the
    host itself. Suffixes are those of ``rules``, else of the fixed list."""
    low, suffix, domain = F.col("_h"), F.col("_s_suffix"), F.col("_s_domain")
    site = (
        F.when(domain == "", low).when(suffix == "", domain)
        .otherwise(F.concat(domain, text("."), suffix))
    )
    staged = with_suffix_parts(df.withColumns({"_h": F.lower(host)}), low, "_s_", rules)
    return fenced(staged, {out: site}).drop("_h", "_s_suffix", "_s_domain", "_s_subdomain")


def with_site(df: DataFrame, url: str, out: str, rules: Rules | None = None) -> DataFrame:
    """Add the registered site of a URL's host."""
    split = with_split(df, F.col(url), "_u_")
    named = with_site_of_host(split, hostname(F.col("_u_netloc")), out, rules)
    return named.drop(*("_u_" + n for n in ("scheme", "netloc", "path", "query", "fragment")))


def display_url(url: Column) -> Column:
    """Short form for logs: scheme, netloc and the start of the path, without the query."""
    part = split_url(url)
    base = F.when(
        part["scheme"] != "", F.concat(part["scheme"], text("://"), part["netloc"])
    ).otherwise(part["netloc"])
    path = F.concat(
        F.substring(part["path"], 1, K.DISPLAY_PATH),
        F.when(F.length(part["path"]) > K.DISPLAY_PATH, text("…")).otherwise(text("")),
    )
    malformed = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    is_bad = F.contains(malformed, text("[")) != F.contains(malformed, text("]"))
    return F.substring(F.when(is_bad, url).otherwise(F.concat(base, path)), 1, K.DISPLAY_TOTAL)


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)
