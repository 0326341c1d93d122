"""Expected values worked out by hand for awkward URLs."""

import math

import pytest
from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions import risk, text as T, urls as U
from urlsieve.operators import features as FE
from urlsieve.plans import sqlkit

PROBE = "https://www.Example.com/path/to/file.html?a=1&b=2"


def rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, url string")


def one(df):
    return [r[-1] for r in sorted(df.collect())]


def test_profile_parts(spark):
    urls = [PROBE, "example.com/login", "http://user@h.com:8080/a;b/c;d?q#z", "http://[bad/x", "http://[::1]/x"]
    got = U.with_profile_parts(rows(spark, urls)).orderBy("i").select(
        "scheme", "host", "port", "path", "query", "fragment").collect()
    assert [tuple(r) for r in got] == [
        ("https", "www.example.com", None, "/path/to/file.html", "a=1&b=2", ""),
        ("", "example.com", None, "/login", "", ""),
        ("http", "user@h.com", "8080", "/a;b/c;d", "q", "z"),
        ("", "", None, "", "", ""),
        ("http", "[::1]", None, "/x", "", ""),
    ]


def test_split_forms_agree(spark):
    urls = [PROBE, "", "a:b", "//h/p?q#f", "http:/x", "x?y#z?w", "http://h?q", "1a://h/p", "\t http://h\n/p", "http://a]b/"]
    names = ("scheme", "netloc", "path", "query", "fragment")
    staged = U.with_split(rows(spark, urls), F.col("url"), "s_")
    flat = staged.select(*("s_" + n for n in names), *(c.alias("c_" + n) for n, c in U.split_url(F.col("url")).items()))
    for r in flat.collect():
        assert [r["s_" + n] for n in names] == [r["c_" + n] for n in names]


def test_tabular_probe(spark):
    df = FE.tabular_features(rows(spark, [PROBE]), "url")
    assert df.columns == list(K.TABULAR_FEATURES) and len(df.columns) == 105
    f = df.first().asDict()
    assert (f["url_len"], f["host_len"], f["path_len"], f["query_len"]) == (49, 15, 18, 7)
    assert (f["path_depth"], f["num_query_params"], f["has_query"], f["has_port"]) == (3, 2, 1, 0)
    assert (f["host_num_subdomains"], f["host_starts_with_www"], f["tld_com"], f["tld_is_common"]) == (1, 1, 1, 1)
    assert (f["is_https"], f["has_upper"], f["has_any_ext"], f["has_cdn_ext"]) == (1, 1, 1, 0)
    assert math.isclose(f["mixed_case_ratio"], 1 / 34)  # 34 letters, one of them upper case


def test_tabular_dirty(spark):
    f = [r.asDict() for r in FE.tabular_features(rows(spark, [
        "example.com/login", "http://999.1.1.1/x", "http://h.com/setup.EXE", "http://h.com/app.js/",
        "http://h.com/?a=1&a=2&b&=c", "http://h.com/é?ü=²", ""]), "url", ("i",)).orderBy("i").collect()]
    assert (f[0]["host_len"], f[0]["path_len"], f[0]["tld_com"], f[0]["has_phishing_keyword"]) == (0, 17, 1, 1)
    assert f[1]["is_ip_host"] == 1 and f[1]["tld_missing"] == 1
    assert f[2]["has_malware_ext"] == 1 and f[3]["has_cdn_ext"] == 1
    assert f[4]["num_query_params"] == 3
    assert f[5]["has_non_ascii"] == 1 and f[5]["digit_count_url"] == 1
    assert f[6]["url_len"] == 0 and f[6]["tld_missing"] == 1 and f[6]["is_bare_hostname"] == 1


def test_lexical(spark):
    df = FE.lexical_features(rows(spark, ["https://a.b.example.com.vn:80//x?p&q", "", "http://10.1.2.3/"]), "url", ("i",)).orderBy("i")
    assert df.columns[1:] == list(K.LEXICAL_FEATURES)
    a, b, c = (r.asDict() for r in df.collect())
    assert (a["num_subdomains"], a["subdomain_length_max"], a["tld_is_vn"], a["has_port"]) == (3, 7, 1, 1)
    assert (a["path_depth"], a["has_double_slash_in_path"], a["query_param_count"]) == (2, 1, 2)
    assert all(v == 0 for k, v in b.items() if k != "i")
    assert c["has_ip_host"] == 1 and c["num_subdomains"] == 0


@pytest.mark.parametrize("host,tld,domain", [
    ("m.vnexpress.net", ".net", "vnexpress.net"), ("bbc.co.uk", ".co.uk", "bbc.co.uk"), ("co.uk", ".uk", "co.uk"),
    ("localhost", "<none>", "localhost"), ("10.0.0.1", "<ip>", "10.0.0.1"), ("", "<none>", "<none>"),
    ("a.b.zzz", ".zzz", "b.zzz"), ("evn.vnx.com", ".com", "vnx.com"),
])
def test_profile_domain(spark, host, tld, domain):
    df = rows(spark, [host]).select(U.profile_tld(F.col("url")).alias("t"), F.col("url").alias("h"))
    assert tuple(df.select("t", U.profile_domain(F.col("h"), F.col("t"))).first()) == (tld, domain)


def test_split_domain(spark):
    urls = ["http://u:p@x.y.co.uk:80/z", "http://10.1.2.3:8/x", "//a/b", "", "http://a.b.zzz", "co.uk", "HTTP://H.COM"]
    got = one(rows(spark, urls).select("i", U.split_domain(F.col("url"))))
    assert got == ["y.co.uk", "10.1.2.3", "<unknown>", "<unknown>", "b.zzz", "co.uk", "h.com"]


def test_vn_target(spark):
    urls = ["https://a.com.vn:80/", "https://evn.vnx.com/", "https://vietcombank.xyz/", "http://x.com/bidv", "http://x.com/abidvc", "http://x.vn"]
    assert one(rows(spark, urls).select("i", U.is_vn_target(F.col("url")))) == [True, False, True, True, False, True]


def test_vn_target_as_spelled_out(spark):
    """The grouped names and the host that is only parsed where it must be give what the plain definition gives."""
    names = [n.replace("-?", "-") for n in K.VN_BRANDS] + [n.replace("-?", "") for n in K.VN_BRANDS] + [*K.VN_BRAND_WORDS, "vn-ab", "vnab", "vn-a", "vn"]
    urls = [shape.format(n) for n in names for shape in ("http://a.{0}.x/", "HTTP://X/{0}", "http://x/a{0}", "http://x/1{0}b", "{0}", "é{0}é", "/{0}_")]
    urls += [u.upper() for u in urls] + [u.replace("a", "", 1) for u in urls] + [u[:-3] for u in urls]
    urls += ["http://a.v\tn/", "http://a.vn\n", "http://a.v\rn:80/x", "http://[a.vn]/", "http://[a.vn]x/", "http://[a.vn/", "http://u@[b]c.vn]@a.vn", "http://x.vn@y.z/",
             "http://u:p@A.VN:8/", "//a.vn", "a.vn", "http://a.vn\\x", "http://a.vn;x/", "\x01http://a.vn", "http://a.vn ", "x:a.vn", "", " ", None]
    url = F.col("url")
    plain = url.rlike(U.VN_TLD_PATTERN) | url.rlike(sqlkit.brand_pattern()) | F.endswith(U.hostname(U.split_url(url)["netloc"]), F.lit(".vn"))
    df = rows(spark, urls)
    assert df.where(U.is_vn_target(url) != F.coalesce(plain, F.lit(False))).collect() == []
    assert 0 < df.where(U.is_vn_target(url)).count() < len(urls)
    assert one(rows(spark, ["http://a.v\tn/", "http://[a.vn]/", "http://a.vn;x/"]).select("i", U.is_vn_target(url))) == [True, True, False]


def test_encode(spark):
    urls = ["aZ", "x" * 300, "é", ""]
    a, b, c, d = one(rows(spark, urls).select("i", T.encode(F.col("url"))))
    assert a[:3] == [K.VOCAB.index("a") + 2, K.VOCAB.index("Z") + 2, 0] and len(a) == 256
    assert len(b) == 256 and 0 not in b
    assert c[0] == 1 and c[1] == 0 and set(d) == {0}


def test_resolution(spark):
    base = "http://h.com/a/b/c?q=1#f"
    cases = {"d": "http://h.com/a/b/d", "../d": "http://h.com/a/d", "/d": "http://h.com/d", "?x": "http://h.com/a/b/c?x",
             "#z": "http://h.com/a/b/c?q=1", "//O.com": "http://o.com/", "../../../../x": "http://h.com/x", "./": "http://h.com/a/b/",
             "https://U:p@K.com:443/p;v?q#f": "https://k.com:443/p;v?q", "javascript:x()": None, "http://h:99999/": None, "": None}
    df = spark.createDataFrame([(i, k, base) for i, k in enumerate(cases)], "i int, link string, base string")
    assert one(U.with_normal_url(df, "link", "out", base="base").select("i", "out")) == list(cases.values())


def test_private_hosts(spark):
    hosts = {"localhost": True, "10.1.2.3": True, "172.32.0.1": False, "172.31.255.255": True, "127.0.0.1": True, "8.8.8.8": False,
             "::1": True, "fe80::1": True, "fc::1": False, "fd00::1": True, "2001:db8::1": False, "a.com": False, "010.0.0.1": False}
    assert one(rows(spark, list(hosts)).select("i", U.is_private_host(F.col("url")))) == list(hosts.values())


def test_entropy_and_runs(spark):
    df = rows(spark, ["aabb", "", "abcd", "a1b22c333"])
    assert [round(x, 9) for x in one(df.select("i", T.entropy(F.col("url"))))][:3] == [1.0, 0.0, 2.0]
    assert one(df.select("i", T.longest_run(F.col("url"), "[0-9]"))) == [0, 0, 0, 3]


def test_risk_bounds(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.25, 0.2501, 0.5, 0.75, 0.76])], "i int, p double")
    assert one(df.select("i", risk.risk_level(F.col("p")))) == ["Low Risk", "Caution", "Caution", "Suspicious", "High Risk"]


def test_display(spark):
    urls = ["http://h.com/" + "p" * 60 + "?secret=1", "http://[bad/x", "x/y"]
    got = one(rows(spark, urls).select("i", U.display_url(F.col("url"))))
    assert got == ["http://h.com/" + "p" * 39 + "…", "http://[bad/x", "x/y"]


def test_non_finite_scores(spark):
    raw = FE.lexical_features(rows(spark, ["http://a.com/", "http://b.com/x"]), "url")
    stats = FE.feature_stats(raw).withColumn("std", F.when(F.col("feature") == "num_dots", F.lit(0.0)).otherwise(F.col("std")))
    shifted = stats.withColumn("mean", F.when(F.col("feature") == "num_dots", F.lit(float("nan"))).otherwise(F.col("mean")))
    with pytest.raises(Exception, match="not finite|DIVIDE_BY_ZERO"):
        FE.normalize_features(raw, shifted, repair=False).collect()


RULES = ["com", "uk", "co.uk", "a.b.example.com", "*.ck", "!www.ck", "*.kobe.jp", "!city.kobe.jp", "jp"]
SUFFIXES = [
    ("x.com", "com"), ("com", "com"), ("deep.x.co.uk", "co.uk"), ("x.uk", "uk"), ("y.a.b.example.com", "a.b.example.com"),
    ("b.example.com", "com"), ("x.y.ck", "y.ck"), ("y.ck", "y.ck"), ("ck", "ck"), ("www.ck", "ck"), ("z.www.ck", "ck"),
    ("a.b.kobe.jp", "b.kobe.jp"), ("x.city.kobe.jp", "kobe.jp"), ("kobe.jp", "jp"), ("a.foo.eu", "eu"), ("", ""), (None, ""),
]


@pytest.mark.parametrize("form", ["plan", "table"])
@pytest.mark.parametrize("unlisted", [True, False])
def test_suffix_rules(spark, form, unlisted):
    from urlsieve.functions.suffixes import SuffixRules, SuffixTable

    rules = SuffixRules(RULES, unlisted) if form == "plan" else SuffixTable(spark.createDataFrame([(r,) for r in RULES], "rule string"), unlisted)
    hosts = spark.createDataFrame([(h,) for h, _ in SUFFIXES] * 2, "host string")
    got = rules.with_suffix(hosts, "host", "s").collect()
    want = {h: "" if not unlisted and h in ("ck", "a.foo.eu") else s for h, s in SUFFIXES}
    assert len(got) == 2 * len(SUFFIXES) and all(r["s"] == want[r["host"]] for r in got)


def test_sites_under_unlisted_suffixes_differ(spark):
    from urlsieve.functions.suffixes import SuffixRules

    links = spark.createDataFrame([("http://a.foo.eu/", "http://b.bar.eu/"), ("http://a.foo.eu/", "http://b.foo.eu/")], "src string, dst string")
    from urlsieve.operators import pages

    assert [r["dst"] for r in pages.same_site(links, rules=SuffixRules(RULES)).collect()] == ["http://b.foo.eu/"]


def test_rule_files(spark, tmp_path, monkeypatch):
    from urlsieve.functions import suffixes

    (tmp_path / "rules.txt").write_text("// list\n\ncom\n*.CK  comment\n!www.ck\n.uk\n")
    hosts = spark.createDataFrame([("x.y.ck",), ("www.ck",), ("a.b.uk",)], "host string")
    for limit in (10, 2):
        monkeypatch.setattr(suffixes, "INLINE_RULES", limit)
        rules = suffixes.read_rules(spark, str(tmp_path / "rules.txt"))
        assert isinstance(rules, suffixes.SuffixRules if limit == 10 else suffixes.SuffixTable)
        assert {r["host"]: r["s"] for r in rules.with_suffix(hosts, "host", "s").collect()} == {"x.y.ck": "y.ck", "www.ck": "ck", "a.b.uk": "uk"}


def test_features_under_rules(spark):
    from urlsieve.functions.suffixes import SuffixRules
    from urlsieve.operators import features

    df = spark.createDataFrame([("http://x.deep.y.ck/",)], "url string")
    row = features.tabular_features(df, rules=SuffixRules(RULES)).first()
    assert (row["tld_label_count"], row["host_num_subdomains"], row["tld_missing"]) == (2, 1, 0)
