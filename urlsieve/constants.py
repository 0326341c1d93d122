"""Fixed values. Results depend on them literally, so they are stated as plain text."""

from __future__ import annotations

# --- Fixed values: characters -------------------------------------------------------------
# What counts as white space when text is stripped or collapsed (Unicode aware).
WHITESPACE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class; reads the same in Java and in RE2.
WHITESPACE_CLASS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}]"
)
# Decimal digits of any script plus the super- and subscript digits.
DIGIT_CLASS = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"
LETTER_CLASS = r"\p{L}"

# --- Fixed values: character ids ----------------------------------------------------------
# The 92 characters with an id of their own, in code-point order. Id 0 pads, id 1 is "unknown",
# the characters below count up from 2.
VOCAB = (
    " !\"#$%&'()*+,-./0123456789:;<=>?@"
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ[]_abcdefghijklmnopqrstuvwxyz{|}~"
)
# The older lower-case vocabulary that coverage is compared with.
VOCAB_OLD = "#%&+-./0123456789:=?@_abcdefghijklmnopqrstuvwxyz~"
PAD_ID = 0
UNKNOWN_ID = 1
SEQUENCE_LENGTH = 256

# --- Fixed values: public suffixes --------------------------------------------------------
PROFILE_SUFFIXES = (
    "com.vn", "net.vn", "edu.vn", "gov.vn", "org.vn", "ac.vn",
    "co.uk", "co.jp", "co.in", "co.nz", "com.au", "com.br", "com.cn",
    "net.au", "org.uk", "ac.uk", "gov.uk",
    "com", "org", "net", "edu", "gov", "mil", "int",
    "io", "dev", "app", "info", "biz", "mobi", "name",
    "blog", "shop", "tech", "site", "online", "space", "store",
    "de", "fr", "cn", "au", "ca", "jp", "kr", "vn", "ru", "uk",
    "br", "in", "it", "es", "nl", "pl", "cz", "ro", "se", "no",
    "tk", "ml", "ga", "cf", "top", "xyz", "click", "club",
    "live", "cc", "pw", "to", "bid", "download", "party", "faith",
    "work", "gdn", "trade", "stream", "red", "win", "cricket",
    "loan", "racing", "review", "ws", "me", "tv", "fm",
    "social", "page",
)
# Suffixes that get an indicator feature each, in feature order.
INDICATOR_SUFFIXES = (
    "com", "vn", "org", "co.uk", "net", "gov.uk", "com.vn", "gov", "ie", "fm",
    "app", "it", "ru", "int", "dev", "org.vn", "stream", "io", "top", "click",
    "de", "xyz", "info", "digital", "online", "ca", "sbs", "fr", "com.br", "co",
    "shop", "tk", "icu", "uk", "cc", "cn", "site", "me", "pl", "id",
    "in", "cfd", "us", "nl", "live", "com.au", "za", "club", "ar", "edu",
)
VN_SUFFIXES = ("vn", "com.vn", "org.vn", "gov.vn", "edu.vn", "net.vn", "ac.vn")
SUSPICIOUS_SUFFIXES = (
    "top", "xyz", "click", "sbs", "cfd", "icu", "stream", "digital",
    "online", "shop", "live", "tk", "ml", "ga", "gd", "site", "club",
    "fit", "rest", "loan", "men", "review", "trade",
)
COMMON_SUFFIXES = ("com", "org", "net", "edu", "gov")
# The lexical features use a different list, matched on the last label only.
LEXICAL_COMMON_SUFFIXES = ("com", "net", "org", "io", "dev", "app")

# Public-suffix dimension: every suffix this library knows of.
ALL_SUFFIXES = tuple(dict.fromkeys(
    PROFILE_SUFFIXES + INDICATOR_SUFFIXES + VN_SUFFIXES + SUSPICIOUS_SUFFIXES
))

# --- Fixed values: word lists -------------------------------------------------------------
PHISHING_KEYWORDS = (
    "login", "signin", "secure", "verify", "account", "password",
    "bank", "wallet", "confirm", "auth", "session", "recover",
    "unlock", "reset", "support", "billing",
)
MALWARE_EXTENSIONS = ("exe", "apk", "dmg", "sh", "scr", "dll", "bat", "so", "msi")
CDN_EXTENSIONS = (
    "js", "json", "css", "xml", "ts", "jpg", "yaml", "gif",
    "cjs", "png", "woff", "woff2", "svg", "ico",
)
# Names that mark a URL as aimed at Vietnamese users, and those that must stand alone as a word.
VN_BRANDS = (
    "vietcom", "techcom", "vietin", "vpbank", "tpbank", "sacomb", "agribank",
    "mbbank", "acbbank", "hdbank", "seabank", "lpbank", "eximbank",
    "vietbank", "nam-?a-?bank", "namabank", "saigonbank", "abbank",
    "momo", "zalopay", "vnpay", "shopeepay", "finhay", "tikop",
    "shopee", "tiki", "lazada", "sendo", "tgdd", "thegioididong", "dienmayxanh",
    "fptshop", "cellphones", "hoanghamobile", "nguyenkim",
    "vnpost", "vnpt", "viettel", "mobifone", "vinaphone", "fpt-?telecom",
    "vietnamairlines", "vietjet", "bambooairways", "vinpearl", "vinmec", "vinfast",
    "chinhphu", "baohiemxahoi", "bhxh", "gov-?vn",
    "vietnam", "vietnamese",
    "hanoi", "saigon", "hochiminh", "danang", "haiphong", "cantho",
)
VN_BRAND_WORDS = ("bidv", "msb", "ocb")
VN_BRAND_WORD_STARTS = ("vn-?[a-z]{2,}",)

LOCALHOST_NAMES = ("localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback")
HOSTS_FILE_NAMES = ("localhost", "broadcasthost", "ip6-localhost", "ip6-loopback")
PRIVATE_NETWORKS = (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16",
    "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8",
)
# Schemes whose last path segment may carry ";parameters".
PARAMETER_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "https", "imap", "mms", "rtsp", "rtsps", "rtspu",
    "sftp", "shttp", "sip", "sips", "tel",
)

# --- Fixed values: feature names, in column order -----------------------------------------
TABULAR_FEATURES = (
    "url_len", "host_len", "path_len", "query_len", "fragment_len", "path_depth",
    "num_query_params", "has_query", "has_fragment", "has_port", "path_to_url_ratio",
    "is_bare_hostname",
    "digit_count_url", "digit_density_url", "hyphen_count_url", "dot_count_url", "at_count",
    "pct_count", "amp_count", "eq_count", "qmark_count", "has_double_slash_in_path",
    "mixed_case_ratio", "has_upper",
    "has_control_chars", "has_non_ascii", "non_ascii_ratio", "has_punycode",
    "host_digit_count", "host_digit_density", "host_hyphen_count", "host_dot_count",
    "host_num_subdomains", "host_starts_with_www", "host_longest_digit_run",
    "host_longest_consonant_run", "host_vowel_ratio", "host_letter_count",
    "entropy_url", "entropy_host", "entropy_path",
    "is_http", "is_https", "is_ip_host",
    *("tld_" + s.replace(".", "_") for s in INDICATOR_SUFFIXES),
    "tld_other", "tld_missing", "tld_label_count",
    "tld_is_vn", "tld_is_suspicious", "tld_is_common",
    "num_phishing_keywords", "has_phishing_keyword",
    "has_malware_ext", "has_cdn_ext", "has_any_ext",
)
LEXICAL_FEATURES = (
    "url_length", "host_length", "path_length", "query_length",
    "num_dots", "num_hyphens", "num_underscores", "num_slashes", "num_question_marks",
    "num_equals", "num_amps", "num_ats", "num_percents", "num_digits",
    "digit_ratio", "letter_ratio", "vowel_ratio", "special_char_ratio",
    "has_ip_host", "has_port", "is_https", "num_subdomains", "subdomain_length_max",
    "tld_is_vn", "tld_is_common", "host_entropy", "has_punycode", "path_depth",
    "has_double_slash_in_path", "query_param_count",
)
# Heavy-tailed lexical features that are log-transformed before standardising.
LOG_FEATURES = (
    "url_length", "host_length", "path_length", "query_length",
    "num_dots", "num_hyphens", "num_underscores", "num_slashes", "num_question_marks",
    "num_equals", "num_amps", "num_ats", "num_percents", "num_digits",
    "num_subdomains", "subdomain_length_max", "path_depth", "query_param_count",
)

# --- Fixed values: limits and defaults ----------------------------------------------------
MAX_REQUEST_LENGTH = 5000
DISPLAY_PATH = 40
DISPLAY_TOTAL = 120
HTML_WINDOW = 10_000
NGRAM_SIZES = (3, 4)
SPLIT_SHARES = (("train", 0.8), ("val", 0.1), ("test", 0.1))
BENIGN_PER_MALICIOUS = 4
PERCENTILES = (50.0, 75.0, 90.0, 95.0, 99.0, 99.5, 99.9, 99.99)
SCORE_BINS = (
    ("[0.00,0.10)", 0.0, 0.1), ("[0.10,0.25)", 0.1, 0.25), ("[0.25,0.50)", 0.25, 0.5),
    ("[0.50,0.75)", 0.5, 0.75), ("[0.75,0.90)", 0.75, 0.9), ("[0.90,1.00]", 0.9, 1.0),
)
DOMAIN_SIZE_BUCKETS = (
    ("1", 1, 1), ("2-5", 2, 5), ("6-20", 6, 20), ("21-100", 21, 100), ("101-1K", 101, 1_000),
    ("1K-10K", 1_001, 10_000), ("10K-100K", 10_001, 100_000), (">100K", 100_001, None),
)
RISK_TIERS = ((25.0, "Low Risk"), (50.0, "Caution"), (75.0, "Suspicious"), (None, "High Risk"))
LABEL_SMOOTHING = 0.05
REQUESTS_PER_MINUTE = 10
MAX_SUBDOMAINS = 30
MAX_SITEMAPS_PER_HOST = 50
MAX_LINK_DEPTH = 3
REQUEST_GAP_SECONDS = 1.0
