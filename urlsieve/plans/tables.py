"""Inputs of the named queries, derived by Spark from the driver's tables, with SQL twins.

``urls`` turns every page URL into a family of URLs that covers ports, user info, addresses,
Vietnamese hosts, punycode, malformed and over-long URLs and so on; it grows with ``pages``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.session import spread

BAD_HOST = "(pills|casino|adult|bets|spam|ads)"
# pages of one partition: as families of URLs, and as texts
FAMILY_PAGES, TEXT_PAGES = 1024, 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, spread over the cores for work on their HTML."""
    return spread(table(spark, sf_dir, "pages"))


# Each family member as a list of pieces: text, or a name in angle brackets for a derived column.
FAMILY: tuple[tuple[str, ...], ...] = (
    ("<url>",),
    ("HTTPS://WWW.", "<HOST>", "<tail>"),
    ("http://user:pw@", "<host>", ":8080", "<tail>", ";v=1#frag"),
    ("<host>", "<tail>"),
    ("http://", "<ip>", "/x?login=1"),
    ("http://999.1.1.", "<small>", "/verify/account.php?bank=1"),
    ("https://login.", "<label>", ".com.vn:443", "<tail>"),
    ("https://xn--", "<label>", ".co.uk//a//b/secure/login.php?account=1&account=2&&=x&b"),
    ("http://[fe80::", "<small>", "]:81/x"),
    ("http://[bad/", "<label>"),
    ("  \"https://vietcombank-", "<label>", ".xyz/setup.EXE\"\t"),
    ("ftp://", "<host>", "/a;b/file.tar.gz;type=i"),
    ("http://", "<host>", "/é?ü=²%zz&%C3%A9=1&a+b=2"),
    ("http://", "<host>", "/a\tb/\x01c"),
    ("https://", "<host>", "/", "<long>", ".png"),
    ("https://", "<label>", ".net",),
    ("http://localhost:3000/", "<label>"),
    ("",),
    ("https://blog.", "<label>", ".github.io/app.js/"),
    ("http://a.b.c.", "<label>", ".unlisted/x_y_z"),
    ("mailto:a@", "<host>"),
    ("http://", "<host>", ":80:90/bad-port"),
    ("https://shop.vn-abc.", "<label>", ".tk/wallet?reset=1#top"),
    ("HTTP://", "<HOST>", "/ABC"),
    ("https://evn.vnx.", "<label>", ".com/msb,ocb?q=a-bidv-b"),
    ("https://", "<label>", ".",),
    ("//", "<host>", "/protocol/relative?u=http://x.y/z"),
)


def family_column(pieces: tuple[str, ...]) -> Column:
    return F.concat(*(
        F.col("f_" + _column(p)) if p.startswith("<") else F.lit(p) for p in pieces
    ))


def _column(piece: str) -> str:
    return "host_upper" if piece == "<HOST>" else piece[1:-1]


def _family_sql(pieces: tuple[str, ...]) -> str:
    return " || ".join(
        "f_" + _column(p) if p.startswith("<") else "'" + p.replace("'", "''") + "'" for p in pieces
    )


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, variant, url, label: the labelled URL table."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url"), FAMILY_PAGES)
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    base = pages.withColumn("f_host", host).select(
        "page_id",
        F.col("url").alias("f_url"),
        "f_host",
        F.upper("f_host").alias("f_host_upper"),
        F.regexp_replace("url", "^[a-z]+://[^/?#]*", "").alias("f_tail"),
        F.concat(F.regexp_replace("f_host", "[.].*$", ""), F.lit("-"), F.col("page_id").cast("string"))
        .alias("f_label"),
        F.concat_ws(
            ".", F.element_at(F.array(*map(F.lit, ("10", "172", "192", "8"))),
                              (F.col("page_id") % 4 + 1).cast("int")),
            ((F.col("page_id") * 7) % 256).cast("string"),
            ((F.col("page_id") * 13) % 256).cast("string"),
            (F.col("page_id") % 256).cast("string"),
        ).alias("f_ip"),
        (F.col("page_id") % 9 + 1).cast("string").alias("f_small"),
        F.repeat(F.concat(F.lit("ab1-"), F.col("page_id").cast("string")), 60).alias("f_long"),
        F.when(F.col("f_host").rlike(BAD_HOST), 1).otherwise(0).alias("label"),
    )
    family = F.array(*(family_column(p) for p in FAMILY))
    return base.select("page_id", "label", F.posexplode(family).alias("variant", "url")).select(
        "page_id", "variant", "url", "label"
    )


URLS_SQL = f"""
family AS (
  SELECT page_id, url AS f_url,
         regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS f_host,
         upper(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS f_host_upper,
         regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS f_tail,
         regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '[.].*$', '')
           || '-' || page_id AS f_label,
         (['10','172','192','8'])[1 + page_id % 4] || '.' || (page_id * 7) % 256 || '.'
           || (page_id * 13) % 256 || '.' || page_id % 256 AS f_ip,
         (page_id % 9 + 1)::VARCHAR AS f_small,
         repeat('ab1-' || page_id, 60) AS f_long,
         CASE WHEN regexp_matches(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '{BAD_HOST}')
              THEN 1 ELSE 0 END AS label
  FROM pages),
urls AS (
  SELECT page_id, unnest(range({len(FAMILY)}))::INT AS variant,
         unnest([{", ".join(_family_sql(p) for p in FAMILY)}]) AS url, label
  FROM family)"""
