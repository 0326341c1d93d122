"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.functions import urls as U
from urlsieve.session import cut_lineage

# A key is "hot" when it holds at least 1/HOT_SHARE of all rows, so there are at most HOT_SHARE
# hot keys whatever the data: that bound is what makes broadcasting them safe.
HOT_SHARE = 2000
SALTS = 64


def hot_keys(rows: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys that hold at least ``1/share`` of the rows; at most ``share`` of them exist."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_total"))
    return (
        counts.crossJoin(F.broadcast(total))
        .where(F.col("_n") * share >= F.col("_total"))
        .select(key)
    )


# Largest table that is broadcast, measured as bytes of JSON text.
BROADCAST_BYTES = 64 << 20


def stored_bytes(df: DataFrame) -> int:
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("b")).first()["b"]
    return size or 0


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure a stored table; true when every executor can hold a copy."""
    return stored_bytes(df) <= limit


def unused_names(taken: list[str], *wanted: str) -> list[str]:
    """Helper column names that clash with none of ``taken``, in any case."""
    lower, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in lower:
            name += "_"
        lower.add(name.lower())
        out.append(name)
    return out


def lookup_join(
    rows: DataFrame, dim: DataFrame, key: str, hot: DataFrame | None = None,
    share: int = HOT_SHARE, limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join with a side that has one row per key, exact under any skew of ``rows``.

    ``dim`` is stored, then measured: a table within ``limit`` is broadcast and the rows are not
    shuffled at all. Beyond that, rows of hot keys meet a broadcast of the hot part of ``dim``,
    which has at most ``share`` rows, and never shuffle by their key; all other rows join by
    shuffle, where no key holds more than ``1/share`` of them. Should even the hot part's rows be
    too wide to broadcast, it is repeated under salts instead, and hot rows are dealt over them.
    """
    dim = cut_lineage(dim)
    values = [c for c in dim.columns if c != key]
    if fits_broadcast(dim, limit):
        return rows.join(F.broadcast(dim), key, "left").select(*rows.columns, *values)
    hot = hot_keys(rows, key, share) if hot is None else hot
    hot_key, hot_value, salt, cold_key, cold_salt, cold = unused_names(
        rows.columns, "_hot_key", "_hot", "_salt", "_cold_key", "_cold_salt", "_cold")
    hot_part = cut_lineage(dim.join(F.broadcast(hot), key, "left_semi").select(
        F.col(key).alias(hot_key), F.struct(*values).alias(hot_value)))
    pick = F.coalesce(hot_value, cold)
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(1_000_000)).cast("int")
    if not fits_broadcast(hot_part, limit):
        marks = F.broadcast(hot_part.select(hot_key))  # at most ``share`` keys
        marked = rows.join(marks, F.col(key) == F.col(hot_key), "left").withColumn(
            salt, F.when(F.col(hot_key).isNull(), F.lit(0)).otherwise(spread % SALTS + 1)).drop(hot_key)
        copies = hot_part.select(F.col(hot_key).alias(cold_key), F.explode(F.sequence(F.lit(1), F.lit(SALTS))).alias(cold_salt), F.col(hot_value).alias(cold))
        plain = dim.select(F.col(key).alias(cold_key), F.lit(0).alias(cold_salt), F.struct(*values).alias(cold))
        match = (F.col(key) == F.col(cold_key)) & (F.col(salt) == F.col(cold_salt))
        return marked.join(plain.unionByName(copies), match, "left").select(*rows.columns, *(F.col(cold)[v].alias(v) for v in values))
    first = rows.join(F.broadcast(hot_part), F.col(key) == F.col(hot_key), "left")
    # open rows keep salt 0 and can match; resolved ones get a salt that spreads them and never does.
    # The salt is a hash of the row, so that a repeated task deals its rows as before.
    open_row = F.col(hot_value).isNull() & F.col(key).isNotNull()
    salted = first.withColumn(salt, F.when(open_row, F.lit(0)).otherwise(spread + 1))
    plain = dim.select(
        F.col(key).alias(cold_key), F.lit(0).alias(cold_salt),
        F.struct(*values).alias(cold),
    )
    match = (F.col(key) == F.col(cold_key)) & (F.col(salt) == F.col(cold_salt))
    return salted.join(plain, match, "left").select(
        *rows.columns, *(pick[v].alias(v) for v in values)
    )


def candidate_suffixes(host: Column) -> Column:
    """A host and everything after each of its dots: ``a.b.c`` gives a.b.c, b.c and c."""
    labels = F.split(host, "\\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )


def longest_suffix(rows: DataFrame, host: str, suffixes: DataFrame) -> DataFrame:
    """Add the longest listed suffix of a host from a suffix table of any size.

    Works on the distinct hosts: their candidate suffixes meet the table in an equi-join, so there
    is no comparison of every host with every suffix, then the answer goes back to the rows.
    """
    hosts = rows.select(host).where(F.col(host) != "").distinct()
    tried = hosts.select(host, F.explode(candidate_suffixes(F.col(host))).alias("suffix"))
    best = (
        tried.join(suffixes.select("suffix").distinct(), "suffix")
        .groupBy(host)
        .agg(F.max(F.struct(F.length("suffix").alias("n"), "suffix"))["suffix"].alias("suffix"))
    )
    return lookup_join(rows, best, host)


def match_networks(rows: DataFrame, host: str, networks: DataFrame) -> DataFrame:
    """Rows whose host is an address inside a listed IPv4 network, with the network.

    The range join becomes an equi-join on (prefix length, network number): a row probes each
    prefix length once, at most 33 of them, instead of every network.
    """
    bits = F.substring_index("cidr", "/", -1).cast("int")
    nets = networks.select(
        "cidr",
        bits.alias("_bits"),
        F.shiftrightunsigned(U.ip_number(F.substring_index("cidr", "/", 1)), 0).alias("_first"),
    ).withColumn("_net", F.expr("shiftright(_first, 32 - _bits)")).drop("_first")
    lengths = F.broadcast(nets.agg(F.collect_set("_bits").alias("_lengths")))
    probes = (
        rows.withColumn("_ip", U.ip_number(F.col(host)))
        .where(F.col("_ip").isNotNull())
        .crossJoin(lengths)
        .withColumn("_bits", F.explode("_lengths"))
        .withColumn("_net", F.expr("shiftright(_ip, 32 - _bits)"))
    )
    return probes.join(nets, ["_bits", "_net"]).select(*rows.columns, "cidr")
