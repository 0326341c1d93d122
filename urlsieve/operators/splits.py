"""Balancing, stratified and domain-honest splits, and checks on them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions.text import percent, text
from urlsieve.operators.lookups import HOT_SHARE, lookup_join
from urlsieve.operators.ranks import assign_by_rank, running, seeded_hash
from urlsieve.session import cut_lineage

# Domains of one size class are ranked in chunks of about this many.
CLASS_CHUNK = 50_000


def balance(
    df: DataFrame, keys: Sequence[str], label: str = "label",
    per_malicious: int = K.BENIGN_PER_MALICIOUS, seed: int = 42,
) -> DataFrame:
    """All malicious rows plus exactly ``per_malicious`` times as many benign ones.

    Benign rows are taken in a seeded order. Fails when there are too few of them.
    """
    malicious, benign = df.where(F.col(label) == 1), df.where(F.col(label) == 0)
    need = malicious.agg((F.count("*") * per_malicious).alias("_need"))
    enough = F.when(F.col("_need") <= F.col("_total"), F.col("_need")).otherwise(
        F.raise_error(text("not enough benign rows")).cast("long")
    )
    dealt = assign_by_rank(benign, keys, [label], [("in", enough)], seed, need, "_part")
    return dealt.where("_part = 'in'").drop("_part").unionByName(malicious)


def shuffled(df: DataFrame, keys: Sequence[str], seed: int = 43) -> DataFrame:
    """Repeatable global shuffle: a range-partitioned sort by a seeded hash."""
    return df.orderBy(seeded_hash(keys, seed), *keys)


def random_split(
    df: DataFrame, keys: Sequence[str], label: str = "label",
    shares: Sequence[tuple[str, float]] = K.SPLIT_SHARES, seed: int = 42,
) -> DataFrame:
    """Stratified split with exact sizes per label: floor of each share, the rest to the last."""
    cuts: list[tuple[str, Column]] = []
    last = F.lit(0).cast("long")
    for name, share in shares[:-1]:
        last = last + F.floor(F.lit(share) * F.col("_total"))
        cuts.append((name, last))
    cuts.append((shares[-1][0], F.col("_total")))
    return assign_by_rank(df, keys, [label], cuts, seed)


def deal_equal_items(deficits: list[float], size: int, count: int) -> list[int]:
    """How many of ``count`` equal items each bin gets when each item goes to the largest deficit.

    Taking every item whose deficit stays above a level is a prefix of the item-by-item order, so
    all but a handful are placed by arithmetic and the last few one by one.
    """
    placed = [0] * len(deficits)
    if count > 16:
        ordered = sorted(deficits, reverse=True)
        level = -math.inf
        for used in range(1, len(ordered) + 1):
            candidate = (sum(ordered[:used]) - count * size) / used
            if used == len(ordered) or candidate >= ordered[used]:
                level = candidate
                break
        level += len(deficits) * size
        placed = [max(0, math.ceil((d - level) / size)) for d in deficits]
    left = [d - k * size for d, k in zip(deficits, placed, strict=True)]
    for _ in range(count - sum(placed)):
        best = max(range(len(left)), key=lambda i: (left[i], -i))
        left[best] -= size
        placed[best] += 1
    return placed


def _pack_sizes(shares: Sequence[float]):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        total = int((pdf["size"] * pdf["domains"]).sum())
        left = [share * total for share in shares]
        cuts = []
        for size, count in zip(pdf["size"], pdf["domains"], strict=True):
            got = deal_equal_items(left, int(size), int(count))
            left = [d - g * int(size) for d, g in zip(left, got, strict=True)]
            cuts.append([sum(got[: i + 1]) for i in range(len(got))])
        return pdf[["majority", "size", "domains"]].assign(cuts=cuts)

    return pack


def domain_assignment(
    df: DataFrame, domain: str = "domain", label: str = "label",
    shares: Sequence[tuple[str, float]] = K.SPLIT_SHARES, seed: int = 42,
) -> DataFrame:
    """domain, size, majority, split: greedy packing of whole domains into splits.

    Per majority label, domains are dealt from the largest to the smallest, each to the split that
    lacks most rows. Domains of equal size are interchangeable, so the greedy runs over the
    histogram of sizes. With N rows there are at most sqrt(2N) distinct sizes, which bounds the
    only sequential step however many domains there are. Within a size class, a seeded hash order
    decides who goes where.
    """
    pool = df.groupBy(domain).agg(
        F.count("*").alias("size"), F.sum((F.col(label) == 1).cast("long")).alias("_mal")
    )
    pool = pool.select(
        domain, "size", (F.col("_mal") > F.col("size") - F.col("_mal")).cast("int").alias("majority")
    )
    classes = pool.groupBy("majority", "size").agg(F.count("*").alias("domains"))
    packed = classes.groupBy("majority").applyInPandas(
        _pack_sizes([s for _, s in shares]),
        "majority int, size long, domains long, cuts array<long>",
    )
    # bounded by 2 * sqrt(2N) rows, see above
    joined = pool.join(F.broadcast(packed), ["majority", "size"])
    hashed = joined.withColumn("_hash", seeded_hash([domain], seed))
    chunks = F.ceil(F.col("domains") / CLASS_CHUNK)
    position = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double") / float(1 << 32)
    ranked = running(
        hashed, [F.col("_hash"), F.col(domain)], F.floor(position * chunks),
        ["majority", "size"], {"_rank": F.lit(1)},
    )
    split = F
    for i, (name, _) in enumerate(shares):
        split = split.when(F.col("_rank") <= F.col("cuts")[i], name)
    return ranked.select(domain, "size", "majority", split.alias("split"))


def domain_split(
    df: DataFrame, domain: str = "domain", label: str = "label",
    shares: Sequence[tuple[str, float]] = K.SPLIT_SHARES, seed: int = 42,
) -> DataFrame:
    """Add ``split`` so that every registered domain lies in one split.

    The assignment (one row per domain) is stored. Domain sizes are known here, so when it is too
    large to broadcast, only the at most ``HOT_SHARE`` giant domains are, and the rest joins by
    shuffle.
    """
    assigned = cut_lineage(domain_assignment(df, domain, label, shares, seed))
    total = assigned.agg(F.sum("size").alias("_total"))
    hot = (
        assigned.crossJoin(F.broadcast(total))
        .where(F.col("size") * HOT_SHARE >= F.col("_total"))
        .select(domain)
    )
    return lookup_join(df, assigned.select(domain, "split"), domain, hot)


def split_stats(df: DataFrame, domain: str = "domain", label: str = "label") -> DataFrame:
    """Rows, shares, labels and distinct domains per mode and split."""
    # counting per domain first keeps the distinct count from shuffling every row
    per_domain = df.groupBy("mode", "split", domain).agg(
        F.count("*").alias("_n"), F.sum((F.col(label) == 1).cast("long")).alias("_mal")
    )
    counts = per_domain.groupBy("mode", "split").agg(
        F.sum("_n").alias("n"), F.sum("_mal").alias("label_1"), F.count("*").alias("domains")
    )
    total = counts.groupBy("mode").agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total), "mode").select(
        "mode", "split", "n", percent(F.col("n"), F.col("_all")).alias("pct"),
        (F.col("n") - F.col("label_1")).alias("label_0"), "label_1", "domains",
        percent(F.col("label_1"), F.col("n")).alias("label_1_pct"),
    )


def split_overlap(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Domains shared by each pair of splits, per mode; 0 everywhere for an honest split."""
    member = df.groupBy("mode", domain).agg(F.collect_set("split").alias("_in"))
    names = [name for name, _ in K.SPLIT_SHARES]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]

    def both(a: str, b: str) -> Column:
        return F.sum((F.array_contains("_in", a) & F.array_contains("_in", b)).cast("long"))

    wide = member.groupBy("mode").agg(*(both(a, b).alias(f"{a}_{b}") for a, b in pairs))
    return wide.select("mode", F.inline(F.array(*(
        F.struct(F.lit(f"{a}/{b}").alias("pair"), F.col(f"{a}_{b}").alias("shared_domains"))
        for a, b in pairs
    ))))

