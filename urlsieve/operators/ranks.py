"""Exact ranks and running totals without putting a whole group into one task.

The order is cut into coarse buckets. Totals per bucket are tiny, so their running sums are cheap;
inside a bucket an ordinary window finishes the job. Where a row's bucket already settles the
answer, not even that window runs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_hash(keys: Sequence[str], seed: int) -> Column:
    """Repeatable pseudo-random order of rows, from a key that identifies a row."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def hash_bucket(hashed: Column) -> Column:
    """First 12 bits of a hex digest, as a number that grows with the digest."""
    return F.conv(F.substring(hashed, 1, 3), 16, 10).cast("int")


def running(
    df: DataFrame,
    order: Sequence[Column],
    bucket: Column,
    partition: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    few_buckets: bool = False,
) -> DataFrame:
    """Add running sums and maxima (inclusive) per partition along ``order``.

    ``bucket`` must grow with ``order``. Rows are shuffled once by partition and bucket; totals,
    offsets and the final window all reuse that exchange. ``few_buckets`` says that partitions
    times buckets is bounded by construction, so the offsets may be broadcast.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    keys = [*partition, "_bucket"]
    base = df.withColumn("_bucket", bucket)
    for name, col in {**sums, **maxima}.items():
        base = base.withColumn(f"_v_{name}", col)
    base = base.repartition(*keys)
    totals = base.groupBy(*keys).agg(
        *(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums),
        *(F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxima),
    )
    before = (
        Window.partitionBy(*partition).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys,
        *(F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums),
        *(F.max(f"_t_{n}").over(before).alias(f"_o_{n}") for n in maxima),
    )
    if few_buckets:
        offsets = F.broadcast(offsets)
    inside = (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    # NULL is a key like any other
    offsets = offsets.select(*(F.col(k).alias(f"_o_key_{k}") for k in keys), *(c for c in offsets.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_key_{k}"))
    out = base.join(offsets, same)
    for n in sums:
        out = out.withColumn(
            n, F.sum(f"_v_{n}").over(inside) + F.coalesce(F.col(f"_o_{n}"), F.lit(0))
        )
    for n in maxima:
        out = out.withColumn(
            n, F.greatest(F.max(f"_v_{n}").over(inside), F.col(f"_o_{n}"))
        )
    helpers = [c for c in out.columns if c.startswith(("_v_", "_o_"))] + ["_bucket"]
    return out.drop(*helpers)


def bucket_by_depth(
    df: DataFrame, value: str, bits: int = 10, rows: DataFrame | None = None
) -> DataFrame:
    """Add ``_depth``: the equal-depth bucket (of ``2**bits``) that a value falls into.

    The split points are approximate quantiles of the data, held in one array; the bucket is
    found by a binary search unrolled into ``bits`` projections. Which split points come out only
    decides how even the buckets are, never a result. When ``df`` is an aggregate, its input may be
    given as ``rows`` (with the same column): quantiles of rows need no shuffle, and a bucket has
    no more distinct values than rows.
    """
    n = 1 << bits
    splits = (df if rows is None else rows).agg(
        F.percentile_approx(value, [i / n for i in range(1, n)], n * 8).alias("_splits")
    )
    out = df.crossJoin(F.broadcast(splits)).withColumn("_depth", F.lit(0))
    step = n // 2
    while step:
        here = F.col("_depth")
        out = out.withColumn(
            "_depth",
            F.when(F.get("_splits", here + (step - 1)) < F.col(value), here + step).otherwise(here),
        )
        step //= 2
    return out.drop("_splits")


def bucket_ranges(df: DataFrame, groups: Sequence[str], hashed: str) -> DataFrame:
    """Rank range ``(_before, _upto]`` of every (group, hash bucket); groups must be few."""
    totals = df.groupBy(*groups, hash_bucket(F.col(hashed)).alias("_bucket")).agg(
        F.count("*").alias("_size")
    )
    upto = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    return totals.withColumn("_upto", F.sum("_size").over(upto)).withColumn(
        "_before", F.col("_upto") - F.col("_size")
    )


def assign_by_rank(
    df: DataFrame,
    keys: Sequence[str],
    groups: Sequence[str],
    cuts: Sequence[tuple[str, Column]],
    seed: int,
    limits: DataFrame | None = None,
    out: str = "split",
) -> DataFrame:
    """Deal the rows of each group, in seeded order, into named parts of exact sizes.

    ``keys`` identify a row. ``cuts`` are (name, last rank) in rising order, where the last rank is
    a Column over ``_total`` (rows of the group) and the one-row ``limits``; ranks beyond the last
    cut get NULL. Rows whose bucket lies inside one part, nearly all, are assigned by a broadcast
    of at most 4096 ranges per group and are never shuffled; only the buckets that a cut goes
    through are ranked by a window.
    """
    base = df.withColumn("_hash", seeded_hash(keys, seed)).withColumn(
        "_bucket", hash_bucket(F.col("_hash"))
    )
    slim = df.select(*groups, seeded_hash(keys, seed).alias("_hash"))
    ranges = bucket_ranges(slim, groups, "_hash").withColumn(
        "_total", F.max("_upto").over(Window.partitionBy(*groups))
    )
    if limits is not None:
        ranges = ranges.crossJoin(F.broadcast(limits))
    for i, (_, last) in enumerate(cuts):
        ranges = ranges.withColumn(f"_cut{i}", last)

    def part(rank: Column) -> Column:
        chain = F
        for i, (name, _) in enumerate(cuts):
            chain = chain.when(rank <= F.col(f"_cut{i}"), name)
        return chain.otherwise(F.lit(None).cast("string"))

    ranges = ranges.withColumn("_first", part(F.col("_before") + 1)).withColumn(
        "_last", part(F.col("_upto"))
    )
    # NULL is a group like any other
    ranges = ranges.withColumnsRenamed({k: f"_r_{k}" for k in (*groups, "_bucket")})
    same = F.lit(True)
    for k in (*groups, "_bucket"):
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    joined = base.join(F.broadcast(ranges), same)
    settled = F.col("_first").eqNullSafe(F.col("_last"))
    easy = joined.where(settled).select(*df.columns, F.col("_first").alias(out))
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_hash", *keys)
    hard = (
        joined.where(~settled)
        .withColumn("_rank", F.row_number().over(inside) + F.col("_before"))
        .select(*df.columns, part(F.col("_rank")).alias(out))
    )
    return easy.unionByName(hard)
