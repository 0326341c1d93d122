"""Exact running totals over scores by a radix histogram, for any number of rows and groups.

A score's bits, read as a number that grows with the score, are cut into a digit of 16 bits and six of 8.
Counts per (cell, label) are mergeable, and their running sums over a cell's children (65,536 at first, then
256) are cheap. Cells that hold too many distinct scores are split by their next digit, and only those; after
the last digit a cell is one score. So what an ordinary window has to order is bounded, however scores crowd
together, and tables of cells stay small: only a cell of very many scores has 256 children.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsieve.operators.lookups import lookup_join
from urlsieve.session import cut_lineage

#: bits below the first digit, then below each further one
LEVELS = (48, 40, 32, 24, 16, 8, 0)
#: distinct scores that one window may order
CELL_SCORES = 1 << 17
_INFINITE = 0x7FF << 52


def ordered_bits(value: Column) -> Column:
    """A double's bits as a bigint that grows with it; both zeros are 0. Exact: all factors are powers of two."""
    x = value.cast("double")
    a = F.abs(x)

    def power(e: Column) -> Column:
        return F.pow(F.lit(2.0), e.cast("double"))

    near = F.floor(F.log2(a))
    fraction = a * power(-near)
    e = near + F.when(fraction >= 2, 1).when(fraction < 1, -1).otherwise(0)
    normal = F.shiftleft((e + 1023).cast("bigint"), 52) + ((a * power(-e) - 1) * float(1 << 52)).cast("bigint")
    half = float(1 << 537)
    size = (
        F.when(a == float("inf"), F.lit(_INFINITE).cast("bigint"))
        .when(a < 2.0**-1022, (a * half * half).cast("bigint")).otherwise(normal)
    )
    return F.when(x < 0, -size).otherwise(size)


def score_counts(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """``*groups, threshold, pos, neg``: rows per distinct score and label. Stored, so scores are read once."""
    positive = (F.col(label) == 1).cast("long")
    counts = df.groupBy(*groups, F.col(score).alias("threshold")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )
    return cut_lineage(counts)


def running_counts(counts: DataFrame, groups: Sequence[str] = (), cell_scores: int = CELL_SCORES) -> DataFrame:
    """Adds ``tp, fp`` (at or above a score) and ``n_pos, n_neg`` (in all) per group to :func:`score_counts`.

    NULL is a group like any other.
    """
    todo = counts.withColumns({
        "_key": ordered_bits(F.col("threshold")), "_tp": F.lit(0).cast("long"), "_fp": F.lit(0).cast("long"),
        "n_pos": F.lit(None).cast("long"), "n_neg": F.lit(None).cast("long"),
    })
    settled: list[DataFrame] = []
    for i, bits in enumerate(LEVELS):
        # children of the cells that are still open, with what lies above them inside their parent
        todo = todo.withColumn("_at", F.struct(*groups, F.lit(bits).alias("_bits"), F.shiftright("_key", bits).alias("_cell")))
        cells = todo.groupBy("_at").agg(F.count("*").alias("_n"), F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
        cell = F.col("_at")["_cell"]
        parent = [*(F.col("_at")[g] for g in groups), F.shiftright(cell, LEVELS[i - 1] - bits) if i else F.lit(0)]
        above = Window.partitionBy(*parent).orderBy(cell.desc()).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*parent)
        table = cut_lineage(cells.select(
            "_at", "_n", F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("_more_pos"),
            F.coalesce(F.sum("_neg").over(above), F.lit(0)).alias("_more_neg"),
            F.sum("_pos").over(whole).alias("_all_pos"), F.sum("_neg").over(whole).alias("_all_neg"),
        ))
        met = lookup_join(todo, table, "_at")
        open_cell = F.col("_n") > cell_scores
        stepped = met.select(
            *counts.columns, "_key", "_at", (F.col("_tp") + F.col("_more_pos")).alias("_tp"),
            (F.col("_fp") + F.col("_more_neg")).alias("_fp"), F.coalesce("n_pos", "_all_pos").alias("n_pos"),
            F.coalesce("n_neg", "_all_neg").alias("n_neg"), open_cell.alias("_open"),
        )
        if not bits or table.where(open_cell).isEmpty():
            settled.append(stepped.drop("_open"))
            break
        settled.append(stepped.where(~F.col("_open")).drop("_open"))
        todo = stepped.where("_open").drop("_open")
    rows = settled[0]
    for part in settled[1:]:
        rows = rows.unionByName(part)
    # the cell comes first: it tells rows apart at the first comparison of the sort
    cell = [F.col("_at")["_cell"], F.col("_at")["_bits"], *groups]
    inside = Window.partitionBy(*cell).orderBy(F.desc("_key"), F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        *counts.columns, (F.col("_tp") + F.sum("pos").over(inside)).alias("tp"),
        (F.col("_fp") + F.sum("neg").over(inside)).alias("fp"), "n_pos", "n_neg",
    )
