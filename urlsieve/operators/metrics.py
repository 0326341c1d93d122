"""Evaluation of score tables: thresholds, curves, areas, confusion counts, histograms.

A score table has a probability and a 0/1 label. Exact curves are computed on distinct scores:
equal scores collapse map-side, and the running totals over the rest are distributed (``curves``).
Group columns give one curve for each of their values, all in the same jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions import risk
from urlsieve.functions.text import ratio
from urlsieve.operators.curves import running_counts, score_counts
from urlsieve.session import inline_table


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F1 and false-positive rate; a zero denominator gives 0."""
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "precision": precision, "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
        "fpr": ratio(fp, fp + tn),
    }


def with_rates(df: DataFrame) -> DataFrame:
    parts = df.withColumns({
        k: v for k, v in rates(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))).items()
        if k in ("precision", "recall", "fpr")
    })
    p, r = F.col("precision"), F.col("recall")
    return parts.withColumn("f1", ratio(2 * p * r, p + r))


def confusion(
    df: DataFrame, threshold: float | Column = 0.5, score: str = "score", label: str = "label",
    groups: Sequence[str] = (),
) -> DataFrame:
    """tp, fp, fn, tn at a threshold (inclusive), with the rates, over ``scored_rows``."""
    df = scored_rows(df, score, label)
    hit, real = F.col(score) >= threshold, F.col(label) == 1

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0))

    return with_rates(df.groupBy(*groups).agg(
        count(hit & real).alias("tp"), count(hit & ~real).alias("fp"),
        count(~hit & real).alias("fn"), count(~hit & ~real).alias("tn"),
    ))


def classification_report(
    df: DataFrame, threshold: float = 0.5, score: str = "score", label: str = "label",
    names: tuple[str, str] = ("benign", "phish"),
) -> DataFrame:
    """Per-class precision, recall, F1 and support, then accuracy, macro and weighted means."""
    c = confusion(df, threshold, score, label)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    pos, neg = rates(tp, fp, fn, tn), rates(tn, fn, fp, tp)
    n_neg, n_pos = tn + fp, tp + fn
    total = n_neg + n_pos
    measures = ("precision", "recall", "f1")
    right = ratio(tp + tn, total)

    def row(name: str, values: Sequence[Column], support: Column) -> Column:
        return F.struct(F.lit(name).alias("class"),
                        *(v.alias(m) for v, m in zip(values, measures, strict=True)),
                        support.alias("support"))

    return c.select(F.inline(F.array(
        row(names[0], [neg[m] for m in measures], n_neg),
        row(names[1], [pos[m] for m in measures], n_pos),
        row("accuracy", [F.lit(None).cast("double"), F.lit(None).cast("double"), right], total),
        row("macro avg", [(neg[m] + pos[m]) / 2 for m in measures], total),
        row("weighted avg", [ratio(neg[m] * n_neg + pos[m] * n_pos, total) for m in measures], total),
    )))


# --- curves over distinct scores ----------------------------------------------------------

def scored_rows(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Rows that metrics count: those with a label and a score; NULL and NaN are no score."""
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))


def cumulative(
    df: DataFrame, score: str = "score", label: str = "label", groups: Sequence[str] = (),
) -> DataFrame:
    """threshold, pos, neg (at that score), tp, fp (at or above it), n_pos, n_neg (in all), per group."""
    return running_counts(score_counts(scored_rows(df, score, label), score, label, groups), groups)


def areas_of(points: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Areas from the rows of :func:`cumulative`."""
    tp, fp, pos, neg = (F.col(x).cast("double") for x in ("tp", "fp", "pos", "neg"))
    sums = points.groupBy(*groups).agg(
        F.sum(neg * (tp - pos / 2)).alias("_wins"),
        F.sum(pos * tp / (tp + fp)).alias("_steps"),
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
    )
    return sums.select(
        *groups, "n_pos", "n_neg",
        ratio(F.col("_wins"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("roc_auc"),
        ratio(F.col("_steps"), F.col("n_pos")).alias("pr_auc"),
    )


def curve_areas(
    df: DataFrame, score: str = "score", label: str = "label", groups: Sequence[str] = (),
) -> DataFrame:
    """ROC area (ties count half) and average precision (a step sum, not a trapezoid), per group."""
    return areas_of(cumulative(df, score, label, groups), groups)


def points_of(rows: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates at each distinct score, from the rows of :func:`cumulative`."""
    return with_rates(rows.select(
        *groups, "threshold", "tp", "fp", (F.col("n_pos") - F.col("tp")).alias("fn"),
        (F.col("n_neg") - F.col("fp")).alias("tn"),
    ))


def curve_points(
    df: DataFrame, score: str = "score", label: str = "label", groups: Sequence[str] = (),
) -> DataFrame:
    """One point per distinct score: what precision-recall and ROC plots draw."""
    return points_of(cumulative(df, score, label, groups), groups)


# --- threshold grid -----------------------------------------------------------------------

def threshold_sweep(
    df: DataFrame, score: str = "score", label: str = "label", points: int = 99
) -> DataFrame:
    """Confusion counts and rates at thresholds k / (points + 1), score >= threshold.

    Each score falls into the last grid point it reaches; counting per grid point and summing
    backwards over at most ``points + 1`` rows replaces a comparison with every threshold. Rows
    without a score or label (NULL, NaN) are not counted.
    """
    df = scored_rows(df, score, label)
    cells = points + 1

    def grid(k: Column) -> Column:
        return k.cast("double") / F.lit(float(cells))

    s = F.col(score)
    near = F.floor(s * cells)
    # the product may be off by one unit in the last place, so compare with the grid itself
    reached = F.when(s >= grid(near + 1), near + 1).when(s < grid(near), near - 1).otherwise(near)
    positive = (F.col(label) == 1).cast("long")
    cell = F.greatest(F.least(reached, F.lit(points)), F.lit(0)).cast("long")
    counts = df.groupBy(cell.alias("k")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )
    frame = df.sparkSession.range(0, cells).withColumnRenamed("id", "k")
    full = frame.join(F.broadcast(counts), "k", "left").fillna(0, ["pos", "neg"])
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(1))
    summed = full.select(
        "k", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(whole).alias("n_pos"), F.sum("neg").over(whole).alias("n_neg"),
    )
    return with_rates(summed.where("k > 0").select(
        F.round(grid(F.col("k")), 4).alias("threshold"), "tp", "fp",
        (F.col("n_pos") - F.col("tp")).alias("fn"), (F.col("n_neg") - F.col("fp")).alias("tn"),
    ))


POINT = ("threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr")


def operating_points(
    rows: DataFrame, precision_floor: float = 0.99, recall_floor: float = 0.99,
    degrade: bool = True, groups: Sequence[str] = (),
) -> DataFrame:
    """The default, safer and precise operating points of a sweep or of curve points, per group.

    default: best F1 (lowest threshold among equals). safer: lowest threshold that keeps the
    precision floor. precise: highest threshold that keeps the recall floor. When no row keeps a
    floor: the row of best recall or precision (``degrade``), else the default point.
    """
    point = F.struct(*POINT)
    low = -F.col("threshold")

    def best(rank: Column, condition: Column | None = None) -> Column:
        value = F.struct(rank.alias("r"), low.alias("t"), point.alias("p"))
        return F.max(value if condition is None else F.when(condition, value))["p"]

    default = best(F.col("f1"))
    safer = best(low, F.col("precision") >= precision_floor)
    precise = best(F.col("threshold"), F.col("recall") >= recall_floor)
    safer_else = best(F.col("recall")) if degrade else default
    precise_else = best(F.col("precision")) if degrade else default
    picked = rows.groupBy(*groups).agg(
        default.alias("default"), F.coalesce(safer, safer_else).alias("safer"),
        F.coalesce(precise, precise_else).alias("precise"),
    )
    return picked.select(*groups, F.inline(F.array(*(
        F.struct(F.lit(op).alias("op"), *(F.col(op)[c].alias(c) for c in POINT))
        for op in ("default", "safer", "precise")
    ))))


def results_by_split(
    df: DataFrame, score: str = "score", label: str = "label", mode: str = "mode", split: str = "split", tuned_on: str = "val",
    precision_floor: float = 0.99, recall_floor: float = 0.99, digits: int | None = None,
) -> DataFrame:
    """The evaluation table: one row per (mode, split, operating point).

    Thresholds are the exact operating points of a mode's ``tuned_on`` rows and are applied to all its
    splits. With them come the areas and counts of each split. Scores are read once: curves of all
    modes and splits are grouped, and counts at the thresholds are one aggregation of distinct scores.
    A mode without tuning rows has no rows. ``digits`` rounds rates before they are compared.
    """
    keys = (mode, split)
    counts = score_counts(scored_rows(df, score, label), score, label, keys)
    curve = running_counts(counts, keys)
    tuning = points_of(curve.where(F.col(split) == tuned_on).drop(split), (mode,))
    if digits is not None:
        tuning = tuning.withColumns({c: F.round(c, digits) for c in ("precision", "recall", "f1", "fpr")})
    # three rows per mode
    tuned = operating_points(tuning, precision_floor, recall_floor, groups=(mode,)).select(
        F.col(mode).alias("_mode"), "op", F.col("threshold").alias("_cut"))
    hit = F.col("threshold") >= F.col("_cut")
    some = lambda c, where: F.sum(F.when(where, F.col(c)).otherwise(0))
    at = counts.join(F.broadcast(tuned), F.col(mode).eqNullSafe(F.col("_mode"))).groupBy(*keys, "op").agg(
        F.first("_cut").alias("threshold"), some("pos", hit).alias("tp"), some("neg", hit).alias("fp"),
        some("pos", ~hit).alias("fn"), some("neg", ~hit).alias("tn"))
    areas = areas_of(curve, keys).withColumnsRenamed({mode: "_mode", split: "_split"})
    same = F.col(mode).eqNullSafe(F.col("_mode")) & F.col(split).eqNullSafe(F.col("_split"))
    return with_rates(at).join(F.broadcast(areas), same).select(
        *keys, "op", (F.col("n_pos") + F.col("n_neg")).alias("n_samples"), "n_pos", "n_neg", "roc_auc", "pr_auc", *POINT)


def resolve_thresholds(requests: DataFrame, table: DataFrame) -> DataFrame:
    """Threshold per request: its own, else the tuned one of its (mode, op), else 0.5."""
    tuned = table.select("mode", "op", F.col("threshold").alias("_tuned"))
    joined = requests.join(tuned, ["mode", "op"], "left")
    source = (
        F.when(F.col("custom").isNotNull(), "custom")
        .when(F.col("_tuned").isNotNull(), "table").otherwise("fallback")
    )
    return joined.select(
        *requests.columns, F.coalesce("custom", "_tuned", F.lit(0.5)).alias("threshold"),
        source.alias("threshold_source"),
    )


# --- other summaries ----------------------------------------------------------------------

def score_histogram(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Six fixed bins (the last one closed), counted for all rows and per label."""
    s, bin_no = F.col(score), F
    for i, (_, low, high) in enumerate(K.SCORE_BINS):
        last = i == len(K.SCORE_BINS) - 1
        bin_no = bin_no.when((s >= low) & ((s <= high + 1e-9) if last else (s < high)), i)
    counts = df.groupBy(bin_no.otherwise(F.lit(None).cast("int")).alias("position")).agg(
        F.count("*").alias("all"),
        F.sum((F.col(label) == 1).cast("long")).alias("label_1"),
        F.sum((F.col(label) == 0).cast("long")).alias("label_0"),
    )
    bins = inline_table(df.sparkSession, ["position", "bin"],
                        [(i, name) for i, (name, _, _) in enumerate(K.SCORE_BINS)])
    return bins.join(F.broadcast(counts), "position", "left").fillna(0)


def smoothed_bce(
    df: DataFrame, logit: str = "logit", label: str = "label", pos_weight: float | Column = 1.0,
    epsilon: float = K.LABEL_SMOOTHING,
) -> DataFrame:
    """Mean weighted cross-entropy of logits against smoothed labels."""
    z, y = F.col(logit), risk.smooth(F.col(label), epsilon)
    weight = F.lit(pos_weight) if isinstance(pos_weight, (int, float)) else pos_weight
    loss = weight * y * risk.softplus(-z) + (1 - y) * risk.softplus(z)
    return df.agg(F.count("*").alias("n"), F.avg(loss).alias("loss"))


def smoothed_rows(
    df: DataFrame, label: str = "label", pos_weight: float = 1.0,
    epsilon: float = K.LABEL_SMOOTHING,
) -> DataFrame:
    """Each row twice, as positive and as negative, weighted so that a weighted classifier
    minimises exactly the smoothed loss."""
    y = risk.smooth(F.col(label), epsilon)
    others = [c for c in df.columns if c != label]
    pair = F.array(
        F.struct(F.lit(1).alias(label), (F.lit(pos_weight) * y).alias("weight")),
        F.struct(F.lit(0).alias(label), (1 - y).alias("weight")),
    )
    return df.select(*others, F.inline(pair))


def compare_scorers(
    df: DataFrame, first: str, second: str, label: str = "label", threshold: float = 0.5,
    tolerance: float = 0.005,
) -> DataFrame:
    """F1 of two scorers on the same rows, their difference, and the gap between the scores."""
    real = F.col(label) == 1

    def counts(score: str) -> list[Column]:
        hit = F.col(score) >= threshold
        return [F.coalesce(F.sum((hit & real).cast("long")), F.lit(0)),
                F.coalesce(F.sum((hit & ~real).cast("long")), F.lit(0)),
                F.coalesce(F.sum((~hit & real).cast("long")), F.lit(0))]

    gap = F.abs(F.col(first) - F.col(second))
    names = [f"{c}_{i}" for i in (1, 2) for c in ("tp", "fp", "fn")]
    sums = df.agg(
        F.count("*").alias("n"),
        *(c.alias(n) for c, n in zip(counts(first) + counts(second), names, strict=True)),
        F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"),
    )
    f1 = {
        i: ratio(2 * F.col(f"tp_{i}"), 2 * F.col(f"tp_{i}") + F.col(f"fp_{i}") + F.col(f"fn_{i}"))
        for i in (1, 2)
    }
    delta = f1[2] - f1[1]
    return sums.select("n", f1[1].alias("f1_first"), f1[2].alias("f1_second"), delta.alias("delta"),
                       (F.abs(delta) < tolerance).alias("passed"), "max_gap", "mean_gap")


def early_stop(
    epochs: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "metric",
    patience: int = 3, min_gain: float = 1e-6,
) -> DataFrame:
    """Best epoch of each training run and the epoch at which patience runs out (NULL if never).

    A run has as many rows as it has epochs, so folding them in order inside one row is bounded.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(metric).alias("m"))))
    start = F.struct(
        F.lit(float("-inf")).alias("best"), F.lit(None).cast("long").alias("best_epoch"),
        F.lit(0).alias("waited"), F.lit(None).cast("long").alias("stopped"),
    )

    def step(state: Column, row: Column) -> Column:
        better = row["m"] > state["best"] + min_gain
        waited = F.when(better, F.lit(0)).otherwise(state["waited"] + 1)
        moved = F.struct(
            F.when(better, row["m"]).otherwise(state["best"]).alias("best"),
            F.when(better, row["e"].cast("long")).otherwise(state["best_epoch"]).alias("best_epoch"),
            waited.alias("waited"),
            F.when(waited >= patience, row["e"].cast("long")).alias("stopped"),
        )
        return F.when(state["stopped"].isNotNull(), state).otherwise(moved)

    folded = epochs.groupBy(run).agg(F.aggregate(steps, start, step).alias("s"))
    return folded.select(run, F.col("s.best").alias("best_metric"),
                         F.col("s.best_epoch").alias("best_epoch"),
                         F.col("s.stopped").alias("stopped_epoch"))
