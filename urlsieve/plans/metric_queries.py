"""Evaluation queries over score tables made from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions import risk
from urlsieve.operators import metrics as M
from urlsieve.plans import sqlkit as Q
from urlsieve.plans.registry import query
from urlsieve.plans.tables import table
from urlsieve.session import inline_table

# ``score`` has 50 distinct values with many ties, ``fine`` nearly as many as there are rows.
SCORES = """s AS (SELECT l_orderkey, l_linenumber, (l_returnflag = 'R')::INT AS label, l_quantity / 50 AS score,
  least(l_extendedprice / 100000, 1.0) AS fine, (l_quantity - 25) / 10 AS logit FROM lineitem)"""
WITH = "WITH " + SCORES


def scores(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_quantity") / 50).alias("score"),
        F.least(F.col("l_extendedprice") / 100000, F.lit(1.0)).alias("fine"),
        ((F.col("l_quantity") - 25) / 10).alias("logit"),
    )


def rounded(df, *exact):
    return df.select(*(F.col(c) if c in exact or t not in ("double",) else F.round(c, 6).alias(c)
                       for c, t in df.dtypes))


P_, R_ = Q.ratio("tp", "tp + fp"), Q.ratio("tp", "tp + fn")
RATES = (f"round({P_}, 6) AS precision, round({R_}, 6) AS recall, "
         f"round({Q.ratio(f'2 * {P_} * {R_}', f'{P_} + {R_}')}, 6) AS f1, round({Q.ratio('fp', 'fp + tn')}, 6) AS fpr")


def counts_sql(score: str, thr: str) -> str:
    return (f"count(*) FILTER ({score} >= {thr} AND label = 1) AS tp, count(*) FILTER ({score} >= {thr} AND label = 0) AS fp, "
            f"count(*) FILTER ({score} < {thr} AND label = 1) AS fn, count(*) FILTER ({score} < {thr} AND label = 0) AS tn")


@query("confusion_matrix", f"{WITH}, c AS (SELECT {counts_sql('score', '0.5')} FROM s) SELECT *, {RATES} FROM c")
def confusion_matrix(spark, sf):
    return rounded(M.confusion(scores(spark, sf)))


def _class_sql(tp, fp, fn):
    p, r = Q.ratio(tp, f"{tp} + {fp}"), Q.ratio(tp, f"{tp} + {fn}")
    return p, r, Q.ratio(f"2 * {p} * {r}", f"{p} + {r}")


_NEG, _POS = _class_sql("tn", "fn", "fp"), _class_sql("tp", "fp", "fn")


@query("classification_report", f"""{WITH}, c AS (SELECT {counts_sql('score', '0.5')} FROM s),
r AS (SELECT {', '.join(f'{v} AS {n}0' for n, v in zip('prf', _NEG))}, {', '.join(f'{v} AS {n}1' for n, v in zip('prf', _POS))},
      tn + fp AS s0, tp + fn AS s1, {Q.ratio('tp + tn', 'tp + tn + fp + fn')} AS acc FROM c)
SELECT 'benign' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM r
UNION ALL SELECT 'phish', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM r
UNION ALL SELECT 'accuracy', NULL, NULL, round(acc, 6), s0 + s1 FROM r
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), s0 + s1 FROM r
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / (s0 + s1), 6), round((r0 * s0 + r1 * s1) / (s0 + s1), 6),
  round((f0 * s0 + f1 * s1) / (s0 + s1), 6), s0 + s1 FROM r""")
def classification_report(spark, sf):
    return rounded(M.classification_report(scores(spark, sf)))


def curve_ctes(score: str) -> str:
    return f"""{WITH},
d AS (SELECT {score} AS threshold, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM s GROUP BY {score}),
k AS MATERIALIZED (SELECT threshold, pos, neg, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp,
  (sum(pos) OVER ())::BIGINT AS n_pos, (sum(neg) OVER ())::BIGINT AS n_neg FROM d WINDOW w AS (ORDER BY threshold DESC)),
pts AS MATERIALIZED (SELECT threshold, tp, fp, n_pos - tp AS fn, n_neg - fp AS tn FROM k)"""


def _area(score: str, expr: str, name: str) -> str:
    return f"{curve_ctes(score)} SELECT max(n_pos) AS n_pos, max(n_neg) AS n_neg, round({expr}, 6) AS {name} FROM k"


_ROC = "sum(neg::DOUBLE * (tp - pos / 2.0::DOUBLE)) / (max(n_pos)::DOUBLE * max(n_neg))"
_AP = "sum(pos::DOUBLE * tp / (tp + fp)) / max(n_pos)"


@query("roc_auc", _area("score", _ROC, "roc_auc"))
def roc_auc(spark, sf):
    return rounded(M.curve_areas(scores(spark, sf)).drop("pr_auc"))


@query("pr_auc", _area("score", _AP, "pr_auc"))
def pr_auc(spark, sf):
    return rounded(M.curve_areas(scores(spark, sf)).drop("roc_auc"))


@query("curve_areas_fine", f"""{curve_ctes('fine')}
SELECT max(n_pos) AS n_pos, max(n_neg) AS n_neg, round({_ROC}, 6) AS roc_auc, round({_AP}, 6) AS pr_auc FROM k""")
def curve_areas_fine(spark, sf):
    return rounded(M.curve_areas(scores(spark, sf), "fine"))


@query("roc_curve", f"""{curve_ctes('fine')}
SELECT threshold, round({Q.ratio('fp', 'fp + tn')}, 6) AS fpr, round({Q.ratio('tp', 'tp + fn')}, 6) AS tpr FROM pts""")
def roc_curve(spark, sf):
    points = M.curve_points(scores(spark, sf), "fine")
    return points.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("recall", 6).alias("tpr"))


@query("pr_curve", f"{curve_ctes('fine')} SELECT threshold, round({P_}, 6) AS precision, round({R_}, 6) AS recall FROM pts")
def pr_curve(spark, sf):
    points = M.curve_points(scores(spark, sf), "fine")
    return points.select("threshold", F.round("precision", 6).alias("precision"),
                         F.round("recall", 6).alias("recall"))


SWEEP = f"""{WITH}, sweep AS MATERIALIZED (
  SELECT *, {RATES} FROM (SELECT t.k / 100.0::DOUBLE AS threshold, {counts_sql('fine', '(t.k / 100.0::DOUBLE)')}
  FROM range(1, 100) t(k), s GROUP BY t.k))"""


@query("threshold_sweep", f"{SWEEP} SELECT * FROM sweep")
def threshold_sweep(spark, sf):
    return rounded(M.threshold_sweep(scores(spark, sf), "fine"))


_COLS = "threshold, tp, fp, fn, tn, precision, recall, f1, fpr"


def points_sql(rows: str, pf: float, rf: float, safer_else: str, precise_else: str) -> str:
    def pick(where: str, order: str, op: str) -> str:
        return f"(SELECT '{op}' AS op, {_COLS} FROM {rows} WHERE {where} ORDER BY {order} LIMIT 1)"

    default = "f1 DESC, threshold"
    safer_any, precise_any = f"EXISTS (SELECT 1 FROM {rows} WHERE precision >= {pf})", f"EXISTS (SELECT 1 FROM {rows} WHERE recall >= {rf})"
    return " UNION ALL ".join([
        pick("true", default, "default"),
        pick(f"precision >= {pf}", "threshold", "safer"), pick(f"NOT {safer_any}", safer_else, "safer"),
        pick(f"recall >= {rf}", "threshold DESC", "precise"), pick(f"NOT {precise_any}", precise_else, "precise"),
    ])


@query("operating_points", f"""{SWEEP} {points_sql('sweep', 0.99, 0.99, 'recall DESC, threshold', 'precision DESC, threshold')}""")
def operating_points(spark, sf):
    sweep = rounded(M.threshold_sweep(scores(spark, sf), "fine"))
    return M.operating_points(sweep)


@query("operating_points_floors", f"""{SWEEP} {points_sql('sweep', 0.25, 0.4, 'recall DESC, threshold', 'precision DESC, threshold')}""")
def operating_points_floors(spark, sf):
    sweep = rounded(M.threshold_sweep(scores(spark, sf), "fine"))
    return M.operating_points(sweep, 0.25, 0.4)


@query("operating_points_exact", f"""{curve_ctes('fine')}, r AS MATERIALIZED (SELECT *, {RATES} FROM pts)
{points_sql('r', 0.99, 0.99, 'f1 DESC, threshold', 'f1 DESC, threshold')}""")
def operating_points_exact(spark, sf):
    points = rounded(M.curve_points(scores(spark, sf), "fine"), "threshold")
    return M.operating_points(points, degrade=False)


# Two modes of splitting the same rows: by row and by order.
_PARTS = """SELECT *, CASE WHEN part < 6 THEN 'train' WHEN part < 8 THEN 'val' ELSE 'test' END AS split FROM (
  SELECT 'random' AS mode, (l_orderkey + l_linenumber) % 10 AS part, label, fine FROM s
  UNION ALL SELECT 'domain', l_orderkey % 10, label, fine FROM s)"""


def mode_rows(spark, sf):
    rows = scores(spark, sf)
    part = F.when(F.col("part") < 6, "train").when(F.col("part") < 8, "val").otherwise("test")
    modes = [rows.select(F.lit(m).alias("mode"), p.alias("part"), "label", "fine")
             for m, p in (("random", (F.col("l_orderkey") + F.col("l_linenumber")) % 10), ("domain", F.col("l_orderkey") % 10))]
    return modes[0].unionByName(modes[1]).withColumn("split", part)


def _by_mode_sql(pf: float, rf: float) -> str:
    def pick(where: str, order: str, op: str) -> str:
        return (f"SELECT mode, '{op}' AS op, threshold FROM r WHERE split = 'val' AND {where} "
                f"QUALIFY row_number() OVER (PARTITION BY mode ORDER BY {order}) = 1")

    some = "EXISTS (SELECT 1 FROM r q WHERE q.split = 'val' AND q.mode = r.mode AND q.{} >= {})"
    safer, precise = some.format("precision", pf), some.format("recall", rf)
    return f"""{WITH}, m AS MATERIALIZED ({_PARTS}),
d AS (SELECT mode, split, fine AS threshold, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM m GROUP BY ALL),
k AS MATERIALIZED (SELECT *, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp, (sum(pos) OVER g)::BIGINT AS n_pos,
  (sum(neg) OVER g)::BIGINT AS n_neg FROM d WINDOW w AS (PARTITION BY mode, split ORDER BY threshold DESC), g AS (PARTITION BY mode, split)),
r AS MATERIALIZED (SELECT mode, split, threshold, {RATES} FROM (SELECT *, n_pos - tp AS fn, n_neg - fp AS tn FROM k)),
o AS MATERIALIZED ({pick('true', 'f1 DESC, threshold', 'default')}
 UNION ALL {pick(f'precision >= {pf}', 'threshold', 'safer')} UNION ALL {pick(f'NOT {safer}', 'recall DESC, threshold', 'safer')}
 UNION ALL {pick(f'recall >= {rf}', 'threshold DESC', 'precise')} UNION ALL {pick(f'NOT {precise}', 'precision DESC, threshold', 'precise')}),
a AS (SELECT mode, split, max(n_pos) AS n_pos, max(n_neg) AS n_neg, round({_ROC}, 6) AS roc_auc, round({_AP}, 6) AS pr_auc FROM k GROUP BY ALL),
c AS (SELECT m.mode, m.split, o.op, o.threshold, {counts_sql('fine', 'o.threshold')} FROM m JOIN o USING (mode) GROUP BY ALL)
SELECT mode, split, op, n_pos + n_neg AS n_samples, n_pos, n_neg, roc_auc, pr_auc, threshold, tp, fp, fn, tn, {RATES} FROM c JOIN a USING (mode, split)"""


@query("results_by_mode", _by_mode_sql(0.99, 0.99))
def results_by_mode(spark, sf):
    return rounded(M.results_by_split(mode_rows(spark, sf), "fine", digits=6), "threshold")


@query("results_by_mode_floors", _by_mode_sql(0.25, 0.4))
def results_by_mode_floors(spark, sf):
    return rounded(M.results_by_split(mode_rows(spark, sf), "fine", precision_floor=0.25, recall_floor=0.4, digits=6), "threshold")


# Requests for thresholds: one per order line, some with a threshold of their own.
_MODES, _OPS = ("random", "domain", "other"), ("default", "safer", "precise", "unknown")
_TUNED = [(mode, op, t + i / 100) for i, mode in enumerate(("random", "domain"))
          for op, t in (("default", 0.42), ("safer", 0.18), ("precise", 0.97))]


@query("threshold_resolve", f"""WITH q AS (
  SELECT l_orderkey, l_linenumber, ({Q.array(_MODES)})[1 + l_orderkey % 3] AS mode, ({Q.array(_OPS)})[1 + l_partkey % 4] AS op,
         CASE WHEN l_linenumber = 1 THEN l_discount END AS custom FROM lineitem),
t(mode, op, thr) AS (VALUES {', '.join(f"('{m}', '{o}', {t!r}::DOUBLE)" for m, o, t in _TUNED)})
SELECT q.*, coalesce(custom, thr, 0.5) AS threshold,
       CASE WHEN custom IS NOT NULL THEN 'custom' WHEN thr IS NOT NULL THEN 'table' ELSE 'fallback' END AS threshold_source
FROM q LEFT JOIN t USING (mode, op)""")
def threshold_resolve(spark, sf):
    pick = lambda names, c, n: F.get(F.array(*map(F.lit, names)), (F.col(c) % n).cast("int"))
    requests = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", pick(_MODES, "l_orderkey", 3).alias("mode"),
        pick(_OPS, "l_partkey", 4).alias("op"),
        F.when(F.col("l_linenumber") == 1, F.col("l_discount")).alias("custom"))
    return M.resolve_thresholds(requests, inline_table(spark, ["mode", "op", "threshold"], _TUNED))


_BINS = ", ".join(f"({i}, '{n}', {lo}, {hi if i < 5 else 1.1})" for i, (n, lo, hi) in enumerate(K.SCORE_BINS))


@query("score_histogram", f"""{WITH}, b(position, bin, lo, hi) AS (VALUES {_BINS})
SELECT position, bin, count(s.score) AS all, count(*) FILTER (label = 1) AS label_1, count(*) FILTER (label = 0) AS label_0
FROM b LEFT JOIN s ON s.score >= lo AND s.score < hi GROUP BY ALL""")
def score_histogram(spark, sf):
    return M.score_histogram(scores(spark, sf))


_EPS = K.LABEL_SMOOTHING
_Y = f"(label * {1 - 2 * _EPS!r}::DOUBLE + {_EPS}::DOUBLE)"


@query("smoothed_bce", f"""{WITH} SELECT count(*) AS n, round(avg(3.0::DOUBLE * {_Y} * ln(1 + exp(-logit)) + (1 - {_Y}) * ln(1 + exp(logit))), 6) AS loss FROM s""")
def smoothed_bce(spark, sf):
    return rounded(M.smoothed_bce(scores(spark, sf), pos_weight=3.0))


@query("smooth_rows", f"""{WITH}
SELECT l_orderkey, l_linenumber, 1 AS label, round(3.0::DOUBLE * {_Y}, 6) AS weight FROM s
UNION ALL SELECT l_orderkey, l_linenumber, 0, round(1 - {_Y}, 6) FROM s""")
def smooth_rows(spark, sf):
    rows = scores(spark, sf).select("l_orderkey", "l_linenumber", "label")
    return rounded(M.smoothed_rows(rows, pos_weight=3.0))


@query("ensemble_scores", f"""{WITH}, e AS (SELECT *, (score + fine) / 2 AS p FROM s)
SELECT l_orderkey, l_linenumber, round(p, 9) AS ensemble_prob, CASE WHEN p >= 0.5 THEN 'MAL' ELSE 'BEN' END AS verdict,
       CASE WHEN p * 100 <= 25 THEN 'Low Risk' WHEN p * 100 <= 50 THEN 'Caution' WHEN p * 100 <= 75 THEN 'Suspicious' ELSE 'High Risk' END AS risk_level
FROM e""")
def ensemble_scores(spark, sf):
    both = scores(spark, sf).withColumn("p", risk.ensemble(F.col("score"), F.col("fine")))
    return both.select("l_orderkey", "l_linenumber", F.round("p", 9).alias("ensemble_prob"),
                       risk.verdict(F.col("p")).alias("verdict"),
                       risk.risk_level(F.col("p")).alias("risk_level"))


@query("scorer_regression", """
WITH a AS (SELECT l_orderkey AS k, avg(l_quantity / 50) AS p, max((l_returnflag = 'R')::INT) AS label FROM lineitem GROUP BY 1),
b AS (SELECT l_orderkey AS k, avg(round(l_quantity / 50, 1)) AS p FROM lineitem GROUP BY 1),
j AS (SELECT a.k, a.label, a.p AS p1, b.p AS p2 FROM a JOIN b USING (k)),
c AS (SELECT count(*) AS n, count(*) FILTER (p1 >= 0.5 AND label = 1) AS tp1, count(*) FILTER (p1 >= 0.5 AND label = 0) AS fp1,
  count(*) FILTER (p1 < 0.5 AND label = 1) AS fn1, count(*) FILTER (p2 >= 0.5 AND label = 1) AS tp2,
  count(*) FILTER (p2 >= 0.5 AND label = 0) AS fp2, count(*) FILTER (p2 < 0.5 AND label = 1) AS fn2,
  max(abs(p1 - p2)) AS max_gap, avg(abs(p1 - p2)) AS mean_gap FROM j),
f AS (SELECT *, 2 * tp1 / (2 * tp1 + fp1 + fn1) AS f1_first, 2 * tp2 / (2 * tp2 + fp2 + fn2) AS f1_second FROM c)
SELECT n, round(f1_first, 6) AS f1_first, round(f1_second, 6) AS f1_second, round(f1_second - f1_first, 6) AS delta,
       (abs(f1_second - f1_first) < 0.005) AS passed, round(max_gap, 6) AS max_gap, round(mean_gap, 6) AS mean_gap FROM f""")
def scorer_regression(spark, sf):
    lines = table(spark, sf, "lineitem")
    first = lines.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.avg(F.col("l_quantity") / 50).alias("p1"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"))
    second = lines.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.avg(F.round(F.col("l_quantity") / 50, 1)).alias("p2"))
    return rounded(M.compare_scorers(first.join(second, "k"), "p1", "p2"))


EPOCHS = """e AS (SELECT l_linenumber AS run, (year(l_shipdate) - 1992) * 12 + month(l_shipdate) AS epoch,
  round(avg(l_discount), 6) AS metric FROM lineitem GROUP BY ALL)"""


@query("early_stop", f"""WITH {EPOCHS},
b AS (SELECT *, max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
i AS (SELECT *, before IS NULL OR metric > before + 0.0000001 AS better FROM b),
g AS (SELECT *, count(*) FILTER (better) OVER (PARTITION BY run ORDER BY epoch) AS grp FROM i),
w AS (SELECT *, row_number() OVER (PARTITION BY run, grp ORDER BY epoch) - 1 AS waited FROM g),
st AS (SELECT run, min(epoch) FILTER (waited >= 3) AS stopped_epoch FROM w GROUP BY run)
SELECT w.run, arg_max(metric, epoch) FILTER (better AND (stopped_epoch IS NULL OR epoch <= stopped_epoch)) AS best_metric,
       max(epoch) FILTER (better AND (stopped_epoch IS NULL OR epoch <= stopped_epoch)) AS best_epoch, max(stopped_epoch) AS stopped_epoch
FROM w JOIN st USING (run) GROUP BY w.run""")
def early_stop(spark, sf):
    month = (F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate")
    epochs = table(spark, sf, "lineitem").groupBy(
        F.col("l_linenumber").alias("run"), month.alias("epoch")
    ).agg(F.round(F.avg("l_discount"), 6).alias("metric"))
    return M.early_stop(epochs, min_gain=1e-7)
