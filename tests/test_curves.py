"""Exact curves: the order of bits, crowded cells, groups, and the stored result table."""

import math
import random
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from urlsieve.operators import curves, metrics as M
from urlsieve.sources import writers


def bits(x):
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def test_ordered_bits_are_the_bits(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 1.0, -1.0, 0.5, 1 - 2**-53, 1 + 2**-52, 2.0, math.inf, -math.inf, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324,
              1.7976931348623157e308, 0.1, 1 / 3, 8.000000000000002, 7.999999999999999]
    values += [math.ldexp(rng.random() + 1, rng.randint(-1022, 1023)) * rng.choice([1, -1]) for _ in range(3000)] + [2.0**k for k in range(-1074, 1024)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert all(r["b"] == bits(r["x"]) for r in df.select("x", curves.ordered_bits(F.col("x")).alias("b")).collect())


def brute(rows):
    """(group, score) -> pos, neg, tp, fp, n_pos, n_neg"""
    by = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for g, s, y in rows:
        by[g][s][0 if y else 1] += 1
    out = {}
    for g, scores in by.items():
        n_pos, n_neg = (sum(c[i] for c in scores.values()) for i in (0, 1))
        tp = fp = 0
        for s in sorted(scores, reverse=True):
            tp, fp = tp + scores[s][0], fp + scores[s][1]
            out[g, s] = (*scores[s], tp, fp, n_pos, n_neg)
    return out


@pytest.mark.parametrize("cell_scores", [1, 7, curves.CELL_SCORES])
def test_running_counts_with_crowded_cells(spark, cell_scores):
    rng = random.Random(5)
    rows = [(g, s, int(rng.random() < 0.4)) for g in ("a", None, "b") for s in (
        *(0.5 + rng.randrange(40) * 2.0**-50 for _ in range(120)),  # half of the rows crowd into one cell of three digits
        *(rng.random() for _ in range(60)), *(rng.gauss(0, 50) for _ in range(40)), 0.0, -0.0, math.inf, -math.inf)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    counts = curves.score_counts(df, "score", "label", ["g"])
    got = {(r["g"], r["threshold"]): tuple(r[c] for c in ("pos", "neg", "tp", "fp", "n_pos", "n_neg"))
           for r in curves.running_counts(counts, ["g"], cell_scores).collect()}
    assert got == brute(rows)


def test_scores_are_read_once(spark, tmp_path):
    spark.range(1000).selectExpr("id / 1000 as score", "cast(id % 3 = 0 as int) as label").write.parquet(f"{tmp_path}/s")
    plan = M.curve_points(spark.read.parquet(f"{tmp_path}/s"))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan  # the final plan reads stored counts of distinct scores


def test_no_rows(spark):
    none = spark.createDataFrame([], "mode string, split string, score double, label int")
    assert M.cumulative(none).count() == 0 and M.results_by_split(none).count() == 0
    assert M.curve_areas(none).first()["roc_auc"] is None


def test_results_by_split(spark, tmp_path):
    rng = random.Random(6)
    rows = [(m, p, round(rng.random() * 0.5 + (0.4 if y else 0), 3), y) for m in ("random", "domain") for p in ("train", "val", "test")
            for y in (0, 1) for _ in range(150)] + [("untuned", "test", 0.5, 1), ("random", "val", None, 1), ("random", "val", 0.3, None)]
    df = spark.createDataFrame(rows, "mode string, split string, score double, label int")
    got = {(r["mode"], r["split"], r["op"]): r for r in M.results_by_split(df, precision_floor=0.9, recall_floor=0.9).collect()}
    assert len(got) == 18 and not any(k[0] == "untuned" for k in got)
    for mode in ("random", "domain"):
        ops = {r["op"]: r["threshold"] for r in M.operating_points(
            M.curve_points(df.where(f"mode = '{mode}' and split = 'val'")), 0.9, 0.9).collect()}
        for split in ("train", "val", "test"):
            part = df.where(f"mode = '{mode}' and split = '{split}'")
            areas = M.curve_areas(part).first()
            for op, cut in ops.items():
                r, c = got[mode, split, op], M.confusion(part, cut).first()
                assert r["threshold"] == cut and [r[x] for x in ("tp", "fp", "fn", "tn")] == [c[x] for x in ("tp", "fp", "fn", "tn")]
                assert math.isclose(r["roc_auc"], areas["roc_auc"]) and math.isclose(r["pr_auc"], areas["pr_auc"]) and r["n_samples"] == 300
    path = f"{tmp_path}/results"
    table = M.results_by_split(df)
    writers.store_results(table, path)
    newer = df.where("mode = 'domain'").withColumn("score", F.lit(0.5))
    for _ in range(2):  # a repeated write changes nothing
        writers.store_results(M.results_by_split(newer), path)
        stored = spark.read.parquet(path)
        assert stored.count() == 18 and {r["roc_auc"] for r in stored.where("mode = 'domain'").collect()} == {0.5}
        assert stored.where("mode = 'random'").count() == 9 and stored.where("mode = 'random' and roc_auc = 0.5").count() == 0


def test_tables_of_cells_stay_small(spark, monkeypatch):
    """Splitting a crowded cell gives 256 children, not one for nearly every score."""
    tables, plain = [], curves.cut_lineage
    monkeypatch.setattr(curves, "cut_lineage", lambda df: tables.append(plain(df)) or tables[-1])
    df = spark.range(0, 20_000).select((0.5 + F.col("id") / 1e6).alias("score"), (F.col("id") % 2).cast("int").alias("label"))
    rows = curves.running_counts(curves.score_counts(df, "score", "label"), (), 1000)
    assert max(t.count() for t in tables[1:]) <= 256
    got = rows.where("tp + fp = 20000").select("threshold", "tp", "n_pos", "n_neg").collect()
    assert [tuple(r) for r in got] == [(0.5, 10_000, 10_000, 10_000)]
