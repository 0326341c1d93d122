"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade >= k) = sigmoid(w.x - theta_k) with one weight vector w for all thresholds theta_1 <= theta_2
<= ..., fitted by proximal gradient steps with an L1 penalty on a bounded sample of labelled rows.
x marks which hashed words occur in the whole text. The output is the expected severity, which is the
sum over k of P(grade >= k), and the verdict P(grade >= 1) >= 0.5.

Scoring is one pass of Arrow batches over the documents with a model of fixed size; nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.common import bounded_sample, free_names

CELLS = 1 << 18
SAMPLE_ROWS = 3_000  # labelled rows of each verdict that the fit may read
GRADES = 3
WORD = re.compile(r"[^\W\d_]+")
STEM = itemgetter(slice(0, 4))
STEPS = (3, 6, 12, 20, 35, 60)  # words in a thousand


@dataclass
class OrdinalModel:
    """Sparse shared weights (cell -> weight) and the ordered thresholds."""

    weights: dict[int, float]
    thresholds: list[float]
    cells: int = CELLS

    def reach(self, text: str | None) -> list[float]:
        """P(grade >= k) for every k from 1."""
        score = sum(self.weights.get(c, 0.0) for c in features(text, self.cells)) if self.weights else 0.0
        return [1 / (1 + float(np.exp(min(60.0, t - score)))) for t in self.thresholds]


def features(text: str | None, cells: int = CELLS) -> set[int]:
    """Cells of a whole text's sparse marks: the distinct lower-cased words (runs of letters), and for
    each word stem (first four letters, two words or more) the steps that its share of words reaches."""
    words = WORD.findall((text or "").lower())
    marks = set(words)
    stems = Counter(map(STEM, words))
    for stem, n in stems.items():
        if n > 1:
            share = 1000 * n / len(words)
            for step in STEPS:
                if share < step:
                    break
                marks.add(f"{stem}|{step}")
    return {zlib.crc32(w.encode("utf-8", "replace")) % cells for w in marks}


def severity_grades(flat: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, share: float = 0.5) -> np.ndarray:
    """Grades 0, 1, 2 from a yes/no label: a toxic row is severe (2) when it holds more words that are
    typical of toxic rows than the median toxic row that holds any.

    Rows are given as their cells one after the other (``flat``) and their numbers of cells.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.bincount(flat[toxic[owner] == 1], minlength=CELLS)
    outside = np.bincount(flat[toxic[owner] == 0], minlength=CELLS)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    typical = (inside >= max(3, 0.02 * n1)) & (inside / n1 > 20 * (outside + 0.5) / n0)
    marks = np.bincount(owner[typical[flat]], minlength=len(sizes))
    found = marks[(toxic == 1) & (marks > 0)]
    middle = np.quantile(found, share) if len(found) else np.inf
    return np.where(toxic == 1, np.where(marks > middle, 2, 1), 0)


def fit_ordinal(
    flat: np.ndarray, sizes: np.ndarray, grades: np.ndarray, n_grades: int = GRADES, cells: int = CELLS,
    penalty: float = 1e-3, steps: int = 200,
) -> OrdinalModel:
    """Accelerated proximal gradient on the cumulative logistic loss, classes weighted to balance."""
    k = n_grades - 1
    if len(sizes) == 0 or len(set(grades.tolist())) < 2:
        return OrdinalModel({}, [30.0] * k, cells)
    seen = np.bincount(flat, minlength=cells)
    used = np.flatnonzero(seen >= 3)
    if not len(used):
        return OrdinalModel({}, [30.0] * k, cells)
    place = np.full(cells, -1, np.int32)
    place[used] = np.arange(len(used))
    ok = place[flat] >= 0
    col, row, n, m = place[flat][ok], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[ok], len(sizes), len(used)
    positive = grades >= 1
    balance = np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum())
    above = (grades[:, None] >= np.arange(1, n_grades)[None, :]).astype(float)
    # step length from the largest curvature, by power iteration
    u = np.ones(m) / np.sqrt(m)
    for _ in range(15):
        u = np.bincount(col, (balance * np.bincount(row, u[col], minlength=n))[row], minlength=m)
        curve = np.linalg.norm(u)
        u /= curve
    rate = 1 / max(1e-9, 0.25 * k * 1.1 * (curve + 1))
    w, v = np.zeros(m), np.zeros(m)
    theta = back = np.arange(k, dtype=float)
    momentum = 1.0
    for _ in range(steps):
        score = np.bincount(row, v[col], minlength=n)
        p = 1 / (1 + np.exp(np.clip(back[None, :] - score[:, None], -60, 60)))
        slack = (p - above) * balance[:, None]
        grad = np.bincount(col, slack.sum(axis=1)[row], minlength=m)
        moved = v - rate * grad
        new = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = (momentum - 1) / following
        raised = np.maximum.accumulate(back + rate * slack.sum(axis=0))
        if np.dot(v - new, new - w) > 0:  # restart where momentum points uphill
            ahead, following = 0.0, 1.0
        v, w, back, theta = new + ahead * (new - w), new, raised + ahead * (raised - theta), raised
        momentum = following
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return OrdinalModel({int(used[i]): float(w[i]) for i in kept}, theta.tolist(), cells)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id",
    text: str = "text", toxic: str = "toxic",
) -> OrdinalModel:
    """Fit on at most ``sample_rows`` toxic and as many other labelled rows, chosen by key hash.

    Only the hashed words of those rows reach the driver. Null labels and keys take no part; without
    both verdicts in the labels the model calls nothing toxic.
    """
    given = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).select(
        F.col(key).alias("_key"), (F.col(toxic) > 0).cast("int").alias("_toxic")).distinct()
    picked = bounded_sample(given.where("_toxic = 1"), "_key", sample_rows).unionByName(
        bounded_sample(given.where("_toxic = 0"), "_key", sample_rows))
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(picked), "_key")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [sorted(features(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets, pa.list_(pa.int32())), b.column(0), b.column(2)], ["cells", "k", "t"])

    got = texts.mapInArrow(cells, "cells array<int>, k long, t int").toArrow().sort_by([("k", "ascending")])
    marks = got.column("t").to_numpy().astype(int)
    lists = got.column("cells").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()).astype(int)
    flat = lists.flatten().to_numpy()
    return fit_ordinal(flat, sizes, severity_grades(flat, sizes, marks))


def with_toxicity(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus ``severity_grade`` (int), ``expected_severity`` (double)
    and ``toxic`` (boolean).

    Null and empty texts score like a text without words. Columns of these names are replaced.
    """
    own = ["severity_grade", "expected_severity", "toxic"]
    keep = [c for c in docs.columns if c not in own]
    base = docs.select(*keep)
    (helper,) = free_names(base, "_reach")

    @F.pandas_udf("array<double>")
    def reach(texts):
        return texts.map(model.reach, na_action=None)

    scored = base.withColumn(helper, reach(F.coalesce(F.col(text), F.lit(""))))
    total = F.aggregate(helper, F.lit(0.0), lambda a, p: a + p)
    grade = F.size(F.filter(helper, lambda p: p >= 0.5))
    return scored.select(
        *keep, grade.alias("severity_grade"), F.round(total, 6).alias("expected_severity"),
        (F.get(helper, F.lit(0)) >= 0.5).alias("toxic"))
