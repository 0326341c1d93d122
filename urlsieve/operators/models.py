"""Classifiers on URL and page features, built on Spark ML, and scoring with them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.functions import risk
from urlsieve.functions.text import strip
from urlsieve.operators import features as FE
from urlsieve.operators import metrics as M
from urlsieve.operators import pages as P
from urlsieve.session import inline_table, run_dir

URL_NGRAMS = (3, 4, 5)


def class_weights(df: DataFrame, label: str = "label", balanced: bool = False) -> tuple[float, float]:
    """Weights of the negative and the positive class: (1, neg/pos), or balanced n / (2 n_c)."""
    row = df.agg(
        F.sum((F.col(label) == 0).cast("long")).alias("neg"),
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
    ).first()
    neg, pos = row["neg"] or 0, row["pos"] or 0
    if balanced:
        return (neg + pos) / max(2.0 * neg, 1.0), (neg + pos) / max(2.0 * pos, 1.0)
    return 1.0, neg / max(pos, 1)


def with_weight(df: DataFrame, weights: tuple[float, float], label: str = "label") -> DataFrame:
    return df.withColumn("weight", F.when(F.col(label) == 1, weights[1]).otherwise(weights[0]))


def train_trees(
    features: DataFrame, names: Sequence[str] = K.TABULAR_FEATURES, label: str = "label",
    validation: str | None = None, rounds: int = 50, depth: int = 5, step: float = 0.05,
    seed: int = 42,
) -> PipelineModel:
    """Boosted trees on named feature columns, positives weighted by the class ratio.

    ``validation`` names a boolean column; rounds stop when the loss on its rows stops falling.
    """
    assembler = VectorAssembler(inputCols=list(names), outputCol="features")
    weighted = with_weight(features, class_weights(features, label), label)
    trees = GBTClassifier(
        labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=step,
        subsamplingRate=0.8, featureSubsetStrategy="0.8", maxBins=256, seed=seed,
    )
    if validation is not None:
        trees = trees.setValidationIndicatorCol(validation)
    model = trees.fit(assembler.transform(weighted))
    return PipelineModel(stages=[assembler, model])


# how a vector column lies in Arrow
_VECTOR = pa.struct([
    pa.field("type", pa.int8(), False), pa.field("size", pa.int32()),
    pa.field("indices", pa.list_(pa.field("element", pa.int32(), False))),
    pa.field("values", pa.list_(pa.field("element", pa.float64(), False))),
])
# pieces that are hashed at a time
_CHUNK = 1 << 20


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _mixed(k: np.ndarray) -> np.ndarray:
    return _rotated(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def murmur3(data: np.ndarray, begin: np.ndarray, length: int, seed: int = 42) -> np.ndarray:
    """The 32-bit hash that ``HashingTF`` takes, of the ``length`` bytes from each of the places ``begin``."""
    def word(at: int, n: int) -> np.ndarray:
        return sum((data[begin + (at + i)].astype(np.uint32) << np.uint32(8 * i) for i in range(n)), np.uint32(0))

    h = np.full(len(begin), seed, np.uint32)
    whole = length - length % 4
    for at in range(0, whole, 4):
        h = _rotated(h ^ _mixed(word(at, 4)), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    if length > whole:
        h ^= _mixed(word(whole, length - whole))
    h ^= np.uint32(length)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def piece_counts(text: bytes, sizes: Sequence[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash cells of all pieces of a UTF-8 text, ascending, and how many pieces each holds."""
    data = np.frombuffer(text, np.uint8)
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of characters
    cells, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for n in sizes:
        for first in range(0, len(starts) - n, _CHUNK):
            begin = starts[first:min(first + _CHUNK, len(starts) - n)]
            length = starts[first + n:first + n + len(begin)] - begin
            hashes = [murmur3(data, begin[length == k], int(k)) for k in np.flatnonzero(np.bincount(length))]
            found = np.unique(np.concatenate(hashes) & np.uint32((1 << bits) - 1), return_counts=True)
            cells.append(found[0])
            counts.append(found[1])
    distinct, at = np.unique(np.concatenate(cells), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), len(distinct))


def sparse_vectors(width: int, ends: Sequence[int], cells: np.ndarray, values: np.ndarray) -> pa.Array:
    """A column of sparse vectors; ``ends`` (from 0) says where the entries of each begin and end."""
    ends, n = pa.array(np.asarray(ends, np.int32)), len(ends) - 1
    return pa.StructArray.from_arrays([
        pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32)),
        pa.ListArray.from_arrays(ends, pa.array(cells.astype(np.int32)), type=_VECTOR.field("indices").type),
        pa.ListArray.from_arrays(ends, pa.array(values.astype(np.float64)), type=_VECTOR.field("values").type),
    ], fields=list(_VECTOR))


def piece_vectors(sizes: Sequence[int], bits: int) -> Callable[[pa.Array], pa.Array]:
    def run(texts: pa.Array) -> pa.Array:
        cells, values, ends = [], [], [0]
        for text in texts.cast(pa.binary()):
            cell, n = piece_counts(text.as_py() or b"", sizes, bits)
            cells.append(cell)
            values.append(n / max(np.sqrt((n * n).sum()), 1.0))
            ends.append(ends[-1] + len(cell))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
        return sparse_vectors(1 << bits, ends, join(cells), join(values))

    return run


def page_features(pages: DataFrame, html: str = "html", bits: int = 20, window: int | None = None) -> DataFrame:
    """Hashed, unit-length counts of the 3- and 4-character pieces of the clean page.

    Counting happens inside the row, so nothing is shuffled; cells and values are those of ``HashingTF`` and
    ``Normalizer``, hashed per page in arrays instead of piece by piece.
    """
    vector = F.arrow_udf(piece_vectors(K.NGRAM_SIZES, bits), VectorUDT())
    return pages.withColumn("features", vector(P.normalize_html(F.col(html), window)))


def vector_sizes(vectors: pa.Array) -> pa.Array:
    """cells, norm: the entries of each sparse vector and the sum of their squares."""
    values = vectors.field("values")
    squares = np.append(0.0, np.cumsum(values.flatten().to_numpy(zero_copy_only=False) ** 2))
    n = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    return pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), pa.array(squares[ends] - squares[ends - n])], ["cells", "norm"])


def train_linear(
    rows: DataFrame, label: str = "label", weight: str = "weight", iterations: int = 20, reg: float = 1e-4
) -> PipelineModel:
    fit = LogisticRegression(labelCol=label, weightCol=weight, maxIter=iterations, regParam=reg)
    return PipelineModel(stages=[fit.fit(rows)])


def train_page_model(
    pages: DataFrame, html: str = "html", label: str = "label", bits: int = 20,
    window: int | None = None, iterations: int = 20,
) -> PipelineModel:
    """Linear page classifier with balanced class weights (counted over all rows)."""
    weighted = with_weight(pages, class_weights(pages, label, balanced=True), label)
    return train_linear(page_features(weighted, html, bits, window), label, iterations=iterations)


def met_cells(data: np.ndarray, row: np.ndarray, sizes: Sequence[int], bits: int, width: int) -> np.ndarray:
    """``row * width + cell``, ascending, of the hash cells that the pieces of each row's UTF-8 text meet.

    ``data`` holds the texts one after the other, ``row`` the row of each byte.
    """
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of characters
    of = row[starts[:-1]]
    met = [np.zeros(0, np.int64)]
    for n in sizes:
        first = np.flatnonzero(of[:len(of) - n + 1] == of[n - 1:]) if len(of) >= n else np.zeros(0, int)
        begin = starts[first]
        length = starts[first + n] - begin
        for k in np.flatnonzero(np.bincount(length)):
            same = length == k
            cells = murmur3(data, begin[same], int(k)) & np.uint32((1 << bits) - 1)
            met.append(of[first[same]] * width + cells)
    met = np.sort(np.concatenate(met))  # several times as fast as np.unique, which hashes
    return met[np.append(True, met[1:] != met[:-1])] if len(met) else met


def url_vectors(sizes: Sequence[int], bits: int) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """Sparse vectors of the cells that a URL's pieces meet (1 each), followed by its numbers."""
    def run(urls: pa.Array, numbers: pa.Array) -> pa.Array:
        texts = [u.as_py() or b"" for u in urls.cast(pa.binary())]
        sizes_of = np.array([len(t) for t in texts], np.int64)
        tail = numbers.flatten().to_numpy(zero_copy_only=False).reshape(len(texts), -1)
        width = (1 << bits) + tail.shape[1]
        part = np.cumsum(sizes_of) // _CHUNK  # about a chunk of bytes at a time
        keys = [np.zeros(0, np.int64)]
        for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1):
            data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
            keys.append(met_cells(data, np.repeat(rows, sizes_of[rows]), sizes, bits, width))
        pieces = np.concatenate(keys)
        at, column = np.nonzero(tail)
        key = np.append(pieces, at * width + (1 << bits) + column)
        order = np.argsort(key, kind="stable")
        value = np.append(np.ones(len(pieces)), tail[at, column])[order]
        ends = np.append(0, np.cumsum(np.bincount(key // width, minlength=len(texts))))
        return sparse_vectors(width, ends, key[order] % width, value)

    return run


def url_sequence_features(
    df: DataFrame, stats: DataFrame, url: str = "url", keep: tuple[str, ...] = (), bits: int = 18,
    cut: int | None = None,
) -> DataFrame:
    """Character pieces of the whole URL (case kept) next to the standardised lexical features.

    ``cut`` limits URLs to their first characters, for callers that serve models of fixed length.
    """
    bare = strip(F.col(url))
    cut = df.withColumn(url, bare if cut is None else F.substring(bare, 1, cut))
    return vectors_of(FE.lexical_features(cut, url, (*keep, url)), stats, url, keep, bits)


def vectors_of(
    lexical: DataFrame, stats: DataFrame, url: str = "url", keep: tuple[str, ...] = (), bits: int = 18,
) -> DataFrame:
    """:func:`url_sequence_features` of stripped URLs whose lexical features are there already.

    Cells and values are those of a binary ``HashingTF`` and ``VectorAssembler``, made per batch in arrays.
    """
    z = FE.normalize_features(lexical, stats, (*keep, url))
    vector = F.arrow_udf(url_vectors(URL_NGRAMS, bits), VectorUDT())
    return z.select(*keep, url, vector(F.col(url), F.array(*K.LEXICAL_FEATURES)).alias("features"))


def train_url_model(
    df: DataFrame, stats: DataFrame, url: str = "url", label: str = "label", bits: int = 18,
    epsilon: float = K.LABEL_SMOOTHING, iterations: int = 20,
) -> PipelineModel:
    """Linear model on URL character pieces and lexical features with smoothed labels."""
    return train_on_vectors(url_sequence_features(df, stats, url, (label,), bits), label, epsilon, iterations)


def train_on_vectors(
    vectors: DataFrame, label: str = "label", epsilon: float = K.LABEL_SMOOTHING, iterations: int = 20,
) -> PipelineModel:
    _, pos_weight = class_weights(vectors, label)
    smoothed = M.smoothed_rows(vectors, label, pos_weight, epsilon)
    return train_linear(smoothed, label, iterations=iterations)


# --- scoring ------------------------------------------------------------------------------

def probability_of(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


def score_frame(scored: DataFrame, threshold: float = 0.5, keep: Sequence[str] = ("url",)) -> DataFrame:
    """keep, probability, threshold, prediction, label, risk_level of a model's output."""
    p = probability_of()
    return scored.select(*keep, p.alias("probability")).select(
        *keep, "probability", F.lit(threshold).alias("threshold"),
        (F.col("probability") >= threshold).cast("int").alias("prediction"),
        risk.verdict(F.col("probability"), threshold, ("MALICIOUS", "BENIGN")).alias("label"),
        risk.risk_level(F.col("probability")).alias("risk_level"),
    )


# --- importance ---------------------------------------------------------------------------

def stored_nodes(model: PipelineModel, spark: SparkSession) -> tuple[DataFrame, list[float]]:
    """``treeID`` and node columns of a boosted ensemble, one row per node, and the weights of its trees."""
    trees = next(s for s in model.stages if isinstance(s, GBTClassificationModel))
    # the ensemble writes its nodes as a table in the shared folder
    path = run_dir(spark, "trees")
    trees.write().overwrite().save(path)
    return spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*"), list(trees.treeWeights)


def tree_importance(model: PipelineModel, df: DataFrame, names: Sequence[str] = K.TABULAR_FEATURES) -> DataFrame:
    """Per feature: splits (weight), mean and total gain, mean and total cover, rank by gain.

    Read from the stored trees, one row per node.
    """
    spark = df.sparkSession
    nodes = stored_nodes(model, spark)[0].where("leftChild >= 0")
    named = inline_table(spark, ["position", "feature"], list(enumerate(names)))
    stats = nodes.groupBy(F.col("split.featureIndex").alias("position")).agg(
        F.count("*").alias("weight"), F.avg("gain").alias("gain"), F.avg("rawCount").alias("cover"),
        F.sum("gain").alias("total_gain"), F.sum("rawCount").alias("total_cover"))
    joined = stats.join(F.broadcast(named), "position").drop("position")
    ranked = joined.orderBy(F.desc("gain"), "feature")
    return ranked.select("feature", "weight", "gain", "cover", "total_gain", "total_cover")


@dataclass
class FlatTrees:
    """A boosted ensemble as arrays, small enough to travel with a task: all nodes of all trees in one row."""

    roots: np.ndarray
    feature: np.ndarray  # -1 at leaves
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # of leaves, times the weight of the tree
    depth: int

    @staticmethod
    def of(model: PipelineModel, spark: SparkSession) -> FlatTrees:
        table, weights = stored_nodes(model, spark)
        # bounded by rounds and depth of the model
        rows = table.select(
            "treeID", "id", "leftChild", "rightChild", "prediction", F.col("split.featureIndex").alias("f"),
            F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("t")).orderBy("treeID", "id").collect()
        place = {(r["treeID"], r["id"]): i for i, r in enumerate(rows)}
        inner = np.array([r["leftChild"] >= 0 for r in rows])
        child = lambda c: np.array([place[r["treeID"], r[c]] if r[c] >= 0 else i for i, r in enumerate(rows)])
        left, right = child("leftChild"), child("rightChild")
        level, depth = np.zeros(len(rows), int), 0
        for i in range(len(rows)):  # children are stored behind their parent
            if inner[i]:
                level[left[i]] = level[right[i]] = level[i] + 1
                depth = max(depth, level[i] + 1)
        return FlatTrees(
            np.array([place[t, 0] for t in range(len(weights))]), np.where(inner, [r["f"] for r in rows], -1),
            np.array([r["t"] if r["t"] is not None else 0.0 for r in rows]), left, right,
            np.array([r["prediction"] * weights[r["treeID"]] for r in rows]), int(depth))

    def used_by(self) -> list[np.ndarray]:
        """Per tree the features it asks for."""
        ends = [*self.roots[1:], len(self.feature)]
        return [np.unique(f[f >= 0]) for f in (self.feature[a:b] for a, b in zip(self.roots, ends, strict=True))]

    def margins(self, x: np.ndarray, tree: int) -> np.ndarray:
        """What a tree adds to each row's log-odds (halved)."""
        at, rows = np.full(len(x), self.roots[tree]), np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[at]
            down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f >= 0, down, at)
        return self.value[at]


def permuted_scores(trees: FlatTrees, names: Sequence[str], label: str, seed: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per batch the scores of all rows as they are (feature -1) and with each feature permuted inside the batch.

    A permutation changes only the trees that ask for the feature, so the others are not walked again.
    """
    used = trees.used_by()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, batch in enumerate(batches):
            x = batch[list(names)].to_numpy(float)
            y = batch[label].to_numpy()
            parts = np.stack([trees.margins(x, t) for t in range(len(trees.roots))]) if len(trees.roots) else np.zeros((1, len(x)))
            whole = parts.sum(axis=0)
            yield pd.DataFrame({"feature": -1, "score": whole, "label": y})
            for j in range(len(names)):
                touched = [t for t, f in enumerate(used) if j in f]
                score = whole
                if touched:
                    kept = x[:, j].copy()
                    x[:, j] = np.random.default_rng([seed, j, number]).permutation(kept)
                    # summed in the same order as the whole, so that unchanged trees leave equal scores equal
                    moved = parts.copy()
                    for t in touched:
                        moved[t] = trees.margins(x, t)
                    score = moved.sum(axis=0)
                    x[:, j] = kept
                yield pd.DataFrame({"feature": j, "score": score, "label": y})

    return run


def permutation_importance(
    model: PipelineModel, features: DataFrame, names: Sequence[str] = K.TABULAR_FEATURES, label: str = "label", seed: int = 42
) -> DataFrame:
    """Loss of ROC area when a feature is permuted, for every feature of a tree model: ``feature, importance``.

    ``features`` should be rows the model was not trained on. They are spread and ordered by hash, so that
    batches are random and the same at every run; one pass scores all permutations of a batch, and the
    areas of all features are one grouped curve. ``names`` are the model's inputs, in its order.
    """
    spark = features.sparkSession
    trees = FlatTrees.of(model, spark)
    order = F.xxhash64(*features.columns)
    spread = features.select(*names, F.col(label).cast("int").alias(label), order.alias("_order")).repartition("_order").sortWithinPartitions("_order")
    rows = spread.mapInPandas(permuted_scores(trees, names, label, seed), "feature int, score double, label int")
    areas = M.curve_areas(rows, groups=("feature",)).select("feature", "roc_auc")
    base = areas.where("feature = -1").select(F.col("roc_auc").alias("base"))
    named = inline_table(spark, ["feature", "name"], list(enumerate(names)))
    return areas.join(F.broadcast(named), "feature").crossJoin(F.broadcast(base)).select(
        F.col("name").alias("feature"), (F.col("base") - F.col("roc_auc")).alias("importance"))
