"""Fitted models: flattened trees, importance of all features, attributions that add up."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from urlsieve import constants as K
from urlsieve.operators import explain as X, features as FE, models as MD

NAMES = ["a", "b", "c", "unused"]


@pytest.fixture(scope="module")
def trees(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.2 * rng.normal(size=600) > 0).astype(int)
    df = spark.createDataFrame([(*map(float, r), 0.0, int(t)) for r, t in zip(x, y)], "a double, b double, c double, unused double, label int").cache()
    return df, MD.train_trees(df, NAMES, rounds=5, depth=3, step=0.3)


def test_flat_trees_score_like_the_model(spark, trees):
    df, model = trees
    flat = MD.FlatTrees.of(model, spark)
    rows = model.transform(df).select(*NAMES, MD.probability_of().alias("p")).toPandas()
    x = rows[NAMES].to_numpy(float)
    margin = sum(flat.margins(x, t) for t in range(len(flat.roots)))
    assert np.allclose(1 / (1 + np.exp(-2 * margin)), rows.p, atol=1e-12) and len(flat.roots) == 5


def area(score, label):
    p, q = score[label == 1], score[label == 0]
    return ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))


def test_importance_equals_permuting_by_hand(spark, trees):
    df, model = trees
    held = df.repartition(3)
    got = {r["feature"]: r["importance"] for r in MD.permutation_importance(model, held, NAMES, seed=7).collect()}
    assert list(sorted(got)) == sorted(NAMES) and got["unused"] == 0.0 and got["a"] > got["b"] > 0.0
    # one batch of rows: the same permutations by hand
    one = df.limit(200).coalesce(1)
    flat, batch = MD.FlatTrees.of(model, spark), one.toPandas()
    frames = list(MD.permuted_scores(flat, NAMES, "label", 7)(iter([batch])))
    x, y = batch[NAMES].to_numpy(float), batch.label.to_numpy()
    for frame in frames:
        j, z = int(frame.feature.iloc[0]), x.copy()
        if j >= 0:
            z[:, j] = np.random.default_rng([7, j, 0]).permutation(x[:, j])
        want = sum(flat.margins(z, t) for t in range(5))
        assert np.allclose(frame.score, want) and math.isclose(area(frame.score.to_numpy(), y), area(want, y), abs_tol=1e-9)
    assert MD.permutation_importance(model, df.limit(0), NAMES).count() == 0


def test_attributions_add_up_to_the_log_odds(spark):
    urls = [(i, f"https://{'pay' if i % 2 else 'www'}-site{i}.example.{'tk' if i % 2 else 'com'}/{'login' * (i % 3)}?q={i}", i % 2) for i in range(60)]
    df = spark.createDataFrame([*urls, (60, "", 0), (61, "ab", 1)], "id int, url string, label int").repartition(4)
    stats = FE.feature_stats(FE.lexical_features(df, "url", ("id", "label")))
    for bits in (6, 12):  # with many and with few pieces in one cell
        model = MD.train_url_model(df, stats, bits=bits, iterations=5)
        vectors = MD.url_sequence_features(df, stats, "url", ("id",), bits=bits)
        want = {r["id"]: r["z"] for r in model.transform(vectors).select("id", vector_to_array("rawPrediction")[1].alias("z")).collect()}
        parts = X.explain_url_model(model, df, stats, ("id",), bits=bits)
        got = {r["id"]: r["z"] for r in parts.groupBy("id").agg(F.sum("attribution").alias("z")).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
        assert parts.where("kind = 'lexical'").count() == 62 * len(K.LEXICAL_FEATURES)


def test_page_vectors_are_those_of_hashing_tf(spark):
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.sql import functions as F

    from urlsieve.operators import pages as P

    texts = ["<p>abc abc</p>", "", None, "ab", "abc", "žluťoučký kůň 日本語のページ 😀😀😀 é", "x" * 500, "a😀b" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, html string")
    grams = df.withColumn("grams", P.all_ngrams(P.normalize_html(F.col("html"))))
    for bits in (6, 20):
        counts = HashingTF(inputCol="grams", outputCol="counts", numFeatures=1 << bits).transform(grams)
        want = {r["id"]: r["v"] for r in Normalizer(inputCol="counts", outputCol="v", p=2.0).transform(counts).select("id", "v").collect()}
        got = {r["id"]: r["features"] for r in MD.page_features(df, bits=bits).select("id", "features").collect()}
        assert got == want


def test_page_vectors_leave_the_jvm_once(spark):
    """Pieces are neither listed as strings nor sent through a row-wise function."""
    df = spark.createDataFrame([(1, "<p>abc</p>")], "id int, html string")
    plan = MD.page_features(df)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "BatchEvalPython" not in plan


def test_evaluation_scores_rows_once(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from urlsieve.plans import model_queries as Q

    seen = spark.sparkContext.accumulator(0)

    def score(x):
        seen.add(1)
        return [1 - x / 40, x / 40]

    rows = spark.range(0, 40, 1, 2).select((F.col("id") % 2).alias("label"), array_to_vector(F.udf(score, "array<double>")("id")).alias("probability"))
    assert Q.evaluation(rows).count() == 1
    assert seen.value == 40


def test_url_families_are_dealt_by_pages(spark, tmp_path):
    """A small file becomes many URLs and large vectors, so partitions are bounded by pages, not by bytes."""
    from pyspark.sql import functions as F

    from urlsieve.plans.tables import FAMILY, FAMILY_PAGES, urls

    n = FAMILY_PAGES * 6
    spark.range(0, n, 1, 1).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.com/"), "id").alias("url")).write.parquet(f"{tmp_path}/pages.parquet")
    sizes = [r["count"] for r in urls(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n * len(FAMILY) and max(sizes) <= 1.1 * FAMILY_PAGES * len(FAMILY)


def test_url_vectors_are_those_of_hashing_tf(spark):
    from pyspark.ml.feature import HashingTF, VectorAssembler
    from pyspark.sql import functions as F

    from urlsieve.functions.text import strip
    from urlsieve.operators import pages as P

    texts = ["http://a.b/abc?abc", "", " \t", "ab", "abc", None, "http://h/é?ü=²%zz", "a\tb\x01\nc", "日本語の😀😀😀", "http://x/" + "ab1-" * 300, "  'q.vn'\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, url string").repartition(2)
    known = df.where("url IS NOT NULL")
    stats = FE.feature_stats(FE.lexical_features(known, "url", ("id",)))
    z = FE.normalize_features(FE.lexical_features(known.withColumn("url", strip(F.col("url"))), "url", ("id", "url")), stats, ("id", "url"))
    grams = z.withColumn("grams", P.all_ngrams(F.col("url"), MD.URL_NGRAMS))
    for bits in (5, 18):
        counts = HashingTF(inputCol="grams", outputCol="counts", numFeatures=1 << bits, binary=True).transform(grams)
        want = {r["id"]: r["v"] for r in VectorAssembler(inputCols=["counts", *K.LEXICAL_FEATURES], outputCol="v").transform(counts).select("id", "v").collect()}
        got = {r["id"]: r["features"] for r in MD.url_sequence_features(df, stats, "url", ("id",), bits=bits).collect()}
        assert got.pop(5).numNonzeros() <= len(K.LEXICAL_FEATURES)
        assert got == want and all(len(v.indices) == v.numNonzeros() for v in got.values())
    # texts of one batch are cut into chunks
    chunk, MD._CHUNK = MD._CHUNK, 64
    try:
        import pyarrow as pa

        rows = [t or "" for t in texts]
        numbers = pa.array([[float(i), 0.0] for i in range(len(rows))])
        few = MD.url_vectors(MD.URL_NGRAMS, 12)(pa.array(rows), numbers).to_pylist()
    finally:
        MD._CHUNK = chunk
    assert few == MD.url_vectors(MD.URL_NGRAMS, 12)(pa.array(rows), numbers).to_pylist()


def test_urls_are_parsed_once_and_hashed_in_arrays(spark, tmp_path):
    """Training reads URLs many times: their features are stored, and pieces are not listed as strings."""
    from pyspark.sql import functions as F

    from urlsieve.plans import model_queries as Q

    host = F.concat(F.when(F.col("id") % 3 == 0, "casino").otherwise("site"), "id", F.lit(".com/login?x="), F.col("id") * 7)
    spark.range(0, 40).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), host).alias("url")).write.parquet(f"{tmp_path}/pages.parquet")
    rows, stats, _ = Q._url_model(spark, str(tmp_path))
    vectors = MD.vectors_of(rows, stats, "url", Q.KEYS, bits=8)
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "parquet" not in plan and vectors.count() == rows.count()
    want = {r["feature"]: r for r in FE.feature_stats(Q.training_rows(FE.lexical_features(Q.urls(spark, str(tmp_path)), "url", (*Q.KEYS, "label")))).collect()}
    for r in stats.collect():
        assert math.isclose(r["mean"], want[r["feature"]]["mean"], abs_tol=1e-9) and math.isclose(r["std"], want[r["feature"]]["std"], abs_tol=1e-9)


def test_tree_rows_are_split_before_urls_are_taken_apart(spark, tmp_path, monkeypatch):
    """The split reads its rows several times; stored partitions follow pages, and rows and splits stay as they were."""
    from pyspark.sql import functions as F

    from urlsieve.operators import splits as S
    from urlsieve.plans import model_queries as Q
    from urlsieve.plans.tables import FAMILY, FAMILY_PAGES

    n = FAMILY_PAGES * 5
    host = F.concat(F.when(F.col("id") % 3 == 0, "casino").otherwise("site"), "id", F.lit(".com/a"))
    spark.range(0, n, 1, 1).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), host).alias("url")).write.parquet(f"{tmp_path}/pages.parquet")
    seen, plain = [], FE.tabular_features
    monkeypatch.setattr(FE, "tabular_features", lambda df, *rest: seen.append(df.columns) or plain(df, *rest))
    rows = Q.split_features(spark, str(tmp_path))
    assert seen == [["page_id", "variant", "url", "label", "split"]]
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n * len(FAMILY) and max(sizes) <= 1.1 * FAMILY_PAGES * len(FAMILY)
    want = S.random_split(Q.urls(spark, str(tmp_path)), Q.KEYS).select(*Q.KEYS, "label", "split")
    assert rows.select(want.columns).exceptAll(want).isEmpty()
