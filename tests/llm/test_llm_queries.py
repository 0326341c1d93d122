"""Every corpus query and the pipeline run over whole tables."""

import __spark_entry__ as entry
import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"
COUNTS = {"op2": "documents", "op4": "documents", "op5": "documents", "op6": "documents", "op7": "documents",
          "op8": "pages", "op9": "documents", "op10": "documents"}


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op")))
def test_query(spark, name):
    got = entry.queries()[name](spark, SF)
    table = COUNTS.get(name.split("_")[0])
    assert got.count() == (spark.read.parquet(f"{SF}/{table}.parquet").count() if table else got.count()) > 0


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total, before = docs.count(), docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.count() <= before
        before = docs.count()
    assert before > 0.5 * total
    pieces = corpus_pipeline.packed(spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
PROSE = "the of and to in a is that it was for on are as with his they at be this have from or one had by words but not what all were we when your can said"
ROWS = [(None, PROSE, "en", "a", 1), (1, None, None, None, None), (2, "", "en", "a", 0), (3, PROSE, "en", None, 9), (3, PROSE, "en", None, 9),
        (4, PROSE.upper(), None, "b", 9), (5, LONG, "de", "a", 1), (6, f"{PROSE} token=abcdefgh1234", "en", "a", 1), (7, " \t\n", "en", "b", 3),
        (8, f"{PROSE} <|endoftext|> é日😀", "en", "b", 3), (3, f"{PROSE} under the same key", "en", "b", 3)]


@pytest.mark.parametrize("rows", [ROWS, [], ROWS[1:3]], ids=["odd", "none", "blank"])
def test_stages_take_any_rows(spark, tmp_path, rows):
    """Nulls in any column, blank, repeated and very long texts, shared keys and empty tables, through all stages in turn."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/0")
    left = {r["doc_id"] for r in rows_of(docs)}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, spark.read.parquet(f"{tmp_path}/{i}"), SF).write.parquet(f"{tmp_path}/{i + 1}")
        out = spark.read.parquet(f"{tmp_path}/{i + 1}")
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= left and (i == 4 or out.columns == list(corpus_pipeline.COLUMNS))
        left = ids
    if len(rows) > 3:
        masked = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/4").collect()}
        assert all("abcdefgh1234" not in (t or "") for t in masked.values())


def rows_of(df):
    return df.select("doc_id").collect()


def test_stages_one_by_one_on_odd_rows(spark):
    """Each stage on the raw odd rows, which an earlier stage might have dropped."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {name: [(r["doc_id"], r["text"]) for r in stage(spark, docs, SF).collect()] for name, stage in corpus_pipeline.STAGES[:-1]}
    # near copies, two of them under the smallest key: one document stays
    assert [k for k, _ in kept["near_duplicates"]].count(3) == 1 and not {k for k, _ in kept["near_duplicates"]} & {4, 8}
    assert (None, PROSE) in kept["near_duplicates"] and len(kept["secrets"]) == len(ROWS) == len(kept["toxicity"])
    assert not {k for k, _ in kept["quality_rules"]} & {1, 2, 7}


def test_token_counts_query_finds_earlier_counts(spark, tmp_path):
    from urlsieve.llm import queries

    spark.conf.set(queries.COUNT_CACHE, f"{tmp_path}/cache")
    try:
        rows = sorted(map(tuple, queries.QUERIES["op10_token_counts"](spark, SF).collect()))
        stored = spark.read.parquet(f"{tmp_path}/cache").count()
        assert sorted(map(tuple, queries.QUERIES["op10_token_counts"](spark, SF).collect())) == rows
        assert spark.read.parquet(f"{tmp_path}/cache").count() == stored > 0  # the second run encoded nothing
    finally:
        spark.conf.unset(queries.COUNT_CACHE)
