"""Every query with a SQL twin gives the same rows on the smallest tables."""

import __spark_entry__ as entry
import compare
import pytest

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    _, problems = compare.compare(spark, duck, SF, QUERIES[name], TWINS[name])
    assert not problems, "\n".join(problems)


@pytest.mark.parametrize("name", ["feed_zip", "html_hashed", "score_urls"])
def test_query_without_twin_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
