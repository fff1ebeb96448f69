"""Some of the named queries against their SQL; ``oracle.py`` runs them all."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SMALL
from oracle import compare, connect
from vacatlas.operators import clustering as C

CHECKED = [
    "dedup_postings", "clean_postings", "clean_pages", "states", "yoe", "salary_annual", "skills_long", "summaries",
    "title_words", "filters_combined", "search_text", "min_support", "kpis", "region_stats", "cluster_summary",
    "box_stats_cluster", "salary_histogram", "crosstab_long", "skill_gaps", "tfidf_weights", "silhouette", "weekly_events",
    "silhouette_euclidean", "kmeans_embeddings", "choose_k", "vocabulary", "region_stats_sketched",
]


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, db, name):
    assert compare(queries()[name](spark, SMALL), db, oracle_sql()[name]) == ""


def test_entry(spark):
    assert entry(spark).count() > 0


def test_cluster_postings_takes_the_starts_of_the_operator(spark, monkeypatch):
    class Tried(Exception):
        pass

    def chosen(points, key, min_k, max_k, seed, starts, **_):
        raise Tried(min_k, max_k, starts)

    monkeypatch.setattr(C, "choose_k", chosen)
    with pytest.raises(Tried) as found:
        queries()["cluster_postings"](spark, SMALL)
    assert found.value.args == (5, 15, 10)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
