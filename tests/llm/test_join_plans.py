"""Joins with exploded rows are never broadcast: the planner takes such tables for as small as before the explode."""

import pytest

from lodestat.llm import jaccard, simhash

TEXTS = [(i, f"words of text {i % 40} and so on, {'with more of them' if i % 3 else 'none'}") for i in range(200)]


@pytest.fixture
def plans(spark, monkeypatch):
    found = {}

    def spy(make):
        def run(df, name):
            found.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
            return make(df, name)

        return run

    monkeypatch.setattr(simhash, "written", spy(simhash.written))
    monkeypatch.setattr(jaccard, "written", spy(jaccard.written))
    return found


def test_buckets_are_not_broadcast(spark, plans):
    assert simhash.near_groups(spark.createDataFrame(TEXTS, "doc_id long, text string")).count() == len(TEXTS)
    for name in ("simhash-buckets", "simhash-stars"):
        assert "BroadcastHashJoin" not in plans[name], name


def test_texts_of_pairs_are_not_broadcast(spark, plans):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert 0 < simhash.one_of_each(docs).count() < len(TEXTS)
    for name in ("simhash-buckets", "simhash-stars", "jaccard-texts", "simhash-links"):
        assert "BroadcastHashJoin" not in plans[name], name
