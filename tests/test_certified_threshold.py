"""A cell of more than 100,000 decisions."""

from lodestat.plans import decision_queries

D = "/root/testdata/sf0.001"


def test_certified_threshold_of_a_large_cell(spark, monkeypatch):
    rows = spark.range(300_000).selectExpr("'a' as arm", "'x' as layer", "case when id < 1000 then 0.9D else 0.4D end as conf", "true as correct")
    monkeypatch.setattr(decision_queries, "decisions", lambda s, d: rows)
    assert [tuple(r) for r in decision_queries.certified_threshold(spark, D).collect()] == [("a", "x", 0.4)]


def test_needed_count_that_is_a_whole_number(spark, monkeypatch):
    # 0.8 * 121 + 1.2 * 11 is 110
    rows = spark.range(121).selectExpr("'a' as arm", "'x' as layer", "0.9D as conf", "id < 110 as correct")
    monkeypatch.setattr(decision_queries, "decisions", lambda s, d: rows)
    assert [tuple(r) for r in decision_queries.certified_threshold(spark, D).collect()] == [("a", "x", 0.9)]
