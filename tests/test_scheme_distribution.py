"""A text of more than 100,000 lines."""

from lodestat.plans import item_queries

D = "/root/testdata/sf0.001"


def test_scheme_distribution_of_a_long_text(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a line here\n" * 100_400)], "doc_id long, text string")
    monkeypatch.setattr(item_queries, "docs", lambda s, d: rows)
    assert sum(r["n"] for r in item_queries.scheme_distribution(spark, D).collect()) == 25_100
