"""Ties at the cut go by id."""

from lodestat.operators import retrieval


def test_nearest_ties_by_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(3000)][::-1]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(7)
    got = retrieval.nearest(v, v.where("id = 7"), 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 1, 2]
