"""Every query gets both of its lists."""

import numpy as np

from lodestat.plans import serving_queries

D = "/root/testdata/sf0.001"


def test_candidate_union_has_both_lists_of_each_query(spark):
    read = lambda t: spark.read.parquet(f"{D}/{t}.parquet").collect()
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in read("embeddings")}
    ids = sorted({r["doc_id"] for r in read("documents")} & set(v))
    got = {}
    for r in serving_queries.candidate_union(spark, D).collect():
        got.setdefault(r["query"], {})[r["id"]] = r["place"]
    asked = {r["item_id"] for r in read("benchmark")} & set(v)
    assert asked and set(got) == asked
    for q, places in got.items():
        cos = {i: round(float(v[q] @ v[i] / np.linalg.norm(v[q]) / np.linalg.norm(v[i])), 6) for i in ids if i != q}
        dense = sorted(cos, key=lambda i: (-cos[i], i))[:5]
        assert set(dense) <= set(places) <= set(cos) and len(places) <= 10
        assert sorted(places.values()) == list(range(1, len(places) + 1))
