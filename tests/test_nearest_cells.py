"""Nearest vectors by cells: the rows of a plain search, from fewer products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import retrieval


def table(spark, v, family):
    return spark.createDataFrame([(i, x.tolist(), f) for i, (x, f) in enumerate(zip(v, family, strict=True))], "id long, v array<double>, family string")


@pytest.mark.parametrize("exclude", [None, "family"])
@pytest.mark.parametrize("spread", [0.05, 1.0, 0.0])
def test_cells_lose_nothing(spark, monkeypatch, exclude, spread):
    """Tight groups, one cloud, and copies only (all ties)."""
    r = np.random.default_rng(3)
    middle = r.normal(size=(12, 6))
    v = middle[r.integers(0, 12, 400)] + spread * r.normal(size=(400, 6))
    v[7] = 0.0
    family = r.choice(["a", "b", "c"], 400).tolist()
    df = table(spark, v, family)
    seen = []
    plain = retrieval.products

    def counting(slabs, blocks, k, exclude):
        seen.append(retrieval.pairs_of(slabs, blocks).agg(F.sum(F.size("x") * F.size("q"))).first()[0] or 0)
        return plain(slabs, blocks, k, exclude)

    monkeypatch.setattr(retrieval, "products", counting)
    got = {}
    for x in retrieval.nearest(df, df.where("id % 9 = 0"), 4, exclude, block=16, slab=40).collect():
        got.setdefault(x["query"], []).append((x["rank"], x["id"], x["cosine"]))
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    sim = np.round(u @ u.T, 6)
    for q in range(0, 400, 9):
        keep = [i for i in range(400) if i != q and (exclude is None or family[i] != family[q])]
        want = sorted(keep, key=lambda i: (-sim[q, i], i))[:4]
        assert [i for _, i, _ in sorted(got[q])] == want
    if spread == 0.05:
        assert sum(seen) < 0.5 * 400 * 45


def test_empty(spark):
    none = table(spark, np.zeros((0, 2)), [])
    some = table(spark, np.eye(2), ["a", "b"])
    assert retrieval.nearest(none, some, 3).count() == 0 and retrieval.nearest(some, none, 3).count() == 0
