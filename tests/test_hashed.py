"""Hashed terms and the fit over them against Spark ML."""

import re

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lodestat.operators import hashed, models

SIZE = 256
TEXTS = ["abc d", "", "ab", "héllo wörld 日本 👍🏽x", "The quick brown fox jumps over it_1 2 x" * 3, "a\n\nb"]


def grams(x):
    return [x[i : i + 3] for i in range(len(x) - 2)] or [x]


def test_buckets_are_those_of_hashing_tf(spark):
    def terms(x):
        w = re.findall(r"\w+", x.lower())
        return [*w, *map(" ".join, zip(w, w[1:], strict=False)), *grams(x)]

    rows = HashingTF(inputCol="t", outputCol="v", numFeatures=1 << 14).transform(spark.createDataFrame([(terms(x),) for x in TEXTS], "t array<string>")).collect()
    for x, r in zip(TEXTS, rows, strict=True):
        assert np.array_equal(hashed.style_counts(x, 1 << 14), r["v"].toArray())


def test_blocks_change_nothing(monkeypatch):
    want = [hashed.style_counts(x, SIZE).tolist() for x in TEXTS]
    monkeypatch.setattr(hashed, "BLOCK", 4)
    assert [hashed.style_counts(x, SIZE).tolist() for x in TEXTS] == want


def test_fit_is_that_of_spark_ml(spark):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "quia"][: 5 + i % 3 // 2], 8)), float(i % 3 == 0)) for i in range(300)]
    rows = spark.createDataFrame(texts, "id long, text string, label double")
    table = hashed.packed(rows, hashed.gram_counts, SIZE, binary=False)
    got = {r["id"]: r["score"] for r in hashed.scored(table, *hashed.fitted(table, SIZE, most=500, close=1e-12)).collect()}
    data = spark.createDataFrame([(i, grams(t), y, 1.5 if y else 0.75) for i, t, y in texts], "id long, terms array<string>, label double, weight double")
    stages = [HashingTF(inputCol="terms", outputCol="tf", numFeatures=SIZE), IDF(inputCol="tf", outputCol="features"), LogisticRegression(regParam=0.01, maxIter=500, tol=1e-12, weightCol="weight")]
    want = Pipeline(stages=stages).fit(data).transform(data).select("id", F.element_at(vector_to_array("probability"), 2).alias("p")).collect()
    assert max(abs(got[r["id"]] - r["p"]) for r in want) < 1e-4


def test_one_label_and_null_texts(spark):
    rows = spark.createDataFrame([(1, "a b", 1.0), (2, None, 1.0), (3, "c", 0.0)], "id long, text string, label double")
    assert {r["id"]: r["score"] for r in models.style_scores(rows, F.col("id") < 3).collect()} == {1: 1.0, 2: 1.0, 3: 1.0}
