"""Text models: calibration and shortcut audit on Spark ML, style and separability on hashed terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.functions.values import hash_bucket
from lodestat.operators import hashed, letters


def platt(rows: DataFrame) -> DataFrame:
    """rows(id, logit, correct): logistic fit of correct on the logit, and the calibrated confidence of each row."""
    data = rows.withColumn("label", F.col("correct").cast("double"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["logit"], outputCol="features"), LogisticRegression(regParam=0.0, maxIter=50)]).fit(data)
    return model.transform(data).select("id", F.element_at(vector_to_array("probability"), 2).alias("conf"))


def style_scores(rows: DataFrame, train: Column, size: int = 1 << 14) -> DataFrame:
    """rows(id, text, label): id and the probability of label 1 of all rows, fitted on those of train, of which both labels weigh alike.

    Terms are words, runs of two words and character 3-grams, each once a text.
    """
    table = hashed.packed(rows.select("id", "label", train.alias("train"), "text"), hashed.style_counts, size, binary=True)
    return hashed.scored(table, *hashed.fitted(table.where("train"), size)).select("id", "score")


def shortcut_audit(rows: DataFrame, features: list[str], group: str, folds: int = 5, gate: float = 0.55) -> DataFrame:
    """AUROC of a label from surface features, out of fold, folds by group; over the gate the label leaks."""
    each = VectorAssembler(inputCols=features, outputCol="features").transform(rows.withColumn("_fold", hash_bucket(F.col(group), folds)))
    scored = None
    for k in range(folds):  # a fixed number of fits
        model = LogisticRegression(regParam=0.01, maxIter=30).fit(each.where(F.col("_fold") != k))
        part = model.transform(each.where(F.col("_fold") == k)).select("label", "rawPrediction", "_fold")
        scored = part if scored is None else scored.unionAll(part)
    auc = BinaryClassificationEvaluator().evaluate(scored)
    return rows.sparkSession.range(1).select(F.lit(float(auc)).alias("auroc"), F.lit(bool(max(auc, 1 - auc) > gate)).alias("leaks"))


def separability(rows: DataFrame, key: str, gate: float = 0.95, size: int = 1 << 14) -> DataFrame:
    """rows(key, text, label: 1 real, 0 synthetic): AUROC of character 3-grams weighed by tf-idf, learned on one half of the keys and measured on the other; over the gate the synthetic texts give themselves away."""
    table = hashed.packed(rows.select("label", hash_bucket(F.col(key), 2).alias("fold"), "text"), hashed.gram_counts, size, binary=False)
    scored = hashed.scored(table.where("fold = 1"), *hashed.fitted(table.where("fold = 0"), size))
    auc = float(BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(scored))
    return rows.sparkSession.range(1).select(F.lit(auc).alias("auroc"), F.lit(auc > gate).alias("iterate"))


def gram_kinds(rows: DataFrame, label: str, n: int = 3) -> DataFrame:
    """label, kind, share of each kind of character gram among all of a label: number, word edge, punctuation or letters, the first that one of its characters makes it.

    Counted for all texts of a batch. A label whose texts are all shorter than a gram has no shares.
    """
    kinds = ["letters", "punctuation", "word edge", "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters.kinds_of_letters()
        for b in batches:
            met: dict = {}
            for own, text in zip(b.column(0).to_pylist(), letters.texts_of(b.column(1)), strict=True):
                counts = met.setdefault(own, np.zeros(len(kinds), np.int64))
                if text is not None and len(text) >= n:
                    each = letters.looked_up(text, table)
                    worst = each[: len(each) - n + 1]
                    for i in range(1, n):
                        worst = np.maximum(worst, each[i : len(each) - n + 1 + i])
                    counts += np.bincount(worst, minlength=len(kinds))
            counts = np.array(list(met.values()), np.int64).reshape(-1, len(kinds))
            yield pa.RecordBatch.from_arrays([pa.array(list(met), b.column(0).type), *map(pa.array, np.ascontiguousarray(counts.T))], names=[label, *(f"n{i}" for i in range(len(kinds)))])

    names = [f"n{i}" for i in range(len(kinds))]
    each = rows.select(label, "text").mapInArrow(run, f"`{label}` {dict(rows.dtypes)[label]}, " + ", ".join(f"{c} long" for c in names))
    sums = each.groupBy(label).agg(*(F.sum(c).alias(c) for c in names)).withColumn("_all", sum((F.col(c) for c in names), F.lit(0)))
    out = sums.select(label, "_all", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("n")) for k, c in zip(kinds, names, strict=True)))).alias("x"))
    return out.select(label, "x.kind", "x.n", F.round(F.try_divide("x.n", "_all"), 6).alias("share"))
