"""Token-level analytics over top-k tables: penalties, nucleus cut, rare-token mass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seen_before(candidates: DataFrame, generated: DataFrame) -> DataFrame:
    """candidates(answer, pos, token, ...) with whether the answer has generated the token at an earlier place."""
    first = generated.groupBy("answer", "token").agg(F.min("pos").alias("_first"))
    return candidates.join(first, ["answer", "token"], "left").withColumn("seen", F.coalesce(F.col("_first") < F.col("pos"), F.lit(False))).drop("_first")


def nucleus(candidates: DataFrame, top_p: float) -> DataFrame:
    """Candidates (answer, pos, token, p) in order of probability until the mass is reached, the crossing one kept, renormalised."""
    w = Window.partitionBy("answer", "pos").orderBy(F.desc("p"), "token")
    before = F.coalesce(F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = candidates.withColumn("_before", before).where(F.col("_before") < top_p).drop("_before")
    return kept.withColumn("q", F.col("p") / F.sum("p").over(Window.partitionBy("answer", "pos")))


def penalised(candidates: DataFrame, penalty: float, temperature: float) -> DataFrame:
    """Softmax of (logit - penalty where seen) / temperature at each place."""
    w = Window.partitionBy("answer", "pos")
    x = (F.col("logit") - F.when(F.col("seen"), penalty).otherwise(0.0)) / temperature
    e = F.exp(x - F.max(x).over(w))
    return candidates.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def rare_rate(candidates: DataFrame, rare: Column, *by: str) -> DataFrame:
    """Expected rare tokens per million places from renormalised masses q."""
    mass = candidates.groupBy(*by, "answer", "pos").agg(F.sum(F.when(rare, F.col("q")).otherwise(0.0)).alias("m"))
    return mass.groupBy(*by).agg(F.count("*").alias("places"), F.round(F.sum("m") * 1e6 / F.count("*"), 4).alias("per_million"))
