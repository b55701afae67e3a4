"""Exact bounds on rates, from counts that Spark has aggregated: small Arrow UDFs over a few result rows, and tables built once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_binomial_tail(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X >= k) of a binomial, from its greatest term on as far as a double can tell."""
    out = np.zeros(len(k))
    for i, (a, b, q) in enumerate(zip(k, n, p, strict=True)):
        width = int(12 * math.sqrt(b) + 50)
        lo = max(int(a), int(b * q) - width)
        j = np.arange(lo, min(int(b), max(lo, int(b * q)) + width) + 1)
        logs = [math.lgamma(b + 1) - math.lgamma(x + 1) - math.lgamma(b - x + 1) + x * math.log(q) + (b - x) * math.log1p(-q) for x in j]
        out[i] = sum(map(math.exp, logs))
    return out


def cp_lower_values(k: pd.Series, n: pd.Series, alpha: float) -> pd.Series:
    """One-sided Clopper-Pearson lower bounds, by bisection on the tail."""
    lo, hi = np.zeros(len(k)), np.where(n > 0, k / np.maximum(n, 1), 0.0)
    for _ in range(50):
        mid = (lo + hi) / 2
        tail = np.where(k > 0, log_binomial_tail(k.to_numpy(), n.to_numpy(), np.clip(mid, 1e-15, 1 - 1e-15)), 0.0)
        low = tail < alpha
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return pd.Series(np.where(k > 0, lo, 0.0))


def with_exact_bounds(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """counts(k, n): one-sided lower bound and its mirror for the upper one."""

    @F.pandas_udf(T.DoubleType())
    def lower(k: pd.Series, n: pd.Series) -> pd.Series:
        return cp_lower_values(k, n, alpha).round(6)

    return counts.withColumn("low", lower("k", "n")).withColumn("high", F.round(1 - lower(F.col("n") - F.col("k"), "n"), 6))


def kmin_values(lo: int, hi: int, target: float, alpha: float) -> list[int]:
    """For n = lo..hi-1 the least k with P(X >= k) <= alpha.

    k grows by 0 or 1 from n to n + 1, and so does the tail by recurrence: P(X >= k) of n + 1 is that of n and the
    target's part of P(X = k - 1) of n. Only the first tail of a block is summed, from its greatest term on.
    """
    log_pmf = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(target) + (n - k) * math.log1p(-target)
    n, out = lo, []
    width = int(12 * math.sqrt(n) + 50)
    k = min(n + 1, max(0, int(n * target) - width))
    tail = sum(math.exp(log_pmf(n, j)) for j in range(k, min(n, k + 3 * width) + 1)) if k <= n else 0.0
    while k <= n and tail > alpha:
        tail -= math.exp(log_pmf(n, k))
        k += 1
    while n < hi:
        out.append(k if tail <= alpha else k + 1)
        # to n + 1: what lay at k - 1 and is right once more comes in
        if k >= 1:
            tail += target * math.exp(log_pmf(n, k - 1))
        n += 1
        if k <= n and tail > alpha:
            tail -= math.exp(log_pmf(n, k))
            k += 1
    return out


def kmin_table(spark: SparkSession, nmax: int, target: float, alpha: float = 0.05, block: int = 4096) -> DataFrame:
    """n, kmin: how many of n must be right for the lower bound to reach the target. Blocks of n are worked out apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                n = np.arange(1 + i * block, min(nmax, (i + 1) * block) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(kmin_values(int(n[0]), int(n[-1]) + 1, target, alpha), pa.int64())], names=["n", "kmin"])

    blocks = -(-nmax // block)
    return spark.range(0, blocks, 1, max(1, min(blocks, 64))).mapInArrow(run, "n long, kmin long")


def poisson_tail(k: int, mean: float) -> float:
    """P(X <= k): terms from the greatest one down, as many as a double can tell."""
    top = min(k, int(mean))
    term = math.exp(-mean + top * math.log(mean) - math.lgamma(top + 1))
    total, t, i = 0.0, term, top
    while i >= 0 and t > term * 1e-18:
        total, t, i = total + t, t * i / mean, i - 1
    t, i = term * mean / (top + 1), top + 1
    while i <= k and t > term * 1e-18:
        total, t, i = total + t, t * mean / (i + 1), i + 1
    return total


def poisson_upper_value(k: int, alpha: float = 0.05) -> float:
    """Exact one-sided upper bound on the mean of a Poisson count."""
    lo, hi = 0.0, k + 20.0 + 10 * math.sqrt(k + 1)
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid == 0 or poisson_tail(k, mid) > alpha else (lo, mid)
    return lo


def rate_per_million(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """counts(k, n): events per million places and their exact upper bound."""

    @F.pandas_udf(T.DoubleType())
    def upper(k: pd.Series) -> pd.Series:
        return k.map(lambda x: poisson_upper_value(int(x), alpha))

    return counts.withColumn("rate", F.round(1e6 * F.col("k") / F.col("n"), 6)).withColumn("upper", F.round(1e6 * upper("k") / F.col("n"), 6))


def residual_noise(cells: DataFrame, draws: int = 20000, seed: int = 7, gate: float = 0.02) -> DataFrame:
    """cells(pool, reviewed, wrong): posterior mean and 95 % bound of the pool's noise, Jeffreys prior in each cell, and whether the bound is within the gate.

    A cell's draws are made together; they are summed over the cells of a task before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros(draws), 0.0
        for b in batches:
            for pool, reviewed, wrong in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rng = np.random.default_rng((seed, pool, reviewed, wrong))
                total += pool * rng.beta(wrong + 0.5, reviewed - wrong + 0.5, draws)
                size += pool
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(total), pa.array(np.full(draws, size))], names=["draw", "noise", "pool"])

    each = cells.select("pool", "reviewed", "wrong").mapInArrow(run, "draw long, noise double, pool double")
    total = each.groupBy("draw").agg((F.sum("noise") / F.sum("pool")).alias("noise"))
    out = total.agg(F.avg("noise").alias("mean"), F.percentile("noise", F.lit(0.95)).alias("bound"))
    return out.withColumn("within", F.col("bound") <= gate)
