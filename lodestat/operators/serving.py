"""Summaries of serving logs: latency, load, counters, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.values import wilson
from lodestat.operators.ordered import running


def benchmark_summary(requests: DataFrame, *by: str, most_cv: float = 0.05) -> DataFrame:
    """requests(latency, failed) of each run: mean, median, p95, p99; runs with a failure are left out; unstable where the variation is too large."""
    q = lambda p: F.round(F.percentile("latency", F.lit(p)), 6)
    out = requests.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"), F.round(F.avg("latency"), 6).alias("mean"), q(0.5).alias("median"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.round(F.stddev_samp("latency") / F.avg("latency"), 6).alias("cv"))
    return out.where("failures = 0").drop("failures").withColumn("unstable", F.col("cv") > most_cv)


def acceptance_by_position(drafts: DataFrame) -> DataFrame:
    """drafts(position, accepted): share accepted at each draft position and over all (null)."""
    return drafts.rollup("position").agg(F.count("*").alias("drafted"), F.count_if("accepted").alias("accepted")).withColumn("rate", F.round(F.col("accepted") / F.col("drafted"), 6))


def counter_deltas(samples: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Growth of a monotone counter from sample to sample; a reset counts from zero."""
    w = Window.partitionBy(key).orderBy(ts)
    before = F.lag(value).over(w)
    delta = F.when(before.isNull(), None).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    return samples.withColumn("delta", delta)


def load_windows(events: DataFrame, ts: str, width: str, value: str) -> DataFrame:
    """Requests, p50 and p95 of each tumbling window."""
    return events.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95")).select(F.col("w.start").alias("start"), "n", "p50", "p95")


def profile_of(counts: DataFrame) -> DataFrame:
    """counts(start, value, n) of closed windows: requests, p50 and p95, each the least value that so many per cent do not exceed. A null value counts in n only."""
    each = running(counts.withColumn("m", F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)), [F.col("value")], ["m"], "start")
    reached = (F.col("m_ahead") + F.col("m")) * 100
    at = lambda p: F.min(F.when(reached >= F.col("m_all") * p, F.col("value")))
    return each.groupBy("start").agg(F.sum("n").alias("n"), at(50).alias("p50"), at(95).alias("p95"))


def gate_windows(events: DataFrame, ts: str, width: str, flag: Column, baseline: float) -> DataFrame:
    """Share of flagged rows of each window with Wilson bounds; alarm where the lower one passes the baseline."""
    out = events.groupBy(F.window(ts, width).alias("w")).agg(F.count_if(flag).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.select(F.col("w.start").alias("start"), "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), (F.round(low, 6) > baseline).alias("alarm"))


def sessions(events: DataFrame, key: str, ts: str, gap: str, most: int) -> DataFrame:
    """Sessions of a key by gaps in time, with their size against a ceiling."""
    out = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "n", (F.col("n") > most).alias("over"))


def growth_per_step(samples: DataFrame, step: str, value: str, run: int = 1024) -> DataFrame:
    """Greatest value of each step and its growth over the step before.

    Steps are taken in runs of so many; only the last step of each run is ordered over all of them.
    """
    tops = samples.groupBy(step).agg(F.max(value).alias("top")).withColumn("_run", F.floor(F.col(step) / run))
    ends = tops.groupBy("_run").agg(F.max_by("top", step).alias("_end"))
    ends = ends.select("_run", F.lag("_end").over(Window.orderBy("_run")).alias("_end"))  # a row for each run of steps
    before = F.coalesce(F.lag("top").over(Window.partitionBy("_run").orderBy(step)), F.col("_end"))
    return tops.join(ends, "_run").select(step, "top", F.round(F.col("top") - before, 6).alias("growth"))
