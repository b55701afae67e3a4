"""Paired comparison of runs on common items, resampling, corrections for many tests."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.values import binomial_two_sided
from lodestat.operators.ordered import running


def paired(a: DataFrame, b: DataFrame, *keys: str, value: str = "passed") -> DataFrame:
    """Items of both runs with their values as a and b; what only one run has does not count."""
    return a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), list(keys))


def mcnemar(pairs: DataFrame, *by: str, exact_below: int | None = None) -> DataFrame:
    """n11, n10, n01, n00 and the exact two-sided p of pairs(a, b); from exact_below discordant pairs on, chi squared with continuity correction decides."""
    a, b = F.col("a"), F.col("b")
    out = pairs.groupBy(*by).agg(F.count_if(a & b).alias("n11"), F.count_if(a & ~b).alias("n10"), F.count_if(~a & b).alias("n01"), F.count_if(~a & ~b).alias("n00"))
    n10, n01 = F.col("n10"), F.col("n01")
    chi = F.when(n10 + n01 > 0, (F.abs(n10 - n01) - 1) ** 2 / (n10 + n01)).otherwise(0.0)
    out = out.withColumn("chi2", F.round(chi, 6)).withColumn("p_exact", F.round(binomial_two_sided(n10, n01), 6))
    return out if exact_below is None else out.withColumn("exact", n10 + n01 < exact_below)


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    """Upper tail of chi squared with one degree of freedom; for a few result rows."""
    return x.map(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2)))


def mcnemar_p(pairs: DataFrame, *by: str, exact_below: int = 25) -> DataFrame:
    """mcnemar with p: exact below so many discordant pairs, else from chi squared."""
    out = mcnemar(pairs, *by, exact_below=exact_below)
    return out.withColumn("p", F.when(F.col("exact"), F.col("p_exact")).otherwise(F.round(chi2_tail("chi2"), 6)))


def rate_difference(pairs: DataFrame, margin: float, z: float = 1.959963984540054) -> DataFrame:
    """(b - a) / n with a Wald interval from discordant pairs, and what it says against a non-inferiority margin."""
    a, b = F.col("a"), F.col("b")
    c = pairs.agg(F.count("*").alias("n"), F.count_if(~a & b).alias("gain"), F.count_if(a & ~b).alias("loss"))
    g, x, n = F.col("gain"), F.col("loss"), F.col("n")
    d = (g - x) / n
    se = F.sqrt(g + x - (g - x) * (g - x) / n) / n
    c = c.withColumn("diff", F.round(d, 6)).withColumn("low", F.round(d - z * se, 6)).withColumn("high", F.round(d + z * se, 6))
    return c.withColumn("verdict", F.when(F.col("low") > margin, "non-inferior").when(F.col("high") < margin, "worse").otherwise("undecided"))


def holm(ps: DataFrame, p: str = "p", name: str = "arm") -> DataFrame:
    """Adjusted p of a family of tests (one row each): running maximum of (m - rank + 1) * p, at most 1."""
    order = Window.orderBy(p, name)  # a row a test: as many as there are arms, whatever the data
    m = ps.withColumn("m", F.count("*").over(Window.partitionBy(F.lit(0)))).withColumn("rn", F.row_number().over(order))
    step = (F.col("m") - F.col("rn") + 1) * F.col(p)
    return m.withColumn("p_adjusted", F.round(F.least(F.lit(1.0), F.max(step).over(order.rowsBetween(Window.unboundedPreceding, 0))), 6)).drop("m", "rn")


def sign_test(diffs: DataFrame, *by: str) -> DataFrame:
    """diffs(d): positive, negative, zero and the exact two-sided p without zeros."""
    out = diffs.groupBy(*by).agg(F.count_if(F.col("d") > 0).alias("pos"), F.count_if(F.col("d") < 0).alias("neg"), F.count_if(F.col("d") == 0).alias("zero"))
    return out.withColumn("p", F.round(binomial_two_sided(F.col("pos"), F.col("neg")), 6))


def average_rank(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    """rows with rank: that of value within its group, ties sharing the mean of theirs.

    Counts of distinct values are ranked, not rows, and by ranges of the values.
    """
    keyed = rows.withColumn("_v", value)
    counts = keyed.groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    ranks = running(counts, [F.col("_v")], ["_n"], *by).withColumn("rank", F.col("_n_ahead") + (F.col("_n") + 1) / 2).select(*by, "_v", "rank")
    return keyed.join(ranks, [*by, "_v"]).drop("_v")


def wilcoxon(diffs: DataFrame, *by: str) -> DataFrame:
    """W+ and W- of diffs(d), zeros dropped, average ranks of |d|."""
    ranked = average_rank(diffs.where("d <> 0"), F.abs("d"), *by)
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("rank"))), F.lit(0.0))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), side(F.col("d") > 0).alias("w_plus"), side(F.col("d") < 0).alias("w_minus"))


#: Distribution function of Poisson(1) at 0, 1, ..., 8.
POISSON = tuple(itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(9)))


def drawn(key: str, reps: int) -> np.ndarray:
    """A number from 0 to 65535 for each replica: 16 bits each of md5(key:0), md5(key:1), ..., eight to a digest."""
    raw = b"".join(hashlib.md5(f"{key}:{j}".encode()).digest() for j in range(-(-reps // 8)))
    return np.frombuffer(raw, ">u2")[:reps]


def poisson_weights(key: str, reps: int) -> np.ndarray:
    """How often a unit is drawn in each replica."""
    return np.searchsorted(np.array(POISSON), drawn(key, reps) / 65536, side="right")


def signs(key: str, reps: int) -> np.ndarray:
    return np.where(drawn(key, reps) < 32768, 1, -1)


def replica_sums(units: DataFrame, reps: int, keys: list[Column], *by: str, weights: Callable[[str, int], np.ndarray] = poisson_weights) -> DataFrame:
    """by, replica, num, den: sums of units(num, den) in each replica, every unit with the product of the weights of its keys.

    Weights of all replicas are drawn together and summed up within a task, so a task sends a row a group and replica,
    and no replica has to see all units in one task.
    """
    kinds = dict(units.dtypes)
    rows = units.select(*by, *(k.cast("string").alias(f"_k{i}") for i, k in enumerate(keys)), F.col("num").cast("double").alias("num"), F.col("den").cast("double").alias("den"))
    n, n_keys = len(by), len(keys)

    def flushed(held: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for group, sums in held.items():
            own = [pa.array([g] * reps) if g is not None else pa.nulls(reps) for g in group]
            yield pa.RecordBatch.from_arrays([*(x.cast(t) for x, t in zip(own, types, strict=True)), pa.array(np.arange(reps, dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])], names=[*by, "replica", "num", "den"])

    types: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            types[:] = [b.column(i).type for i in range(n)]
            groups = list(zip(*(b.column(i).to_pylist() for i in range(n)), strict=True)) if n else [()] * b.num_rows
            own = [b.column(n + i).to_pylist() for i in range(n_keys)]
            values = np.stack([b.column(n + n_keys + i).to_numpy() for i in range(2)])
            known: dict[str, np.ndarray] = {}
            rows: dict[tuple, list[int]] = {}
            for i, g in enumerate(groups):
                rows.setdefault(g, []).append(i)
            for g, at in rows.items():
                total = held.setdefault(g, np.zeros((2, reps)))
                for lo in range(0, len(at), 256):
                    part = at[lo : lo + 256]
                    w = np.ones((len(part), reps))
                    for column in own:
                        for j, i in enumerate(part):
                            key = column[i]
                            if key not in known:
                                if len(known) >= 4096:
                                    known.clear()
                                known[key] = weights(key, reps)
                            w[j] *= known[key]
                    total += values[:, part] @ w
            if len(held) >= 2048:
                yield from flushed(held)
                held = {}
        yield from flushed(held)

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["replica int, num double, den double"])
    return rows.mapInArrow(run, schema).groupBy(*by, "replica").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def cluster_bootstrap(sums: DataFrame, reps: int, seed: int, *by: str) -> DataFrame:
    """sums(cluster, num, den): ratio of sums in each replica, clusters drawn with replacement.

    Every replica draws each cluster a Poisson(1) number of times.
    """
    keys = [F.concat_ws(":", F.lit(str(seed)), F.col("cluster").cast("string"))]
    return replica_sums(sums, reps, keys, *by).withColumn("value", F.try_divide("num", "den"))


def summary(replicas: DataFrame, *by: str) -> DataFrame:
    """median, 95 % interval, standard deviation and two-sided p against zero of replicas(value)."""
    v = F.col("value")
    p = 2 * F.least(F.avg((v <= 0).cast("double")), F.avg((v >= 0).cast("double")))
    at = lambda q: F.round(F.percentile(v, F.lit(q)), 6)
    return replicas.groupBy(*by).agg(at(0.5).alias("median"), at(0.025).alias("low"), at(0.975).alias("high"), F.round(F.stddev_samp(v), 6).alias("sd"), F.round(F.least(F.lit(1.0), p), 6).alias("p"))


def rethresholded(rows: DataFrame, cluster: str, most_risk: float, *by: str, reps: int = 2000, seed: int = 7) -> DataFrame:
    """by, replica, tau, value: in each replica the least confidence whose accepted rows have at most the risk, and the share accepted by it.

    Clusters of rows(conf, correct) are drawn with replacement; the threshold is chosen anew from the weighted counts, so
    what it varies by is part of the interval. No such cut: tau is null, nothing is accepted.
    """
    sums = rows.groupBy(*by, "conf", F.col(cluster).alias("cluster")).agg(F.count_if("correct").alias("num"), F.count("*").alias("den"))
    each = cluster_bootstrap(sums, reps, seed, *by, "conf").drop("value")
    w = Window.partitionBy(*by, "replica").orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    cuts = each.withColumn("kk", F.sum("num").over(w)).withColumn("nn", F.sum("den").over(w))
    ok = F.coalesce(1 - F.try_divide("kk", "nn") <= most_risk, F.lit(False))
    return cuts.groupBy(*by, "replica").agg(F.min(F.when(ok, F.col("conf"))).alias("tau"), F.try_divide(F.coalesce(F.max(F.when(ok, F.col("nn"))), F.lit(0.0)), F.sum("den")).alias("value"))


def verdict(low: Column, high: Column, point: Column) -> Column:
    """Reading of a paired gain: point and interval on one side, only the point, or across zero."""
    return F.when(low > 0, "improves").when(high < 0, "worsens").when(point > 0, "weakly improves").otherwise("undecided")


def bootstrap_difference(pairs: DataFrame, cluster: str, reps: int = 2000, seed: int = 7) -> DataFrame:
    """Mean of b - a over pairs(a, b) with its cluster bootstrap and verdict."""
    d = F.col("b").cast("double") - F.col("a").cast("double")
    sums = pairs.groupBy(F.col(cluster).alias("cluster")).agg(F.sum(d).alias("num"), F.count("*").alias("den"))
    point = pairs.agg(F.round(F.avg(d), 6).alias("point"))
    out = summary(cluster_bootstrap(sums, reps, seed)).crossJoin(F.broadcast(point))  # one row each
    return out.withColumn("verdict", verdict(F.col("low"), F.col("high"), F.col("point")))


def hierarchical_bootstrap(rows: DataFrame, reps: int = 2000, seed: int = 7) -> DataFrame:
    """rows(family, case, num, den): families drawn, then cases within each; weights multiply."""
    each = rows.groupBy("family", "case").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    family, case = F.col("family").cast("string"), F.col("case").cast("string")
    keys = [F.concat_ws(":", F.lit(str(seed)), family), F.concat_ws(":", F.lit(str(seed + 1)), family, case)]
    return summary(replica_sums(each, reps, keys).withColumn("value", F.try_divide("num", "den")))


def sign_flip(diffs: DataFrame, *by: str, reps: int = 2000, seed: int = 7) -> DataFrame:
    """diffs(unit, d): share of sign-flipped sums at least as far from zero, with +1 correction."""
    units = diffs.groupBy(*by, "unit").agg(F.sum("d").alias("num"), F.count("*").alias("den"))
    observed = F.abs(F.sum("num")).alias("observed")
    point = units.groupBy(*by).agg(observed) if by else units.agg(observed)
    flipped = replica_sums(units, reps, [F.concat_ws(":", F.lit(str(seed)), F.col("unit").cast("string"))], *by, weights=signs)
    both = flipped.join(point, list(by)) if by else flipped.crossJoin(point)  # a row a group
    return both.groupBy(*by, "observed").agg(F.round((F.count_if(F.abs("num") >= F.col("observed") - 1e-9) + 1) / (F.count("*") + 1), 6).alias("p"))


def power_table(sums: DataFrame, sizes: list[int], reps: int = 2000, seed: int = 7, rule: float = 0.0) -> DataFrame:
    """size, detectable, share for several numbers of clusters, from one bootstrap of all of them.

    detectable: smallest effect seen with 80 % power, 2.80 standard errors. share: of the replicas, brought to the
    spread of that many clusters, how many are above the rule.
    """
    each = cluster_bootstrap(sums, reps, seed).select("value")
    whole = sums.agg(F.count("*").alias("clusters"), (F.sum("num") / F.sum("den")).alias("point"))  # one row
    each = each.crossJoin(whole).withColumn("size", F.explode(F.array(*(F.lit(s) for s in sizes))))
    wide = F.sqrt(F.col("clusters") / F.col("size"))
    above = F.col("point") + (F.col("value") - F.col("point")) * wide > rule + 1e-12
    return each.groupBy("size").agg(F.round(2.80 * F.stddev_samp("value") * F.first(wide), 6).alias("detectable"), F.round(F.avg(above.cast("double")), 6).alias("share"))


def run_agreement(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, logp): share of equal labels and the greatest and mean change of logp."""
    both = a.select(*keys, F.col("label").alias("la"), F.col("logp").alias("pa")).join(b.select(*keys, F.col("label").alias("lb"), F.col("logp").alias("pb")), list(keys))
    d = F.abs(F.col("pa") - F.col("pb"))
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("la") == F.col("lb")).alias("same_label"), F.count_if((F.col("la") == F.col("lb")) & (d == 0)).alias("identical"), F.round(F.max(d), 6).alias("max_change"), F.round(F.avg(d), 6).alias("mean_change"))


def agreement_bound(a: DataFrame, b: DataFrame, cluster: str, margin: float, reps: int = 2000, seed: int = 7) -> DataFrame:
    """(id, label, correct, cluster): agreement of labels less that of the baseline repeats, its one-sided 5 % cluster-bootstrap bound, and whether that is above -margin."""
    both = a.join(b.select("id", F.col("label").alias("_l"), F.col("correct").alias("_c")), "id")
    d = (F.col("label") == F.col("_l")).cast("int") - (F.col("correct") == F.col("_c")).cast("int")
    sums = both.groupBy(F.col(cluster).alias("cluster")).agg(F.sum(d).alias("num"), F.count("*").alias("den"))
    point = sums.agg(F.round(F.sum("num") / F.sum("den"), 6).alias("beyond"))
    bound = cluster_bootstrap(sums, reps, seed).agg(F.round(F.percentile("value", F.lit(0.05)), 6).alias("bound"))
    return point.crossJoin(bound).withColumn("within", F.col("bound") > -margin)  # one row each


def effect_correlation(rows: DataFrame, group: str) -> DataFrame:
    """rows(group, engine 0 or 1, arm, correct): correlation over groups of the effect (tuned less base) that two engines see."""
    share = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("correct").cast("double")))
    each = rows.groupBy(group, "engine").agg((share("tuned") - share("base")).alias("effect")).where("effect is not null")
    wide = each.groupBy(group).pivot("engine", [0, 1]).agg(F.first("effect")).where("`0` is not null and `1` is not null")
    return wide.agg(F.count("*").alias("groups"), F.round(F.corr("0", "1"), 6).alias("correlation"))


def distinct_outputs(runs: DataFrame, item: str, sha: str, least: int = 2) -> DataFrame:
    """Items with at least so many runs, how many of them gave more than one output, and the verdict."""
    each = runs.groupBy(item).agg(F.count("*").alias("runs"), F.countDistinct(sha).alias("outputs")).where(F.col("runs") >= least)
    out = each.agg(F.count("*").alias("items"), F.count_if(F.col("outputs") > 1).alias("unstable"))
    return out.withColumn("deterministic", F.col("unstable") == 0)


def majority_output(runs: DataFrame, item: str, sha: str, order: str) -> DataFrame:
    """The most frequent output of each item, the one seen first on ties."""
    each = runs.groupBy(item, sha).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy(item).orderBy(F.desc("n"), "first")
    spread = Window.partitionBy(item)
    return each.withColumn("unstable", F.count("*").over(spread) > 1).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "first")


def noise(runs: DataFrame, item: str, *columns: str) -> DataFrame:
    """How many items show more than one value in each column over their repeats."""
    each = runs.groupBy(item).agg(*(F.countDistinct(c).alias(c) for c in columns))
    return each.agg(F.count("*").alias("items"), *(F.count_if(F.col(c) > 1).alias(f"{c}_varies") for c in columns))


def within_unit_wins(rows: DataFrame, unit: str, group: str, score: str) -> DataFrame:
    """Share of (a, b) pairs in a unit with the score of a above that of b, ties half; from ranks, without making the pairs."""
    ranked = average_rank(rows, F.col(score), unit)
    a = F.col(group) == "a"
    out = ranked.groupBy(unit).agg(F.count_if(a).alias("na"), F.count_if(~a).alias("nb"), F.sum(F.when(a, F.col("rank"))).alias("ra"))
    share = (F.col("ra") - F.col("na") * (F.col("na") + 1) / 2) / (F.col("na") * F.col("nb"))
    return out.where("na > 0 and nb > 0").select(unit, "na", "nb", F.round(share, 6).alias("share"))


def first_divergence(a: DataFrame, b: DataFrame, item: str) -> DataFrame:
    """(item, pos, token): first position at which two sequences differ; a missing side is a difference."""
    x = a.select(item, "pos", F.col("token").alias("ta"))
    y = b.select(item, "pos", F.col("token").alias("tb"))
    both = x.join(y, [item, "pos"], "full_outer")
    return both.groupBy(item).agg(F.min(F.when(~F.col("ta").eqNullSafe(F.col("tb")), F.col("pos"))).alias("first_pos"))


def mode_groups(labels: DataFrame, most: float) -> DataFrame:
    """labels(run, id, label): runs whose labels differ on at most the share of their common items form one mode; its least run names it.

    The counts are aggregated over all items in Spark; what is then grouped is a row for each pair of runs, of which
    there are a few dozen whatever the number of items.
    """
    a = labels.select(F.col("run").alias("a"), "id", F.col("label").alias("la"))
    b = labels.select(F.col("run").alias("b"), "id", F.col("label").alias("lb"))
    flips = a.join(b, "id").where("a < b").groupBy("a", "b").agg(F.avg((F.col("la") != F.col("lb")).cast("double")).alias("flips"))
    mode = {r["run"]: r["run"] for r in labels.select("run").distinct().collect()}
    for r in flips.where(F.col("flips") <= most).collect():
        x, y = sorted((mode[r["a"]], mode[r["b"]]))
        mode = {k: x if v == y else v for k, v in mode.items()}
    kind = dict(labels.dtypes)["run"]
    return labels.sparkSession.createDataFrame(sorted(mode.items()), f"run {kind}, mode {kind}")
