"""Selective decisions: risk and coverage, thresholds, calibration, ranking quality.

Curves run down the confidence order of an arm. They are built from counts by distinct confidence, summed up over
ranges of it (`ordered.running`), so no task sorts an arm, however many confidence values it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.values import harmonic
from lodestat.operators.ordered import kept, running
from lodestat.operators.paired import average_rank


def steps(rows: DataFrame, *by: str) -> DataFrame:
    """Counts k (right) and n at each confidence, their sums kk and nn from the top down to it, and right and total of the arm."""
    each = rows.groupBy(*by, "conf").agg(F.count_if("correct").alias("k"), F.count("*").alias("n"))
    out = running(each, [F.desc("conf")], ["k", "n"], *by)
    return out.select(*by, "conf", "k", "n", (F.col("k_ahead") + F.col("k")).alias("kk"), (F.col("n_ahead") + F.col("n")).alias("nn"), F.col("n_all").alias("total"), F.col("k_all").alias("right"))


def risk_curve(rows: DataFrame, *by: str) -> DataFrame:
    """Coverage, risk and precision at every cut of the confidence."""
    out = steps(rows, *by).withColumn("coverage", F.round(F.col("nn") / F.col("total"), 6)).withColumn("risk", F.round(1 - F.col("kk") / F.col("nn"), 6))
    return out.select(*by, "conf", "kk", "nn", "coverage", "risk")


def aurc(rows: DataFrame, *by: str) -> DataFrame:
    """Area under the risk-coverage curve with one step a confidence: weighted mean of the risk, and what is above the best possible order.

    The best possible: all right rows first. Its area is a sum of j / (right + j) over the wrong ones, a difference of harmonic numbers.
    """
    s = steps(rows, *by)
    area = F.sum(F.col("n") * (1 - F.col("kk") / F.col("nn"))) / F.sum("n")
    out = s.groupBy(*by).agg(area.alias("a"), F.sum("n").alias("rows"), F.sum("k").alias("right"))
    wrong = F.col("rows") - F.col("right")
    best = (wrong - F.col("right") * (harmonic(F.col("rows")) - harmonic(F.col("right")))) / F.col("rows")
    best = F.when(F.col("rows") == F.col("right"), 0.0).otherwise(best)
    return out.select(*by, "rows", "right", F.round("a", 6).alias("aurc"), F.round(best, 6).alias("best"), F.round(F.col("a") - best, 6).alias("excess"))


def risk_by_kind(rows: DataFrame, kind: Column, *by: str, sure: float = 0.8, unsure: float = 0.4) -> DataFrame:
    """For each kind of proposal: the risk's best possible part and its excess, the wrong decisions by type, AUROC of being right.

    Wrong decisions are sure (from sure on), plain, or unsure (below unsure). AUROC is null where all are right or all wrong.
    """
    rows, keys = rows.withColumn("kind", kind), [*by, "kind"]
    wrong = ~F.col("correct")
    types = {"sure_wrong": F.col("conf") >= sure, "plain_wrong": (F.col("conf") >= unsure) & (F.col("conf") < sure), "unsure_wrong": F.col("conf") < unsure}
    counts = rows.groupBy(*keys).agg(*(F.count_if(wrong & c).alias(t) for t, c in types.items()))
    parts = aurc(rows, *keys).select(*keys, "rows", "best", "excess")
    return parts.join(counts, keys).join(auroc(rows, "conf", F.col("correct"), *keys).select(*keys, "auroc"), keys)


def least_cut(rows: DataFrame, ok: DataFrame, *by: str) -> DataFrame:
    """tau of every group of rows: its least confidence in ok, or null."""
    tau = ok.groupBy(*by).agg(F.min("conf").alias("tau"))
    return rows.select(*by).distinct().join(tau, list(by), "left") if by else tau


def choose_threshold(rows: DataFrame, kmin: DataFrame, *by: str) -> DataFrame:
    """Smallest confidence at which the right rows above reach kmin(n, kmin); no such cut: null.

    kmin holds, for each number of accepted rows, how many must be right for the bound wanted.
    """
    ok = steps(rows, *by).join(kmin, F.col("nn") == kmin["n"], "left").where(F.col("kk") >= F.col("kmin"))
    return least_cut(rows, ok, *by)


def needed_threshold(rows: DataFrame, needed: Callable[[Column], Column], *by: str) -> DataFrame:
    """As choose_threshold, with the count that must be right as an expression of the number of accepted rows, however many."""
    ok = steps(rows, *by).where(F.col("kk") >= needed(F.col("nn")))
    return least_cut(rows, ok, *by)


def wilson_threshold(rows: DataFrame, target: float, least: int, *by: str, z: float = 1.6448536269514722) -> DataFrame:
    """Smallest confidence whose accepted rows have a one-sided Wilson bound at the target, from a least number on."""
    k, n = F.col("kk"), F.col("nn")
    p = k / n
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    ok = steps(rows, *by).where((n >= least) & (low >= target))
    return least_cut(rows, ok, *by)


def empirical_threshold(rows: DataFrame, most_errors: float, *by: str) -> DataFrame:
    """The cut with most accepted rows whose error share is at most so much."""
    ok = steps(rows, *by).where(1 - F.col("kk") / F.col("nn") <= most_errors)
    return ok.groupBy(*by).agg(F.min("conf").alias("tau"), F.max("nn").alias("accepted"))


def selective_metrics(rows: DataFrame, tau: Column, *by: str) -> DataFrame:
    """Coverage and precision of rows with conf at tau or more, and accuracy of all."""
    inside = F.col("conf") >= tau
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(inside).alias("accepted"), F.count_if(inside & F.col("correct")).alias("right"), F.count_if("correct").alias("right_all"))
    prec = F.when(F.col("accepted") > 0, F.round(F.col("right") / F.col("accepted"), 6))
    return out.withColumn("coverage", F.round(F.col("accepted") / F.col("n"), 6)).withColumn("precision", prec).withColumn("accuracy", F.round(F.col("right_all") / F.col("n"), 6))


def precision_at_coverage(rows: DataFrame, share: float, *by: str) -> DataFrame:
    """Precision at the first cut that covers at least the share."""
    out = steps(rows, *by).where(F.col("nn") >= share * F.col("total"))
    return out.groupBy(*by).agg(F.max_by(F.round(F.col("kk") / F.col("nn"), 6), "conf").alias("precision"))


def coverage_at_precision(rows: DataFrame, precision: float, *by: str) -> DataFrame:
    """Greatest coverage of a cut that keeps the precision; 0 if none does."""
    out = steps(rows, *by)
    return out.groupBy(*by).agg(F.round(F.coalesce(F.max(F.when(F.col("kk") / F.col("nn") >= precision, F.col("nn") / F.col("total"))), F.lit(0.0)), 6).alias("coverage"))


def auroc(rows: DataFrame, score: str, positive: Column, *by: str) -> DataFrame:
    """Chance that a positive is ranked above a negative, ties half; from average ranks of distinct scores."""
    ranked = average_rank(rows.withColumn("_pos", positive), F.col(score), *by)
    out = ranked.groupBy(*by).agg(F.count_if("_pos").alias("pos"), F.count_if(~F.col("_pos")).alias("neg"), F.sum(F.when(F.col("_pos"), F.col("rank"))).alias("r"))
    value = (F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))
    return out.select(*by, "pos", "neg", F.round(F.when((F.col("pos") > 0) & (F.col("neg") > 0), value), 6).alias("auroc"))


def calibration_error(rows: DataFrame, bins: int, *by: str) -> DataFrame:
    """Expected calibration error over bins of equal width, and the Brier score."""
    b = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1))
    y = F.col("correct").cast("double")
    each = rows.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.sum("conf").alias("c"), F.sum(y).alias("y"), F.sum((F.col("conf") - y) ** 2).alias("sq"))
    return each.groupBy(*by).agg(F.round(F.sum(F.abs(F.col("c") - F.col("y"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"))


def equal_mass_bins(rows: DataFrame, bins: int, *by: str) -> DataFrame:
    """Bins of (nearly) equal numbers by confidence and id, the first ones taking what is left over; mean confidence and accuracy of each."""
    each = running(rows.select(*by, "conf", "id", "correct", F.lit(1).alias("one")), [F.col("conf"), F.col("id")], ["one"], *by)
    size, more, at = F.floor(F.col("one_all") / bins), F.col("one_all") % bins, F.col("one_ahead")
    later = more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1)))
    bin_ = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(later) + 1
    return each.groupBy(*by, bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("conf"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))


def fpr_at_recall(rows: DataFrame, score: str, positive: Column, recall: float, *by: str) -> DataFrame:
    """Highest cut that keeps the recall, and the share of negatives at or above it."""
    each = rows.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    ok = running(each, [F.desc("s")], ["p", "q"], *by).where(F.col("p_ahead") + F.col("p") >= recall * F.col("p_all"))
    return ok.groupBy(*by).agg(F.max("s").alias("cut"), F.round(F.max_by((F.col("q_ahead") + F.col("q")) / F.col("q_all"), "s"), 6).alias("fpr"))


def arm_statistics(rows: DataFrame, target: float, least: int, *by: str, z: float = 1.6448536269514722) -> DataFrame:
    """All of an arm's numbers from one pass over its curve: rows, accuracy with its Wilson interval, tau (as wilson_threshold), coverage and precision there, AURC and its best possible, AUROC of the confidence.

    Counts by confidence are all that is shuffled, sums of counts all that is summed up.
    """
    s = steps(rows, *by)
    kk, nn, k, n = (F.col(c) for c in ("kk", "nn", "k", "n"))
    p = kk / nn
    low = (p + z * z / (2 * nn) - z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn))) / (1 + z * z / nn)
    ok = (nn >= least) & (low >= target)
    below = (F.col("total") - F.col("right")) - (nn - kk)  # wrong rows of less confidence
    out = s.groupBy(*by).agg(
        F.max("total").alias("rows"), F.max("right").alias("right"), F.min(F.when(ok, F.col("conf"))).alias("tau"), F.min_by(F.when(ok, nn), F.when(ok, F.col("conf"))).alias("nn"),
        F.min_by(F.when(ok, kk), F.when(ok, F.col("conf"))).alias("kk"), F.sum(n * (1 - p)).alias("area"), F.sum(k * (below + (n - k) / 2)).alias("wins"),
    )
    rows_, right = F.col("rows"), F.col("right")
    wrong, acc = rows_ - right, right / rows_
    best = F.when(wrong == 0, 0.0).otherwise((wrong - right * (harmonic(rows_) - harmonic(right))) / rows_)
    half = z * F.sqrt(acc * (1 - acc) / rows_ + z * z / (4 * rows_ * rows_))
    r = lambda c: F.round(c, 6)
    return out.select(
        *by, "rows", "right", r(acc).alias("accuracy"), r((acc + z * z / (2 * rows_) - half) / (1 + z * z / rows_)).alias("low"), r((acc + z * z / (2 * rows_) + half) / (1 + z * z / rows_)).alias("high"),
        "tau", r(F.col("nn") / rows_).alias("coverage"), r(kk / nn).alias("precision"), r(F.col("area") / rows_).alias("aurc"), r(best).alias("best"),
        r(F.when((right > 0) & (wrong > 0), F.col("wins") / (right * wrong))).alias("auroc"),
    )


def ceiling(rows: DataFrame, *by: str) -> DataFrame:
    """Share of rows that have a gold answer."""
    return rows.groupBy(*by).agg(F.round(F.avg(F.col("gold").isNotNull().cast("double")), 6).alias("ceiling"))


def cascade(first: DataFrame, second: DataFrame, tau: float) -> DataFrame:
    """first(id, conf, correct, latency) decides at tau or more, else second does: coverage of the first, accuracy, share passed on, median latency."""
    both = first.join(second.select("id", F.col("correct").alias("c2"), F.col("latency").alias("l2")), "id", "left")
    own = F.col("conf") >= tau
    right = F.when(own, F.col("correct")).otherwise(F.coalesce("c2", F.lit(False)))
    lat = F.when(own, F.col("latency")).otherwise(F.col("latency") + F.coalesce("l2", F.lit(0.0)))
    return both.agg(F.count("*").alias("n"), F.count_if(own).alias("by_first"), F.round(F.avg((~own).cast("double")), 6).alias("passed_on"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"), F.round(F.percentile(lat, F.lit(0.5)), 6).alias("median_latency"))


def closed_system(rows: DataFrame, tau: float, *by: str) -> DataFrame:
    """rows(bound, conf, correct, missing): rows bound by rule, decided by the model, handed to a human, or asked for data."""
    status = F.when(F.col("bound"), "bound").when(F.col("missing"), "data request").when(F.col("conf") >= tau, "model").otherwise("human")
    closed = F.col("status").isin("bound", "model")
    out = rows.withColumn("status", status).groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(s.replace(" ", "_")) for s in ("bound", "model", "human", "data request")), F.count_if(closed & ~F.col("correct")).alias("wrong"))
    n_closed = F.col("bound") + F.col("model")
    return out.withColumn("useful_coverage", F.round((n_closed - F.col("wrong")) / F.col("n"), 6)).withColumn("closure_error", F.when(n_closed > 0, F.round(F.col("wrong") / n_closed, 6)))


def best_arm(rows: DataFrame, *metrics: str) -> DataFrame:
    """The arm with the greatest first metric, then the next, and so on."""
    return rows.agg(F.max_by("arm", F.struct(*metrics)).alias("arm"), *(F.max_by(m, F.struct(*metrics)).alias(m) for m in metrics))


def option_scores(labels: DataFrame, temperature: float = 1.0) -> DataFrame:
    """labels(id, perm, option, logp): softmax within each option order, averaged by option over orders."""
    w = Window.partitionBy("id", "perm")
    x = F.col("logp") / temperature
    e = F.exp(x - F.max(x).over(w))
    each = labels.withColumn("_p", e).withColumn("_p", F.col("_p") / F.sum("_p").over(w))
    return each.groupBy("id", "option").agg(F.avg("_p").alias("score"))


def decided(scores: DataFrame) -> DataFrame:
    """The option with the greatest score of each item and that score; the lesser name on ties."""
    w = Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "option")
    return scores.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", F.col("option").alias("pred"), F.round("score", 4).alias("conf"))


def position_bias(labels: DataFrame) -> DataFrame:
    """Mean log probability of each label position."""
    return labels.groupBy("position").agg(F.round(F.avg("logp"), 6).alias("bias"), F.count("*").alias("n"))


def gold_losses(labels: DataFrame, temperatures: list[float]) -> dict[float, float]:
    """labels(id, option, logp, gold): mean negative log likelihood of gold at each temperature, from one pass; rows whose gold is not among the options are out."""
    at = range(len(temperatures))
    x = [F.col("logp") / t for t in temperatures]
    each = labels.groupBy("id").agg(*(F.max(F.when(F.col("option") == F.col("gold"), x[i])).alias(f"g{i}") for i in at), *(F.sum(F.exp(x[i])).alias(f"z{i}") for i in at))
    got = each.where("g0 is not null").agg(*(F.avg(F.log(f"z{i}") - F.col(f"g{i}")).alias(f"l{i}") for i in at)).first()
    return {t: got[f"l{i}"] for i, t in enumerate(temperatures) if got[f"l{i}"] is not None}


def fit_temperature(labels: DataFrame, low: float = 0.05, high: float = 20.0, tries: int = 16, close: float = 1e-4) -> DataFrame:
    """temperature, nll: the temperature of least loss, to the given share of it. No row with its gold: no row.

    The loss has one valley. Each job tries some temperatures between the bounds, and the neighbours of the best one
    bound the next; so five jobs, whatever the number of rows.
    """
    spark, best = labels.sparkSession, None
    labels = kept(labels.select("id", "option", "logp", "gold"), "temperature")
    while best is None or high / low > 1 + close:
        grid = [low * (high / low) ** (i / (tries + 1)) for i in range(tries + 2)]
        loss = gold_losses(labels, grid)
        if not loss:
            return spark.createDataFrame([], "temperature double, nll double")
        best = min(grid, key=loss.__getitem__)
        i = grid.index(best)
        low, high = grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)]
    return spark.createDataFrame([(best, loss[best])], "temperature double, nll double")


def group_balance(rows: DataFrame, group: str, tau: float, *by: str) -> DataFrame:
    """Groups with any row accepted, all accepted, all accepted and right, and with an accepted error."""
    inside = F.col("conf") >= tau
    each = rows.groupBy(*by, group).agg(F.some(inside).alias("some"), F.every(inside).alias("every"), F.every(inside & F.col("correct")).alias("clean"), F.some(inside & ~F.col("correct")).alias("error"))
    return each.groupBy(*by).agg(F.count("*").alias("groups"), *(F.count_if(c).alias(c) for c in ("some", "every", "clean", "error")))


def mode_flips(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """(id, by, label, correct) of two numeric modes: labels and correctness that differ."""
    both = a.join(b.select("id", F.col("label").alias("l2"), F.col("correct").alias("c2")), "id")
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("l2")).alias("labels"), F.count_if(F.col("correct") != F.col("c2")).alias("correctness"))
