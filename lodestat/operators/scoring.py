"""Scores of model output against gold: outcomes, strict F1, gates, weighted items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.values import equal_by_type, outcome, wilson


def with_outcomes(fields: DataFrame, kind: Column | None = None) -> DataFrame:
    """fields(run, doc, field, kind, gold, pred) with the outcome of each."""
    kind = F.col("kind") if kind is None else kind
    return fields.withColumn("outcome", outcome(F.col("gold"), F.col("pred"), equal_by_type(kind, F.col("gold"), F.col("pred"))))


def prf(counted: DataFrame, prefix: str = "") -> DataFrame:
    """precision, recall and f1 from tp, fp, fn and mm; a mismatch counts against both."""
    tp, fp, fn, mm = (F.col(prefix + c) for c in ("tp", "fp", "fn", "mm"))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    return counted.withColumn(prefix + "precision", share(tp, tp + fp + mm)).withColumn(prefix + "recall", share(tp, tp + fn + mm)).withColumn(prefix + "f1", share(2 * tp, 2 * tp + fp + fn + 2 * mm))


def outcome_counts(rows: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn and mm of each group."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    return rows.groupBy(*by).agg(n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"), n("mismatch").alias("mm"))


def strict_f1(fields: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Raw and normalised F1 of each run. Mismatches are judged again as loose text; excluded(doc, field) goes from all runs."""
    if excluded is not None:
        fields = fields.join(excluded, ["doc", "field"], "left_anti")
    raw = with_outcomes(fields)
    again = F.when((F.col("outcome") == "mismatch") & equal_by_type(F.lit("loose"), F.col("gold"), F.col("pred")), "tp").otherwise(F.col("outcome"))
    n = lambda c, x: F.count_if(c == x)
    both = raw.withColumn("again", again).groupBy("run").agg(*(n(F.col(c), x).alias(p + a) for c, p in (("outcome", ""), ("again", "norm_")) for x, a in (("tp", "tp"), ("fp", "fp"), ("fn", "fn"), ("mismatch", "mm"))))
    return prf(prf(both), "norm_")


def f1_by_grain(fields: DataFrame) -> DataFrame:
    """F1 of each run and field, each run, and in total."""
    rows = with_outcomes(fields)
    n = lambda x: F.count_if(F.col("outcome") == x)
    return prf(rows.rollup("run", "field").agg(n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"), n("mismatch").alias("mm")))


def gate_flags(parties: DataFrame, own_digits: str, hints: list[str]) -> DataFrame:
    """parties(run, doc, tax, name) with by_tax, by_name, flagged, both and unusable."""
    digits = F.regexp_replace("tax", r"\D", "")
    by_tax = F.coalesce(digits.startswith(own_digits), F.lit(False))
    by_name = F.coalesce(F.exists(F.array(*(F.lit(h.lower()) for h in hints)), lambda h: F.lower("name").contains(h)), F.lit(False))
    unusable = F.col("tax").isNull() & F.col("name").isNull()
    rows = parties.withColumn("by_tax", by_tax).withColumn("by_name", by_name).withColumn("unusable", unusable)
    return rows.withColumn("flagged", F.col("by_tax") | F.col("by_name")).withColumn("both", F.col("by_tax") & F.col("by_name"))


def gate_counts(flags: DataFrame, *by: str) -> DataFrame:
    """docs, flagged, both and unusable of each group."""
    return flags.groupBy(*by).agg(F.count("*").alias("docs"), *(F.count_if(c).alias(c) for c in ("flagged", "both", "unusable")))


def list_credit(given: DataFrame, expected: DataFrame) -> DataFrame:
    """credit = found / max(expected, given) of each item; both are (item, element), order does not matter, repeats do."""
    g = given.groupBy("item", "element").agg(F.count("*").alias("g"))
    e = expected.groupBy("item", "element").agg(F.count("*").alias("e"))
    both = e.join(g, ["item", "element"], "full_outer").na.fill(0, ["e", "g"])
    out = both.groupBy("item").agg(F.sum(F.least("e", "g")).alias("found"), F.sum("e").alias("expected"), F.sum("g").alias("given"))
    return out.withColumn("credit", F.round(F.col("found") / F.greatest("expected", "given"), 6))


def item_pass(fields: DataFrame) -> DataFrame:
    """passed and points of each run and document: every scored field right."""
    rows = with_outcomes(fields)
    right = F.col("outcome").isin("tp", "tn")
    return rows.groupBy("run", "doc").agg(F.every(right).alias("passed"), F.round(F.avg(right.cast("double")), 6).alias("points"))


def pass_rates(items: DataFrame, *by: str) -> DataFrame:
    """Pass rate with Wilson interval of each group and, as nulls, over groups."""
    out = items.rollup(*by).agg(F.count_if("passed").alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.withColumn("rate", F.round(F.col("k") / F.col("n"), 6)).withColumn("low", F.round(low, 6)).withColumn("high", F.round(high, 6))


def rate_table(rows: DataFrame, hit: Column, *by: str) -> DataFrame:
    """k, n, rate and Wilson bounds of each cell."""
    out = rows.groupBy(*by).agg(F.count_if(hit).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.withColumn("rate", F.round(F.col("k") / F.col("n"), 6)).withColumn("low", F.round(low, 6)).withColumn("high", F.round(high, 6))


def field_agreement(fields: DataFrame) -> DataFrame:
    """Share of documents in which both runs give the same text, by field; a value in one run only is a difference."""
    a, b = (fields.where(F.col("run") == r).select("doc", "field", F.col("pred").alias(f"p{r}")) for r in (1, 2))
    both = a.join(b, ["doc", "field"], "full_outer")
    return both.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("p1").eqNullSafe(F.col("p2"))).alias("same")).withColumn("share", F.round(F.col("same") / F.col("n"), 6))


def component_coverage(rows: DataFrame, *by: str) -> DataFrame:
    """rows(hits, possible): hits over possible of each group."""
    return rows.groupBy(*by).agg(F.sum("hits").alias("hits"), F.sum("possible").alias("possible")).withColumn("coverage", F.round(F.col("hits") / F.col("possible"), 6))


def scenario_scores(calls: DataFrame, must: list[tuple[str, int]], must_not: list[str], most_turns: int) -> DataFrame:
    """calls(scenario, turn, tool): passed if every required tool is called often enough, no forbidden one, in few enough turns."""
    need = [F.count_if(F.col("tool") == t) >= n for t, n in must]
    bad = F.count_if(F.col("tool").isin(must_not)) if must_not else F.lit(0)
    out = calls.groupBy("scenario").agg(F.max("turn").alias("turns"), sum((c.cast("int") for c in need), F.lit(0)).alias("met"), bad.alias("forbidden"))
    return out.withColumn("passed", (F.col("met") == len(must)) & (F.col("forbidden") == 0) & (F.col("turns") <= most_turns))


def verdicts_of(sheet: DataFrame) -> DataFrame:
    """sheet(item, judge, manual): the manual verdict where there is one, else the judge's; agreement where both are."""
    manual = F.nullif(F.trim("manual"), F.lit(""))
    return sheet.withColumn("final", F.coalesce(manual, F.col("judge"))).withColumn("agree", F.when(manual.isNotNull(), manual == F.col("judge")))


def value_weighted(rows: DataFrame, cap: float = 0.99) -> DataFrame:
    """rows(arm, value, covered): covered share of value by arm, values capped at a quantile of the arm."""
    top = rows.groupBy("arm").agg(F.percentile("value", F.lit(cap)).alias("top"))
    capped = rows.join(top, "arm").withColumn("v", F.least("value", "top"))
    return capped.groupBy("arm").agg(F.round(F.sum(F.when(F.col("covered"), F.col("v")).otherwise(0.0)) / F.sum("v"), 6).alias("coverage"))


def scoreboard(arms: DataFrame, results: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each arm with its metrics side by side; what is missing stays visible as null."""
    wide = results.groupBy("arm").pivot("metric", metrics).agg(F.first("value"))
    return arms.join(wide, "arm", "left")


def transition(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Counts of category pairs with both margins; null stands for the total."""
    return rows.cube(before, after).agg(F.count("*").alias("n"))


def stratified_by_control(control: DataFrame, candidate: DataFrame) -> DataFrame:
    """candidate's pass rate where the control passed and where it failed; both are (doc, passed)."""
    both = candidate.join(control.select("doc", F.col("passed").alias("control")), "doc")
    return rate_table(both, F.col("passed"), "control")


def best_of_baseline(rows: DataFrame) -> DataFrame:
    """rows(side, config, value): each side's best configuration and its change against the side's baseline in percent."""
    w = Window.partitionBy("side").orderBy(F.desc("value"), "config")
    base = rows.where(F.col("config") == "base").select("side", F.col("value").alias("base"))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").join(base, "side", "left").withColumn("delta_percent", F.round(100 * (F.col("value") / F.col("base") - 1), 6))
