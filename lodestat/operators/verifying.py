"""Verification of extracted facts, business calendars and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def excluded_by_amount(candidates: DataFrame, stated: DataFrame, tolerance: float) -> DataFrame:
    """candidates(group, id, amount) against stated(group, full): excluded beyond the tolerance; a group with one left is bound to it."""
    each = candidates.join(stated, "group").withColumn("excluded", F.abs(F.col("amount") - F.col("full")) > tolerance)
    out = each.groupBy("group").agg(F.count("*").alias("candidates"), F.count_if(~F.col("excluded")).alias("left"), F.min(F.when(~F.col("excluded"), F.col("id"))).alias("first"))
    return out.withColumn("bound", F.when(F.col("left") == 1, F.col("first"))).drop("first")


def rule_holds(value: Column, relation: Column, bound: Column, slack: float = 1e-9) -> Column:
    """value in relation (<, <=, >, >=) to bound; equality is let pass."""
    return F.when(relation.isin("<", "<="), value <= bound + slack).when(relation.isin(">", ">="), value >= bound - slack)


def contradictions(values: DataFrame, *keys: str) -> DataFrame:
    """Keys with more than one value: for a human."""
    return values.groupBy(*keys).agg(F.countDistinct(F.round("value", 6)).alias("n")).withColumn("to_human", F.col("n") > 1)


def claims_in_source(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """claims(id, field, value, span) with the reason that one is not borne out by its text, or null: the span must be in the text, the value in the span, and no other field of the text may use the same span."""
    each = claims.join(texts, "id")
    used = claims.groupBy("id", "span").agg(F.count("*").alias("uses"))
    reason = F.when(F.instr("text", F.col("span")) == 0, "span not in text").when(F.instr("span", F.col("value")) == 0, "value not in span").when(F.col("uses") > 1, "span used twice")
    return each.join(used, ["id", "span"]).select("id", "field", reason.alias("reason"))


def gap(text: Column, at: Column, size: Column, cue: str) -> Column:
    """Characters between a stretch of a text (its first character counts as 1) and the nearest cue beside it; null without one."""
    before, after = F.substr(text, F.lit(1), at - 1), F.substr(text, at + size)
    left, right = F.instr(F.reverse(before), cue[::-1]), F.instr(after, cue)
    return F.least(F.when(left > 0, left - 1), F.when(right > 0, right - 1))


def claims_by_role(claims: DataFrame, texts: DataFrame, cues: dict[int, str]) -> DataFrame:
    """claims(id, field, value, span) with the first reason that a claim is not borne out by its text, or null.

    The first occurrence of the span holds. Of the cue words of all fields that of the claim's own must be the nearest to
    the value (ties are let pass). A place is taken by the least field that bears out; later ones find it used. A null
    text has no span. Cues are matched inside the row, so a text meets its own claims only.
    """
    each = claims.join(texts, "id").withColumns({"_s": F.instr("text", F.col("span")), "_v": F.instr("span", F.col("value"))})
    each = each.withColumn("_at", F.col("_s") + F.col("_v") - 1)
    gaps = {f: F.when((F.col("_s") > 0) & (F.col("_v") > 0), gap(F.col("text"), F.col("_at"), F.length("value"), cue)) for f, cue in cues.items()}
    each = each.withColumns({f"_g{f}": g for f, g in gaps.items()})
    own = F.coalesce(*(F.when(F.col("field") == f, F.col(f"_g{f}")) for f in cues))
    nearest = F.least(*(F.col(f"_g{f}") for f in cues))
    reason = F.when(F.coalesce("_s", F.lit(0)) == 0, "span not in text").when(F.coalesce("_v", F.lit(0)) == 0, "value not in span")
    each = each.select("id", "field", "_at", reason.when(own.isNull(), "no role cue").when(own > nearest, "another role is nearer").alias("reason"))
    order = F.row_number().over(Window.partitionBy("id", "_at", F.col("reason").isNull()).orderBy("field"))
    return each.select("id", "field", F.when(F.col("reason").isNull() & (order > 1), "used before").otherwise(F.col("reason")).alias("reason"))


def calendar(first: Column, last: Column, days: DataFrame, holidays: list[str], moved: list[str]) -> DataFrame:
    """day, working and the running number of the working day over the span of days(one row)."""
    each = days.select(F.explode(F.sequence(first, last)).alias("day"))
    off = F.col("day").cast("string").isin(holidays) | (F.dayofweek("day").isin(1, 7) & ~F.col("day").cast("string").isin(moved))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return each.withColumn("working", ~off).withColumn("number", F.sum((~off).cast("int")).over(w))


def working_day_deadline(rows: DataFrame, cal: DataFrame, start: str, n: int) -> DataFrame:
    """rows with due: the n-th working day after start, which does not count itself."""
    base = cal.select(F.col("day").alias(start), F.col("number").alias("_from"))
    due = cal.where("working").select(F.col("day").alias("due"), F.col("number").alias("_to"))
    return rows.join(base, start).join(due, F.col("_to") == F.col("_from") + n).drop("_from", "_to")


def penalty(late_days: Column, base: Column, rate: float, cap: float) -> Column:
    """Daily penalty on the base, capped at a share of it, to whole cents."""
    return F.round(F.least(late_days * base * rate, base * cap), 2)


def indexed(base: Column, rates: Column, cap: float, unit: int = 10) -> Column:
    """A chain of years: each base is that of the year before, raised by at most cap and rounded up to the unit."""
    return F.aggregate(rates, base, lambda acc, r: F.ceil(F.round(acc * (1 + F.least(r, F.lit(cap))), 6) / unit) * unit * F.lit(1.0))


def arithmetic_check(lines: DataFrame, stated: DataFrame, tolerance: float) -> DataFrame:
    """lines(doc, net, vat) summed against stated(doc, gross)."""
    sums = lines.groupBy("doc").agg(F.sum("net").alias("net"), F.sum("vat").alias("vat"))
    return sums.join(stated, "doc").withColumn("ok", F.abs(F.col("net") + F.col("vat") - F.col("gross")) <= tolerance)


def base_units(rows: DataFrame, pattern: str, units: DataFrame) -> DataFrame:
    """rows(id, text): quantities with units, in base units by units(unit, base, factor); unknown units are null."""
    number = F.regexp_extract("text", pattern, 1).try_cast("double")
    each = rows.withColumn("q", number).withColumn("unit", F.lower(F.regexp_extract("text", pattern, 2)))
    return each.join(units, "unit", "left").select("id", "base", F.round(F.col("q") * F.col("factor"), 6).alias("quantity"))


def chain_losses(items: DataFrame, *by: str) -> DataFrame:
    """items(plain, extracted, oracle as right or not, passed): shares and what the extraction loses, what rules gain, what passes falsely."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    out = items.rollup(*by).agg(F.count("*").alias("n"), share("plain").alias("plain"), share("extracted").alias("extracted"), share("oracle").alias("oracle"), F.count_if(F.col("passed") & ~F.col("extracted")).alias("false_pass"))
    return out.withColumn("extraction_loss", F.round(F.col("oracle") - F.col("extracted"), 6)).withColumn("rule_gain", F.round(F.col("extracted") - F.col("plain"), 6))
