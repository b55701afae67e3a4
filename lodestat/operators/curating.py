"""Curation of training and evaluation sets: dedup, decontamination, splits, quotas, audits."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.values import hash_bucket, seeded, shingles, tokens

#: Rows of two longs that are sent to all tasks at most.
BROADCAST_ROWS = 2_000_000


def keep_first(rows: DataFrame, body: Column, order: str) -> DataFrame:
    """order, kept and first: whether a row is the first of those with an equal body, and which one is.

    The least id of each hash is aggregated before it is joined back, so thousands of copies make no window.
    """
    keyed = rows.select(order, F.sha2(body, 256).alias("_sha"))
    first = keyed.groupBy("_sha").agg(F.min(order).alias("first"))
    return keyed.join(first, "_sha").select(order, (F.col(order) == F.col("first")).alias("kept"), "first")


def decontaminate(pool: DataFrame, evaluation: DataFrame, n: int = 8, drop: float = 0.5, report: float = 0.2) -> DataFrame:
    """Share of a pool text's distinct word n-grams that occur in any evaluation text, and what follows from it.

    Both are (id, text). Grams are compared by two hashes of 64 bits, those of the evaluation made distinct first; up to
    BROADCAST_ROWS of them are sent to all tasks, so that no gram of the pool is shuffled, beyond that both sides meet by
    a shuffle. A text of fewer than n words is one gram as it stands.
    """
    grams = lambda c: F.array_distinct(F.when(F.size(c) < n, F.array(F.array_join(c, " "))).otherwise(shingles(c, n)))
    both = lambda g: F.transform(g, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(n), x).alias("b")))
    of = lambda rows, *keep: rows.select(*keep, tokens(F.col("text")).alias("w")).where(F.size("w") > 0).select(*keep, F.explode(both(grams(F.col("w")))).alias("g")).select(*keep, "g.a", "g.b")
    seen = of(evaluation).distinct().withColumn("hit", F.lit(1))
    if seen.count() <= BROADCAST_ROWS:
        seen = F.broadcast(seen)
    hit = of(pool, "id").join(seen, ["a", "b"], "left")
    out = hit.groupBy("id").agg(F.count("*").alias("grams"), F.count("hit").alias("hits")).withColumn("share", F.round(F.col("hits") / F.col("grams"), 6))
    return out.withColumn("verdict", F.when(F.col("share") >= drop, "drop").when(F.col("share") >= report, "report").otherwise("keep"))


def shared_text(pool: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Pool rows whose normalised text is that of an evaluation row: joined by hash, then compared."""
    norm = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    a = pool.select("id", norm.alias("t")).withColumn("h", F.xxhash64("t"))
    b = evaluation.select(F.col("id").alias("eval_id"), norm.alias("t2")).withColumn("h", F.xxhash64("t2"))
    return a.join(b, "h").where("t = t2").groupBy("id").agg(F.count("*").alias("n"), F.min("eval_id").alias("first"))


def groups_in_several(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups found in more than one split."""
    return rows.groupBy(group).agg(F.countDistinct(split).alias("splits"), F.count("*").alias("rows")).where(F.col("splits") > 1)


def split_overlap(rows: DataFrame, split: str, rules: dict[str, list[str]], train: str = "train") -> DataFrame:
    """For each rule (name -> columns) how many rows outside the training split share their columns with it."""
    out = None
    for name, columns in rules.items():
        known = rows.where(F.col(split) == train).select(*columns).distinct()
        other = rows.where(F.col(split) != train)
        each = other.join(known.withColumn("_in", F.lit(1)), columns, "left").groupBy(split).agg(F.count("*").alias("rows"), F.count("_in").alias("shared")).withColumn("rule", F.lit(name))
        out = each if out is None else out.unionByName(each)
    return out


def hash_split(rows: DataFrame, group: Column, validation: int = 10, test: int = 10) -> DataFrame:
    """split of each row from its group's bucket; all rows of a group fall together."""
    b = hash_bucket(group)
    return rows.withColumn("split", F.when(b < validation, "val").when(b < validation + test, "test").otherwise("train"))


def digest_modulo(key: Column, m: int = 100) -> Column:
    """The whole sha256 as a number, modulo m: a fold over its digits."""
    digits = F.split(F.sha2(key.cast("string"), 256), "")
    value = lambda c: F.conv(c, 16, 10).cast("int")
    return F.aggregate(F.filter(digits, lambda c: c != ""), F.lit(0), lambda acc, c: (acc * 16 + value(c)) % m)


def one_per_group(rows: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """The row with the least seeded hash of each group."""
    best = rows.groupBy(group).agg(F.min_by(key, seeded(seed, F.col(key))).alias(key))
    return rows.join(best, [group, key], "left_semi")


def in_hash_order(rows: DataFrame, key: str, seed: str, *by: str, weight: str | None = None) -> DataFrame:
    """rows with rank (place in the order of seeded hashes of key, from 1, within by), size of the cell and before (sum of weight, or of rows, ahead of it).

    The order is cut by the first three digits of the hash: sums of these 4096 parts a cell are added up, and only a
    part is sorted in one task.
    """
    each = rows.withColumn("_h", seeded(seed, F.col(key))).withColumn("_part", F.substring("_h", 1, 3)).withColumn("_w", F.col(weight) if weight else F.lit(1))
    parts = each.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.sum("_w").alias("_sum"))
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows a cell
    earlier = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    parts = parts.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_part").alias("_p"), earlier("_n").alias("_rows"), earlier("_sum").alias("_ahead"), F.sum("_n").over(Window.partitionBy(*by)).alias("size"))
    on = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    own = Window.partitionBy(*by, "_part").orderBy("_h", key)
    met = each.join(parts, on)
    met = met.withColumn("rank", (F.col("_rows") + F.row_number().over(own)).cast("long"))
    met = met.withColumn("before", F.col("_ahead") + F.coalesce(F.sum("_w").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return met.select(*rows.columns, "rank", "size", "before")


def quota_split(rows: DataFrame, group: str, quotas: list[tuple[str, int]], seed: str) -> DataFrame:
    """Groups in hash order; each goes to the slice whose quota the rows before it have not reached, the rest to reserve."""
    groups = in_hash_order(rows.groupBy(group).agg(F.count("*").alias("n")), group, seed, weight="n").drop("rank", "size")
    slot, ends = F.lit(None).cast("string"), itertools.accumulate(q for _, q in quotas)
    for (name, _), end in reversed(list(zip(quotas, ends, strict=True))):
        slot = F.when(F.col("before") < end, name).otherwise(slot)
    return groups.withColumn("slice", F.coalesce(slot, F.lit("reserve")))


def ranked_sample(rows: DataFrame, key: str, take: Column, seed: str, *by: str) -> DataFrame:
    """The rows of each cell with the least seeded hashes, as many as take says; rank and size beside them."""
    return in_hash_order(rows, key, seed, *by).drop("before").where(F.col("rank") <= take)


def audit_sample(rows: DataFrame, key: str, flag: str, cap: int, share: float, seed: str, *by: str) -> DataFrame:
    """All flagged rows of a cell up to a cap, and a share of the others; with the probability of each to be drawn."""
    take = F.when(F.col(flag), F.least(F.lit(cap), F.col("size"))).otherwise(F.ceil(F.col("size") * share)).cast("long")
    out = ranked_sample(rows, key, take, seed, *by, flag)
    return out.withColumn("incl_prob", F.round(take / F.col("size"), 6)).drop("rank", "size")


def family_quotas(counts: DataFrame, budget: int, cap: int) -> DataFrame:
    """Targets of families (family, n) by water-filling: the level that spends the budget, no family over its size or the cap."""
    limit = F.least(F.col("n"), F.lit(cap))
    each = counts.withColumn("limit", limit)
    w = Window.orderBy("limit", "family")  # one row a family
    each = each.withColumn("below", F.coalesce(F.sum("limit").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = each.withColumn("left", F.count("*").over(Window.partitionBy(F.lit(0))) - F.row_number().over(w) + 1)
    each = each.withColumn("level", F.floor((budget - F.col("below")) / F.col("left")))
    first = each.where("limit > level").agg(F.min_by("level", F.struct("limit", "family")).alias("water"))
    return each.crossJoin(F.broadcast(first)).select("family", "n", F.least("limit", F.coalesce("water", "limit")).alias("target"))


def length_matched(reference: DataFrame, pool: DataFrame, value: str, key: str, per_bin: int, seed: str, bins: int = 10) -> DataFrame:
    """An equal draw from the pool for each quantile bin of the reference."""
    edges = reference.agg(F.percentile(value, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("edges"))
    each = pool.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(value)))).drop("edges")
    return ranked_sample(each, key, F.lit(per_bin), seed, "bin").select(key, value, "bin")


def thinned(rows: DataFrame, flag: Column, share: float, key: str, seed: str) -> DataFrame:
    """Flagged rows thinned so that they make up the share; the others stay."""
    total = rows.agg(F.count_if(~flag).alias("others"))
    want = F.floor(F.col("others") * share / (1 - share))
    each = rows.withColumn("_flag", flag).crossJoin(F.broadcast(total))
    out = ranked_sample(each, key, F.when(F.col("_flag"), want).otherwise(F.col("size")).cast("long"), seed, "_flag")
    return out.drop("_flag", "others", "rank", "size")


def fixed_point_free(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """key and partner: each row is given the next one in hash order, the last the first."""
    each = in_hash_order(rows.select(key), key, seed)
    after = each.select(F.col("rank").alias("_j"), F.col(key).alias("partner"))
    return each.join(after, F.col("rank") % F.col("size") + 1 == F.col("_j")).select(key, "partner")


def carried_over(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, context, options, gold, decision): decisions of rows whose context, option set and gold did not change."""
    o = old.select("id", F.col("context").alias("c0"), F.array_sort("options").alias("o0"), F.col("gold").alias("g0"), "decision")
    j = new.join(o, "id")
    return j.where((F.col("context") == F.col("c0")) & (F.array_sort("options") == F.col("o0")) & F.col("gold").eqNullSafe(F.col("g0"))).select("id", "decision")


def vote_removal(votes: DataFrame, items: DataFrame, p_min: float, least: int = 2) -> DataFrame:
    """votes(item, option, p): options that any judge votes out, or that none answered, go; items left with too few are dropped."""
    worst = votes.groupBy("item", "option").agg(F.max("p").alias("p"))
    gone = worst.where(F.col("p").isNull() | (F.col("p") >= p_min))
    left = items.join(gone, ["item", "option"], "left_anti").groupBy("item").agg(F.count("*").alias("left"))
    return items.select("item").distinct().join(left, "item", "left").na.fill(0, ["left"]).withColumn("kept", F.col("left") >= least)


def triage(votes: DataFrame, gold: DataFrame, sure: float = 0.8) -> DataFrame:
    """votes(id, judge, pred, conf): consensus when two judges or more are sure of the same other answer, else single or none."""
    other = votes.join(gold, "id").where((F.col("pred") != F.col("gold")) & (F.col("conf") >= sure)).groupBy("id", "pred").agg(F.countDistinct("judge").alias("judges"))
    best = other.groupBy("id").agg(F.max("judges").alias("judges"))
    return gold.join(best, "id", "left").select("id", F.when(F.col("judges") >= 2, "consensus").when(F.col("judges") == 1, "single").otherwise("none").alias("tier"))


def agreement_survivors(rows: DataFrame, conf: float, mass: float = 0.5) -> DataFrame:
    """rows(id, original, pred, gold, conf, mass): kept when the checker gives the gold surely; a variant only with its original. Reasons for the rest."""
    reason = F.when(F.col("mass") < mass, "mass").when(F.col("pred") != F.col("gold"), "answer").when(F.col("conf") < conf, "unsure")
    each = rows.withColumn("reason", reason)
    ok = each.where("reason is null").select(F.col("id").alias("original"), F.lit(1).alias("alive")).distinct()
    out = each.join(ok, "original", "left")
    return out.select("id", F.coalesce("reason", F.when(F.col("original").isNotNull() & F.col("alive").isNull(), "original lost"), F.lit("kept")).alias("status"))


def gold_positions(items: DataFrame) -> DataFrame:
    """items(n_options, position): observed against even counts by position, and chi squared of each length of list."""
    seen = items.groupBy("n_options", "position").agg(F.count("*").alias("seen"))
    total = items.groupBy("n_options").agg(F.count("*").alias("total"))
    full = total.withColumn("position", F.explode(F.sequence(F.lit(1), F.col("n_options"))))
    each = full.join(seen, ["n_options", "position"], "left").na.fill(0, ["seen"])
    e = F.col("total") / F.col("n_options")
    return each.groupBy("n_options").agg(F.max("total").alias("total"), F.round(F.sum((F.col("seen") - e) ** 2 / e), 6).alias("chi2"))


def content_state(gold: Column, kind: Column) -> Column:
    """MATCH where there is a gold answer, else the state its kind of absence stands for."""
    return F.when(gold.isNotNull(), "MATCH").when(kind == "missing", "MISSING_DATA").when(kind == "outside", "OUT_OF_SCOPE").otherwise("NO_MATCH")


def soft_target(probs: Column, sure: float = 0.999) -> tuple[Column, Column]:
    """probs: map option -> probability. (hard gold or null, renormalised map or null): hard where one option holds all but nothing."""
    top = F.array_max(F.map_values(probs))
    name = F.element_at(F.map_keys(F.map_filter(probs, lambda k, v: v == top)), 1)
    total = F.aggregate(F.map_values(probs), F.lit(0.0), lambda a, v: a + v)
    return F.when(top / total >= sure, name), F.when(top / total < sure, F.transform_values(probs, lambda k, v: F.round(v / total, 6)))


def validated(items: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """items with the list of rules they break."""
    return items.withColumn("errors", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for m, c in checks.items()))))


def audit_summary(rows: DataFrame, *by: str) -> DataFrame:
    """rows(reviewed, wrong, ambiguous): pool, reviewed, wrong, ambiguous and noise rate of each cell, and the cell's share of the pool's noise."""
    seen = lambda c: F.count_if(F.col("reviewed") & F.col(c))
    out = rows.groupBy(*by).agg(F.count("*").alias("pool"), F.count_if("reviewed").alias("reviewed"), seen("wrong").alias("wrong"), seen("ambiguous").alias("ambiguous"))
    out = out.withColumn("rate", F.when(F.col("reviewed") > 0, F.col("wrong") / F.col("reviewed")))
    total = F.broadcast(out.agg(F.sum("pool").alias("total")))
    return out.crossJoin(total).select(*by, "pool", "reviewed", "wrong", "ambiguous", F.round("rate", 6).alias("rate"), F.round(F.col("rate") * F.col("pool") / F.col("total"), 6).alias("weighted"))


def family_summary(rows: DataFrame, family: str, split: str, splits: list[str]) -> DataFrame:
    """n and split counts of each family."""
    wide = rows.groupBy(family).pivot(split, splits).agg(F.count(F.lit(1)))
    return rows.groupBy(family).agg(F.count("*").alias("n")).join(wide, family).na.fill(0, splits)


def completeness(expected: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """Expected keys against rows: present once, missing, repeated, unexpected."""
    seen = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    both = expected.withColumn("_e", F.lit(1)).join(seen, list(keys), "full_outer")
    state = F.when(F.col("_e").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").otherwise("once")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("keys"))


def merged_pools(*pools: DataFrame, key: str = "id") -> DataFrame:
    """Union of pools by name; of rows with one key the later pool's stays."""
    out = None
    for i, p in enumerate(pools):
        p = p.withColumn("_pool", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    last = out.groupBy(key).agg(F.max("_pool").alias("_pool"))
    return out.join(last, [key, "_pool"], "left_semi").drop("_pool")


def same_items(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_a, only_b and equal of two sets of rows."""
    return a.exceptAll(b).agg(F.count("*").alias("only_a")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_b"))).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))
