"""How the given tables are read as operator inputs; the SQL twin of each reading stands beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def run_fields(spark: SparkSession, d: str) -> DataFrame:
    """Two simulated extraction runs over orders: run, doc, grp, field, kind, gold, pred. Which values are wrong follows from the key."""
    o = table(spark, d, "orders").withColumn("run", F.explode(F.array(F.lit(1), F.lit(2))))
    k, run = F.col("o_orderkey"), F.col("run")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    day = F.to_date("o_orderdate")
    status = F.when(k % (7 + 2 * run) == 0, "X").when(k % (13 + run) == 0, None).when(k % 5 == 0, F.concat(F.lit(" "), F.col("o_orderstatus"))).otherwise(F.col("o_orderstatus"))
    total_gold = F.when(k % 19 != 0, cents.cast("string"))
    total = F.when(k % (11 + run) == 0, (cents + 100).cast("string")).when(k % 17 == 0, None).otherwise(cents.cast("string"))
    date = F.when(k % (23 + run) == 0, F.date_add(day, 1)).otherwise(day).cast("string")
    priority = F.when(k % 29 == run, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    each = F.explode(F.array(*(
        F.struct(F.lit(f).alias("field"), F.lit(t).alias("kind"), g.alias("gold"), p.alias("pred"))
        for f, t, g, p in (
            ("status", "exact", F.col("o_orderstatus"), status), ("total", "number", total_gold, total),
            ("date", "date", day.cast("string"), date), ("priority", "exact", F.col("o_orderpriority"), priority),
        )
    ))).alias("x")
    return o.select(run.alias("run"), k.alias("doc"), F.col("o_custkey").alias("grp"), each).select("run", "doc", "grp", "x.*")


RUN_FIELDS = """
o as (select *, r.run as run, cast(round(o_totalprice * 100) as bigint) as cents, cast(o_orderdate as date) as day
      from orders, (select unnest([1, 2])::int as run) r),
run_fields as (
  select run, o_orderkey as doc, o_custkey as grp, 'status' as field, 'exact' as kind, o_orderstatus as gold,
         case when o_orderkey % (7 + 2 * run) = 0 then 'X' when o_orderkey % (13 + run) = 0 then null
              when o_orderkey % 5 = 0 then ' ' || o_orderstatus else o_orderstatus end as pred from o
  union all
  select run, o_orderkey, o_custkey, 'total', 'number', case when o_orderkey % 19 <> 0 then cents::varchar end,
         case when o_orderkey % (11 + run) = 0 then (cents + 100)::varchar when o_orderkey % 17 = 0 then null else cents::varchar end from o
  union all
  select run, o_orderkey, o_custkey, 'date', 'date', day::varchar,
         case when o_orderkey % (23 + run) = 0 then (day + 1)::varchar else day::varchar end from o
  union all
  select run, o_orderkey, o_custkey, 'priority', 'exact', o_orderpriority,
         case when o_orderkey % 29 = run then lower(o_orderpriority) else o_orderpriority end from o),
outcomes as (
  select *, case when gold is null and pred is null then 'tn' when gold is null then 'fp' when pred is null then 'fn'
    when case kind when 'number' then abs(gold::double - pred::double) <= 0.01 else trim(gold) = trim(pred) end then 'tp'
    else 'mismatch' end as outcome from run_fields)
"""


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions read from events: id, grp, arm, layer, conf (0 to 1) and correct."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("grp"), F.when(F.col("event_id") % 2 == 0, "base").otherwise("tuned").alias("arm"),
        F.col("event_type").alias("layer"), F.round((k + 1) / 101.0, 6).alias("conf"), ((F.col("event_id") * 7919 + k * 31) % 100 < 30 + k * 0.7).alias("correct"),
    )


DECISIONS = """
ev as (select *, cast(json_extract_string(props, '$.k') as int) as k from events),
decisions as (
  select event_id as id, user_id as grp, case when event_id % 2 = 0 then 'base' else 'tuned' end as arm, event_type as layer,
         round((k + 1) / 101.0, 6)::double as conf, (event_id * 7919 + k * 31) % 100 < 30 + k * 0.7 as correct from ev)
"""
