"""Queries over the scoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.functions import values
from lodestat.operators import paired, scoring
from lodestat.plans.inputs import RUN_FIELDS, run_fields, table
from lodestat.plans.registry import query

PRF = """round(case when tp + fp + mm > 0 then tp / (tp + fp + mm) else 0 end, 6)::double as {p}precision,
round(case when tp + fn + mm > 0 then tp / (tp + fn + mm) else 0 end, 6)::double as {p}recall,
round(case when 2 * tp + fp + fn + 2 * mm > 0 then 2 * tp / (2 * tp + fp + fn + 2 * mm) else 0 end, 6)::double as {p}f1"""
COUNTS = ", ".join(f"(count(*) filter ({{c}} = '{x}'))::bigint as {a}" for x, a in (("tp", "tp"), ("fp", "fp"), ("fn", "fn"), ("mismatch", "mm")))


@query("strict_f1", f"""with {RUN_FIELDS}, j as (select *, case when outcome = 'mismatch' and lower(trim(gold)) = lower(trim(pred)) then 'tp' else outcome end as again
  from outcomes where not (doc % 41 = 0 and field = 'date')),
a as (select run, {COUNTS.format(c="outcome")} from j group by run), b as (select run, {COUNTS.format(c="again")} from j group by run),
x as (select *, {PRF.format(p="")} from a), y as (select *, {PRF.format(p="norm_")} from b)
select x.*, y.tp as norm_tp, y.fp as norm_fp, y.fn as norm_fn, y.mm as norm_mm, norm_precision, norm_recall, norm_f1 from x join y using (run)""")
def strict_f1(spark, d):
    rows = run_fields(spark, d)
    excluded = rows.where("doc % 41 = 0 and field = 'date'").select("doc", "field").distinct()
    return scoring.strict_f1(rows, excluded)


@query("outcome_buckets", f"with {RUN_FIELDS} select run, field, outcome, count(*) as n from outcomes group by all")
def outcome_buckets(spark, d):
    return scoring.with_outcomes(run_fields(spark, d)).groupBy("run", "field", "outcome").agg(F.count("*").alias("n"))


@query("typed_equality", f"""with {RUN_FIELDS} select run, kind, count(*) as n, (count(*) filter (gold is not null and pred is not null and
 (case kind when 'number' then abs(gold::double - pred::double) <= 0.01 else trim(gold) = trim(pred) end)))::bigint as same from run_fields group by all""")
def typed_equality(spark, d):
    same = values.equal_by_type(F.col("kind"), F.col("gold"), F.col("pred"))
    return run_fields(spark, d).groupBy("run", "kind").agg(F.count("*").alias("n"), F.count_if(same).alias("same"))


@query("f1_by_grain", f"with {RUN_FIELDS}, a as (select run, field, {COUNTS.format(c='outcome')} from outcomes group by rollup (run, field)) select *, {PRF.format(p='')} from a")
def f1_by_grain(spark, d):
    return scoring.f1_by_grain(run_fields(spark, d))


PARTIES = """parties as (select r.run, c_custkey as doc, c_nationkey as nation, case when c_custkey % 37 = 0 then null else lpad((c_custkey * 7 + r.run)::varchar, 8, '1') || '-2' end as tax,
  case when c_custkey % 37 = 0 then null when c_custkey % 10 = r.run then 'Own ' || c_mktsegment || ' Ltd' else c_name end as name
  from customer, (select unnest([1, 2])::int as run) r),
flags as (select *, coalesce(starts_with(regexp_replace(tax, '[^0-9]', '', 'g'), '1111'), false) as by_tax,
  coalesce(contains(lower(name), 'own building') or contains(lower(name), 'own machinery'), false) as by_name, tax is null and name is null as unusable from parties)"""


def parties(spark, d):
    c = table(spark, d, "customer").withColumn("run", F.explode(F.array(F.lit(1), F.lit(2))))
    k = F.col("c_custkey")
    tax = F.when(k % 37 != 0, F.concat(F.lpad((k * 7 + F.col("run")).cast("string"), 8, "1"), F.lit("-2")))
    name = F.when(k % 37 == 0, None).when(k % 10 == F.col("run"), F.concat(F.lit("Own "), F.col("c_mktsegment"), F.lit(" Ltd"))).otherwise(F.col("c_name"))
    return c.select("run", k.alias("doc"), F.col("c_nationkey").alias("nation"), tax.alias("tax"), name.alias("name"))


HINTS = ["Own Building", "Own Machinery"]


@query("gate_counts", f"with {PARTIES} select run, count(*) as docs, (count(*) filter (by_tax or by_name))::bigint as flagged, (count(*) filter (by_tax and by_name))::bigint as \"both\", (count(*) filter (unusable))::bigint as unusable from flags group by run")
def gate_counts(spark, d):
    return scoring.gate_counts(scoring.gate_flags(parties(spark, d), "1111", HINTS), "run")


@query("gate_flags", f"with {PARTIES} select run, doc, by_tax, by_name, unusable from flags where by_tax or by_name or unusable")
def gate_flags(spark, d):
    return scoring.gate_flags(parties(spark, d), "1111", HINTS).where("flagged or unusable").select("run", "doc", "by_tax", "by_name", "unusable")


@query("linked_gate", f"""with {PARTIES} select run, count(*) as n, (count(*) filter (by_name = (s_suppkey % 3 = 0)))::bigint as agree
 from flags join supplier on s_suppkey = doc where s_acctbal > 0 group by run""")
def linked_gate(spark, d):
    link = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("doc"), (F.col("s_suppkey") % 3 == 0).alias("linked"))
    flags = scoring.gate_flags(parties(spark, d), "1111", HINTS).join(link, "doc")
    return flags.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("by_name") == F.col("linked")).alias("agree"))


@query("aggregate_only_export", f"with {PARTIES} select nation, count(*) as docs, (count(*) filter (by_tax or by_name))::bigint as flagged, (count(*) filter (by_tax and by_name))::bigint as \"both\", (count(*) filter (unusable))::bigint as unusable from flags group by nation having count(*) >= 50")
def aggregate_only_export(spark, d):
    from lodestat.sources.files import exportable

    return exportable(scoring.gate_counts(scoring.gate_flags(parties(spark, d), "1111", HINTS), "nation"), "docs", 50)


ELEMENTS = """expected as (select l_orderkey as item, p_brand as element from lineitem join part on p_partkey = l_partkey),
given as (select l_orderkey as item, case when (l_partkey + l_linenumber) % 6 = 0 then 'Brand#0' else p_brand end as element from lineitem join part on p_partkey = l_partkey where (l_orderkey + l_linenumber) % 9 <> 0)"""


def elements(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    given = rows.where("(l_orderkey + l_linenumber) % 9 <> 0").select(F.col("l_orderkey").alias("item"), F.expr("case when (l_partkey + l_linenumber) % 6 = 0 then 'Brand#0' else p_brand end").alias("element"))
    return given, rows.select(F.col("l_orderkey").alias("item"), F.col("p_brand").alias("element"))


@query("list_credit", f"""with {ELEMENTS}, e as (select item, element, count(*) as e from expected group by all), g as (select item, element, count(*) as g from given group by all),
b as (select coalesce(e.item, g.item) as item, coalesce(e, 0) as e, coalesce(g, 0) as g from e full join g on e.item = g.item and e.element = g.element)
select item, sum(least(e, g))::bigint as found, sum(e)::bigint as expected, sum(g)::bigint as given, round(sum(least(e, g)) / greatest(sum(e), sum(g)), 6)::double as credit from b group by item""")
def list_credit(spark, d):
    return scoring.list_credit(*elements(spark, d))


@query("component_coverage", f"with {ELEMENTS}, e as (select item % 5 as source, count(*) as p from expected group by all), g as (select item % 5 as source, count(*) as h from given where element <> 'Brand#0' group by all) select source, h as hits, p as possible, round(h / p, 6)::double as coverage from e join g using (source)")
def component_coverage(spark, d):
    given, expected = elements(spark, d)
    a = given.where("element <> 'Brand#0'").select((F.col("item") % 5).alias("source"), F.lit(1).alias("hits"), F.lit(0).alias("possible"))
    b = expected.select((F.col("item") % 5).alias("source"), F.lit(0).alias("hits"), F.lit(1).alias("possible"))
    return scoring.component_coverage(a.unionAll(b), "source")


ITEMS = "items as (select run, doc, grp, bool_and(outcome in ('tp', 'tn')) as passed, round(avg((outcome in ('tp', 'tn'))::int), 6)::double as points from outcomes group by all)"


@query("item_pass", f"with {RUN_FIELDS}, {ITEMS} select run, doc, passed, points from items")
def item_pass(spark, d):
    return scoring.item_pass(run_fields(spark, d))


Z = "1.959963984540054"
WILSON = f"""round(k / n, 6)::double as rate,
round(case when n = 0 then 0 else greatest((k / n + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) - {Z} * sqrt(k / n * (1 - k / n) / n + {Z} * {Z} / (4 * n * n)) / (1 + {Z} * {Z} / n), 0) end, 6)::double as low,
round(case when n = 0 then 1 else least((k / n + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) + {Z} * sqrt(k / n * (1 - k / n) / n + {Z} * {Z} / (4 * n * n)) / (1 + {Z} * {Z} / n), 1) end, 6)::double as high"""


@query("pass_rates", f"with {RUN_FIELDS}, {ITEMS}, a as (select run, doc % 4 as fault, count(*) filter (passed) as k, count(*) as n from items group by rollup (run, fault)) select *, {WILSON} from a")
def pass_rates(spark, d):
    return scoring.pass_rates(item_pass(spark, d).withColumn("fault", F.col("doc") % 4), "run", "fault")


@query("rate_table_wilson", f"with a as (select lang, source, count(*) filter (toxic = 1) as k, count(*) as n from documents join labels using (doc_id) group by all) select *, {WILSON} from a")
def rate_table_wilson(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    return scoring.rate_table(rows, F.col("toxic") == 1, "lang", "source")


@query("stratified_by_control", f"with {RUN_FIELDS}, {ITEMS}, b as (select x.passed as control, y.passed from items x join items y on x.doc = y.doc and x.run = 1 and y.run = 2), a as (select control, count(*) filter (passed) as k, count(*) as n from b group by all) select *, {WILSON} from a")
def stratified_by_control(spark, d):
    items = item_pass(spark, d)
    return scoring.stratified_by_control(items.where("run = 1"), items.where("run = 2"))


@query("transition_matrix", f"with {RUN_FIELDS}, b as (select x.outcome as run1, y.outcome as run2 from outcomes x join outcomes y on x.doc = y.doc and x.field = y.field and x.run = 1 and y.run = 2) select run1, run2, count(*) as n from b group by cube (run1, run2)")
def transition_matrix(spark, d):
    rows = scoring.with_outcomes(run_fields(spark, d)).select("run", "doc", "field", "outcome")
    both = rows.where("run = 1").select("doc", "field", F.col("outcome").alias("run1")).join(rows.where("run = 2").select("doc", "field", F.col("outcome").alias("run2")), ["doc", "field"])
    return scoring.transition(both, "run1", "run2")


@query("path_agreement", f"with {RUN_FIELDS} select x.field, count(*) as n, (count(*) filter (x.pred is not distinct from y.pred))::bigint as same, round(count(*) filter (x.pred is not distinct from y.pred) / count(*), 6)::double as share from run_fields x join run_fields y on x.doc = y.doc and x.field = y.field and x.run = 1 and y.run = 2 group by 1")
def path_agreement(spark, d):
    return scoring.field_agreement(run_fields(spark, d))


SIDES = "a as (select doc, passed as a from items where run = 1), b as (select doc, passed as b from items where run = 2), pairs as (select doc, a, b from a join b using (doc))"


def pairs_of(spark, d):
    items = item_pass(spark, d)
    return paired.paired(items.where("run = 1"), items.where("run = 2"), "doc")


@query("paired_runs", f"with {RUN_FIELDS}, {ITEMS}, {SIDES} select doc, a, b from pairs")
def paired_runs(spark, d):
    return pairs_of(spark, d)


BINOM = "case when {n} = 0 then 1 else least(1, 2 * (select sum(exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))) from range(0, least({b}, {c}) + 1) t(i))) end"


@query("mcnemar", f"""with {RUN_FIELDS}, {ITEMS}, {SIDES}, c as (select doc % 50 as cell, count(*) filter (a and b) as n11, count(*) filter (a and not b) as n10, count(*) filter (not a and b) as n01, count(*) filter (not a and not b) as n00 from pairs group by 1)
select *, round(case when n10 + n01 > 0 then (abs(n10 - n01) - 1) ** 2 / (n10 + n01) else 0 end, 6)::double as chi2, round({BINOM.format(n="(n10 + n01)", b="n10", c="n01")}, 6)::double as p_exact, n10 + n01 < 25 as exact from c""")
def mcnemar(spark, d):
    return paired.mcnemar(pairs_of(spark, d).withColumn("cell", F.col("doc") % 50), "cell", exact_below=25)


@query("rate_difference", f"""with {RUN_FIELDS}, {ITEMS}, {SIDES}, c as (select count(*) as n, count(*) filter (not a and b) as gain, count(*) filter (a and not b) as loss from pairs),
e as (select *, round((gain - loss) / n, 6)::double as diff, round((gain - loss) / n - {Z} * sqrt(gain + loss - (gain - loss) * (gain - loss) / n) / n, 6)::double as low,
 round((gain - loss) / n + {Z} * sqrt(gain + loss - (gain - loss) * (gain - loss) / n) / n, 6)::double as high from c)
select *, case when low > -0.0133 then 'non-inferior' when high < -0.0133 then 'worse' else 'undecided' end as verdict from e""")
def rate_difference(spark, d):
    return paired.rate_difference(pairs_of(spark, d), -0.0133)


@query("holm_family", f"""with {RUN_FIELDS}, {ITEMS}, {SIDES}, c as (select doc % 12 as arm, count(*) filter (a and not b) as n10, count(*) filter (not a and b) as n01 from pairs group by 1),
p as (select arm, round({BINOM.format(n="(n10 + n01)", b="n10", c="n01")}, 6)::double as p from c), r as (select *, row_number() over (order by p, arm) as rn, count(*) over () as m from p)
select arm, p, round(least(1, max((m - rn + 1) * p) over (order by p, arm)), 6)::double as p_adjusted from r""")
def holm_family(spark, d):
    ps = paired.mcnemar(pairs_of(spark, d).withColumn("arm", F.col("doc") % 12), "arm").select("arm", F.col("p_exact").alias("p"))
    return paired.holm(ps)


@query("value_weighted_coverage", """with a as (select o_orderpriority as arm, quantile_cont(o_totalprice, 0.99) as top from orders group by 1)
select arm, round(sum(case when o_orderstatus <> 'P' then least(o_totalprice, top) else 0 end) / sum(least(o_totalprice, top)), 6)::double as coverage from orders join a on arm = o_orderpriority group by 1""")
def value_weighted_coverage(spark, d):
    return scoring.value_weighted(table(spark, d, "orders").select(F.col("o_orderpriority").alias("arm"), F.col("o_totalprice").alias("value"), (F.col("o_orderstatus") != "P").alias("covered")))


@query("manual_over_machine", """with s as (select doc_id as item, quality::varchar as judge, case when doc_id % 3 = 0 then ' ' || toxic::varchar || ' ' when doc_id % 3 = 1 then '  ' end as manual from labels)
select item, judge, manual, coalesce(nullif(trim(manual), ''), judge) as final, case when nullif(trim(manual), '') is not null then trim(manual) = judge end as agree from s""")
def manual_over_machine(spark, d):
    l = table(spark, d, "labels")
    manual = F.expr("case when doc_id % 3 = 0 then concat(' ', cast(toxic as string), ' ') when doc_id % 3 = 1 then '  ' end")
    return scoring.verdicts_of(l.select(F.col("doc_id").alias("item"), F.col("quality").cast("string").alias("judge"), manual.alias("manual")))


@query("scenario_scores", """with c as (select conv_id as scenario, turn, case when length(text) % 3 = 0 then 'search' when length(text) % 3 = 1 then 'lookup' else 'delete' end as tool from conversations),
a as (select scenario, max(turn) as turns, ((count(*) filter (tool = 'search') >= 1)::int + (count(*) filter (tool = 'lookup') >= 1)::int) as met, count(*) filter (tool = 'delete') as forbidden from c group by 1)
select *, met = 2 and forbidden = 0 and turns <= 6 as passed from a""")
def scenario_scores(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("scenario"), "turn", F.expr("case when length(text) % 3 = 0 then 'search' when length(text) % 3 = 1 then 'lookup' else 'delete' end").alias("tool"))
    return scoring.scenario_scores(c, [("search", 1), ("lookup", 1)], ["delete"], 6)


@query("arm_scoreboard", f"""with {RUN_FIELDS}, {ITEMS}, arms as (select unnest([1, 2, 3])::int as arm), p as (select run as arm, round(avg(passed::int), 6)::double as pass_rate, round(avg(points), 6)::double as points from items group by 1)
select arm, pass_rate, points from arms left join p using (arm)""")
def arm_scoreboard(spark, d):
    items = item_pass(spark, d)
    each = items.groupBy(F.col("run").alias("arm")).agg(F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"), F.round(F.avg("points"), 6).alias("points"))
    long = each.unpivot("arm", ["pass_rate", "points"], "metric", "value")
    arms = spark.range(1, 4).select(F.col("id").cast("int").alias("arm"))
    return scoring.scoreboard(arms, long, ["pass_rate", "points"])
