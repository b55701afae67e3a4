"""Queries over decisions, calibration, thresholds and repeats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestat.operators import deciding, paired
from lodestat.plans.inputs import DECISIONS, RUN_FIELDS, decisions, table
from lodestat.plans.registry import query
from lodestat.plans.score_queries import ITEMS

STEPS = """c as (select arm, layer, conf, count(*) filter (correct) as k, count(*) as n from decisions group by all),
s as (select *, sum(k) over w as kk, sum(n) over w as nn, sum(n) over (partition by arm, layer) as total from c window w as (partition by arm, layer order by conf desc rows unbounded preceding))"""
W = f"with {DECISIONS}, {STEPS}"
BY = ("arm", "layer")


@query("risk_coverage", f"{W} select arm, layer, conf, kk::bigint as kk, nn::bigint as nn, round(nn / total, 6)::double as coverage, round(1 - kk / nn, 6)::double as risk from s")
def risk_coverage(spark, d):
    return deciding.risk_curve(decisions(spark, d), *BY)


@query("aurc", f"""{W}, a as (select arm, layer, sum(n * (1 - kk / nn)) / sum(n) as a, sum(n) as rows, sum(k) as right_ from s group by all),
b as (select *, case when rows = right_ then 0 else (select sum(j / (right_ + j)) from range(1, (rows - right_)::bigint + 1) t(j)) / rows end as best from a)
select arm, layer, rows::bigint as rows, right_::bigint as "right", round(a, 6)::double as aurc, round(best, 6)::double as best, round(a - best, 6)::double as excess from b""")
def aurc(spark, d):
    return deciding.aurc(decisions(spark, d), *BY)


KIND = "case when grp % 3 = 0 then 'none fits' when layer = 'purchase' then 'list' else 'option' end"


@query("risk_by_kind", f"""with {DECISIONS}, r as (select *, {KIND} as kind from decisions), c as (select arm, kind, conf, count(*) as n, count(*) filter (correct) as k from r group by all),
s as (select *, sum(n) over w as nn, sum(k) over w as kk from c window w as (partition by arm, kind order by conf desc)), a as (select arm, kind, sum(n) as rows, sum(k) as y, sum(n * (1 - kk / nn)) / sum(n) as area from s group by all),
b as (select *, case when rows = y then 0 else (select sum(j / (y + j)) from range(1, (rows - y)::bigint + 1) t(j)) / rows end as best from a),
e as (select arm, kind, count(*) filter (not correct and conf >= 0.8) as sure_wrong, count(*) filter (not correct and conf >= 0.4 and conf < 0.8) as plain_wrong, count(*) filter (not correct and conf < 0.4) as unsure_wrong from r group by all),
u as (select arm, kind, avg(case when x.conf > z.conf then 1 when x.conf = z.conf then 0.5 else 0 end) as auroc from r x join r z using (arm, kind) where x.correct and not z.correct group by all)
select arm, kind, rows::bigint as rows, round(best, 6)::double as best, round(area - best, 6)::double as excess, sure_wrong, plain_wrong, unsure_wrong, round(auroc, 6)::double as auroc from b join e using (arm, kind) left join u using (arm, kind)""")
def risk_by_kind(spark, d):
    return deciding.risk_by_kind(decisions(spark, d), F.expr(KIND), "arm")


@query("aurc_over_all_rows", f"""{W}, u as (select arm, count(*) as undecided from decisions where conf < 0.2 group by 1),
a as (select arm, count(*) as n from decisions group by 1), c2 as (select arm, conf, count(*) filter (correct) as k, count(*) as n from decisions where conf >= 0.2 group by all),
s2 as (select *, sum(k) over w as kk, sum(n) over w as nn from c2 window w as (partition by arm order by conf desc rows unbounded preceding))
select arm, round(sum(s2.n * (1 - kk / nn)) / max(a.n), 6)::double as over_all, round((sum(s2.n * (1 - kk / nn)) + max(undecided)) / max(a.n), 6)::double as undecided_wrong from s2 join a using (arm) join u using (arm) group by arm""")
def aurc_over_all_rows(spark, d):
    rows = decisions(spark, d)
    s = deciding.steps(rows.where("conf >= 0.2"), "arm").drop("total", "right")
    total = rows.groupBy("arm").agg(F.count("*").alias("total"), F.count_if(F.col("conf") < 0.2).alias("undecided"))
    area = F.sum(F.col("n") * (1 - F.col("kk") / F.col("nn")))
    return s.join(total, "arm").groupBy("arm").agg(F.round(area / F.max("total"), 6).alias("over_all"), F.round((area + F.max("undecided")) / F.max("total"), 6).alias("undecided_wrong"))


KMIN = "kmin as (select n, ceil(0.8 * n + 1.2 * sqrt(n))::bigint as kmin from range(1, 100001) t(n))"


@query("certified_threshold", f"""{W}, {KMIN}, ok as (select arm, layer, min(conf) as tau from s join kmin on s.nn = kmin.n where kk >= kmin group by all)
select arm, layer, tau from (select distinct arm, layer from decisions) left join ok using (arm, layer)""")
def certified_threshold(spark, d):
    # 0.8 n as a quotient of whole numbers: 0.8 as a double is a little too much where the sum is a whole number
    return deciding.needed_threshold(decisions(spark, d), lambda n: F.ceil(4 * n / 5 + 1.2 * F.sqrt(n)), *BY)


@query("bound_threshold", f"""{W}, ok as (select arm, layer, min(conf) as tau from s where nn >= 30 and
 (kk / nn + 1.6448536269514722 ** 2 / (2 * nn) - 1.6448536269514722 * sqrt(kk / nn * (1 - kk / nn) / nn + 1.6448536269514722 ** 2 / (4 * nn * nn))) / (1 + 1.6448536269514722 ** 2 / nn) >= 0.75 group by all)
select arm, layer, tau from (select distinct arm, layer from decisions) left join ok using (arm, layer)""")
def bound_threshold(spark, d):
    return deciding.wilson_threshold(decisions(spark, d), 0.75, 30, *BY)


@query("empirical_threshold", f"{W} select arm, layer, min(conf) as tau, max(nn)::bigint as accepted from s where 1 - kk / nn <= 0.2 group by all")
def empirical_threshold(spark, d):
    return deciding.empirical_threshold(decisions(spark, d), 0.2, *BY)


@query("selective_metrics", f"""with {DECISIONS} select arm, layer, count(*) as n, (count(*) filter (conf >= 0.5))::bigint as accepted, (count(*) filter (conf >= 0.5 and correct))::bigint as "right", (count(*) filter (correct))::bigint as right_all,
 round(count(*) filter (conf >= 0.5) / count(*), 6)::double as coverage, round(count(*) filter (conf >= 0.5 and correct) / count(*) filter (conf >= 0.5), 6)::double as precision, round(count(*) filter (correct) / count(*), 6)::double as accuracy from decisions group by all""")
def selective_metrics(spark, d):
    return deciding.selective_metrics(decisions(spark, d), F.lit(0.5), *BY)


@query("metric_breakdowns", f"""with {DECISIONS}, x as (select *, id % 3 as kind from decisions) select arm, layer, kind::bigint as kind, count(*) as n, (count(*) filter (correct))::bigint as "right" from x group by grouping sets ((arm, layer), (arm, kind), (arm))""")
def metric_breakdowns(spark, d):
    rows = decisions(spark, d).withColumn("kind", F.col("id") % 3)
    return rows.groupingSets([["arm", "layer"], ["arm", "kind"], ["arm"]], "arm", "layer", "kind").agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))


@query("precision_at_coverage", f"{W} select arm, layer, round(arg_max(kk / nn, conf), 6)::double as precision from s where nn >= 0.5 * total group by all")
def precision_at_coverage(spark, d):
    return deciding.precision_at_coverage(decisions(spark, d), 0.5, *BY)


@query("coverage_at_precision", f"{W} select arm, layer, round(coalesce(max(case when kk / nn >= 0.8 then nn / total end), 0), 6)::double as coverage from s group by all")
def coverage_at_precision(spark, d):
    return deciding.coverage_at_precision(decisions(spark, d), 0.8, *BY)


RANK = """c as (select arm, conf, count(*) as n, count(*) filter (correct) as p from decisions group by all),
r as (select *, coalesce(sum(n) over (partition by arm order by conf rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2 as rank from c)"""


@query("auroc", f"""with {DECISIONS}, {RANK} select arm, sum(p)::bigint as pos, sum(n - p)::bigint as neg, round((sum(p * rank) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * sum(n - p)), 6)::double as auroc from r group by 1""")
def auroc(spark, d):
    return deciding.auroc(decisions(spark, d), "conf", F.col("correct"), "arm")


@query("auroc_text_length", """with x as (select n_chars as v, toxic = 1 as p from documents join labels using (doc_id)), c as (select v, count(*) as n, count(*) filter (p) as p from x group by 1),
r as (select *, coalesce(sum(n) over (order by v rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2 as rank from c)
select sum(p)::bigint as pos, sum(n - p)::bigint as neg, round((sum(p * rank) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * sum(n - p)), 6)::double as auroc from r""")
def auroc_text_length(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return deciding.auroc(rows, "n_chars", F.col("toxic") == 1)


@query("average_rank", f"with {DECISIONS}, {RANK} select arm, conf, n, rank::double as rank from r")
def average_rank(spark, d):
    ranked = paired.average_rank(decisions(spark, d), F.col("conf"), "arm")
    return ranked.groupBy("arm", "conf").agg(F.count("*").alias("n"), F.max("rank").cast("double").alias("rank"))


@query("calibration_error", f"""with {DECISIONS}, b as (select arm, layer, least(floor(conf * 10), 9) as bin, count(*) as n, sum(conf) as c, sum(correct::int) as y, sum((conf - correct::int) ** 2) as sq from decisions group by all)
select arm, layer, round(sum(abs(c - y)) / sum(n), 6)::double as ece, round(sum(sq) / sum(n), 6)::double as brier from b group by all""")
def calibration_error(spark, d):
    return deciding.calibration_error(decisions(spark, d), 10, *BY)


@query("equal_mass_bins", f"""with {DECISIONS}, b as (select *, ntile(15) over (partition by arm, layer order by conf, id) as bin from decisions)
select arm, layer, bin::int as bin, count(*) as n, round(avg(conf), 6)::double as conf, round(avg(correct::int), 6)::double as accuracy from b group by all""")
def equal_mass_bins(spark, d):
    return deciding.equal_mass_bins(decisions(spark, d), 15, *BY)


@query("fpr_at_recall", f"""with {DECISIONS}, c as (select arm, conf as s, count(*) filter (correct) as p, count(*) filter (not correct) as q from decisions group by all),
x as (select *, sum(p) over w as pp, sum(q) over w as qq, sum(p) over (partition by arm) as tp, sum(q) over (partition by arm) as tq from c window w as (partition by arm order by s desc rows unbounded preceding))
select arm, max(s) as cut, round(arg_max(qq / tq, s), 6)::double as fpr from x where pp >= 0.9 * tp group by 1""")
def fpr_at_recall(spark, d):
    return deciding.fpr_at_recall(decisions(spark, d), "conf", F.col("correct"), 0.9, "arm")


@query("answer_ceiling", "select lang, round(avg((quality is not null)::int), 6)::double as ceiling from documents left join labels using (doc_id) group by 1")
def answer_ceiling(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("gold")), "doc_id", "left")
    return deciding.ceiling(rows, "lang")


CASCADE = """o1 as (select o_orderkey as id, round((o_orderkey * 13 % 101) / 100, 6)::double as conf, o_orderkey % 4 <> 0 as correct, (o_orderkey % 17)::double as latency from orders),
o2 as (select o_orderkey as id, o_orderkey % 9 <> 0 as correct, (5 + o_orderkey % 31)::double as latency from orders where o_orderkey % 8 <> 1)"""


def two_stages(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    k = F.col("id")
    first = o.select("id", F.round((k * 13 % 101) / 100, 6).alias("conf"), (k % 4 != 0).alias("correct"), (k % 17).cast("double").alias("latency"))
    return first, o.where("id % 8 <> 1").select("id", (k % 9 != 0).alias("correct"), (5 + k % 31).cast("double").alias("latency"))


@query("two_stage_cascade", f"""with {CASCADE}, j as (select o1.*, o2.correct as c2, o2.latency as l2 from o1 left join o2 using (id))
select count(*) as n, (count(*) filter (conf >= 0.6))::bigint as by_first, round(avg((conf < 0.6)::int), 6)::double as passed_on, round(avg((case when conf >= 0.6 then correct else coalesce(c2, false) end)::int), 6)::double as accuracy,
round(quantile_cont(case when conf >= 0.6 then latency else latency + coalesce(l2, 0) end, 0.5), 6)::double as median_latency from j""")
def two_stage_cascade(spark, d):
    return deciding.cascade(*two_stages(spark, d), 0.6)


@query("closed_system", f"""with {CASCADE}, x as (select *, id % 6 = 0 as bound, id % 10 = 7 as missing, id % 3 as family from o1), y as (select *, case when bound then 'b' when missing then 'd' when conf >= 0.6 then 'm' else 'h' end as s from x),
a as (select family, count(*) as n, count(*) filter (s = 'b') as bound, count(*) filter (s = 'm') as model, count(*) filter (s = 'h') as human, count(*) filter (s = 'd') as data_request, count(*) filter (s in ('b', 'm') and not correct) as wrong from y group by 1)
select *, round((bound + model - wrong) / n, 6)::double as useful_coverage, case when bound + model > 0 then round(wrong / (bound + model), 6) end::double as closure_error from a""")
def closed_system(spark, d):
    k = F.col("id")
    rows = two_stages(spark, d)[0].withColumn("bound", k % 6 == 0).withColumn("missing", k % 10 == 7).withColumn("family", k % 3)
    return deciding.closed_system(rows, 0.6, "family")


@query("system_threshold", f"""with {CASCADE}, m as (select conf, count(*) filter (correct) as k, count(*) as n from o1 where id % 6 <> 0 group by 1), b as (select count(*) as bn, count(*) filter (correct) as bk from o1 where id % 6 = 0),
s as (select conf, sum(k) over w as kk, sum(n) over w as nn from m window w as (order by conf desc rows unbounded preceding))
select min(conf) as tau, max(nn + bn)::bigint as closed from s, b where (kk + bk) >= 0.7 * (nn + bn)""")
def system_threshold(spark, d):
    rows = two_stages(spark, d)[0]
    bound = rows.where("id % 6 = 0").agg(F.count("*").alias("bn"), F.count_if("correct").alias("bk"))
    s = deciding.steps(rows.where("id % 6 <> 0")).crossJoin(F.broadcast(bound))
    return s.where("kk + bk >= 0.7 * (nn + bn)").agg(F.min("conf").alias("tau"), F.max(F.col("nn") + F.col("bn")).alias("closed"))


LABELS = """lab as (select event_id // 8 as id, (event_id // 4) % 2 as perm, 'o' || (event_id % 4) as option, event_id % 4 as position, ln((k + 1) / 101) as logp from ev)"""


def labels_of(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    i = F.col("event_id")
    return e.select(F.floor(i / 8).alias("id"), (F.floor(i / 4) % 2).alias("perm"), F.concat(F.lit("o"), (i % 4).cast("string")).alias("option"), (i % 4).alias("position"), F.log((F.col("k") + 1) / 101).alias("logp"))


@query("permutation_averaged", f"""with {DECISIONS}, {LABELS}, p as (select id, perm, option, exp(logp) / sum(exp(logp)) over (partition by id, perm) as p from lab), a as (select id, option, avg(p) as s from p group by all),
r as (select *, row_number() over (partition by id order by round(s, 9) desc, option) as rn from a) select id, option as pred, round(s, 4)::double as conf from r where rn = 1""")
def permutation_averaged(spark, d):
    return deciding.decided(deciding.option_scores(labels_of(spark, d)))


@query("label_position_bias", f"with {DECISIONS}, {LABELS} select position, round(avg(logp), 6)::double as bias, count(*) as n from lab group by 1")
def label_position_bias(spark, d):
    return deciding.position_bias(labels_of(spark, d))


TEMPERATURE = """losses{n} as (select t, avg(ln(z) - g) as nll from (select t, id, max(case when option = gold then logp / t end) as g, sum(exp(logp / t)) as z from gold, grid{n} group by all) where g is not null group by 1),
best{n} as (select arg_min(t, nll) as t, min(nll) as nll from losses{n})"""


@query("temperature_fit", f"""with {DECISIONS}, {LABELS}, a as (select id, option, avg(logp) as logp from lab group by id, option),
gold as (select *, case when id % 5 < 3 then first_value(option) over (partition by id order by round(logp, 9) desc, option) else 'o' || (id % 4) end as gold from a),
grid1 as (select 0.05 * 400 ** (i / 300) as t from range(301) r(i)), {TEMPERATURE.format(n=1)},
grid2 as (select t * 400 ** ((i - 150) / 45000) as t from best1, range(301) r(i)), {TEMPERATURE.format(n=2)} select round(t, 1)::double as temperature, round(nll, 6)::double as nll from best2""")
def temperature_fit(spark, d):
    rows = labels_of(spark, d).groupBy("id", "option").agg(F.avg("logp").alias("logp"))
    first = F.first("option").over(Window.partitionBy("id").orderBy(F.desc(F.round("logp", 9)), "option"))
    rows = rows.withColumn("gold", F.when(F.col("id") % 5 < 3, first).otherwise(F.concat(F.lit("o"), (F.col("id") % 4).cast("string"))))
    return deciding.fit_temperature(rows).select(F.round("temperature", 1).alias("temperature"), F.round("nll", 6).alias("nll"))


@query("calibration_arm", f"""with {DECISIONS}, b as (select arm, least(floor(conf * 10), 9) as bin, count(*) as n, sum(conf) as c, sum(correct::int) as y from decisions group by all), e as (select arm, -round(sum(abs(c - y)) / sum(n), 6)::double as ece from b group by 1),
c as (select arm, conf, count(*) filter (correct) as k, count(*) as n from decisions group by all), s as (select *, sum(k) over w as kk, sum(n) over w as nn, sum(n) over (partition by arm) as total from c window w as (partition by arm order by conf desc rows unbounded preceding)),
v as (select arm, round(coalesce(max(case when kk / nn >= 0.9 then nn / total end), 0), 6)::double as c90 from s group by 1)
select arm, c90, ece from v join e using (arm) order by c90 desc, ece desc limit 1""")
def calibration_arm(spark, d):
    rows = decisions(spark, d)
    c90 = deciding.coverage_at_precision(rows, 0.9, "arm").withColumnRenamed("coverage", "c90")
    ece = deciding.calibration_error(rows, 10, "arm").select("arm", (-F.col("ece")).alias("ece"))
    return deciding.best_arm(c90.join(ece, "arm"), "c90", "ece")


@query("group_balance", f"""with {DECISIONS}, g as (select arm, grp, bool_or(conf >= 0.5) as s, bool_and(conf >= 0.5) as e, bool_and(conf >= 0.5 and correct) as c, bool_or(conf >= 0.5 and not correct) as x from decisions group by all)
select arm, count(*) as "groups", (count(*) filter (s))::bigint as "some", (count(*) filter (e))::bigint as "every", (count(*) filter (c))::bigint as clean, (count(*) filter (x))::bigint as error from g group by 1""")
def group_balance(spark, d):
    return deciding.group_balance(decisions(spark, d), "grp", 0.5, "arm")


@query("cross_fit", f"""with {DECISIONS}, h as (select *, ('0x' || right(sha256(id::varchar), 1))::int % 2 as half from decisions), c as (select half, conf, count(*) filter (correct) as k, count(*) as n from h group by all),
s as (select *, sum(k) over w as kk, sum(n) over w as nn from c window w as (partition by half order by conf desc rows unbounded preceding)), t as (select half, min(conf) as tau from s where 1 - kk / nn <= 0.25 group by 1)
select h.half, count(*) as n, (count(*) filter (conf >= tau))::bigint as accepted, (count(*) filter (conf >= tau and correct))::bigint as "right" from h join t on h.half <> t.half group by 1""")
def cross_fit(spark, d):
    half = F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 64, 1), 16, 10).cast("int") % 2
    rows = decisions(spark, d).withColumn("half", half)
    tau = deciding.empirical_threshold(rows, 0.25, "half").select((1 - F.col("half")).alias("half"), "tau")
    inside = F.col("conf") >= F.col("tau")
    return rows.join(F.broadcast(tau), "half").groupBy("half").agg(F.count("*").alias("n"), F.count_if(inside).alias("accepted"), F.count_if(inside & F.col("correct")).alias("right"))


TWO = """r1 as (select event_id // 2 as id, event_type as label, ln((k + 1) / 101) as logp, user_id % 7 as layer, k % 3 <> 0 as correct from ev where event_id % 2 = 0),
r2 as (select event_id // 2 as id, event_type as label, ln((k + 1) / 101) as logp, user_id % 7 as layer, k % 3 <> 0 as correct from ev where event_id % 2 = 1)"""


def two_runs(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    make = lambda r: e.where(F.col("event_id") % 2 == r).select(F.floor(F.col("event_id") / 2).alias("id"), F.col("event_type").alias("label"), F.log((F.col("k") + 1) / 101).alias("logp"), (F.col("user_id") % 7).alias("layer"), (F.col("k") % 3 != 0).alias("correct"))
    return make(0), make(1)


@query("run_agreement", f"""with {DECISIONS}, {TWO} select count(*) as n, (count(*) filter (r1.label = r2.label))::bigint as same_label, (count(*) filter (r1.label = r2.label and r1.logp = r2.logp))::bigint as identical,
round(max(abs(r1.logp - r2.logp)), 6)::double as max_change, round(avg(abs(r1.logp - r2.logp)), 6)::double as mean_change from r1 join r2 using (id)""")
def run_agreement(spark, d):
    return paired.run_agreement(*two_runs(spark, d), "id")


@query("mode_flips", f"with {DECISIONS}, {TWO} select r1.layer, count(*) as n, (count(*) filter (r1.label <> r2.label))::bigint as labels, (count(*) filter (r1.correct <> r2.correct))::bigint as correctness from r1 join r2 using (id) group by 1")
def mode_flips(spark, d):
    return deciding.mode_flips(*two_runs(spark, d), "layer")


@query("determinism", "with r as (select user_id as item, sha256(event_type) as sha from events), e as (select item, count(*) as runs, count(distinct sha) as outputs from r group by 1 having count(*) >= 2) select count(*) as items, (count(*) filter (outputs > 1))::bigint as unstable, count(*) filter (outputs > 1) = 0 as deterministic from e")
def determinism(spark, d):
    return paired.distinct_outputs(table(spark, d, "events").select(F.col("user_id").alias("item"), F.sha2("event_type", 256).alias("sha")), "item", "sha")


@query("majority_output", """with e as (select user_id as item, event_type as sha, count(*) as n, min(event_id) as first from events group by all), r as (select *, count(*) over (partition by item) > 1 as unstable, row_number() over (partition by item order by n desc, first) as rn from e)
select item, sha, n, unstable from r where rn = 1""")
def majority_output(spark, d):
    return paired.majority_output(table(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("sha"), "event_id"), "item", "sha", "event_id")


@query("instrument_noise", "with e as (select user_id % 40 as item, user_id, count(distinct event_type) as t, count(distinct value > 99) as p from events group by all) select count(*) as items, (count(*) filter (t > 1))::bigint as text_varies, (count(*) filter (p > 1))::bigint as pass_varies from e")
def instrument_noise(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("text"), (F.col("value") > 99).alias("pass"))
    return paired.noise(e, "user_id", "text", "pass")


@query("prefix_reuse", "with e as (select user_id, sha256(string_agg(event_type, ',' order by event_id)) as sha from events group by 1), f as (select user_id % 20 as item, count(distinct sha) as n from e group by 1) select item, n, n = 1 as same from f")
def prefix_reuse(spark, d):
    order = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    e = table(spark, d, "events").groupBy("user_id").agg(F.sha2(F.array_join(F.transform(order, lambda x: x["event_type"]), ","), 256).alias("sha"))
    return e.groupBy((F.col("user_id") % 20).alias("item")).agg(F.countDistinct("sha").alias("n")).withColumn("same", F.col("n") == 1)


@query("first_divergence", """with a as (select user_id as item, event_id // 150 as pos, min(event_type) as t from events where event_id % 2 = 0 group by all), b as (select user_id as item, event_id // 150 as pos, min(event_type) as t from events where event_id % 2 = 1 group by all),
j as (select coalesce(a.item, b.item) as item, coalesce(a.pos, b.pos) as pos, a.t as ta, b.t as tb from a full join b on a.item = b.item and a.pos = b.pos) select item, min(pos) filter (ta is distinct from tb) as first_pos from j group by 1""")
def first_divergence(spark, d):
    e = table(spark, d, "events")
    side = lambda r: e.where(F.col("event_id") % 2 == r).groupBy(F.col("user_id").alias("item"), F.floor(F.col("event_id") / 150).alias("pos")).agg(F.min("event_type").alias("token"))
    return paired.first_divergence(side(0), side(1), "item")


@query("within_unit_wins", """with e as (select user_id as unit, case when event_type in ('click', 'view') then 'a' else 'b' end as g, value as s from events), p as (select x.unit, avg(case when x.s > y.s then 1 when x.s = y.s then 0.5 else 0 end) as share, count(*) as n from e x join e y on x.unit = y.unit and x.g = 'a' and y.g = 'b' group by 1),
c as (select unit, count(*) filter (g = 'a') as na, count(*) filter (g = 'b') as nb from e group by 1) select unit, na, nb, round(share, 6)::double as share from p join c using (unit)""")
def within_unit_wins(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("unit"), F.when(F.col("event_type").isin("click", "view"), "a").otherwise("b").alias("g"), F.col("value").alias("s"))
    return paired.within_unit_wins(e, "unit", "g", "s")


DIFFS = "df as (select o_orderpriority as arm, (o_orderkey * 7 % 13 - 6 + (o_orderkey % 5 = 0)::int)::double as d from orders)"


def diffs(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("arm"), F.col("o_custkey").alias("unit"), (k * 7 % 13 - 6 + (k % 5 == 0).cast("int")).cast("double").alias("d"))


@query("wilcoxon_sums", f"""with {DIFFS}, c as (select arm, abs(d) as a, count(*) as n, count(*) filter (d > 0) as p from df where d <> 0 group by all), r as (select *, coalesce(sum(n) over (partition by arm order by a rows between unbounded preceding and 1 preceding), 0) + (n + 1) / 2 as rank from c)
select arm, sum(n)::bigint as n, sum(p * rank)::double as w_plus, sum((n - p) * rank)::double as w_minus from r group by 1""")
def wilcoxon_sums(spark, d):
    return paired.wilcoxon(diffs(spark, d), "arm")


@query("sign_counts", f"with {DIFFS} select arm, (count(*) filter (d > 0))::bigint as pos, (count(*) filter (d < 0))::bigint as neg, (count(*) filter (d = 0))::bigint as zero from df group by 1")
def sign_counts(spark, d):
    return paired.sign_test(diffs(spark, d), "arm").drop("p")


#: Replicas of every bootstrap, and in SQL the weight that replica r draws for a unit: 16 bits of an md5, eight replicas to a digest.
REPS = 2000
BITS = "('0x' || substr(md5({key} || ':' || (r // 8)), 1 + 4 * (r % 8), 4))::int"
REPLICAS = f"replicas as (select unnest(range(0, {REPS})) as r)"


def weight_sql(key: str) -> str:
    return "(" + " + ".join(f"({BITS.format(key=key)} / 65536.0::double >= {c!r}::double)::int" for c in paired.POISSON) + ")"


def summary_sql(by: str = "") -> str:
    q = lambda p: f"round(quantile_cont(value, {p}), 6)::double"
    return f"{by}{q(0.5)} as median, {q(0.025)} as low, {q(0.975)} as high, round(stddev_samp(value), 6)::double as sd, round(least(1, 2 * least(avg((value <= 0)::int), avg((value >= 0)::int))), 6)::double as p"


@query("sign_flip_test", f"""with df as (select o_orderpriority as arm, o_custkey as unit, (o_orderkey * 7 % 13 - 6 + (o_orderkey % 5 = 0)::int) as d from orders), u as (select arm, unit, sum(d) as d from df group by all), {REPLICAS},
f as (select arm, r, sum(case when {BITS.format(key="'7:' || unit")} < 32768 then d else -d end) as s from u, replicas group by all), o as (select arm, abs(sum(d)) as observed from u group by 1)
select arm, observed::double as observed, round(((count(*) filter (abs(s) >= observed)) + 1) / (count(*) + 1), 6)::double as p from f join o using (arm) group by all""")
def sign_flip_test(spark, d):
    return paired.sign_flip(diffs(spark, d), "arm", reps=REPS)


def _bootstrap_pairs(spark, d):
    from lodestat.plans.score_queries import item_pass, run_fields

    grp = run_fields(spark, d).select("doc", "grp").distinct()
    items = item_pass(spark, d)
    return paired.paired(items.where("run = 1"), items.where("run = 2"), "doc").join(grp, "doc")


PAIRS = f"""{RUN_FIELDS}, {ITEMS}, grps as (select distinct doc, grp from run_fields),
pairs as (select g.grp, x.passed::int as a, y.passed::int as b from items x join items y on x.doc = y.doc and x.run = 1 and y.run = 2 join grps g on g.doc = x.doc),
sums as (select grp as cluster, sum(b - a) as num, count(*) as den from pairs group by 1), {REPLICAS},
reps as (select r, sum(num * w) / nullif(sum(den * w), 0) as value from (select r, num, den, {weight_sql("'7:' || cluster")} as w from sums, replicas) group by 1)"""


@query("cluster_bootstrap", f"""with {PAIRS}, s as (select {summary_sql()} from reps), p as (select round(avg(b - a), 6)::double as point from pairs)
select *, case when low > 0 then 'improves' when high < 0 then 'worsens' when point > 0 then 'weakly improves' else 'undecided' end as verdict from s, p""")
def cluster_bootstrap(spark, d):
    return paired.bootstrap_difference(_bootstrap_pairs(spark, d), "grp", REPS)


@query("rethresholded_bootstrap", f"""with {DECISIONS}, {REPLICAS}, c as (select arm, conf, grp, count(*) filter (correct) as k, count(*) as n from decisions group by all),
w as (select grp, r, {weight_sql("'7:' || grp")} as w from (select distinct grp from c), replicas),
x as (select arm, r, conf, sum(k * w) as k, sum(n * w) as n from c join w using (grp) group by all),
s as (select *, sum(k) over v as kk, sum(n) over v as nn from x window v as (partition by arm, r order by conf desc rows unbounded preceding)),
t as (select arm, r, min(conf) filter (nn > 0 and 1 - kk / nn <= 0.2) as tau, coalesce(max(nn) filter (nn > 0 and 1 - kk / nn <= 0.2), 0) / sum(n) as value from s group by all)
select {summary_sql("arm, ")}, round(avg((tau is null)::int), 6)::double as no_cut, round(quantile_cont(tau, 0.5), 6)::double as tau from t group by arm""")
def rethresholded_bootstrap(spark, d):
    each = paired.rethresholded(decisions(spark, d), "grp", 0.2, "arm", reps=REPS)
    cuts = each.groupBy("arm").agg(F.round(F.avg(F.col("tau").isNull().cast("double")), 6).alias("no_cut"), F.round(F.percentile("tau", F.lit(0.5)), 6).alias("tau"))
    return paired.summary(each, "arm").join(cuts, "arm")


@query("hierarchical_bootstrap", f"""with {DECISIONS}, {REPLICAS}, c as (select layer, grp, count(*) filter (correct) as num, count(*) as den from decisions group by all),
reps as (select r, sum(num * w) / nullif(sum(den * w), 0) as value from (select r, num, den, {weight_sql("'7:' || layer")} * {weight_sql("'8:' || layer || ':' || grp")} as w from c, replicas) group by 1) select {summary_sql()} from reps""")
def hierarchical_bootstrap(spark, d):
    rows = decisions(spark, d).select(F.col("layer").alias("family"), F.col("grp").alias("case"), F.col("correct").cast("int").alias("num"), F.lit(1).alias("den"))
    return paired.hierarchical_bootstrap(rows, REPS)


@query("answer_bootstrap", f"""with {DECISIONS}, {REPLICAS}, reps as (select arm, r, sum(num * w) / nullif(sum(w), 0) as value from (select arm, r, correct::int as num, {weight_sql("'11:' || id")} as w from decisions, replicas) group by all) select {summary_sql("arm, ")} from reps group by arm""")
def answer_bootstrap(spark, d):
    rows = decisions(spark, d).select("arm", F.col("id").alias("cluster"), F.col("correct").cast("int").alias("num"), F.lit(1).alias("den"))
    return paired.summary(paired.cluster_bootstrap(rows, REPS, 11, "arm"), "arm")


@query("detectable_effect", f"""with {PAIRS}, z as (select unnest([100, 500, 1000, 5000])::int as size), whole as (select count(*) as clusters, sum(num) / sum(den) as point from sums)
select size, round(2.80 * stddev_samp(value) * sqrt(max(clusters) / size), 6)::double as detectable, round(avg((point + (value - point) * sqrt(clusters / size) > 1e-12)::int), 6)::double as share from reps, z, whole group by size""")
def detectable_effect(spark, d):
    p = _bootstrap_pairs(spark, d)
    sums = p.groupBy(F.col("grp").alias("cluster")).agg(F.sum(F.col("b").cast("int") - F.col("a").cast("int")).alias("num"), F.count("*").alias("den"))
    return paired.power_table(sums, [100, 500, 1000, 5000], REPS)
