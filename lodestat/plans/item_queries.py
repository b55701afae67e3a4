"""Queries over bounds, decoding, items, text models and run comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestat.operators import bounds, decoding, deciding, items, models, paired, scoring, texts
from lodestat.plans.curation_queries import LAB, docs, labelled
from lodestat.plans.decision_queries import REPLICAS, REPS, STEPS, TWO, two_runs, weight_sql
from lodestat.plans.inputs import DECISIONS, RUN_FIELDS, decisions, run_fields, table
from lodestat.plans.registry import query
from lodestat.plans.score_queries import ITEMS, item_pass
from lodestat.plans.text_queries import LINES, doc_lines


@query("exact_bounds")
def exact_bounds(spark, d):
    cells = labelled(spark, d).groupBy("lang").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count("*").alias("n"))
    return bounds.with_exact_bounds(cells)


@query("kmin_table")
def kmin_table(spark, d):
    rows = decisions(spark, d)
    most = rows.groupBy("arm", "layer").count().agg(F.max("count")).first()[0]
    return deciding.choose_threshold(rows, bounds.kmin_table(spark, int(most), 0.75), "arm", "layer")


@query("poisson_rate")
def poisson_rate(spark, d):
    cells = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 99).alias("k"), F.count("*").alias("n"))
    return bounds.rate_per_million(cells)


@query("residual_noise")
def residual_noise(spark, d):
    cells = labelled(spark, d).groupBy("lang").agg(F.count("*").alias("pool"), F.count_if(F.col("doc_id") % 3 == 0).alias("reviewed"), F.count_if((F.col("doc_id") % 3 == 0) & (F.col("toxic") == 1)).alias("wrong"))
    return bounds.residual_noise(cells)


CAND = """cand as (select event_id // 40 as answer, (event_id // 8) % 5 as pos, event_type || (event_id % 3) as token, min(value) as logit from events group by all), gen as (select distinct answer, pos, token from (select *, row_number() over (partition by answer, pos order by logit, token) as rn from cand) where rn = 1),
seen as (select c.*, coalesce(f.first < c.pos, false) as seen from cand c left join (select answer, token, min(pos) as first from gen group by all) f using (answer, token)),
soft as (select *, exp((logit - case when seen then 1.5 else 0 end) / 20) / sum(exp((logit - case when seen then 1.5 else 0 end) / 20)) over (partition by answer, pos) as p from seen),
nuc as (select *, p / sum(p) over (partition by answer, pos) as q from (select *, coalesce(sum(p) over (partition by answer, pos order by p desc, token rows between unbounded preceding and 1 preceding), 0) as before from soft) where before < 0.8)"""


def candidates(spark, d):
    i = F.col("event_id")
    cand = table(spark, d, "events").groupBy(F.floor(i / 40).alias("answer"), (F.floor(i / 8) % 5).alias("pos"), F.concat("event_type", (i % 3).cast("string")).alias("token")).agg(F.min("value").alias("logit"))
    w = Window.partitionBy("answer", "pos").orderBy("logit", "token")
    gen = cand.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("answer", "pos", "token")
    return decoding.penalised(decoding.seen_before(cand, gen), 1.5, 20.0)


@query("seen_token_penalty", f"with {CAND} select seen, count(*) as n from soft group by 1")
def seen_token_penalty(spark, d):
    return candidates(spark, d).groupBy("seen").agg(F.count("*").alias("n"))


@query("nucleus_cut", f"with {CAND} select answer, pos, count(*) as kept, round(max(q), 4)::double as top from nuc group by all")
def nucleus_cut(spark, d):
    return decoding.nucleus(candidates(spark, d), 0.8).groupBy("answer", "pos").agg(F.count("*").alias("kept"), F.round(F.max("q"), 4).alias("top"))


@query("rare_token_rate", f"with {CAND}, m as (select pos % 2 as segment, answer, pos, sum(case when starts_with(token, 'error') then q else 0 end) as m from nuc group by all) select segment, count(*) as places, round(sum(m) * 1e6 / count(*), 2)::double as per_million from m group by 1")
def rare_token_rate(spark, d):
    nuc = decoding.nucleus(candidates(spark, d), 0.8).withColumn("segment", F.col("pos") % 2)
    return decoding.rare_rate(nuc, F.col("token").startswith("error"), "segment").withColumn("per_million", F.round("per_million", 2))


@query("prediction_gold_join", """select l_orderkey % 10 as cell, count(*) as n, (count(*) filter (l_linestatus = o_orderstatus))::bigint as correct, count(distinct l_orderkey) as items from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus <> 'P' group by 1""")
def prediction_gold_join(spark, d):
    gold = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    both = table(spark, d, "lineitem").join(gold, "l_orderkey")
    return both.groupBy((F.col("l_orderkey") % 10).alias("cell")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == F.col("o_orderstatus")).alias("correct"), F.countDistinct("l_orderkey").alias("items"))


@query("readout_validation", """with p as (select vec_id, [x / list_sum([abs(y) for y in embedding[1:4]]) for x in [abs(z) for z in embedding[1:4]]] as p from embeddings) select vec_id, case when vec_id % 9 = 0 then 'sum' when vec_id % 7 = 0 then 'mass' end as fault from p""")
def readout_validation(spark, d):
    e = table(spark, d, "embeddings")
    four = F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x).cast("double"))
    total = F.aggregate(four, F.lit(0.0), lambda a, x: a + x)
    scale = F.when(F.col("vec_id") % 9 == 0, 0.5).otherwise(1.0)
    rows = e.select("vec_id", F.transform(four, lambda x: x / total * scale).alias("probs"), F.when(F.col("vec_id") % 7 == 0, 0.0).otherwise(0.9).alias("mass"))
    return items.readout_faults(rows).select("vec_id", "fault")


@query("gold_drop", f"""with {LAB}, x as (select doc_id as id, lang, case when not flag then 'g' end as gold from lab), t as (select lang, count(*) as n, count(*) filter (gold is null) as none from x group by 1), r as (select x.*, n, none, row_number() over (partition by x.lang, gold is null order by sha256('z:' || id), id) as rn from x join t using (lang))
select id, gold is not null and rn <= floor(n * 0.25) - none as dropped from r""")
def gold_drop(spark, d):
    rows = labelled(spark, d).select(F.col("doc_id").alias("id"), "lang", F.when(F.col("toxic") != 1, "g").alias("gold"))
    return items.gold_dropped(rows, 0.25, "z", "lang").select("id", "dropped")


@query("option_padding", """with o as (select l_orderkey as id, list_distinct(list(p_brand)) as options from lineitem join part on p_partkey = l_partkey group by 1) select id, greatest(len(options), least(4 + id % 3, 25))::int as n from o""")
def option_padding(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("p_brand").alias("options"))
    pool = table(spark, d, "part").agg(F.array_sort(F.collect_set("p_brand")).alias("pool"))  # the brands: a fixed list
    return items.padded_options(rows, pool, (4 + F.col("id") % 3).cast("int"), "o").select("id", F.size("options").alias("n"))


@query("next_line_items", f"""with {LINES}, h as (select doc_id, list({{'pos': pos, 'line': line}} order by pos) as every from lines group by 1),
g as (select doc_id, pos, line, lead(line) over (partition by doc_id order by pos) as gold from lines qualify gold is not null)
select doc_id, pos, line, gold, coalesce(array_to_string(list_transform(list_filter(every, lambda x: abs(x.pos - pos) > 2)[1:3], lambda x: x.line), ' / '), '') as distractors from g join h using (doc_id)""")
def next_line_items(spark, d):
    return items.next_line_items(doc_lines(spark, d), "doc_id").withColumn("distractors", F.array_join("distractors", " / "))


@query("common_item_schema", """with l as (select conv_id, max(turn) as at_ from conversations where role = 'user' group by 1) select conv_id, arg_max(text, turn) as request, string_agg(role, ',' order by turn, role) as roles, count(*) as turns from conversations join l using (conv_id) where turn <= at_ group by 1""")
def common_item_schema(spark, d):
    return items.common_items(table(spark, d, "conversations"))


@query("fact_check", """with t as (select p_partkey as id, p_name || ' costs ' || p_size || ' at ' || (p_size % 7) || '.' as text, case when p_partkey % 3 = 0 then '999' else p_size::varchar end as value, (p_size % 5)::varchar as forbidden from part)
select id, case when value = '999' then 'value missing' when forbidden = (text.split(' costs ')[2]).split(' ')[1] or forbidden = (id * 0 + (value::int % 7))::varchar then 'forbidden reading' end as reason from t""".replace("text.split(' costs ')[2]", "string_split(text, ' costs ')[2]").replace("(string_split(text, ' costs ')[2]).split(' ')[1]", "string_split(string_split(text, ' costs ')[2], ' ')[1]"))
def fact_check(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("", "p_name", F.lit(" costs "), F.col("p_size").cast("string"), F.lit(" at "), (F.col("p_size") % 7).cast("string"), F.lit(".")).alias("text"), F.col("p_size"))
    plans = p.select("id", F.when(F.col("id") % 3 == 0, "999").otherwise(F.col("p_size").cast("string")).alias("value"), (F.col("p_size") % 5).cast("string").alias("forbidden"))
    return items.fact_check(plans, p.select("id", "text"))


@query("number_mentions")
def number_mentions(spark, d):
    return items.number_mentions(docs(spark, d), "doc_id")


@query("sentence_rows", r"""with s as (select doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as s from documents), u as (select doc_id, list_filter([trim(x, E' \t\n\r') for x in s], lambda x: x <> '') as s from s)
select doc_id, unnest(range(0, len(s)))::int as pos, unnest(s) as sentence from u""")
def sentence_rows(spark, d):
    return items.sentence_rows(docs(spark, d), "doc_id")


@query("stanza_rows", r"""with s as (select doc_id, list_filter(string_split_regex(text, '\n[ \t]*\n'), lambda x: trim(x, ' \t\n\r') <> '') as s from documents), u as (select doc_id, unnest(range(0, len(s)))::int as pos, unnest(s) as p from s), l as (select *, list_filter(string_split(p, chr(10)), lambda x: trim(x) <> '') as l from u)
select doc_id, pos, len(l)::int as lines, l[1] as first from l""")
def stanza_rows(spark, d):
    return items.stanza_rows(docs(spark, d), "doc_id")


@query("scheme_distribution")
def scheme_distribution(spark, d):
    lines = docs(spark, d).select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    parts = lines.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("lines") / 4)), lambda i: F.slice("lines", (i * 4 + 1).cast("int"), 4))).alias("lines")).where(F.size("lines") == 4)
    return items.schemes(parts, "doc_id").groupBy("scheme").agg(F.count("*").alias("n"))


@query("related_names", """with p as (select p_brand, p_name as a, lead(p_name) over (partition by p_brand order by p_partkey) as b from part) select a, b, case when contains(lower(a), lower(b)) or contains(lower(b), lower(a)) then 'contained' when list_has_any([substr(w, 1, 4) for w in string_split(lower(a), ' ')], [substr(w, 1, 4) for w in string_split(lower(b), ' ')]) then 'stem'
 when levenshtein(lower(a), lower(b)) <= 2 then 'close' end as relation, count(*) as n from p where b is not null group by all""")
def related_names(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    pairs = table(spark, d, "part").select(F.col("p_name").alias("a"), F.lead("p_name").over(w).alias("b")).where("b is not null")
    return items.related_names(pairs.groupBy("a", "b").agg(F.count("*").alias("n")))


@query("block_building")
def block_building(spark, d):
    sizes = docs(spark, d).select("doc_id", F.transform(F.split("text", "\n"), lambda x: (F.length(x) % 5 + 1).cast("int")).alias("sizes"))
    return items.blocks_of(sizes, "doc_id").select("doc_id", F.size("blocks").alias("n"))


Z = 1.6448536269514722


@query("grouped_statistic", f"""with {DECISIONS}, {STEPS}, t as (select arm, layer, sum(k) as y from c group by all),
v as (select *, kk / nn as p, nn >= 30 and (kk / nn + {Z} ** 2 / (2 * nn) - {Z} * sqrt(kk / nn * (1 - kk / nn) / nn + {Z} ** 2 / (4 * nn * nn))) / (1 + {Z} ** 2 / nn) >= 0.75 as ok from s join t using (arm, layer)),
g as (select arm, layer, max(total) as n, max(y) as y, min(conf) filter (ok) as tau, arg_min(nn, conf) filter (ok) as tn, arg_min(kk, conf) filter (ok) as tk, sum(n * (1 - p)) as area from v group by all),
w as (select arm, layer, avg(case when x.conf > z.conf then 1 when x.conf = z.conf then 0.5 else 0 end) as auroc from decisions x join decisions z using (arm, layer) where x.correct and not z.correct group by all),
b as (select *, y / n as a, case when n = y then 0 else (select sum(j / (y + j)) from range(1, (n - y)::bigint + 1) r(j)) / n end as best, {Z} * sqrt(y / n * (1 - y / n) / n + {Z} ** 2 / (4 * n * n)) as half from g)
select arm, layer, n::bigint as rows, y::bigint as "right", round(a, 6)::double as accuracy, round((a + {Z} ** 2 / (2 * n) - half) / (1 + {Z} ** 2 / n), 6)::double as low, round((a + {Z} ** 2 / (2 * n) + half) / (1 + {Z} ** 2 / n), 6)::double as high,
tau, round(tn / n, 6)::double as coverage, round(tk / tn, 6)::double as precision, round(area / n, 6)::double as aurc, round(best, 6)::double as best, round(auroc, 6)::double as auroc from b left join w using (arm, layer)""")
def grouped_statistic(spark, d):
    """Threshold, AURC, AUROC and accuracy of every arm and layer from one curve."""
    return deciding.arm_statistics(decisions(spark, d), 0.75, 30, "arm", "layer")


@query("ordered_output", "select event_id, event_type from events order by event_id")
def ordered_output(spark, d):
    return table(spark, d, "events").select("event_id", "event_type").orderBy("event_id")


@query("platt_calibration")
def platt_calibration(spark, d):
    rows = decisions(spark, d).withColumn("logit", F.log(F.col("conf") / (1.0001 - F.col("conf"))))
    return models.platt(rows)


@query("style_classifier")
def style_classifier(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("id"), "text", (F.col("lang") == "en").cast("double").alias("label"))
    return models.style_scores(rows, F.expr("id % 5 <> 0"))


def _real_and_synthetic(spark, d):
    """Benchmark passages as the real texts, generated documents as the synthetic ones."""
    real = table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("key"), "text", F.lit(1.0).alias("label"))
    return real.unionAll(docs(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")), "text", F.lit(0.0)))


@query("real_vs_synthetic")
def real_vs_synthetic(spark, d):
    return models.separability(_real_and_synthetic(spark, d), "key")


@query("gram_kinds", r"""with t as (select 1.0::double as label, text from benchmark union all select 0.0, text from documents), g as (select label, unnest([substr(text, i, 3) for i in range(1, length(text) - 1)]) as g from t where length(text) >= 3),
k as (select label, case when regexp_matches(g, '[0-9]') then 'number' when regexp_matches(g, '\s') then 'word edge' when regexp_matches(g, '[^\p{L}]') then 'punctuation' else 'letters' end as kind, count(*) as n from g group by all), z as (select label, unnest(['number', 'word edge', 'punctuation', 'letters']) as kind from (select distinct label from t))
select z.label, z.kind, coalesce(n, 0)::bigint as n, round(coalesce(n, 0) / sum(n) over (partition by z.label), 6)::double as share from z left join k on k.label = z.label and k.kind = z.kind""")
def gram_kinds(spark, d):
    return models.gram_kinds(_real_and_synthetic(spark, d), "label")


@query("shortcut_audit")
def shortcut_audit(spark, d):
    rows = labelled(spark, d).select("source", F.col("toxic").cast("double").alias("label"), F.col("n_chars").cast("double").alias("n_chars"))
    return models.shortcut_audit(rows, ["n_chars"], "source")


@query("agreement_bound", f"""with {DECISIONS}, {TWO}, {REPLICAS}, x as (select r1.layer as cluster, (r1.label = r2.label)::int - (r1.correct = r2.correct)::int as d from r1 join r2 using (id)), s as (select cluster, sum(d) as num, count(*) as den from x group by 1),
v as (select r, sum(num * w) / nullif(sum(den * w), 0) as value from (select r, num, den, {weight_sql("'7:' || cluster")} as w from s, replicas) group by 1), b as (select round(quantile_cont(value, 0.05), 6)::double as bound from v)
select (select round(sum(num) / sum(den), 6)::double from s) as beyond, bound, bound > -0.02 as within from b""")
def agreement_bound(spark, d):
    return paired.agreement_bound(*two_runs(spark, d), "layer", margin=0.02, reps=REPS)


@query("effect_correlation", f"""with {DECISIONS}, x as (select grp, id // 2 % 2 as engine, avg(correct::int) filter (arm = 'tuned') - avg(correct::int) filter (arm = 'base') as effect from decisions group by all), p as (select a.effect as a, b.effect as b from x a join x b on a.grp = b.grp and a.engine = 0 and b.engine = 1 where a.effect is not null and b.effect is not null)
select count(*) as groups, round(corr(a, b), 6)::double as correlation from p""")
def effect_correlation(spark, d):
    rows = decisions(spark, d).withColumn("engine", F.floor(F.col("id") / 2) % 2)
    return paired.effect_correlation(rows, "grp")


@query("agreement_beyond_noise", f"with {DECISIONS}, {TWO} select round(avg((r1.label = r2.label)::int) - avg((r1.correct = r2.correct)::int), 6)::double as beyond from r1 join r2 using (id)")
def agreement_beyond_noise(spark, d):
    a, b = two_runs(spark, d)
    both = a.join(b.select("id", F.col("label").alias("l2"), F.col("correct").alias("c2")), "id")
    return both.agg(F.round(F.avg((F.col("label") == F.col("l2")).cast("double")) - F.avg((F.col("correct") == F.col("c2")).cast("double")), 6).alias("beyond"))


@query("category_decrease", f"""with {RUN_FIELDS}, c as (select doc, count(*) filter (run = 1 and outcome = 'mismatch') - count(*) filter (run = 2 and outcome = 'mismatch') as d from outcomes group by 1) select d, count(*) as items from c group by 1""")
def category_decrease(spark, d):
    bad = (F.col("outcome") == "mismatch")
    each = scoring.with_outcomes(run_fields(spark, d)).groupBy("doc").agg((F.count_if(bad & (F.col("run") == 1)) - F.count_if(bad & (F.col("run") == 2))).alias("d"))
    return each.groupBy("d").agg(F.count("*").alias("items"))


@query("augmentation_effect", f"""with {RUN_FIELDS}, {ITEMS}, p as (select x.doc, x.doc % 3 as variant, x.doc % 2 as lang, x.passed as a, y.passed as b from items x join items y on x.doc = y.doc and x.run = 1 and y.run = 2)
select variant, lang, count(*) as n, (count(*) filter (not a and b))::bigint as improved, (count(*) filter (a and not b))::bigint as worsened from p group by grouping sets ((), (variant), (lang))""")
def augmentation_effect(spark, d):
    it = item_pass(spark, d)
    p = paired.paired(it.where("run = 1"), it.where("run = 2"), "doc").withColumn("variant", F.col("doc") % 3).withColumn("lang", F.col("doc") % 2)
    a, b = F.col("a"), F.col("b")
    return p.groupingSets([[], ["variant"], ["lang"]], "variant", "lang").agg(F.count("*").alias("n"), F.count_if(~a & b).alias("improved"), F.count_if(a & ~b).alias("worsened"))


@query("control_reproduction", f"""with {RUN_FIELDS}, {ITEMS} select x.doc, x.passed as control, y.passed as again from items x join items y on x.doc = y.doc and x.run = 1 and y.run = 2 where x.passed <> y.passed""")
def control_reproduction(spark, d):
    it = item_pass(spark, d)
    return paired.paired(it.where("run = 1"), it.where("run = 2"), "doc").where("a <> b").select("doc", F.col("a").alias("control"), F.col("b").alias("again"))


@query("error_types", f"with {DECISIONS} select arm, case when correct then 'right' when conf >= 0.8 then 'sure and wrong' when conf >= 0.4 then 'wrong' else 'unsure' end as kind, count(*) as n from decisions group by all")
def error_types(spark, d):
    kind = F.when(F.col("correct"), "right").when(F.col("conf") >= 0.8, "sure and wrong").when(F.col("conf") >= 0.4, "wrong").otherwise("unsure")
    return decisions(spark, d).groupBy("arm", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("checker_comparison", f"with {DECISIONS} select arm, layer, count(*) as n, round(avg(correct::int), 6)::double as top1, round(avg((conf >= 0.6)::int), 6)::double as passing, round(quantile_cont(conf, 0.5), 6)::double as median from decisions group by grouping sets ((arm), (arm, layer))")
def checker_comparison(spark, d):
    rows = decisions(spark, d)
    return rows.groupingSets([["arm"], ["arm", "layer"]], "arm", "layer").agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("top1"), F.round(F.avg((F.col("conf") >= 0.6).cast("double")), 6).alias("passing"), F.round(F.percentile("conf", F.lit(0.5)), 6).alias("median"))


@query("band_contrast", """with o as (select lang, source, avg((toxic = 1)::int) as m from documents join labels using (doc_id) group by all), b as (select lang, avg(m) filter (source in ('src8', 'src9', 'src10', 'src11')) as mid, avg(m) filter (source not in ('src8', 'src9', 'src10', 'src11')) as ends from o group by 1) select lang, round(mid - ends, 6)::double as contrast from b""")
def band_contrast(spark, d):
    o = labelled(spark, d).groupBy("lang", "source").agg(F.avg((F.col("toxic") == 1).cast("double")).alias("m"))
    mid = F.col("source").isin("src8", "src9", "src10", "src11")
    return o.groupBy("lang").agg(F.round(F.avg(F.when(mid, F.col("m"))) - F.avg(F.when(~mid, F.col("m"))), 6).alias("contrast"))


@query("pattern_gate", "select source, round(avg(regexp_matches(text, '[0-9]')::int), 6)::double as digits, count(*) as n, quantile_cont(length(text), 0.5)::double as median_length from documents group by 1")
def pattern_gate(spark, d):
    return texts.pattern_rates(docs(spark, d), {"digits": "[0-9]"}, "source")


@query("minimal_pairs")
def minimal_pairs(spark, d):
    rows = docs(spark, d).select(F.floor(F.col("doc_id") / 2).alias("unit"), "doc_id", "text", F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("cue"))
    return items.minimal_pairs(rows, r"(?i)\b(the|de|der|la)\b").select("unit", "doc_id")


@query("indistinguishable_names", """with p as (select p_brand, p_name || ' ' || p_size as a, lead(p_name || ' ' || p_size) over (partition by p_brand order by p_partkey) as b from part), q as (select a, b, list_sort(regexp_extract_all(a, '[0-9]+')) as qa, list_sort(regexp_extract_all(b, '[0-9]+')) as qb,
list_distinct(regexp_extract_all(lower(a), '[\\p{L}]+')) as wa, list_distinct(regexp_extract_all(lower(b), '[\\p{L}]+')) as wb from p where b is not null)
select case when qa = qb and len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) >= 0.5 then 'indistinguishable' when qa <> qb and len(list_filter(wa, lambda x: not list_contains(wb, x))) + len(list_filter(wb, lambda x: not list_contains(wa, x))) = 0 then 'size variant' end as kind, count(*) as n from q group by 1""")
def indistinguishable_names(spark, d):
    name = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    pairs = table(spark, d, "part").select(name.alias("a"), F.lead(name).over(w).alias("b")).where("b is not null")
    return items.indistinguishable(pairs).groupBy("kind").agg(F.count("*").alias("n"))


@query("distinguishing_attributes", """with p as (select p_partkey, p_name, p_brand, p_type, lead(p_brand) over w as ob, lead(p_type) over w as ot from part window w as (order by p_partkey)), t as (select *, lower(p_name || ' ' || case when p_partkey % 2 = 0 then p_brand else ot end) as t from p where ob is not null)
select p_partkey, case when (p_brand <> ob and (contains(t, lower(p_brand)) or len(list_filter(regexp_extract_all(t, '[\\p{L}]{3,}'), lambda w: w[1] = lower(p_brand)[1] and regexp_matches(lower(p_brand), '^' || array_to_string(string_split(w, ''), '.*')))) > 0)) or (p_type <> ot and (contains(t, lower(p_type)) or len(list_filter(regexp_extract_all(t, '[\\p{L}]{3,}'), lambda w: w[1] = lower(p_type)[1] and regexp_matches(lower(p_type), '^' || array_to_string(string_split(w, ''), '.*')))) > 0)) then 'yes' when (p_brand <> ob and (contains(t, lower(ob)) or len(list_filter(regexp_extract_all(t, '[\\p{L}]{3,}'), lambda w: w[1] = lower(ob)[1] and regexp_matches(lower(ob), '^' || array_to_string(string_split(w, ''), '.*')))) > 0)) or (p_type <> ot and (contains(t, lower(ot)) or len(list_filter(regexp_extract_all(t, '[\\p{L}]{3,}'), lambda w: w[1] = lower(ot)[1] and regexp_matches(lower(ot), '^' || array_to_string(string_split(w, ''), '.*')))) > 0)) then 'contradicts' else 'no' end as verdict from t""")
def distinguishing_attributes(spark, d):
    p = table(spark, d, "part")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("ob"), F.col("p_type").alias("ot"))
    both = p.join(after, "p_partkey")
    text = F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("ot")))
    as_map = lambda b, t: F.create_map(F.lit("brand"), F.col(b), F.lit("type"), F.col(t))
    rows = both.select("p_partkey", text.alias("text"), as_map("p_brand", "p_type").alias("gold"), as_map("ob", "ot").alias("other"))
    return items.distinguishing(rows).select("p_partkey", "verdict")


@query("kind_rebalancing", """with x as (select doc_id as id, case when doc_id % 4 = 0 then 'a' when doc_id % 4 = 1 and toxic = 1 then 'b' end as kind, lang as family, doc_id % 3 = 2 as spare from documents join labels using (doc_id)), n as (select count(*) as n from x where not spare),
c as (select x.*, kind is not null and row_number() over (partition by kind order by sha256('k:' || id), id) > floor(n * 0.1) as gone from x, n where not spare), need as (select family, count(*) as need from c where gone group by 1),
f as (select x.id, kind, x.family, row_number() over (partition by x.family order by sha256('k:' || id), id) as rn, need from x join need using (family) where spare and kind is null)
select id, kind, family from c where not gone union all select id, kind, family from f where rn <= need""")
def kind_rebalancing(spark, d):
    k = F.col("doc_id")
    rows = labelled(spark, d).select(k.alias("id"), F.when(k % 4 == 0, "a").when((k % 4 == 1) & (F.col("toxic") == 1), "b").alias("kind"), F.col("lang").alias("family"), (k % 3 == 2).alias("spare"))
    return items.rebalanced(rows, "kind", "family", 0.1, "k")


@query("mode_groups", """with recursive l as (select event_id % 10 as run, event_id // 10 as id, cast(json_extract_string(props, '$.k') as int) > 10 * (event_id % 10 + 1) as label from events), p as (select a.run as a, b.run as b, avg((a.label <> b.label)::int) as f from l a join l b on a.id = b.id and a.run < b.run group by all),
n as (select a, b from p where f <= 0.31 union all select b, a from p where f <= 0.31), r as (select distinct run, run as m from l union select n.a, r.m from r join n on n.b = r.run) select run, min(m) as mode from r group by 1""")
def mode_groups(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select((i % 10).alias("run"), F.floor(i / 10).alias("id"), (F.get_json_object("props", "$.k").cast("int") > 10 * (i % 10 + 1)).alias("label"))
    return paired.mode_groups(rows, 0.31)


@query("section_items")
def section_items(spark, d):
    return items.section_items(doc_lines(spark, d), "doc_id", F.length("line") < 20, 4, "h")


@query("own_distractors", r"""with s as (select doc_id as id, lower(lang || source) as g, list_distinct(regexp_extract_all(text, '\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*')) as s from documents) select id, least(len(list_filter(s, lambda x: not (contains(lower(x), g) or contains(g, lower(x)) or substr(lower(x), 1, 4) = substr(g, 1, 4)))), 5)::int as n from s""")
def own_distractors(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("id"), "text", F.concat("lang", "source").alias("gold"))
    return items.own_distractors(rows, 5).select("id", F.size("options").alias("n"))
