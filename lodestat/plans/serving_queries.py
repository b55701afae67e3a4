"""Queries over retrieval, verification, serving logs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.operators import retrieval, serving, verifying
from lodestat.plans.curation_queries import TOK, bench, texts
from lodestat.plans.inputs import table
from lodestat.plans.registry import query
from lodestat.sources.scratch import removed_at_exit, scratch_path
from lodestat.streaming import jobs


@query("bm25_top_k", f"""with d as (select doc_id as id, {TOK} as w from documents), s as (select count(*) as n, avg(len(w)) as avg from d), t as (select id, len(w) as len, unnest(w) as term from d), f as (select id, len, term, count(*) as tf from t group by all),
g as (select term, count(*) as df from f group by 1), q as (select item_id as query, unnest(list_distinct({TOK})) as term from benchmark),
x as (select query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 4)::double as score from q join f using (term) join g using (term), s group by all)
select query, id, score, row_number() over (partition by query order by score desc, id)::int as rank from x qualify rank <= 8""")
def bm25_top_k(spark, d):
    return retrieval.bm25(texts(spark, d), bench(spark, d).withColumnRenamed("id", "query"))


@query("fielded_bm25", f"""with t as (select doc_id as id, unnest(['title', 'text']) as field, unnest([split_part(text, chr(10), 1), text]) as text from documents where lang <> 'de'), d as (select id, field, {TOK} as w from t), s as (select field, count(*) as n, avg(len(w)) as avg from d group by 1),
f as (select id, field, len, term, count(*) as tf from (select id, field, len(w) as len, unnest(w) as term from d) group by all), g as (select field, term, count(*) as df from f group by all), q as (select item_id as query, unnest(list_distinct({TOK})) as term from benchmark),
x as (select query, id, field, sum(case field when 'title' then 2 else 1 end * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))) as s from q join f using (term) join g using (field, term) join s using (field) group by all),
y as (select query, id, round(max(s), 4)::double as score from x group by all) select query, id, score, row_number() over (partition by query order by score desc, id)::int as rank from y qualify rank <= 5""")
def fielded_bm25(spark, d):
    """Titles (first lines) count twice, texts once; German documents are not in the index."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text", "lang")
    return retrieval.fielded_bm25(rows, bench(spark, d).withColumnRenamed("id", "query"), {"title": 2.0, "text": 1.0}, 5, active=F.col("lang") != "de")


UNIT = """u as (select vec_id as id, label, [x::double / sqrt(list_sum([y::double * y::double for y in embedding])) for x in embedding] as v from embeddings)"""


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label"))


@query("dense_top_k", f"""with {UNIT}, c as (select a.id as query, b.id, round(list_dot_product(a.v, b.v), 6)::double as cosine from u a join u b on a.id <> b.id and a.id % 50 = 0)
select query, id, cosine, row_number() over (partition by query order by cosine desc, id)::int as rank from c qualify rank <= 10""")
def dense_top_k(spark, d):
    v = vectors(spark, d)
    return retrieval.nearest(v, v.where("id % 50 = 0"), 10)


@query("nearest_other_family", f"""with {UNIT}, c as (select a.id as query, b.id, round(list_dot_product(a.v, b.v), 6)::double as cosine from u a join u b on a.label <> b.label and a.id % 50 = 0)
select query, id, cosine, row_number() over (partition by query order by cosine desc, id)::int as rank from c qualify rank <= 1""")
def nearest_other_family(spark, d):
    v = vectors(spark, d)
    return retrieval.nearest(v, v.where("id % 50 = 0"), 1, "label")


@query("nearest_counts", f"""with {UNIT}, c as (select a.id, max(round(list_dot_product(a.v, b.v), 6)) as m from u a join u b on a.id <> b.id and a.id % 50 = 0 group by 1) select count(*) as n, (count(*) filter (m >= 0.9))::bigint as over_90, (count(*) filter (m >= 0.5))::bigint as over_50, round(quantile_cont(m, 0.5), 4)::double as median from c""")
def nearest_counts(spark, d):
    best = nearest_one(spark, d)
    return best.agg(F.count("*").alias("n"), F.count_if(F.col("cosine") >= 0.9).alias("over_90"), F.count_if(F.col("cosine") >= 0.5).alias("over_50"), F.round(F.percentile("cosine", F.lit(0.5)), 4).alias("median"))


def nearest_one(spark, d):
    v = vectors(spark, d)
    return retrieval.nearest(v, v.where("id % 50 = 0"), 1)


@query("retrieval_margin", f"""with {UNIT}, c as (select a.id as query, b.id, round(list_dot_product(a.v, b.v), 6)::double as s from u a join u b on a.id <> b.id and a.id % 50 = 0), r as (select *, row_number() over (partition by query order by s desc, id) as rank from c)
select query, round((max(s) filter (rank = 1) - max(s) filter (rank = 2)) / max(s) filter (rank = 1), 4)::double as margin from r group by 1""")
def retrieval_margin(spark, d):
    return retrieval.margins(dense_top_k(spark, d).withColumnRenamed("cosine", "score"))


UNION_LEX = f"""with d as (select doc_id as id, {TOK} as w from documents join ok on ok.id = doc_id), s as (select count(*) as n, avg(len(w)) as avg from d), t as (select id, len(w) as len, unnest(w) as term from d), f as (select id, len, term, count(*) as tf from t group by all), g as (select term, count(*) as df from f group by 1),
q as (select item_id as query, unnest(list_distinct({TOK})) as term from benchmark join u on u.id = item_id), x as (select query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 4)::double as score from q join f using (term) join g using (term), s group by all)
select query, id, score from x qualify row_number() over (partition by query order by score desc, id) <= 6"""


@query("difficulty_bands", f"""with {UNIT}, c as (select a.id as query, b.id, a.label as own, b.label as family, round(list_dot_product(a.v, b.v), 6)::double as s from u a join u b on a.id <> b.id and a.id % 50 = 0), r as (select *, row_number() over (partition by query order by s desc, id) as rank from c qualify rank <= 10),
q as (select query // 50 % 3 as split, query, max(s) filter (rank = 1) as s1, max(s) filter (rank = 2) as s2, max((own = family)::int) filter (rank = 1) as top, sum((own = family)::int) as kin from r group by all)
select split, count(*) as queries, round(avg(top), 6)::double as gold_first, round(avg((kin - top > 0)::int), 6)::double as with_siblings, round(quantile_cont(round((s1 - s2) / s1, 4), 0.5), 6)::double as median_margin, round(quantile_cont(round((s1 - s2) / s1, 4), 0.5), 6) between 0.0 and 0.1 as in_band from q group by 1""")
def difficulty_bands(spark, d):
    family = vectors(spark, d).select("id", F.col("label").alias("family"))
    ranked = dense_top_k(spark, d).withColumnRenamed("cosine", "score").join(family, "id")
    own = family.select(F.col("id").alias("query"), F.col("family").alias("own"))
    rows = ranked.join(own, "query").withColumn("split", F.floor(F.col("query") / 50) % 3)
    return retrieval.difficulty_bands(rows, "split", 0.0, 0.1)


@query("candidate_union", f"""with {UNIT}, ok as (select id from u join documents on doc_id = id), lex as ({UNION_LEX}), dense as (select query, id, row_number() over (partition by query order by s desc, id) as rank from (select a.id as query, b.id, round(list_dot_product(a.v, b.v), 6) as s from u a join benchmark m on m.item_id = a.id join u b on b.id <> a.id join ok on ok.id = b.id)),
l as (select query, id, row_number() over (partition by query order by score desc, id) as rank from lex where query <> id), b as (select query, id, 0 as list, rank from l where rank <= 5 union all select query, id, 1, rank from dense where rank <= 5), f as (select query, id, min(list * 1000 + rank) as place_ from b group by all)
select query, id, (row_number() over (partition by query order by place_))::int as place from f""")
def candidate_union(spark, d):
    """Queries are the benchmark items that have a vector; both lists are of the ids with a text and a vector, without the query's own."""
    v, t, q = vectors(spark, d), texts(spark, d), bench(spark, d)
    both = v.select("id").join(t.select("id"), "id", "left_semi")
    asked = v.join(q.select("id"), "id", "left_semi")
    lexical = retrieval.bm25(t.join(both, "id", "left_semi"), q.join(asked.select("id"), "id", "left_semi").withColumnRenamed("id", "query"), 6).where("query <> id").drop("rank")
    dense = retrieval.nearest(v.join(both, "id", "left_semi"), asked, 5)
    return retrieval.candidate_union(retrieval.top_k(lexical, "query", "id", 5), dense)


@query("new_options", f"""with {UNIT}, c as (select a.id, max(round(list_dot_product(a.v, b.v), 6)) as m from u a join u b on a.id <> b.id and a.id % 50 = 0 group by 1) select id, m < 0.85 as new from c""")
def new_options(spark, d):
    return nearest_one(spark, d).select(F.col("query").alias("id"), (F.col("cosine") < 0.85).alias("new"))


@query("family_centroids", """with e as (select label, unnest(range(1, len(embedding) + 1)) as dim, unnest(embedding)::double as x from embeddings), m as (select label, dim, avg(x) as x from e group by all), n as (select label, sqrt(sum(x * x)) as n from m group by 1), u as (select m.label, dim, x / n as x from m join n using (label)),
c as (select p.label as a, q.label as b, round(sum(p.x * q.x), 6)::double as cosine from u p join u q using (dim) where p.label <> q.label group by all) select a, b, cosine, row_number() over (partition by a order by cosine desc, b)::int as rank from c qualify rank <= 3""")
def family_centroids(spark, d):
    return retrieval.family_centroids(vectors(spark, d), "label", 3)


WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


@query("duplicate_pairs", f"""with {UNIT}, i as (select p_partkey as id, p_name as name, p_brand as family, v from part join u on u.id = p_partkey), d as (select id, {WORDS.format('name')} as w from i), s as (select count(*) as n, avg(len(w)) as avg from d),
f as (select id, len, term, count(*) as tf from (select id, len(w) as len, unnest(w) as term from d) group by all), g as (select term, count(*) as df from f group by 1), q as (select id as query, unnest(list_distinct(w)) as term from d where id % 50 = 0),
x as (select query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 4) as s from q join f using (term) join g using (term), s group by all),
c as (select query, id from (select * from x qualify row_number() over (partition by query order by s desc, id) <= 12) union select query, id from (select a.id as query, b.id, round(list_dot_product(a.v, b.v), 6) as s from i a join i b on a.id <> b.id and a.id % 50 = 0 qualify row_number() over (partition by query order by s desc, b.id) <= 8)),
p as (select distinct least(query, id) as id_a, greatest(query, id) as id_b from c where query <> id),
m as (select id_a, id_b, regexp_extract_all(a.name, '[0-9]+') as na, regexp_extract_all(b.name, '[0-9]+') as nb, round(list_dot_product(a.v, b.v), 6)::double as cosine,
  exists (select 1 from (select unnest({WORDS.format('a.name')}) as x), (select unnest({WORDS.format('b.name')}) as y) where length(x) >= 4 and length(y) >= 4 and (left(x, 5) = left(y, 5) or ends_with(x, y) or ends_with(y, x))) as stem
  from p join i a on a.id = id_a join i b on b.id = id_b where a.family <> b.family)
select id_a, id_b, stem, cosine from m where (len(list_filter(na, lambda z: not list_contains(nb, z))) = 0 or len(list_filter(nb, lambda z: not list_contains(na, z))) = 0) and (stem or cosine >= 0.6)""")
def duplicate_pairs(spark, d):
    """Candidates: for each item with an id divisible by 50 the names nearest by BM25 and the nearest vectors."""
    v = vectors(spark, d).drop("label")
    items = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("family")).join(v, "id")
    asked = items.where("id % 50 = 0")
    lexical = retrieval.bm25(items.select("id", F.col("name").alias("text")), asked.select(F.col("id").alias("query"), F.col("name").alias("text")), 12)
    dense = retrieval.nearest(items, asked, 8)
    return retrieval.duplicate_pairs(lexical.select("query", "id").unionByName(dense.select("query", "id")), items, 0.6)


@query("amount_exclusion", """with s as (select l_orderkey as g, max(l_extendedprice) as full_ from lineitem group by 1), c as (select l_orderkey as g, l_linenumber as id, abs(l_extendedprice - full_) > 5000 as ex from lineitem join s on g = l_orderkey)
select g as "group", count(*) as candidates, (count(*) filter (not ex))::bigint as "left", case when count(*) filter (not ex) = 1 then min(id) filter (not ex) end as bound from c group by 1""")
def amount_exclusion(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").alias("id"), F.col("l_extendedprice").alias("amount"))
    return verifying.excluded_by_amount(l, l.groupBy("group").agg(F.max("amount").alias("full")), 5000.0)


@query("rule_exclusion", """select p_brand, count(*) as n, (count(*) filter (case when p_size % 2 = 0 then l_quantity <= p_size + 1e-9 else l_quantity >= p_size - 1e-9 end))::bigint as ok from lineitem join part on p_partkey = l_partkey group by 1""")
def rule_exclusion(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    holds = verifying.rule_holds(F.col("l_quantity"), F.when(F.col("p_size") % 2 == 0, "<").otherwise(">"), F.col("p_size"))
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(holds).alias("ok"))


@query("contradictions", "select l_orderkey, l_returnflag, count(distinct round(l_discount, 6)) as n, count(distinct round(l_discount, 6)) > 1 as to_human from lineitem group by all")
def contradictions(spark, d):
    return verifying.contradictions(table(spark, d, "lineitem").withColumn("value", F.col("l_discount")), "l_orderkey", "l_returnflag")


@query("claims_in_source", """with c as (select doc_id as id, f.f as field, case f.f when 1 then substr(text, 5, 20) when 2 then substr(text, 5, 20) else 'nowhere at all' end as span, case when f.f = 2 and doc_id % 2 = 0 then 'zzz' else substr(text, 8, 4) end as value, text from documents, (select unnest([1, 2, 3])::int as f) f where (f.f <> 2 or doc_id % 4 <> 1)),
u as (select id, span, count(*) as uses from c group by all) select id, field, case when instr(text, span) = 0 then 'span not in text' when instr(span, value) = 0 then 'value not in span' when uses > 1 then 'span used twice' end as reason from c join u using (id, span)""")
def claims_in_source(spark, d):
    t = table(spark, d, "documents").withColumn("field", F.explode(F.array(*map(F.lit, (1, 2, 3))))).where("field <> 2 or doc_id % 4 <> 1")
    span = F.when(F.col("field") < 3, F.substring("text", 5, 20)).otherwise("nowhere at all")
    value = F.when((F.col("field") == 2) & (F.col("doc_id") % 2 == 0), "zzz").otherwise(F.substring("text", 8, 4))
    claims = t.select(F.col("doc_id").alias("id"), "field", span.alias("span"), value.alias("value"))
    return verifying.claims_in_source(claims, texts(spark, d))


CUES = {1: " a", 2: " e", 3: " o"}
_GAP = "least(case when instr(reverse(left(text, pos - 1)), reverse('{0}')) > 0 then instr(reverse(left(text, pos - 1)), reverse('{0}')) - 1 end, case when instr(substr(text, pos + length(value)), '{0}') > 0 then instr(substr(text, pos + length(value)), '{0}') - 1 end)"


@query("claims_by_role", f"""with c as (select doc_id as id, f.f as field, case when doc_id % 11 = f.f then 'nowhere at all' else substr(text, 5 + 30 * (f.f // 2)::int, 40) end as span, case when doc_id % 13 = f.f then 'zzzz' else substr(text, 15 + 30 * (f.f // 2)::int, 6) end as value, text from documents, (select unnest([1, 2, 3])::int as f) f),
v as (select *, instr(text, span) as s, instr(span, value) as v from c), p as (select *, s + v - 1 as pos from v),
g as (select *, case when s > 0 and v > 0 then {_GAP.format(CUES[1])} end as g1, case when s > 0 and v > 0 then {_GAP.format(CUES[2])} end as g2, case when s > 0 and v > 0 then {_GAP.format(CUES[3])} end as g3 from p),
o as (select *, case field when 1 then g1 when 2 then g2 else g3 end as own from g),
r as (select id, field, pos, case when coalesce(s, 0) = 0 then 'span not in text' when coalesce(v, 0) = 0 then 'value not in span' when own is null then 'no role cue' when own > least(g1, g2, g3) then 'another role is nearer' end as reason from o)
select id, field, case when reason is null and row_number() over (partition by id, pos, reason is null order by field) > 1 then 'used before' else reason end as reason from r""")
def claims_by_role(spark, d):
    """Three fields a text; the second and third claim the same place, so that the nearest cue decides between them."""
    t = table(spark, d, "documents").withColumn("field", F.explode(F.array(*map(F.lit, CUES))))
    place = (F.col("field") / 2).cast("int") * 30
    span = F.when(F.col("doc_id") % 11 == F.col("field"), "nowhere at all").otherwise(F.substr("text", place + 5, F.lit(40)))
    value = F.when(F.col("doc_id") % 13 == F.col("field"), "zzzz").otherwise(F.substr("text", place + 15, F.lit(6)))
    return verifying.claims_by_role(t.select(F.col("doc_id").alias("id"), "field", span.alias("span"), value.alias("value")), texts(spark, d), CUES)


HOLIDAYS, MOVED = ["1998-01-01", "1997-12-25"], ["1998-01-10"]


@query("working_day_deadline", """with s as (select min(o_orderdate)::date as a, max(o_orderdate)::date + 40 as b from orders), c as (select unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as day from s),
w as (select day, not (day::varchar in ('1998-01-01', '1997-12-25') or (dayofweek(day) in (0, 6) and day::varchar <> '1998-01-10')) as working from c), n as (select *, sum(working::int) over (order by day) as number from w)
select o_orderkey, o_orderdate::date as day, t.day as due from orders join n f on f.day = o_orderdate::date join n t on t.working and t.number = f.number + 8""")
def working_day_deadline(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    span = o.agg(F.min("day").alias("a"), F.date_add(F.max("day"), 40).alias("b"))
    cal = verifying.calendar(F.col("a"), F.col("b"), span, HOLIDAYS, MOVED)
    return verifying.working_day_deadline(o, F.broadcast(cal), "day", 8)


@query("calendar_ends", "select o_orderkey, last_day(o_orderdate::date) as month_end, (o_orderdate::date + 30) as due from orders")
def calendar_ends(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.last_day(day).alias("month_end"), F.date_add(day, 30).alias("due"))


@query("penalty_ledger", "select year(o_orderdate)::int as year, count(*) as n, round(sum(round(least((o_orderkey % 90) * o_totalprice * 0.005, o_totalprice * 0.2), 2)), 0)::double as penalty from orders group by 1")
def penalty_ledger(spark, d):
    p = verifying.penalty(F.col("o_orderkey") % 90, F.col("o_totalprice"), 0.005, 0.2)
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum(p), 0).alias("penalty"))


@query("indexation_chain", """with recursive c as (select p_partkey, 0 as y, p_retailprice as v from part union all select p_partkey, y + 1, (ceil(round(v * (1 + least((p_partkey % 7 + y) / 100, 0.05)), 6) / 10) * 10)::double from c where y < 3) select p_partkey, v from c where y = 3""")
def indexation_chain(spark, d):
    rates = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda y: (F.col("p_partkey") % 7 + y) / 100)
    return table(spark, d, "part").select("p_partkey", verifying.indexed(F.col("p_retailprice"), rates, 0.05).alias("v"))


@query("arithmetic_check", """with l as (select l_orderkey as doc, round(sum(l_extendedprice * (1 - l_discount)), 4) as net, round(sum(l_extendedprice * l_tax), 4) as vat from lineitem group by 1) select doc % 10 as cell, count(*) as n, (count(*) filter (abs(net + vat - o_totalprice) <= 50000))::bigint as ok from l join orders on o_orderkey = doc group by 1""")
def arithmetic_check(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), (F.col("l_extendedprice") * F.col("l_tax")).alias("vat"))
    stated = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_totalprice").alias("gross"))
    out = verifying.arithmetic_check(lines, stated, 50000.0)
    return out.groupBy((F.col("doc") % 10).alias("cell")).agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"))


@query("unit_harmonisation", "select case p_partkey % 4 when 0 then 'm' when 1 then 'm' when 2 then 'kg' end as base, count(*) as n, round(sum(case p_partkey % 4 when 0 then p_size / 100 when 1 then p_size when 2 then p_size / 1000 end), 4)::double as total from part group by 1")
def unit_harmonisation(spark, d):
    units = spark.createDataFrame([("cm", "m", 0.01), ("m", "m", 1.0), ("g", "kg", 0.001)], "unit string, base string, factor double")
    name = F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, (" cm", " M", " g", " pcs"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    out = verifying.base_units(table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("text")), r"([0-9]+) (\w+)$", units)
    return out.groupBy("base").agg(F.count("*").alias("n"), F.round(F.sum("quantity"), 4).alias("total"))


@query("pipeline_loss", """with x as (select o_orderpriority as variant, o_orderkey % 3 = 0 as plain, o_orderkey % 5 <> 0 as extracted, o_orderkey % 11 <> 0 as oracle, o_orderkey % 2 = 0 as passed from orders),
a as (select variant, count(*) as n, round(avg(plain::int), 6)::double as plain, round(avg(extracted::int), 6)::double as extracted, round(avg(oracle::int), 6)::double as oracle, count(*) filter (passed and not extracted) as false_pass from x group by rollup (variant))
select *, round(oracle - extracted, 6) as extraction_loss, round(extracted - plain, 6) as rule_gain from a""")
def pipeline_loss(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("variant"), (k % 3 == 0).alias("plain"), (k % 5 != 0).alias("extracted"), (k % 11 != 0).alias("oracle"), (k % 2 == 0).alias("passed"))
    return verifying.chain_losses(rows, "variant")


@query("benchmark_summary", """select user_id, count(*) as n, round(avg(value), 6)::double as mean, round(quantile_cont(value, 0.5), 6)::double as median, round(quantile_cont(value, 0.95), 6)::double as p95, round(quantile_cont(value, 0.99), 6)::double as p99,
round(stddev_samp(value) / avg(value), 6)::double as cv, round(stddev_samp(value) / avg(value), 6) > 0.9 as unstable from events group by 1 having count(*) filter (event_type = 'error' and value > 90) = 0""")
def benchmark_summary(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("value").alias("latency"), ((F.col("event_type") == "error") & (F.col("value") > 90)).alias("failed"))
    return serving.benchmark_summary(rows, "user_id", most_cv=0.9)


@query("draft_acceptance", "select (event_id % 3)::int as position, count(*) as drafted, (count(*) filter (value > 20 + 10 * (event_id % 3)))::bigint as accepted, round(count(*) filter (value > 20 + 10 * (event_id % 3)) / count(*), 6)::double as rate from events group by rollup (event_id % 3)")
def draft_acceptance(spark, d):
    p = F.col("event_id") % 3
    return serving.acceptance_by_position(table(spark, d, "events").select(p.cast("int").alias("position"), (F.col("value") > 20 + 10 * p).alias("accepted")))


@query("counter_deltas", """with s as (select user_id, ts, (row_number() over (partition by user_id order by ts, event_id) * 3 % 50)::bigint as c, event_id from events), d as (select *, lag(c) over (partition by user_id order by ts, event_id) as p from s)
select user_id, sum(case when p is null then null when c >= p then c - p else c end)::bigint as growth from d group by 1""")
def counter_deltas(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (F.row_number().over(w) * 3 % 50).cast("long").alias("c"))
    return serving.counter_deltas(s, "user_id", "at", "c").groupBy("user_id").agg(F.sum("delta").alias("growth"))


@query("load_windows", "select time_bucket(interval 6 hours, ts) as start, count(*) as n, round(quantile_cont(value, 0.5), 6)::double as p50, round(quantile_cont(value, 0.95), 6)::double as p95 from events group by 1")
def load_windows(spark, d):
    return serving.load_windows(table(spark, d, "events"), "ts", "6 hours", "value").withColumn("start", F.col("start").cast("timestamp_ntz"))


GATE_SQL = """with a as (select time_bucket(interval 1 day, ts) as start, count(*) filter (event_type = 'error') as k, count(*) as n from events group by 1), z as (select 1.959963984540054 as z),
b as (select start, k, n, round(greatest((k / n + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n), 0), 6)::double as low, round(least((k / n + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n), 1), 6)::double as high from a, z)
select *, low > 0.15 as alarm from b"""


@query("gate_windows", GATE_SQL)
def gate_windows(spark, d):
    return serving.gate_windows(table(spark, d, "events"), "ts", "1 day", F.col("event_type") == "error", 0.15).withColumn("start", F.col("start").cast("timestamp_ntz"))


SESSION_SQL = """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hours then 0 else 1 end as s from events), h as (select *, sum(s) over (partition by user_id order by ts) as part from g)
select user_id, min(ts) as start, count(*) as n, count(*) > 5 as over from h group by user_id, part""".replace(" as over ", ' as "over" ')


@query("session_sizes", SESSION_SQL)
def session_sizes(spark, d):
    return serving.sessions(table(spark, d, "events"), "user_id", "ts", "12 hours", 5).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("resource_growth", "with s as (select event_id // 2000 as step, max(value) as top from events group by 1) select step, top, round(top - lag(top) over (order by step), 6)::double as growth from s")
def resource_growth(spark, d):
    return serving.growth_per_step(table(spark, d, "events").withColumn("step", F.floor(F.col("event_id") / 2000)), "step", "value")


@query("best_configuration", """with v as (select user_id % 6 as side, case when event_type = 'view' then 'base' else event_type end as config, round(avg(value), 6)::double as value from events group by all), b as (select side, value as base from v where config = 'base')
select side, config, value, base, round(100 * (value / base - 1), 6)::double as delta_percent from v left join b using (side) qualify row_number() over (partition by side order by value desc, config) = 1""")
def best_configuration(spark, d):
    from lodestat.operators.scoring import best_of_baseline

    v = table(spark, d, "events").groupBy((F.col("user_id") % 6).alias("side"), F.when(F.col("event_type") == "view", "base").otherwise(F.col("event_type")).alias("config")).agg(F.round(F.avg("value"), 6).alias("value"))
    return best_of_baseline(v)


#: Event time after which a silent key is forgotten.
IDLE_MS = 40 * 86_400_000


def _streamed(spark, d, make):
    """Runs a stream over the events table to its end in append mode and gives what it wrote, as a table in the shared folder.

    A second source has one row long after the last event. It moves the watermark past every window and session of
    the table, so these close and are written; its own stays open.
    """
    path = removed_at_exit(spark, scratch_path(spark, "stream"))
    e = table(spark, d, "events")
    after = F.max("ts") + F.expr("interval 30 days")
    closing = e.agg(after.alias("ts")).where("ts is not null")
    closing.select(*(F.col("ts").cast(t).alias(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in e.dtypes)).write.parquet(path + "/closing")
    source = spark.readStream.schema(e.schema)
    rows = source.parquet(f"{d}/events.parquet*").unionByName(source.parquet(path + "/closing")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = make(rows).writeStream.option("checkpointLocation", path + "/state").trigger(availableNow=True).format("parquet").option("path", path + "/out")
    out.start().awaitTermination()
    return spark.read.parquet(path + "/out")


def _local_start(rows):
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_gate_monitor", GATE_SQL)
def stream_gate_monitor(spark, d):
    return _local_start(_streamed(spark, d, lambda s: jobs.gate_monitor(s, "ts", "1 hour", "1 day", F.col("event_type") == "error", 0.15)))


@query("stream_load_profile", "select time_bucket(interval 6 hours, ts) as start, count(*) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by 1")
def stream_load_profile(spark, d):
    return _local_start(serving.profile_of(_streamed(spark, d, lambda s: jobs.load_profile(s, "ts", "1 hour", "6 hours", "value"))))


@query("stream_sessions", SESSION_SQL)
def stream_sessions(spark, d):
    return _local_start(_streamed(spark, d, lambda s: jobs.session_counts(s, "ts", "1 hour", "user_id", "12 hours", 5)))


@query("stream_counter_growth", """with s as (select user_id, value, lag(value) over (partition by user_id order by ts, value) as p from events)
select user_id::varchar as key, count(*)::bigint as n, round(sum(case when p is null then 0 when value >= p then value - p else value end), 4)::double as growth from s group by 1""")
def stream_counter_growth(spark, d):
    each = _streamed(spark, d, lambda s: jobs.counter_growth(s.where("event_id is not null").withColumn("at", F.col("ts")), "user_id", "value", "1 hour", IDLE_MS))
    return each.groupBy("key").agg(F.sum("n").alias("n"), F.round(F.sum("growth"), 4).alias("growth"))


@query("stream_hash_watch", """with f as (select user_id, event_type, first_value(event_type) over (partition by user_id order by ts, sha256(event_type)) as first from events)
select user_id::varchar as key, (count(*) filter (event_type <> first))::bigint as changed from f group by 1 having count(*) filter (event_type <> first) > 0""")
def stream_hash_watch(spark, d):
    each = _streamed(spark, d, lambda s: jobs.first_hash_watch(s.where("event_id is not null").withColumn("at", F.col("ts")).withColumn("sha", F.sha2("event_type", 256)), "user_id", "sha", "1 hour", IDLE_MS))
    return each.groupBy("key").agg(F.sum("changed").alias("changed"))


@query("stream_once_each", "select event_id from events")
def stream_once_each(spark, d):
    return _streamed(spark, d, lambda s: jobs.once_each(s.where("event_id is not null"), "ts", "40 days", "event_id").select("event_id"))
