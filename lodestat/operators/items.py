"""Items for evaluation and training: options, structure-derived questions, number mentions, verse schemes, related names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lodestat.functions.values import seeded
from lodestat.operators.curating import in_hash_order


def gold_dropped(items: DataFrame, share: float, seed: str, *by: str) -> DataFrame:
    """items(id, gold, ...): gold taken away from the first rows in hash order until the share of rows without one is met in each stratum."""
    total = items.groupBy(*by).agg(F.count("*").alias("_n"), F.count_if(F.col("gold").isNull()).alias("_none"))
    ranked = in_hash_order(items.withColumn("_without", F.col("gold").isNull()), "id", seed, *by, "_without").withColumnRenamed("rank", "_rn").drop("_without", "size", "before")
    each = ranked.join(total, list(by))
    need = F.floor(F.col("_n") * share) - F.col("_none")
    dropped = F.col("gold").isNotNull() & (F.col("_rn") <= need)
    return each.withColumn("dropped", dropped).withColumn("gold", F.when(~dropped, F.col("gold"))).drop("_n", "_none", "_rn")


def padded_options(items: DataFrame, pool: DataFrame, want: Column, seed: str) -> DataFrame:
    """items(id, options): options of the pool added in an order of hashes until there are as many as wanted. The pool is one row with an array of bounded size."""
    each = items.crossJoin(F.broadcast(pool))
    fresh = F.array_except("pool", "options")
    order = F.transform(fresh, lambda o: F.struct(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string"), o), 256).alias("k"), o.alias("o")))
    more = F.slice(F.transform(F.array_sort(order), lambda x: x["o"]), F.lit(1), F.greatest(want - F.size("options"), F.lit(0)))
    return each.withColumn("options", F.concat("options", more)).drop("pool")


def next_line_items(lines: DataFrame, key: str, far: int = 2, k: int = 3) -> DataFrame:
    """lines(key, pos, line): each line with the next one as gold and as distractors the first k lines whose pos is more than `far` away.

    These are among the first k + 2 * far + 1 lines of a text, so only they are held beside its other lines.
    """
    w = Window.partitionBy(key).orderBy("pos")
    each = lines.select(key, "pos", "line").withColumn("gold", F.lead("line").over(w)).withColumn("_nth", F.row_number().over(w))
    head = each.where(F.col("_nth") <= k + 2 * far + 1).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_head"))
    away = F.filter("_head", lambda x: F.abs(x["pos"] - F.col("pos")) > far)
    return each.where("gold is not null").join(head, key).select(key, "pos", "line", "gold", F.transform(F.slice(away, 1, k), lambda x: x["line"]).alias("distractors"))


def common_items(messages: DataFrame) -> DataFrame:
    """Conversations as items: the last user turn is the request, what came before the history."""
    last = messages.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("at"))
    each = messages.join(last, "conv_id").where("turn <= at")
    return each.groupBy("conv_id").agg(F.max_by("text", "turn").alias("request"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"), F.count("*").alias("turns"))


def fact_check(plans: DataFrame, texts: DataFrame) -> DataFrame:
    """plans(id, value, forbidden) against texts(id, text): the value must stand alone in the text, the forbidden reading must not."""
    stands = lambda v: F.concat(F.lit(r"(?<![0-9.,])"), v, F.lit(r"(?![0-9]|[.,][0-9])"))
    each = plans.join(texts, "id")
    reason = F.when(~F.regexp_like("text", stands(F.col("value"))), "value missing").when(F.regexp_like("text", stands(F.col("forbidden"))), "forbidden reading")
    return each.select("id", reason.alias("reason"))


def readout_faults(rows: DataFrame) -> DataFrame:
    """rows(id, probs array, mass): first fault of a read-out, or null."""
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    bad = F.exists("probs", lambda x: F.isnan(x) | (x < 0))
    return rows.withColumn("fault", F.when(F.size("probs") == 0, "empty").when(bad, "not finite").when(F.abs(total - 1) > 1e-6, "sum").when(F.col("mass") <= 0, "mass"))


#: Marks of a locale: what groups thousands, what is the decimal mark.
LOCALES = {"en": (",", "."), "de": (". ", ","), "fr": (" ", ","), "es": (". ", ",")}
#: Currency markers, as words or signs.
CURRENCIES = {"$": "USD", "usd": "USD", "dollars": "USD", "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR", "£": "GBP", "gbp": "GBP"}
_MARKER = re.compile("|".join(rf"\b{m}\b" if m.isalpha() else re.escape(m) for m in sorted(CURRENCIES, key=len, reverse=True)), re.I)


def number_patterns(lang: str | None) -> list[tuple[re.Pattern, str, str]]:
    """(pattern, thousands, decimal) of the text's own locale first, then of the others."""
    own = LOCALES.get(lang or "", LOCALES["en"])
    out = []
    for groups, mark in dict.fromkeys([own, *LOCALES.values()]):
        g = f"[{re.escape(groups)}]"
        out.append((re.compile(rf"(?<![\w.,])[-−]?(?:\d{{1,3}}(?:{g}\d{{3}})+|\d+)(?:{re.escape(mark)}\d+)?(?![\w]|[.,]\d)"), groups, mark))
    return out


def numbers_of(text: str, lang: str | None, within: int = 12) -> list[tuple[int, int, float, str | None]]:
    """start, end, value and currency of the numbers of a text, none over another.

    The own locale's reading of a place comes before the others'. A minus counts where no word or number ends just
    before it. The currency is that of the nearest marker within so many characters on either side, the earlier on ties.
    """
    taken: list[tuple[int, int, float]] = []
    for pattern, groups, mark in number_patterns(lang):
        for m in pattern.finditer(text):
            if not any(a < m.end() and m.start() < b for a, b, _ in taken):
                plain = "".join(c for c in m[0] if c not in groups).replace(mark, ".").replace("−", "-")
                taken.append((*m.span(), float(plain)))
    out = []
    markers = [(m.start(), m.end(), CURRENCIES[m[0].lower()]) for m in _MARKER.finditer(text)] if taken else []
    for a, b, value in sorted(taken):
        near = [(max(x - b, a - y, 0), x, name) for x, y, name in markers if x - b <= within and a - y <= within]
        out.append((a, b, value, min(near)[2] if near else None))
    return out


@udtf(returnType="start int, end int, value double, currency string")
class Numbers:
    def eval(self, text: str, lang: str):
        yield from numbers_of(text or "", lang)


@udtf(returnType="pos int, sentence string")
class Sentences:
    """Sentences of a text with their places: cut after . ! or ? before white space."""

    def eval(self, text: str):
        at = 0
        for part in re.split(r"(?<=[.!?])\s+", text or ""):
            if part.strip():
                yield at, part.strip()
                at += 1


@udtf(returnType="pos int, lines int, first string")
class Stanzas:
    """Stanzas of a text with their places: lines up to an empty one."""

    def eval(self, text: str):
        for i, part in enumerate(p for p in re.split(r"\n[ \t]*\n", text or "") if p.strip()):
            lines = [x for x in part.split("\n") if x.strip()]
            yield i, len(lines), lines[0]


def number_mentions(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, text, lang): key, start, end, value and nearest currency of every number of a corpus; see numbers_of."""
    return rows.select(key, "text", "lang").lateralJoin(Numbers(F.col("text").outer(), F.col("lang").outer())).select(key, "start", "end", "value", "currency")


def sentence_rows(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "text").lateralJoin(Sentences(F.col("text").outer())).select(key, "pos", "sentence")


def stanza_rows(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "text").lateralJoin(Stanzas(F.col("text").outer())).select(key, "pos", "lines", "first")


def schemes(stanzas: DataFrame, key: str) -> DataFrame:
    """stanzas(key, lines array): greedy rhyme letters by last letters: a line takes the letter of the first earlier line with its ending."""
    ends = F.transform("lines", lambda x: F.right(F.regexp_replace(F.lower(x), r"[^\p{L}]", ""), F.lit(2)))
    each = stanzas.select(key, ends.alias("_ends")).withColumn("_known", F.array_distinct("_ends"))
    letter = lambda e: F.chr(65 + (F.array_position("_known", e) - 1) % 26)
    return each.select(key, F.array_join(F.transform("_ends", letter), "").alias("scheme"))


def related_names(pairs: DataFrame) -> DataFrame:
    """pairs(a, b): how two names are related: contained, acronym, stem or close in letters; null if not."""
    low = lambda c: F.lower(F.col(c))
    words = lambda c: F.split(low(c), " ")
    initials = lambda c: F.array_join(F.transform(words(c), lambda w: F.substring(w, 1, 1)), "")
    stem = lambda c: F.transform(words(c), lambda w: F.substring(w, 1, 4))
    how = (
        F.when(low("a").contains(low("b")) | low("b").contains(low("a")), "contained")
        .when((low("a") == initials("b")) | (low("b") == initials("a")), "acronym")
        .when(F.arrays_overlap(stem("a"), stem("b")), "stem")
        .when(F.levenshtein(low("a"), low("b")) <= 2, "close")
    )
    return pairs.withColumn("relation", how)


def blocks_of(rows: DataFrame, key: str, least: int = 8, most: int = 16) -> DataFrame:
    """rows(key, sizes array): stanza sizes folded into blocks of at least so many lines, cut at most."""
    fold = F.aggregate(
        "sizes",
        F.struct(F.lit(0).alias("buf"), F.array().cast("array<int>").alias("out")),
        lambda acc, s: F.when(acc["buf"] + s >= least, F.struct(F.lit(0).alias("buf"), F.concat(acc["out"], F.array(F.least(acc["buf"] + s, F.lit(most)))).alias("out"))).otherwise(F.struct((acc["buf"] + s).alias("buf"), acc["out"].alias("out"))),
        lambda acc: acc["out"],
    )
    return rows.select(key, fold.alias("blocks"))


def minimal_pairs(variants: DataFrame, marker: str, least: float = 1 / 3) -> DataFrame:
    """variants(unit, text, cue): a variant holds if a sentence has the marker and the cue's stems are covered both inside and outside of it; one that fails takes its whole unit along."""
    sentences = F.split("text", r"(?<=[.!?])\s+")
    inside = F.filter("_s", lambda s: s.rlike(marker))
    outside = F.filter("_s", lambda s: ~s.rlike(marker))
    stems = F.transform(F.split(F.lower("cue"), " "), lambda w: F.substring(w, 1, 4))
    cover = lambda part: F.size(F.filter("_stems", lambda w: F.lower(F.array_join(part, " ")).contains(w))) / F.greatest(F.size("_stems"), F.lit(1))
    each = variants.withColumn("_s", sentences).withColumn("_stems", stems)
    each = each.withColumn("_in", inside).withColumn("_out", outside)
    ok = (F.size("_in") > 0) & (cover(F.col("_in")) >= least) & (cover(F.col("_out")) >= least)
    judged = each.withColumn("ok", ok)
    bad = judged.where(~F.col("ok")).select("unit").distinct()
    return judged.join(bad, "unit", "left_anti").drop("_s", "_stems", "_in", "_out", "ok")


def indistinguishable(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """pairs(a, b): names with equal quantities, a word overlap of at least so much; and names that differ in their quantities alone."""
    nums = lambda c: F.array_sort(F.regexp_extract_all(F.col(c), F.lit(r"([0-9]+(?:[.,][0-9]+)?)"), F.lit(1)))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.col(c)), F.lit(r"([\p{L}]+)"), F.lit(1)))
    each = pairs.withColumn("_qa", nums("a")).withColumn("_qb", nums("b")).withColumn("_wa", words("a")).withColumn("_wb", words("b"))
    share = F.size(F.array_intersect("_wa", "_wb")) / F.greatest(F.size(F.array_union("_wa", "_wb")), F.lit(1))
    same = F.col("_qa") == F.col("_qb")
    kind = F.when(same & (share >= least), "indistinguishable").when(~same & (F.size(F.array_except("_wa", "_wb")) + F.size(F.array_except("_wb", "_wa")) == 0), "size variant")
    return each.withColumn("kind", kind).drop("_qa", "_qb", "_wa", "_wb")


def present(value: Column, text: Column) -> Column:
    """Whether a text (lower case) has a value: as it stands, or abbreviated by one of its words: three letters or more, the first the value's own, the rest in their order in it."""
    short = F.filter(F.regexp_extract_all(text, F.lit(r"([\p{L}]{3,})"), F.lit(1)), lambda w: F.substring(w, 1, 1) == F.substring(value, 1, 1))
    in_order = lambda w: F.regexp_like(value, F.concat(F.lit("^"), F.array_join(F.split(w, ""), ".*")))
    return text.contains(value) | F.exists(short, in_order)


def distinguishing(rows: DataFrame) -> DataFrame:
    """rows(text, gold map, other map): whether the text tells gold from the other option by an attribute in which they differ: yes, contradicts or no."""
    low = F.lower("text")
    differ = lambda m, o: F.map_filter(F.col(m), lambda k, v: ~v.eqNullSafe(F.element_at(F.col(o), k)))
    has = lambda m: F.size(F.map_filter(m, lambda k, v: present(F.lower(v), low))) > 0
    return rows.withColumn("verdict", F.when(has(differ("gold", "other")), "yes").when(has(differ("other", "gold")), "contradicts").otherwise("no"))


def rebalanced(rows: DataFrame, kind: str, family: str, share: float, seed: str) -> DataFrame:
    """rows(id, kind, family): of each kind at most its share of all rows stays, first in hash order; for what goes, unused rows of the same family without a kind (spare) come in."""
    total = F.broadcast(rows.where(~F.col("spare")).agg(F.count("*").alias("_all")))
    used = rows.where(~F.col("spare"))
    kinded = in_hash_order(used.where(F.col(kind).isNotNull()), "id", seed, kind).crossJoin(total).withColumn("_gone", F.col("rank") > F.floor(F.col("_all") * share))
    plain = used.where(F.col(kind).isNull()).withColumn("_gone", F.lit(False))
    chosen = kinded.select("id", kind, family, "_gone").unionAll(plain.select("id", kind, family, "_gone"))
    need = chosen.where("_gone").groupBy(family).agg(F.count("*").alias("_need"))
    fresh = in_hash_order(rows.where(F.col("spare") & F.col(kind).isNull()), "id", seed, family).join(need, family).where("rank <= _need")
    return chosen.where("not _gone").select("id", kind, family).unionAll(fresh.select("id", kind, family))


def section_items(lines: DataFrame, key: str, is_heading: Column, k: int, seed: str) -> DataFrame:
    """lines(key, pos, line): each line below a heading with it as gold and up to k other headings of the text as options, in an order of hashes."""
    from lodestat.operators.texts import headings_carried

    carried = headings_carried(lines, key, is_heading, F.lit(False)).where(F.col("top").isNotNull() & ~is_heading)
    heads = lines.where(is_heading).groupBy(key).agg(F.collect_set("line").alias("_heads"))
    other = F.filter("_heads", lambda h: h != F.col("top"))
    order = F.array_sort(F.transform(other, lambda h: F.struct(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string"), h), 256).alias("s"), h.alias("h"))))
    return carried.join(heads, key).select(key, "pos", F.col("top").alias("gold"), F.slice(F.transform(order, lambda x: x["h"]), 1, k).alias("options"))


def own_distractors(rows: DataFrame, k: int) -> DataFrame:
    """rows(id, text, gold): capitalised spans of the text that are not related to gold by containment or a common stem, the first k."""
    spans = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)"), F.lit(1)))
    low = F.lower("gold")
    related = lambda s: F.lower(s).contains(low) | low.contains(F.lower(s)) | (F.substring(F.lower(s), 1, 4) == F.substring(low, 1, 4))
    return rows.select("id", F.slice(F.filter(spans, lambda s: ~related(s)), 1, k).alias("options"))
