"""Text corpus jobs: filters, repetition, diversity, spans, verse, web pages."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.values import shingles, tokens
from lodestat.operators import letters
from lodestat.operators.ordered import kept

#: Patterns in the order they are tried. Fixed values.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9][0-9 ()/-]{7,}[0-9]",
    "contact": r"(?i)\b(phone|call me|contact)\b",
}


def first_pattern(text: Column, patterns: dict[str, str]) -> Column:
    """Name of the first pattern that text has, else null."""
    out = F.lit(None).cast("string")
    for name, p in reversed(patterns.items()):
        out = F.when(text.rlike(p), name).otherwise(out)
    return out


def tail_cut(text: Column, markers: list[str], least: int = 15) -> tuple[Column, Column]:
    """text up to its first marker, and whether it is suspect: too little would be left, so all of it stays."""
    at = F.array_min(F.array_compact(F.array(*(F.nullif(F.instr(text, m), F.lit(0)) for m in markers))))
    kept = F.rtrim(F.substring(text, F.lit(1), at - 1))
    suspect = at.isNotNull() & (F.length(kept) < least)
    return F.when(at.isNull() | suspect, text).otherwise(kept), suspect


def strictest_licence(licences: Column, rank: dict[str, int]) -> Column:
    """The strictest of several licences; null if any is unknown."""
    names = F.split(F.lower(licences), r"\s*[,;]\s*")
    known = F.create_map(*(F.lit(x) for kv in rank.items() for x in kv))
    worst = F.array_max(F.transform(names, lambda n: known[n]))
    back = F.create_map(*(F.lit(x) for k, v in rank.items() for x in (v, k)))
    return F.when(F.forall(names, lambda n: known[n].isNotNull()), back[worst])


def clean_sentences(text: Column) -> Column:
    """Sentences of 30 to 300 characters, six words or more, no period inside and at least 40 % of words in lower case."""
    parts = F.transform(F.split(F.regexp_replace(text, r"\n", " "), r"(?<=[.!?]) "), F.trim)
    words = lambda s: F.split(s, " ")
    lower = lambda s: F.size(F.filter(words(s), lambda w: w.rlike(r"^\p{Ll}")))
    ok = lambda s: F.length(s).between(30, 300) & (F.size(words(s)) >= 6) & ~F.substring(s, F.lit(1), F.length(s) - 1).contains(".") & (lower(s) * 10 >= F.size(words(s)) * 4)
    return F.filter(parts, ok)


def diversity(rows: DataFrame, key: str) -> DataFrame:
    """distinct-2, distinct-3 and the rate of repeated lines of each text."""
    w = tokens(F.col("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    share = lambda g: F.when(F.size(g) > 0, F.round(F.size(F.array_distinct(g)) / F.size(g), 6))
    rows = rows.select(key, w.alias("w"), lines.alias("lines")).select(key, shingles(F.col("w"), 2).alias("g2"), shingles(F.col("w"), 3).alias("g3"), "lines")
    return rows.select(key, share(F.col("g2")).alias("distinct2"), share(F.col("g3")).alias("distinct3"), F.when(F.size("lines") > 0, F.round(1 - F.size(F.array_distinct("lines")) / F.size("lines"), 6)).alias("repeated_lines"))


def loops(rows: DataFrame, key: str, n: int = 5, ratio: float = 0.5, most: int = 5) -> DataFrame:
    """Texts that loop: so many of their n-grams are repeats, or one n-gram comes so often."""
    each = rows.select(key, tokens(F.col("text")).alias("w")).select(key, F.explode(shingles(F.col("w"), n)).alias("g")).groupBy(key, "g").agg(F.count("*").alias("c"))
    out = each.groupBy(key).agg(F.round(1 - F.count("*") / F.sum("c"), 6).alias("ratio"), F.max("c").alias("most"))
    return out.withColumn("degenerate", (F.col("ratio") >= ratio) | (F.col("most") >= most))


def memorised(rows: DataFrame, reference: DataFrame, key: str, n: int = 8) -> DataFrame:
    """Length of the longest word n-gram of each text that occurs in one reference text, where there is one of n words or more.

    A text that shares a gram of some length with a reference shares one of every lesser length. So the length is
    doubled while any text still does, then searched for by halves; each round joins hashes of grams of the length
    that a text asks for. Only texts, and after the first round only reference texts, that share n words take part.
    """
    own = kept(rows.select(key, tokens(F.col("text")).alias("w")).where(F.size("w") >= n), "memorised-own")
    refs = kept(reference.select(tokens(F.col("text")).alias("w")).where(F.size("w") >= n).distinct(), "memorised-reference")

    def grams(texts: DataFrame, *names: str) -> DataFrame:
        """A row for each gram of `size` words, as two hashes."""
        at = F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)
        each = F.transform(at, lambda i: F.struct(F.xxhash64(F.slice("w", i, F.col("size"))).alias("h"), F.hash(F.slice("w", i, F.col("size"))).alias("g")))
        return texts.where(F.size("w") >= F.col("size")).select(*names, "size", F.explode(each).alias("x")).select(*names, "size", "x.h", "x.g")

    def shared(asked: DataFrame) -> DataFrame:
        """asked(key, size): those whose text shares a gram of that size."""
        sizes = F.broadcast(asked.select("size").distinct())  # at most two to the number of rounds
        theirs = grams(refs.crossJoin(sizes)).distinct()
        return grams(own.join(asked, key), key).join(theirs, ["size", "h", "g"], "left_semi").select(key, "size").distinct()

    best = kept(shared(own.select(key, F.lit(n).alias("size"))).select(key, F.col("size").alias("least")), "memorised")
    own = kept(own.join(best, key, "left_semi").select(key, "w"), "memorised-own")
    mine = grams(own.withColumn("size", F.lit(n))).distinct()
    hit = grams(refs.withColumn("size", F.lit(n)), "w").join(mine, ["size", "h", "g"], "left_semi")
    refs = kept(hit.select("w").distinct(), "memorised-reference")
    step, rising = n, True  # best: the size that a text is known to share; while rising, also those that shared the last one
    while step >= 1 and not best.isEmpty():
        asked = best.where(F.col("least") == step) if rising else best
        met = shared(asked.select(key, (F.col("least") + step).cast("int").alias("size"))).select(key, F.lit(1).alias("_met"))
        best = kept(best.join(met, key, "left").select(key, F.when(F.col("_met").isNotNull(), F.col("least") + step).otherwise(F.col("least")).cast("int").alias("least")), "memorised")
        if rising and best.where(F.col("least") == 2 * step).isEmpty():
            rising = False
        step = 2 * step if rising else step // 2
    return best.select(key, F.col("least").cast("long").alias("longest"))


def pattern_rates(rows: DataFrame, patterns: dict[str, str], *by: str) -> DataFrame:
    """Share of texts with each pattern, and their median length, by group."""
    share = [F.round(F.avg(F.col("text").rlike(p).cast("double")), 6).alias(n) for n, p in patterns.items()]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *share, F.percentile(F.length("text"), F.lit(0.5)).alias("median_length"))


def length_profile(rows: DataFrame, length: Column, limits: list[int], *by: str) -> DataFrame:
    """p50, p95, greatest length and shares over some limits by group."""
    over = [F.round(F.avg((length > n).cast("double")), 6).alias(f"over_{n}") for n in limits]
    return rows.groupBy(*by).agg(F.percentile(length, F.lit(0.5)).alias("p50"), F.percentile(length, F.lit(0.95)).alias("p95"), F.max(length).alias("longest"), *over)


def language_switches(rows: DataFrame, key: str, stop_words: list[str], size: int = 40, step: int = 10, share: float = 0.35) -> DataFrame:
    """Windows of words, and those in which stop words of the other language take up the share."""
    w = tokens(F.col("text"))
    n = F.size("w")
    at = F.when(n >= size, F.sequence(F.lit(1), n - (size - 1), F.lit(step))).otherwise(F.array(F.lit(1)))
    each = rows.select(key, w.alias("w")).where(n > 0).select(key, F.explode(F.transform(at, lambda i: F.slice("w", i, size))).alias("x"))
    part = F.size(F.filter("x", lambda t: t.isin(stop_words))) / F.size("x")
    return each.groupBy(key).agg(F.count("*").alias("windows"), F.count_if(part >= share).alias("switched"))


def script_spans(rows: DataFrame, key: str, char_class: str) -> DataFrame:
    """Maximal runs of a character class with their places: pieces between runs give the offsets, no character is a row."""
    spans = F.regexp_extract_all("text", F.lit(f"({char_class}+)"), F.lit(1))
    gaps = F.split("text", f"{char_class}+")
    each = rows.select(key, spans.alias("s"), F.transform(gaps, F.length).alias("g"))
    start = lambda i: F.aggregate(F.slice("g", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice(F.transform("s", F.length), F.lit(1), i), F.lit(0), lambda a, x: a + x)
    out = each.select(key, F.explode(F.transform("s", lambda s, i: F.struct(start(i).alias("start"), s.alias("span")))).alias("x"))
    return out.select(key, F.col("x.start").alias("start"), F.col("x.span").alias("span"))


def headings_carried(lines: DataFrame, key: str, is_top: Column, is_sub: Column) -> DataFrame:
    """lines(key, pos, line): the last upper and lower heading above each line; a new upper one clears the lower."""
    w = Window.partitionBy(key).orderBy("pos")
    each = lines.withColumn("top", F.last(F.when(is_top, F.col("line")), True).over(w)).withColumn("part", F.count_if(is_top).over(w))
    v = Window.partitionBy(key, "part").orderBy("pos")
    return each.withColumn("sub", F.last(F.when(is_sub & ~is_top, F.col("line")), True).over(v)).drop("part")


def lines_of(rows: DataFrame, key: str) -> DataFrame:
    """key, pos, line of every line that is not blank."""
    return rows.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")


VOWELS = "aeiouyáéíóöőúüűàèìòùâêîôûäëï"


def line_syllables(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, text): key, the lines that are not blank, n, and of their vowels the sum, s, and the sum of squares, q. A row each for rows with such lines."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters.syllables_of_letters(VOWELS)
        for b in batches:
            out = np.zeros((b.num_rows, 3), np.int64)
            for i, text in enumerate(letters.texts_of(b.column(1))):
                if text:
                    out[i] = _line_sums(text, table)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, np.ascontiguousarray(out.T))], names=[key, "n", "s", "q"])

    return rows.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n long, s long, q long").where("n > 0")


def _line_sums(text: str, table: np.ndarray) -> tuple[int, int, int]:
    lines = [x for x in text.split("\n") if x.strip(" ")]
    if not lines:
        return 0, 0, 0
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    each = np.add.reduceat(letters.looked_up("".join(lines), table), np.cumsum(size) - size, dtype=np.int64)
    return len(lines), int(each.sum()), int(each @ each)


def syllables(line: Column, vowels: str = VOWELS) -> Column:
    """Vowels of a line."""
    return F.length(F.regexp_replace(F.lower(line), f"[^{vowels}]", ""))


def ending(line: Column, n: int = 3) -> Column:
    """Last letters of a line, punctuation off."""
    return F.right(F.regexp_replace(F.lower(line), r"[^\p{L}]", ""), F.lit(n))


def rhyme_score(a: Column, b: Column, repeats: bool = False) -> Column:
    """1 for three equal last letters, 0.7 for two, 0.4 for one; at most 0.5 for the same last word, unless repeats count."""
    word = lambda c: F.regexp_extract(F.lower(c), r"([\p{L}]+)[^\p{L}]*$", 1)
    s = F.when(ending(a) == ending(b), 1.0).when(ending(a, 2) == ending(b, 2), 0.7).when(ending(a, 1) == ending(b, 1), 0.4).otherwise(0.0)
    return s if repeats else F.when(word(a) == word(b), F.least(s, F.lit(0.5))).otherwise(s)


def separation(pairs: DataFrame, scorers: dict[str, Column], grid: list[float]) -> DataFrame:
    """pairs(kind: true or control, ...): for each scorer and threshold the shares at or over it, and what the true pairs have more.

    Counts are kept by score, so the grid multiplies a row for each score, not each pair.
    """
    each = pairs.select("kind", F.explode(F.create_map(*(x for n, c in scorers.items() for x in (F.lit(n), c)))).alias("scorer", "s")).groupBy("scorer", "kind", "s").agg(F.count("*").alias("n"))
    each = each.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    n = lambda kind, more: F.sum(F.when((F.col("kind") == kind) & more, F.col("n")).otherwise(0))
    share = lambda kind: F.round(n(kind, F.col("s") >= F.col("t")) / n(kind, F.lit(True)), 6)
    out = each.groupBy("scorer", "t").agg(n("true", F.lit(True)).alias("pairs"), share("true").alias("own"), share("control").alias("control"))
    return out.withColumn("gain", F.round(F.col("own") - F.col("control"), 6))


def web_text(html: Column, dropped: tuple[str, ...] = ("script", "style", "nav", "header", "footer")) -> Column:
    """Text of a page: dropped elements out, breaks and block ends to line breaks, tags off, common entities on, blank lines folded."""
    out = html
    for tag in dropped:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(out, r" ?\n[ \n]*", "\n")), r"^\n+|\n+$", "")


def token_classes(rows: DataFrame, classes: dict[str, Column], *by: str) -> DataFrame:
    """rows(token): shares of the first class that fits each token, by group; each distinct token is judged once."""
    names = [*classes, "unknown"]
    cls = F.lit("unknown")
    for n, c in reversed(classes.items()):
        cls = F.when(c, n).otherwise(cls)
    counts = rows.groupBy(*by, "token").agg(F.count("*").alias("n")).withColumn("class", cls)
    wide = counts.groupBy(*by).agg(F.sum("n").alias("tokens"), *(F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(c) for c in names))
    return wide


def nearest_cue(rows: DataFrame, key: str, number: str, cue: str, within: int) -> DataFrame:
    """For each number (word) of a text its nearest cue word that begins within so many characters of where it begins; the earlier one on ties.

    Numbers and cues of a text are matched inside its row, so nothing is joined.
    """
    numbers, cues = re.compile(number), re.compile(cue)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                words = (text or "").split(" ")
                start = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
                at = [start[j] for j, w in enumerate(words) if cues.search(w)]
                names = [w for w in words if cues.search(w)]
                for j, w in enumerate(words):
                    if numbers.search(w):
                        best = min(((abs(c - start[j]), c, n) for c, n in zip(_near(at, start[j]), _near(names, start[j], at), strict=True)), default=None)
                        found = best if best and best[0] <= within else (None, None, None)
                        own.append(i)
                        out.append((int(start[j]), found[2], None if found[0] is None else int(found[0])))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], names=[key, "pos", "cue", "distance"])

    return rows.select(key, "text").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, pos int, cue string, distance int")


def _near(values: list, place: int, by: list | None = None) -> list:
    """Of values in order of place (by: their places) the last one before a place and the first one from there on."""
    i = bisect.bisect_left(values if by is None else by, place)
    return values[max(0, i - 1) : i + 1]


def tagged_entities(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, pos, token, tag): B-/I- runs of one type as entities; an I without its B begins none."""
    w = Window.partitionBy(key).orderBy("pos")
    kind = F.regexp_extract("tag", r"^[BI]-(.*)$", 1)
    each = rows.withColumn("kind", kind).withColumn("part", F.count_if((F.substring("tag", 1, 2) == "B-") | (F.col("tag") == "O")).over(w))
    inside = each.where("tag <> 'O'")
    v = Window.partitionBy(key, "part")
    inside = inside.withColumn("first", F.min(F.struct("pos", "tag", "kind")).over(v)).where(F.col("first.tag").startswith("B-") & (F.col("kind") == F.col("first.kind")))
    return inside.groupBy(key, "part").agg(F.min("pos").alias("start"), F.max("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("text")).drop("part")
