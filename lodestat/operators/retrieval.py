"""Retrieval joins: BM25 over an inverted index, nearest vectors by blocks, candidate unions, name pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions.values import tokens
from lodestat.operators.ordered import kept

#: Words that are sent to all tasks at most.
BROADCAST_ROWS = 1_000_000
#: Words that are written into the plan at most.
LITERAL_TERMS = 5_000
#: Cells of vectors at most, and vectors that their centres are fitted to.
CENTRES, FITTED = 256, 8192
#: Keys of a term where its weights are not sent to all tasks.
BLOCKS = 64


def fielded_bm25(docs: DataFrame, queries: DataFrame, weights: dict[str, float], k: int = 8, k1: float = 1.2, b: float = 0.75, active: Column | None = None) -> DataFrame:
    """docs(id, a column for each field) against queries(query, text): the k best documents of each query by their best field.

    A field is an index of its own: its score is Okapi BM25 over the lengths of that field, times its weight. Where
    active is given, only such documents are in the index. A null field is empty.

    Texts are split into words once; what is written of a document is the counts of the words that queries ask for. The weights of
    asked terms go to the tasks that hold the counts, where they are at most BROADCAST_ROWS; beyond that a term is met
    in BLOCKS keys by document, so that a frequent term is no single key. Sums are made by query and document before they are ranked.
    """
    rows = docs if active is None else docs.where(active)
    asked = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    n_asked, n_terms = asked.agg(F.count("*"), F.count_distinct("term")).first()
    few = asked.select("term").distinct()
    fields = F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.coalesce(F.col(f), F.lit(""))).alias("w")) for f in weights))
    words = rows.select("id", F.explode(fields).alias("x")).select("id", "x.field", F.size("x.w").alias("len"), F.col("x.w").alias("w"))
    if n_terms <= LITERAL_TERMS:
        terms = [r["term"] for r in few.collect()]
        words = words.withColumn("w", F.filter("w", lambda t: t.isin(terms)))
    elif n_terms <= BROADCAST_ROWS:
        few = F.broadcast(few)
    words = words.repartition("id")  # what is left of a document stays together up to its scores
    # a row without a term stands for the document itself, so that lengths and counts come from one pass
    each = words.select("id", "field", "len", F.explode(F.concat(F.array(F.lit(None).cast("string")), "w")).alias("term"))
    if n_terms > LITERAL_TERMS:
        each = each.where("term is null").unionByName(each.join(few, "term", "left_semi").select(each.columns))
    counts = kept(each.groupBy("id", "field", "len", "term").agg(F.count("*").alias("tf")), "bm25-counts")
    size = F.broadcast(counts.where("term is null").groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("avg")))  # a row a field
    tf = counts.where("term is not null")
    df = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    own = F.element_at(F.create_map(*(F.lit(x) for f in weights.items() for x in f)), F.col("field"))
    idf = own * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.join(df, "term").join(size, "field").select("query", "term", "field", "avg", idf.alias("idf"))
    if n_asked * len(weights) <= BROADCAST_ROWS:
        met = tf.join(F.broadcast(asked), ["term", "field"])
    else:
        blocks = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
        met = tf.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int")).join(blocks, ["term", "field", "block"])
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    best = [F.coalesce(F.sum(F.when(F.col("field") == f, part)), F.lit(0.0)) for f in weights]
    sums = met.groupBy("query", "id").agg(F.round(F.greatest(*best) if len(best) > 1 else best[0], 4).alias("score"))
    return top_k(sums, "query", "id", k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 8, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, text) against (query, text): the k best documents of each query."""
    return fielded_bm25(docs, queries, {"text": 1.0}, k, k1, b)


def top_k(scores: DataFrame, query: str, item: str, k: int, score: str = "score") -> DataFrame:
    """The k best items of each query, ties by item; limited within tasks before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.desc(score), item)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unit_rows(cells: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of length one."""
    m = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(cells), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def centres(vectors: DataFrame, most: int = CENTRES, sample: int = FITTED, rounds: int = 8) -> np.ndarray:
    """Means of k-means by cosine over a bounded sample: the vectors with the least hashes of their ids."""
    got = vectors.select("id", "v").orderBy(F.xxhash64("id", F.lit(7)), "id").limit(sample).toArrow()  # at most `sample` rows
    if not got.num_rows:
        return np.zeros((0, 0))
    x = unit_rows(got["v"].combine_chunks())
    c = x[: max(1, min(most, int(len(x) ** 0.5)))]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def celled(rows: DataFrame, means: np.ndarray, *more: str) -> DataFrame:
    """id, v, cell (the centre nearest to v), angle to it."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cos = unit_rows(b.column(1)) @ means.T if b.num_rows else np.zeros((0, len(means)))
            cell = np.argmax(cos, axis=1) if b.num_rows else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(cos[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(angle)], names=[*b.schema.names, "cell", "angle"])

    return rows.select("id", "v", *more).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("id", "v", *more)) + ", cell int, angle double")


def pairs_of(slabs: DataFrame, blocks: DataFrame) -> DataFrame:
    """x, q: every slab of a cell beside every block of queries of that cell. Slabs stay apart, so a cell that a third of all vectors are in is many keys."""
    parts = slabs.groupBy("cell").agg(F.max("part").alias("most"))  # a row a cell
    asked = blocks.drop("part").join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), "most")))
    return slabs.join(asked, ["cell", "part"]).select("x", "q")


def products(slabs: DataFrame, blocks: DataFrame, k: int, exclude: str | None) -> DataFrame:
    """query, id, cosine of the k best of each slab (cell, x) for each query of the blocks (cell, q) of its cell."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, q = b.column(0)[i].values, b.column(1)[i].values
                x = x.take(pa.array(np.argsort(x.field("id").to_numpy(), kind="stable")))  # the stable cut below then leaves the least ids of a tie
                sim = np.round(unit_rows(q.field("v")) @ unit_rows(x.field("v")).T, 6)
                ids, own = x.field("id").to_numpy(), q.field("id").to_numpy()
                sim[own[:, None] == ids[None, :]] = -2
                if exclude:
                    sim[q.field(exclude).to_numpy(zero_copy_only=False)[:, None] == x.field(exclude).to_numpy(zero_copy_only=False)[None, :]] = -2
                n = min(k, len(ids))
                at = np.argsort(-sim, axis=1, kind="stable")[:, :n]
                keep = np.take_along_axis(sim, at, 1)
                real = (keep > -2).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)[real]), pa.array(ids[at].ravel()[real]), pa.array(keep.ravel()[real])], names=["query", "id", "cosine"])

    return pairs_of(slabs, blocks).mapInArrow(best, "query long, id long, cosine double")


def packed(rows: DataFrame, name: str, size: int, *more: str) -> DataFrame:
    """cell, part and an array of at most some `size` rows of it; a cell that many rows are in is many parts."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("_parts"))  # a row a cell
    dealt = rows.join(F.broadcast(counts), "cell").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("_parts")).cast("int"))
    return dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "v", *more)).alias(name))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, exclude: str | None = None, block: int = 2048, slab: int = 4096) -> DataFrame:
    """(id, v[, family]) the k items of greatest cosine (to six places) for each query, ties by id; exact.

    Vectors are dealt to cells by the nearest of a few centres. A query meets its own cell first; the k-th best there
    is a bound, and of the other cells it meets those only that may hold better: no vector of a cell is nearer to the query
    than its centre is, less the cell's widest angle. Queries of a cell and its vectors meet in blocks and slabs of
    bounded size, each pair one matrix product that keeps the k best; so k rows a query and slab are shuffled.
    """
    fam = [exclude] if exclude else []
    means = centres(vectors)
    if not len(means):
        return vectors.limit(0).select(F.col("id").alias("query"), "id", F.lit(0.0).alias("cosine"), F.lit(0).alias("rank"))
    cells = kept(celled(vectors, means, *fam), "cells")
    widest = np.full(len(means), -1.0)
    for r in cells.groupBy("cell").agg(F.max("angle").alias("a")).collect():  # a row a cell
        widest[r["cell"]] = r["a"]
    asked = kept(celled(queries, means, *fam), "asked")
    slabs = kept(packed(cells, "x", slab, *fam), "slabs")
    first = kept(products(slabs, packed(asked, "q", block, *fam), k, exclude), "near")
    bound = top_k(first, "query", "id", k, "cosine").where(F.col("rank") == k).select(F.col("query").alias("id"), F.col("cosine").alias("least"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            away = np.arccos(np.clip(unit_rows(b.column(1)) @ means.T, -1, 1)) if b.num_rows else np.zeros((0, len(means)))
            top = np.cos(np.maximum(0.0, away - widest)) + 1e-6  # six places are compared
            least = np.array([-2.0 if x is None else x for x in b.column("least").to_pylist()])
            meets = (widest >= 0) & (top >= least[:, None]) & (np.arange(len(means)) != b.column("cell").to_numpy()[:, None])
            row, cell = np.nonzero(meets)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row)) for c in ("id", "v", *fam)), pa.array(cell, pa.int32())], names=["id", "v", *fam, "cell"])

    kinds = dict(asked.dtypes)
    more = asked.join(bound, "id", "left").select("id", "v", *fam, "cell", "least").mapInArrow(others, ", ".join(f"{c} {kinds[c]}" for c in ("id", "v", *fam)) + ", cell int")
    met = first.unionByName(products(slabs, packed(kept(more, "others"), "q", block, *fam), k, exclude))
    return top_k(met.withColumn("cosine", F.round("cosine", 6)), "query", "id", k, "cosine")


def candidate_union(lexical: DataFrame, dense: DataFrame, k: int = 5) -> DataFrame:
    """Union of the k best of two lists (query, id, rank), order kept, repeats dropped."""
    both = lexical.where(F.col("rank") <= k).select("query", "id", F.lit(0).alias("list"), "rank").unionAll(dense.where(F.col("rank") <= k).select("query", "id", F.lit(1), "rank"))
    first = both.groupBy("query", "id").agg(F.min(F.struct("list", "rank")).alias("at"))
    w = Window.partitionBy("query").orderBy("at.list", "at.rank")
    return first.withColumn("place", F.row_number().over(w)).select("query", "id", "place")


def margins(ranked: DataFrame, query: str = "query", score: str = "score") -> DataFrame:
    """(s1 - s2) / s1 of each query; null where there is one candidate only."""
    s = lambda r: F.max(F.when(F.col("rank") == r, F.col(score)))
    out = ranked.where("rank <= 2").groupBy(query).agg(s(1).alias("s1"), s(2).alias("s2"))
    return out.select(query, F.round((F.col("s1") - F.col("s2")) / F.col("s1"), 4).alias("margin"))


def difficulty_bands(ranked: DataFrame, split: str, low: float, high: float) -> DataFrame:
    """ranked(query, split, rank, score, family, own): for each split how often the first candidate is of the query's family, how often more of it are listed, the median margin, and whether that lies inside the band."""
    first = lambda c: F.max(F.when(F.col("rank") == 1, c))
    kin = (F.col("family") == F.col("own")).cast("int")
    second = F.max(F.when(F.col("rank") == 2, F.col("score")))
    each = ranked.groupBy(split, "query").agg(first(kin).alias("top"), (F.sum(kin) - first(kin)).alias("siblings"), F.round((first(F.col("score")) - second) / first(F.col("score")), 4).alias("margin"))
    out = each.groupBy(split).agg(F.count("*").alias("queries"), F.round(F.avg("top"), 6).alias("gold_first"), F.round(F.avg((F.col("siblings") > 0).cast("double")), 6).alias("with_siblings"), F.round(F.percentile("margin", F.lit(0.5)), 6).alias("median_margin"))
    return out.withColumn("in_band", F.col("median_margin").between(low, high))


def family_centroids(vectors: DataFrame, family: str, k: int = 10) -> DataFrame:
    """Cosine of the k nearest families of each, by the mean vectors of the families.

    Means are aggregated by family and dimension; families, not rows, are paired.
    """
    each = vectors.select(family, F.posexplode("v").alias("dim", "x")).groupBy(family, "dim").agg(F.avg("x").alias("x"))
    norm = each.groupBy(family).agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    unit = each.join(norm, family).select(F.col(family).alias("a"), "dim", (F.col("x") / F.col("norm")).alias("x"))
    other = unit.select(F.col("a").alias("b"), "dim", F.col("x").alias("y"))
    cos = unit.join(other, "dim").where("a <> b").groupBy("a", "b").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("cosine"))
    return top_k(cos, "a", "b", k, "cosine")


def stems(name: Column, n: int = 5) -> Column:
    """First letters of each word of a name, distinct."""
    return F.array_distinct(F.transform(tokens(name), lambda w: F.substring(w, 1, n)))


def duplicate_pairs(candidates: DataFrame, items: DataFrame, close: float, least: int = 4) -> DataFrame:
    """Unordered pairs of candidates(query, id) that may name one thing: items(id, name, family, v) of other families, with the numbers of one name among those of the other, and a common stem or a cosine of at least `close`.

    Words of at least so many letters have a common stem if they begin alike or one ends in the other ("seawater",
    "water"). Only listed candidates are compared, so a stem that a third of all names have makes no pairs of its own.
    """
    nums = F.array_distinct(F.regexp_extract_all("name", F.lit(r"([0-9]+)"), F.lit(1)))
    long = F.filter(tokens(F.col("name")), lambda w: F.length(w) >= least)
    each = items.select("id", "family", nums.alias("nums"), long.alias("words"), "v")
    side = lambda s: each.select(*(F.col(c).alias(f"{c}_{s}") for c in each.columns))
    pairs = candidates.where("query <> id").select(F.least("query", "id").alias("id_a"), F.greatest("query", "id").alias("id_b")).distinct()
    met = pairs.join(side("a"), "id_a").join(side("b"), "id_b").where("family_a <> family_b")
    nested = (F.size(F.array_except("nums_a", "nums_b")) == 0) | (F.size(F.array_except("nums_b", "nums_a")) == 0)
    alike = lambda x, y: (F.substring(x, 1, 5) == F.substring(y, 1, 5)) | x.endswith(y) | y.endswith(x)
    stem = F.exists("words_a", lambda x: F.exists("words_b", lambda y: alike(x, y)))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    cosine = F.round(dot("v_a", "v_b") / F.sqrt(dot("v_a", "v_a") * dot("v_b", "v_b")), 6)
    return met.where(nested).select("id_a", "id_b", stem.alias("stem"), F.coalesce(cosine, F.lit(0.0)).alias("cosine")).where(F.col("stem") | (F.col("cosine") >= close))
