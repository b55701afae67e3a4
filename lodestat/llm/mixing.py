"""Mixing sources to target weights by blocks and index permutations.

The words of a source are laid out in blocks of fixed length. Every output shard draws from each source a
multinomial number of slots; the draws are conditioned on the source's total, so that the sum over shards meets
the target. They are drawn down a binary tree of chunks of shards, with a generator seeded by the node, so a task that
has a chunk draws along one path and no task or driver ever lists all shards. Slot j of a source stands for block perm(j mod n) of its n blocks, with a keyed permutation that needs
no table, so any task can map any slot. Blocks and slots then meet in a join by index.

A source is laid out in lanes of a bounded number of documents each (by hash of the id and the text), so that a hot
source, null ids or a repeated id are never ordered in one task.

The sources themselves - a name and a few numbers each - are the one table that the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.common import code_points, key_col, numbered, raw_texts, renamed, strings, word_spans, written

ROW = ["_key", "_mark", "_nth"]


def MARK() -> Column:
    return F.xxhash64("doc_id", "source", "text")


BLOCK_WORDS = 32
SLOTS_PER_SHARD = 1 << 15
#: Shards whose slots are drawn together.
CHUNK_SHARDS = 4
#: Documents a lane holds on average.
LANE_DOCS = 4096
WEIGHTS = (5.0, 2.0, 1.0)


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target words of each source. Sources in code-point order, null last, weigh the given weights in turn.

    What a source may not take (over most times its size) is shared anew by weight among those below their limit.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]))
    size = np.array([n for _, n in order], float)
    weight = np.array([weights[i % len(weights)] for i in range(len(order))])
    total, limit = share * size.sum(), most * size
    full = size <= 0
    target = np.where(full, 0.0, 0.0)
    while not full.all():
        rest = total - limit[full].sum()
        target[~full] = rest * weight[~full] / weight[~full].sum()
        over = ~full & (target > limit)
        if not over.any():
            break
        full |= over
        target[full] = limit[full]
    return {s: float(t) for (s, _), t in zip(order, target, strict=True)}


def share_of(slots: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's slots are among n of all, drawn without replacement.

    Beyond a thousand million slots the draw is the normal law with the same mean and variance.
    """
    out, rest = np.zeros(len(slots), np.int64), int(slots.sum())
    for i, own in enumerate(slots.tolist()):
        others = rest - own
        if rest < 10**9:
            k = int(rng.hypergeometric(own, others, n)) if n and own else 0
        else:
            mean = n * (own / rest)
            k = round(rng.normal(mean, np.sqrt(max(0.0, mean * (others / rest) * ((rest - n) / (rest - 1))))))
        out[i] = min(max(k, n - others, 0), own, n)
        n, rest = n - int(out[i]), others
    return out


def chunk_counts(slots: np.ndarray, per_shard: int, chunk: int, n_chunks: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in earlier chunks, and in each shard (row) of this chunk."""
    before, left = np.zeros(len(slots), np.int64), slots.astype(np.int64)
    lo, hi = 0, n_chunks
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = share_of(left, (mid - lo) * CHUNK_SHARDS * per_shard, np.random.default_rng([seed, lo, hi]))
        if chunk < mid:
            left, hi = first, mid
        else:
            before, left, lo = before + first, left - first, mid
    rng, out = np.random.default_rng([seed, lo, hi]), []
    while (n := int(left.sum())) > 0:
        out.append(share_of(left, min(n, per_shard), rng))
        left = left - out[-1]
    return before, np.array(out, np.int64).reshape(len(out), len(slots))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n): a four-round Feistel network, walked on while outside the range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in range(4):
            f = (right + np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) & ((1 << 64) - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            left, right = right, left ^ ((f * np.uint64(0x94D049BB133111EB)) >> np.uint64(32) & mask)
        out[todo] = left << np.uint64(half) | right
        todo[todo] = out[todo] >= n
    return out.astype(np.int64)


class Mix:
    """The tables of one mix of docs; each is built on the ones before."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, per_shard: int = SLOTS_PER_SHARD, lane_docs: int = LANE_DOCS, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7):
        self.spark, self.block_words, self.most = docs.sparkSession, block_words, most
        rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key_col("doc_id").alias("_key"), MARK().alias("_mark"))
        rows = written(rows, "mix-sizes")
        #: One row a source. The number of sources is a property of the collection, not of its size.
        found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        goal = targets([(r["source"], r["size"]) for r in found], weights, share, most)
        self.sources = [(i, r["source"], r["size"], -(-r["n"] // lane_docs), goal[r["source"]]) for i, r in enumerate(sorted(found, key=lambda r: (r["source"] is None, r["source"] or "")))]
        cols = list(zip(*self.sources, strict=True)) or [[]] * 5
        fields = {"src": pa.int32(), "source": pa.string(), "source_size": pa.int64(), "lanes": pa.int64(), "target": pa.float64()}
        # an Arrow table has a known size, by which Spark decides how to join it
        kinds = self.spark.createDataFrame(pa.table({k: pa.array(c, t) for (k, t), c in zip(fields.items(), cols, strict=True)}))
        rows = rows.join(kinds, rows["source"].eqNullSafe(kinds["source"])).drop(kinds["source"])
        rows = rows.withColumn("lane", F.pmod(F.xxhash64("_mark", F.lit(seed)), F.col("lanes")))
        order = Window.partitionBy("src", "lane").orderBy("doc_id", "_mark").rowsBetween(Window.unboundedPreceding, -1)
        placed = rows.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0)))
        #: _key, _mark and _nth (among rows that are the same) name a row.
        placed = placed.withColumn("_nth", F.row_number().over(Window.partitionBy("_key", "_mark").orderBy("at")))
        self.placed = written(placed, "mix-placed")
        lanes = self.placed.groupBy("src", "lane").agg(F.sum("size").alias("lane_words")).withColumn("lane_blocks", F.ceil(F.col("lane_words") / block_words))
        before = Window.partitionBy("src").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
        self.lanes = lanes.withColumn("base", F.coalesce(F.sum("lane_blocks").over(before), F.lit(0)))
        blocks = {r["src"]: r["n"] for r in lanes.groupBy("src").agg(F.sum("lane_blocks").alias("n")).collect()}
        self.blocks = [int(blocks.get(s[0]) or 0) for s in self.sources]
        #: A block's mean length turns a target of words into one of slots; no source takes its blocks more than `most` times.
        slots = [min(int(most * b), round(s[4] * b / s[2])) if s[2] else 0 for s, b in zip(self.sources, self.blocks, strict=True)]
        self.drawn = np.array(slots, np.int64)
        self.per_shard, self.seed = per_shard, seed

    def slots(self) -> DataFrame:
        """One row a slot: shard, src, block (index within the source) and turn (how often the block was taken before).

        The planner knows the few rows the slots are made from, not how many they become: join with a merge hint.
        """
        drawn, per_shard, seed = self.drawn, self.per_shard, self.seed
        blocks = self.blocks
        n = -(-int(drawn.sum()) // (CHUNK_SHARDS * per_shard))
        todo = self.spark.range(0, n, 1, max(1, min(n, 16 * self.spark.sparkContext.defaultParallelism)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for chunk in b.column(0).to_pylist():
                    first, counts = chunk_counts(drawn, per_shard, chunk, n, seed)
                    for i, each in enumerate(counts):
                        for s in np.flatnonzero(each).tolist():
                            j = np.arange(first[s], first[s] + each[s])
                            block = permuted(j % blocks[s], blocks[s], seed * 1000003 + s)
                            shard = np.full(len(j), chunk * CHUNK_SHARDS + i, np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.full(len(j), s, np.int32)), pa.array(block), pa.array((j // blocks[s]).astype(np.int32))], names=["shard", "src", "block", "turn"])
                        first = first + each

        return todo.mapInArrow(run, "shard long, src int, block long, turn int")

    def spans(self) -> DataFrame:
        """One row for each document and block that share words: ROW, src, block, lo and hi (words of the document)."""
        b = self.block_words
        rows = self.placed.where("size > 0").join(self.lanes.select("src", "lane", "base"), ["src", "lane"])
        first, last = F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b)
        rows = rows.withColumn("k", F.explode(F.sequence(first, last)))
        lo = F.greatest(F.col("k") * b - F.col("at"), F.lit(0))
        hi = F.least((F.col("k") + 1) * b - F.col("at"), F.col("size"))
        return rows.select(*ROW, "src", (F.col("base") + F.col("k")).alias("block"), lo.alias("lo"), hi.alias("hi"))

    def taken(self) -> DataFrame:
        """One row a document of docs with the words the mix takes from it."""
        times = self.slots().groupBy("src", "block").agg(F.count("*").alias("times"))
        words = self.spans().join(times.hint("merge"), ["src", "block"]).groupBy(*ROW).agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
        return self.placed.join(words, ROW, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of docs.

    A null text has no words and is never taken; a null source is a source of its own, last in order. Repeated rows
    are laid out one after the other and each counts. An empty table gives an empty result. The result depends on
    the rows and the seed alone.
    """
    return Mix(docs, **how).taken()


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix: for each turn the part of a text that was taken then, with all columns of docs.

    A null text is never taken, nor is an empty one; a null source is one of its own. Repeated rows each count. An empty
    table gives an empty result. A document can come twice, once for each turn. White space within a taken run of words stays as it is; runs
    that were apart are joined by a line break. n_chars, where there is such a column, is counted anew. The texts
    are shuffled once.
    """
    names = docs.columns
    mix = Mix(docs, **how)
    spans = mix.spans().join(mix.slots().hint("merge"), ["src", "block"])
    runs = spans.groupBy("_key", "_mark").agg(F.collect_list(F.struct("_nth", "turn", "lo", "hi")).alias("_runs"))
    same = Window.partitionBy("_key", "_mark").orderBy(F.lit(0))
    texts = docs.select(*numbered(docs), key_col("doc_id").alias("_key"), MARK().alias("_mark")).withColumn("_own", F.row_number().over(same))
    own = F.filter("_runs", lambda r: r["_nth"] == F.col("_own"))
    rows = texts.join(runs, ["_key", "_mark"]).select(*(f"k{i}" for i in range(len(names))), F.array_sort(F.transform(own, lambda r: F.struct(r["turn"].alias("turn"), r["lo"].alias("lo"), r["hi"].alias("hi")))).alias("_runs"))
    kinds = [f"k{i} {t}" for i, (_, t) in enumerate(docs.dtypes)]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            back, texts = [], []
            for i, (raw, each) in enumerate(zip(raw_texts(b.column(at)), b.column(len(names)).to_pylist(), strict=True)):
                starts, ends = word_spans(raw)
                for turn in dict.fromkeys(r["turn"] for r in each):
                    joined: list[list[int]] = []
                    for r in each:
                        if r["turn"] == turn:
                            if joined and joined[-1][1] == r["lo"]:
                                joined[-1][1] = r["hi"]
                            else:
                                joined.append([r["lo"], r["hi"]])
                    back.append(i)
                    texts.append(b"\n".join(raw[starts[lo] : ends[hi - 1]] for lo, hi in joined))
            cols = [c.take(pa.array(back, pa.int64())) for c in b.columns[:-1]]
            cols[at] = strings(texts)
            if "n_chars" in names:
                cols[names.index("n_chars")] = pa.array(map(code_points, texts), pa.int64()).cast(cols[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(cols, names=[f"k{i}" for i in range(len(names))])

    return renamed(rows.mapInArrow(run, ", ".join(kinds)), names)
