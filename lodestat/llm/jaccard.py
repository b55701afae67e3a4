"""The exact Jaccard similarity of two texts' sets of word shingles, for pairs that are candidates already.

Sizes and bitmaps rule out most pairs that are not similar before any text is looked at: a bitmap has the parity of the
shingles that fall on each bit, so two of them differ in at most as many bits as the sets do in shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import raw_texts, word_runs, written

SEED = 42
#: Least similarity, as a fraction.
LEAST = (4, 5)
#: Longs of a bitmap.
WORDS = 16
FACTS = f"n int, bits struct<{', '.join(f'b{i}: long' for i in range(WORDS))}>"


def shingles(raw: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles, A-Z lowered.

    With fewer than k words the whole sequence is the one shingle, and so is the empty one of a text without words.
    """
    digest = xxhash.xxh64_intdigest
    found, carry = [], []
    for words in word_runs(raw.lower()):
        words = carry + words
        if len(words) >= k:
            joined = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(size + 1) - 1
            starts = (ends - size).tolist()
            found.append(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=False)], np.uint64))
        carry = words[-(k - 1) :] if k > 1 else []
    if not found:
        return np.array([digest(b" ".join(carry), SEED)], np.uint64)
    return np.unique(np.concatenate(found))


def bitmap(found: np.ndarray) -> np.ndarray:
    """Of each bit whether an odd number of shingles falls on it."""
    ones = np.bincount((found % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").view("<i8")


def bitmaps(sets: list[np.ndarray]) -> pa.StructArray:
    """The bitmap of each set, a field a long: a join's condition then reads plain columns."""
    rows = np.stack([bitmap(s) for s in sets]) if sets else np.zeros((0, WORDS), "<i8")
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=[f"b{i}" for i in range(WORDS)])


def may_be_similar(a: str, b: str) -> Column:
    """By the sizes and bitmaps (n, bits) of two rows; true for all sets that are similar."""
    c = lambda x, y: F.col(f"{x}.{y}")
    low, high = F.least(c(a, "n"), c(b, "n")), F.greatest(c(a, "n"), c(b, "n"))
    differ = sum((F.bit_count(c(a, f"bits.b{i}").bitwiseXOR(c(b, f"bits.b{i}"))) for i in range(WORDS)), F.lit(0))
    most = (low + high) * (LEAST[1] - LEAST[0])
    return (low * LEAST[1] >= high * LEAST[0]) & (differ * (LEAST[0] + LEAST[1]) <= most)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def similar_pairs(pairs: DataFrame, texts: DataFrame, names: DataFrame, k: int = 5) -> DataFrame:
    """The pairs(a, b) of numbers whose whole sets are similar; texts(name, text) and names(node, name) give their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for a, s, t in zip(batch.column(0).to_pylist(), raw_texts(batch.column(2)), raw_texts(batch.column(3)), strict=True):
                if a != last:
                    last, held = a, shingles(s, k)
                keep.append(similar(held, shingles(t, k)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = names.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().hint("merge"), "node", "left_semi")
    one = written(texts.join(asked.hint("merge"), "name").dropDuplicates(["node"]), "jaccard-texts")
    # by the size of compressed files the planner would broadcast texts
    a, b = one.select(F.col("node").alias("a"), F.col("text").alias("ta")), one.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")
