"""Document fingerprints from prefix polynomial hashes.

For a text c[0..n) of code points, H[i] = sum of c[j] * B**j for j < i, modulo a prime, is an array from which the
hash of any span follows by one subtraction (scaled by a power of B so that equal spans at different places
compare equal), and with it the longest common extension of two places by binary search. Two primes make the hash
of a span 62 bits wide.

A fingerprint is the hash of the whole text and a sketch of the hashes of all its spans of SPAN code points: BINS
bins, each with the low bits of the least hash that falls in it. The share of bins that agree estimates the
likeness of two sets of spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import decoded, key_col, mixed, written

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
SPAN = 12
BINS = 128
#: Code points handled at a time; longer texts are taken in blocks.
BLOCK = 1 << 18
FINE = 4  # hexadecimal digits of a bin


def _powers(n: int) -> list[np.ndarray]:
    out = []
    for p, b in zip(PRIMES, BASES, strict=True):
        pw = np.ones(1, np.uint64)
        while len(pw) < n:
            pw = np.concatenate([pw, pw * np.uint64(pow(b, len(pw), p)) % np.uint64(p)])
        out.append(pw[:n])
    return out


POWERS = _powers(BLOCK + SPAN + 1)


def prefix_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """H for each prime, of at most BLOCK + SPAN code points."""
    out = []
    for p, pw in zip(PRIMES, POWERS, strict=True):
        h = np.zeros(len(codes) + 1, np.uint64)
        # products are below 2**53 or so after the reduction, and a block's sum below 2**64
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * pw[: len(codes)] % np.uint64(p), out=h[1:])
        out.append(h % np.uint64(p))
    return out


def span_hash(h: list[np.ndarray], start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """62-bit hashes of spans; equal texts give equal numbers wherever they stand within blocks."""
    start = np.asarray(start)
    parts = []
    for p, pw, x in zip(PRIMES, POWERS, h, strict=True):
        d = (x[start + length] + np.uint64(p) - x[start]) % np.uint64(p)
        parts.append(d * pw[len(pw) - 1 - start] % np.uint64(p))
    return parts[0] << np.uint64(31) | parts[1]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common extension from the starts of two texts: block by block, then by binary search on prefix hashes."""
    n, at = min(len(a), len(b)), 0
    while at < n:
        size = min(BLOCK, n - at)
        ha, hb = prefix_hashes(a[at : at + size]), prefix_hashes(b[at : at + size])
        same = lambda k: all(x[k] == y[k] for x, y in zip(ha, hb, strict=True))  # noqa: B023, E731
        if not same(size):
            lo, hi = 0, size  # the first lo agree, the first hi don't
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if same(mid) else (lo, mid)
            return at + lo
        at += size
    return n


def sketch(codes: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Whole-text hash (two parts) and the least span hash of each bin (all ones: none)."""
    n = len(codes)
    least = np.full(BINS, 2**64 - 1, np.uint64)
    whole = [0, 0]
    for at in range(0, max(n, 1), BLOCK):
        part = codes[at : at + BLOCK + SPAN - 1]
        h = prefix_hashes(part)
        size = min(BLOCK, n - at)
        whole = [(w + int(x[size]) * pow(b, at, p)) % p for w, x, b, p in zip(whole, h, BASES, PRIMES, strict=True)]
        length = min(SPAN, n) if at == 0 else SPAN
        count = len(part) - length + 1
        if length and count > 0:
            m = mixed(span_hash(h, np.arange(count), length))
            bins = (m >> np.uint64(57)).astype(np.int64)
            order = np.lexsort((m, bins)) if count < 64 else None
            if order is None:
                np.minimum.at(least, bins, m)
            else:
                np.minimum.at(least, bins[order], m[order])
    return whole[0], whole[1], least


def fingerprint(text: str) -> str:
    """Length and hash of the whole text, then FINE digits for each bin; `-` marks an empty bin."""
    codes = codes_of(text)
    a, b, least = sketch(codes)
    bins = "".join("-" * FINE if x == 2**64 - 1 else f"{x & 0xFFFF:04x}" for x in least.tolist())
    return f"{len(codes):x}.{a:08x}{b:08x}.{bins}"


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, from 0 to 1: 1 for equal ones, else the share of agreeing bins among those that either has."""
    if a == b:
        return 1.0
    x, y = a.rsplit(".", 1)[1], b.rsplit(".", 1)[1]
    some = same = 0
    for i in range(0, len(x), FINE):
        p, q = x[i : i + FINE], y[i : i + FINE]
        if p[0] != "-" or q[0] != "-":
            some += 1
            same += p == q
    return same / some if some else 0.0


def edited(text: str, other: str) -> str:
    """The last half of text (rounded down) gives way to as many code points from the start of other, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_with_next long, common_with_edited long"
#: Text that a range of documents holds at most, about; smaller ones, of RANGE_DOCS documents at least, where that keeps all cores busy.
RANGE_BYTES = 128 << 20
RANGE_DOCS = 256
#: Documents looked at for each cut between ranges.
LOOKS = 16
ORDER = ["_some", "_key", "_hash"]


def places(some: np.ndarray, key: np.ndarray, text_hash: np.ndarray) -> np.ndarray:
    """Fixed-width byte strings in the order of (some, key, hash): null ids first, then by id, rows of one id by a hash of their text."""
    out = np.zeros((len(key), 17), np.uint8)
    out[:, 0] = 1 + some
    for at, x in ((1, key), (9, text_hash)):
        out[:, at : at + 8] = (x.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def cuts_of(keys: DataFrame) -> np.ndarray:
    """Where the ranges are cut (keys: ORDER and the bytes of each row), from a share of the rows that is chosen by hash; a cut never says more than an order."""
    cores = keys.sparkSession.sparkContext.defaultParallelism
    whole = keys.agg(F.count("*").alias("n"), F.sum("_bytes").alias("b")).first()
    n, size = whole["n"], whole["b"] or 0
    parts = max(-(-size // RANGE_BYTES), min(-(-n // RANGE_DOCS), 16 * cores))
    every = max(1, n // (LOOKS * parts)) if parts else 1
    looked = keys.where(F.pmod(F.xxhash64("_key", "_hash", F.lit(5)), F.lit(every)) == 0).select(*ORDER).toArrow()  # LOOKS rows a range
    at = np.sort(places(*(looked[c].to_numpy() for c in ORDER)))
    return np.unique(at[[i * len(at) // parts for i in range(1, parts)]]) if len(at) else at


def fingerprints(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: fingerprint, that of its edited text, and likeness to that and to the next document.

    Next is by descending id; after the last comes the first. Rows of one id follow each other in order of a hash of
    their text, null ids come last. Null counts as the empty text, bytes that are no UTF-8 as U+FFFD. A table of one
    row is its own next; an empty one gives an empty result. Other columns are not read.

    The rows are cut into ranges of this order, each of which is sorted and walked in one task; the row that opens a
    range is sent to the range before it too. Null or repeated ids are cut like any others, by their text.
    """
    rows = docs.select(F.col(id_col).isNotNull().cast("int").alias("_some"), key_col(id_col).alias("_key"), F.xxhash64("text").alias("_hash"), F.col(id_col).alias("_id"), F.col("text").alias("_text"))
    keys = written(rows.select(*ORDER, F.octet_length("_text").alias("_bytes")), "fingerprint-keys")
    cuts = cuts_of(keys)
    n = len(cuts) + 1

    @F.pandas_udf("int")
    def part(some: pd.Series, key: pd.Series, text_hash: pd.Series) -> pd.Series:
        """Range 0 holds the greatest."""
        return pd.Series(len(cuts) - np.searchsorted(cuts, places(some.to_numpy(np.int64), key.to_numpy(np.int64), text_hash.to_numpy(np.int64))))

    of = part(*ORDER) if n > 1 else F.lit(0)
    tops = keys.select(of.alias("_part"), *ORDER).groupBy("_part").agg(F.max(F.struct(*ORDER)).alias("top")).select("_part", "top.*").toArrow().sort_by("_part")  # one row a range
    before = np.roll(tops["_part"].to_numpy(), 1)  # before the first comes the last
    heads = docs.sparkSession.createDataFrame(tops.append_column("_before", pa.array(before, pa.int32())))
    rows = rows.withColumn("_part", of)
    ordered = rows.select("_part", F.lit(0).alias("_guest"), *ORDER, "_id", "_text")
    first = rows.join(heads, ["_part", *ORDER]).select(F.col("_before").alias("_part"), F.lit(1).alias("_guest"), *ORDER, "_id", "_text")
    dealt = ordered.unionAll(first).repartition(n, "_part").sortWithinPartitions("_part", "_guest", *(F.col(c).desc() for c in ORDER), "_text")
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next one
        for b in batches:
            ids, out = [], []
            for part, guest, one, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(5).to_pylist(), decoded(b.column(6)), strict=True):
                if held and held[0] == part and held[1]:
                    continue  # a row like the one that opens the next range
                row = (part, guest, one, text, fingerprint(text))
                if held and held[0] == part:
                    ids.append(held[2])
                    out.append(compared(held, row))
                held = row
            cols = list(zip(*out, strict=True)) or [[]] * len(OUT.split(","))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(5).type), *(pa.array(c, t) for c, t in zip(cols, KINDS, strict=True))], names=["_id", *(x.split()[0] for x in OUT.split(", "))])

    return dealt.mapInArrow(run, f"_id {kind}, {OUT}").withColumnRenamed("_id", id_col)


KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]


def compared(row: tuple, after: tuple) -> tuple:
    text, mine = row[3], row[4]
    new = edited(text, after[3])
    other = fingerprint(new)
    codes = codes_of(text)
    return (
        len(text), hashlib.sha256(new.encode()).hexdigest(), mine, other, likeness(mine, other), likeness(mine, after[4]),
        common_prefix(codes, codes_of(after[3])), common_prefix(codes, codes_of(new)),
    )
