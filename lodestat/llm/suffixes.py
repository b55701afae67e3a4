"""Suffix-array dedup of bytes by column-wise multi-document construction.

A string of WINDOW bytes can only repeat if its anchor does (see anchors). The runs of such strings, cut out with
their bytes, are the documents of the construction: a few hundred bytes each, so that the rounds - one symbol of
every document each - are few, while whole documents would need as many rounds as the longest has bytes. All runs
of one anchor meet in one task; equal runs are one. The task gathers them into collections of about COLLECTION bytes,
builds each collection's Burrows-Wheeler transform and common prefixes column by column, and reads off the strings
with a common prefix of WINDOW or more. A run that is the only one of its anchor has nothing to be compared with.

Equal windows have their anchor at the same distance from their start. So each run is cut at its anchor, the parts from
there on (alike in their first bytes at least) are the column from which the construction starts, and only the bytes
before it are inserted, a round each: at most WINDOW - GRAM rounds, and a row for every window in place of every byte.

An anchor with HOT different runs or more (a template in changing surroundings) would gather too much in one task. Its
windows are grouped by their distance from the anchor, STEP distances in a row to a group, and dealt by the bytes that
all of these hold: all but STEP - 1. If such a core still has HOT different runs or more, its windows are compared singly
by their own bytes, as a grouping and a join, where copies are one before the shuffle and AQE splits a frequent one's rows.
So no task ever holds more than HOT different runs of an anchor or core; a construction takes what comes in at most
COLLECTION bytes and those runs.

The collections stand in for the sequential external files of the method: they are read and rewritten in sequence
each round, but small enough for memory.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm import collection_bwt
from lodestat.llm.anchors import byte_units, candidates, covered, row_key
from lodestat.llm.common import MASK64, discard, key_col, raw_texts, released, written

WINDOW = 100
GRAM = 32
COLLECTION = 256 << 10
HOT = 4096
STEP = 8
LONGEST = (1 << 15) - 1  # windows of a piece
Run = tuple[int, bytes, int, int]  # hash by which it is dealt, content, start in the text, place of the anchor in the content
RUNS = "h long, content binary, _key long, _row long, s int, p int"


def finer(h: int, content: bytes, start: int, place: int, window: int) -> list[Run]:
    """The windows of a run cut wherever their distance from the anchor enters another STEP, dealt by the bytes that all of a STEP hold."""
    step = min(STEP, window)
    n = len(content) - window + 1
    out, a = [], 0
    while a < n:
        group = (place - a) // step
        b = min(n, place - group * step + 1)
        core = content[place - group * step : place - (group + 1) * step + 1 + window]
        out.append((xxhash.xxh3_64_intdigest(core, (h + group) & MASK64), content[a : b - 1 + window], start + a, place - a))
        a = b
    return out


def runs_of(raw: bytes, pieces: np.ndarray, window: int, gram: int, hot: bool | None = None) -> list[Run]:
    """The runs of a text that may repeat. pieces: start << 32, windows << 16, distance of the anchor from the start << 1,
    and a bit for those of a hot anchor. hot: only those with the bit or without."""
    out: list[Run] = []
    for x in np.unique(pieces).tolist():
        a, k, place, deep = x >> 32, x >> 16 & LONGEST, x >> 1 & LONGEST, bool(x & 1)
        if hot is not None and deep != hot:
            continue
        content = raw[a : a + k - 1 + window]
        h = xxhash.xxh3_64_intdigest(content[place : place + gram])
        out += finer(h, content, a, place, window) if deep else [(h, content, a, place)]
    return out


def mark_of(s: int, content: bytes) -> int:
    """Place and a check of the content."""
    return s << 32 | zlib.crc32(content)


def run_rows(texts: DataFrame, found: DataFrame, window: int, gram: int, hot: bool) -> DataFrame:
    """h, content, _key, _row, s, p of the runs of hot anchors or of the others; equal runs of a batch are one before the shuffle, the first of them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least: dict[bytes, tuple[int, int, int, int, int]] = {}
            for key, row, raw, starts in zip(b.column("_key").to_pylist(), b.column("_row").to_pylist(), raw_texts(b.column("text")), b.column("starts"), strict=True):
                for h, c, at, place in runs_of(raw, starts.values.to_numpy(), window, gram, hot):
                    was = least.get(c)
                    if was is None or (key, row, at) < was[:3]:
                        least[c] = (key, row, at, place, h)
            key, row, s, p, h = zip(*least.values(), strict=True) if least else [()] * 5
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(list(least), pa.binary()),
                pa.array(key, pa.int64()), pa.array(row, pa.int64()), pa.array(s, pa.int32()), pa.array(p, pa.int32()),
            ], names=["h", "content", "_key", "_row", "s", "p"])

    return texts.join(found, "_row").mapInArrow(emit, RUNS)


def judged(runs: list[tuple], window: int) -> pa.RecordBatch:
    """_row, mark, n and flags of distinct runs (h, content, _key, _row, s, p): which of their windows come later than an equal one, as bits."""
    contents = [r[1] for r in runs]
    group, string, offset = collection_bwt.repeats(contents, [r[5] for r in runs], window)
    keys, rows, starts = (np.array([r[i] for r in runs], np.int64) for i in (2, 3, 4))
    order = np.lexsort((starts[string] + offset, rows[string], keys[string], group))
    group, string, offset = group[order], string[order], offset[order]
    later = np.append(False, group[1:] == group[:-1]) if len(group) else np.zeros(0, bool)
    n = np.fromiter((len(c) - window + 1 for c in contents), np.int64, len(contents))
    base = np.cumsum(n) - n
    every = np.zeros(int(n.sum()), bool)
    every[base[string[later]] + offset[later]] = True
    some = np.bincount(string[later], minlength=len(runs)) > 0
    flags = [np.packbits(every[a : a + k]).tobytes() if x else b"" for a, k, x in zip(base.tolist(), n.tolist(), some.tolist(), strict=True)]
    return batch_of(runs, window, flags)


def batch_of(runs: list[tuple], window: int, flags: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([r[3] for r in runs], pa.int64()), pa.array([mark_of(r[4], r[1]) for r in runs], pa.int64()), pa.array(flags, pa.binary()),
    ], names=["_row", "mark", "flags"])


def judged_runs(rows: DataFrame, window: int, limit: int) -> DataFrame:
    """_row, mark, flags: for the first of equal runs its windows that come later than an equal one, as bits."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[tuple] = []  # runs of anchors that have several
        alone: list[tuple] = []
        size, last, first = 0, None, None  # first: the one run of the open anchor so far
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last is not None and row[0] == last[0]:
                    if row[1] == last[1]:
                        continue
                    if first is not None:
                        now.append(first)
                        size, first = size + len(first[1]), None
                    now.append(row)
                    size += len(row[1])
                else:
                    if first is not None:
                        alone.append(first)
                    if size >= limit:
                        yield judged(now, window)
                        now, size = [], 0
                    if len(alone) >= 1 << 13:
                        yield batch_of(alone, window, [b""] * len(alone))
                        alone = []
                    first = row
                last = row
        if first is not None:
            alone.append(first)
        if now:
            yield judged(now, window)
        yield batch_of(alone, window, [b""] * len(alone))

    dealt = rows.repartition("h").sortWithinPartitions("h", "content", "_key", "_row", "s")
    return dealt.mapInArrow(build, "_row long, mark long, flags binary")


def judged_windows(rows: DataFrame, window: int) -> DataFrame:
    """As judged_runs, for runs of at most STEP windows: each window is compared with all others by its own bytes."""
    mark = F.shiftleft(F.col("s").cast("long"), 32).bitwiseOR(F.crc32("content"))
    each = rows.select("_key", "_row", "s", mark.alias("mark"), "content", F.explode(F.sequence(F.lit(0), F.length("content") - window)).alias("i"))
    each = each.select("_row", "mark", "i", F.struct("_key", "_row", (F.col("s") + F.col("i")).alias("s")).alias("own"), F.expr(f"substring(content, i + 1, {window})").alias("w"))
    least = each.groupBy("w").agg(F.min("own").alias("least"))
    bit = F.when(F.col("own") > F.col("least"), F.expr("shiftleft(1, 7 - i)")).otherwise(0)
    runs = each.join(least, "w").groupBy("_row", "mark").agg(F.sum(bit).alias("bits"))
    return runs.select("_row", "mark", F.when(F.col("bits") == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.lpad(F.hex("bits"), 2, "0"))).alias("flags"))


def hot_runs(texts: DataFrame, found: DataFrame, window: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Runs of hot anchors, equal ones once: those of cores with fewer than hot of them, and those of the other cores.

    No run is written before the query that uses it, so that Spark takes one shuffle of the texts for these runs, the others
    and the outcome, and one shuffle of rows for all its uses. The keys of the other cores, at most one in hot of the runs,
    are broadcast, so that rows need no shuffle by them. The broadcast is a column, as a semi or anti join would go below
    the grouping, which then were two; and as one of the joins asks for an h that is not null, all do.
    """
    is_hot = lambda x: x.bitwiseAND(F.lit(1)) == 1
    some = written(found.where(F.exists("starts", is_hot)).select("_row", F.filter("starts", is_hot).alias("starts")), "hot-starts")
    first = F.min(F.struct("_key", "_row", "s", "p")).alias("first")
    released(texts.sparkSession)  # by now nothing refers to the shuffle for found any more, right after its job something may
    rows = run_rows(texts, some, window, gram, True).where(F.col("h").isNotNull()).groupBy("h", "content").agg(first).select("h", "content", "first.*")
    big = rows.groupBy("h").agg(F.count("_row").alias("n")).where(F.col("n") >= hot)  # counts a column of first, else rows without it had a shuffle of their own
    told = rows.join(F.broadcast(big), "h", "left")
    return told.where(F.col("n").isNull()).drop("n"), told.where(F.col("n").isNotNull()).drop("n")


def removed_bytes(raw: bytes, starts: np.ndarray | None, known: pa.Scalar, window: int, gram: int) -> np.ndarray | None:
    """Which bytes of a text go; None: no candidates, so none."""
    if starts is None:
        return None
    first = {r["mark"]: r["flags"] for r in known.as_py() or []}
    gone = []
    for _, content, at, _ in runs_of(raw, starts, window, gram):
        flags = first.get(mark_of(at, content))
        k = len(content) - window + 1
        if flags is None:  # an equal run comes earlier
            gone.append(np.arange(at, at + k))
        elif flags:
            gone.append(at + np.flatnonzero(np.unpackbits(np.frombuffer(flags, np.uint8), count=k)))
    return covered(len(raw), np.concatenate(gone) if gone else np.zeros(0, np.int64), window)


def byte_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = COLLECTION, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    A null or empty text has no bytes; bytes that are no UTF-8 are bytes like any others. Order is by doc_id, null with
    the least; different rows of one doc_id stand in the order of a hash of them. Rows alike in both id and text are
    one document, none of which removes another. Texts shorter than a window stay whole. An empty table gives an
    empty result. Other columns are not read. The texts are shuffled once. A window is less
    than LONGEST bytes longer than gram; doc_id is an integer.
    """
    if not 0 <= window - gram < LONGEST:
        raise ValueError(f"a window is at least a gram and less than {LONGEST} bytes longer")
    each = candidates(docs, byte_units, window, gram)
    often = written(each.groupBy("h").agg(F.countDistinct("c").alias("n")).where(F.col("n") >= hot).select("h", F.lit(1).alias("often")), "hot-anchors")
    starts = F.shiftleft(F.col("s").cast("long"), 32).bitwiseOR(F.col("w").cast("long")).bitwiseOR(F.coalesce("often", F.lit(0)).cast("long"))
    found = written(each.join(often, "h", "left").groupBy("_row").agg(F.collect_list(starts).alias("starts")), "repeated-runs")
    discard(each)
    released(docs.sparkSession)
    texts = docs.select(row_key().alias("_row"), key_col("doc_id").alias("_key"), "text", F.col("doc_id").alias("_id")).repartition("_row")
    cold = run_rows(texts, found, window, gram, False)
    if often.isEmpty():
        runs = judged_runs(cold, window, limit)
    else:
        few, many = hot_runs(texts, found, window, gram, hot)
        runs = judged_runs(cold.unionByName(few), window, limit).unionByName(judged_windows(many, window))
    rows = texts.join(found.join(runs.groupBy("_row").agg(F.collect_list(F.struct("mark", "flags")).alias("runs")), "_row", "left"), "_row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, starts, known in zip(raw_texts(b.column("text")), b.column("starts"), b.column("runs"), strict=True):
                gone = removed_bytes(raw, starts.values.to_numpy() if starts.is_valid else None, known, window, gram)
                if gone is None or not gone.any():
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                else:
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    spans = int(np.count_nonzero(np.diff(gone, prepend=False) & gone))
                    out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
