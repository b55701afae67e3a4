"""Substring dedup by level-wise doubling over words.

Level one: windows of half the length. Only a content-defined choice of them is hashed (anchors: every full window
holds one), because the disk limit does not hold all windows of all words; those that occur once are out. From
there on windows that repeat at one length alone are extended to twice that length - 20, 40, 80, ... words - until
no candidates survive (levels). For this ladder one anchor in STEP is taken, again by content.

A window of 40 or more words that an earlier document has too removes all its words at once; it covers the full
windows inside it. Only full windows around repeated anchors that no such window covers are then told apart one by
one, and of those with equal words the earliest stays. The earliest of all is never covered, or what covers it would
have come earlier still; so the outcome is that of judging every full window.

The texts are shuffled once, by row; both passes over them read that exchange. Hashes of windows have 96 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.anchors import candidates, chosen, covered, ranges, row_key, window_hashes, word_units
from lodestat.llm.common import code_points, discard, key_col, raw_texts, released, renamed, strings, word_spans, written

WINDOW = 20
STEP = 8


def _windows(units: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window that begins at starts, and place << 32 | a second hash of 32 bits."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, c = window_hashes(units, window)[starts], window_hashes(units, window, 1)[starts] >> np.uint64(32)
    return h, (starts.astype(np.uint64) << np.uint64(32) | c).view(np.int64)


def levels(ladder: DataFrame, window: int = WINDOW) -> DataFrame:
    """_row, covers: for each document the places << 32 | lengths at which windows begin that an earlier document has.

    ladder: _row, _key, p, hs, cs of the rungs whose anchor repeats. A level looks only at what repeated at the level
    before, and the levels end when nothing does.
    """
    found, level, now = [], 0, ladder
    while True:
        at = now.where(F.size("hs") > level).withColumn("h", F.col("hs")[level]).withColumn("c", F.col("cs")[level])
        groups = at.groupBy("h", "c").agg(F.count("*").alias("n"), F.min("_key").alias("least")).where("n > 1").drop("n")
        alive = written(at.join(groups, ["h", "c"]).drop("h", "c"), "doubling-level")
        found.append(alive.where(F.col("_key") > F.col("least")).select("_row", F.shiftleft(F.col("p").cast("long"), 32).bitwiseOR(F.lit(window << level)).alias("at")))
        now, level = alive.drop("least"), level + 1
        if alive.isEmpty():
            break
    every = found[0]
    for f in found[1:-1]:
        every = every.unionAll(f)
    return every.groupBy("_row").agg(F.collect_list("at").alias("covers"))


def inside(n: int, covers: np.ndarray | None, window: int) -> np.ndarray:
    """Which of the n windows of a text lie in one of its covers."""
    edge = np.zeros(n + 1, np.int64)
    if covers is not None:
        p, size = covers >> 32, covers & 0xFFFFFFFF
        np.add.at(edge, p, 1)
        np.add.at(edge, p + size - window + 1, -1)
    return np.cumsum(edge)[:n] > 0


def around(units: np.ndarray, starts: np.ndarray, covers: np.ndarray | None, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows around repeated anchors: those in no cover, and those in one."""
    s, n, *_ = chosen(units, starts, window, gram)
    at = ranges(s, n)
    known = inside(max(0, len(units) - window + 1), covers, window)[at]
    return at[~known], at[known]


def first_windows(texts: DataFrame, found: DataFrame, window: int, gram: int) -> DataFrame:
    """_row, firsts: of the windows around the pieces in found that no cover holds, those that come first in the collection.

    Equal windows of a batch are one before the shuffle: the first of them is the only one that can be first of all.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, keys, rows, marks = [], [], [], []
            for i, raw in enumerate(raw_texts(b.column("text"))):
                units = word_units(raw)
                at, _ = around(units, _lists(b, i, "starts"), _lists(b, i, "covers"), window, gram)
                h, mark = _windows(units, at, window)
                hs.append(h)
                marks.append(mark)
                keys.append(np.full(len(h), b.column("_key")[i].as_py(), np.int64))
                rows.append(np.full(len(h), b.column("_row")[i].as_py(), np.int64))
            h, key, row, mark = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hs, np.uint64), (keys, np.int64), (rows, np.int64), (marks, np.int64)))
            c, place = mark & 0xFFFFFFFF, mark >> 32
            order = np.lexsort((place, row, key, c, h))
            h, key, row, mark, c = h[order], key[order], row[order], mark[order], c[order]
            first = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])) if len(h) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(c[first].astype(np.int64)), pa.array(key[first]), pa.array(row[first]), pa.array(mark[first])], names=["h", "c", "_key", "_row", "mark"])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if b.num_rows:
                h, c = b.column(0).to_numpy(), b.column(1).to_numpy()
                first = np.append((h[0], c[0]) != last, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
                last = (h[-1], c[-1])
                yield pa.RecordBatch.from_arrays([pa.array(b.column(3).to_numpy()[first]), pa.array(b.column(4).to_numpy()[first])], names=["_row", "mark"])

    # no select here: with the same columns as in the last pass, the exchange of the texts is the same too
    rows = texts.join(found, "_row").mapInArrow(emit, "h long, c long, _key long, _row long, mark long")
    dealt = rows.repartition("h").sortWithinPartitions("h", "c", "_key", "_row", "mark")
    return dealt.mapInArrow(least, "_row long, mark long").groupBy("_row").agg(F.collect_list("mark").alias("firsts"))


def removed_words(raw: bytes, starts: np.ndarray | None, covers: np.ndarray | None, firsts: np.ndarray | None, window: int, gram: int) -> np.ndarray | None:
    """Which words of a text go; None: no candidate windows, so none."""
    if starts is None:
        return None
    units = word_units(raw)
    at, known = around(units, starts, covers, window, gram)
    _, mark = _windows(units, at, window)
    again = at if firsts is None else at[~np.isin(mark, firsts)]
    return covered(len(units), np.concatenate([again, known]), window)


def joined(docs: DataFrame, rest: list, window: int, gram: int, step: int = STEP) -> DataFrame:
    """_row, _key, text, rest, starts, covers, firsts for every row of docs."""
    each = candidates(docs, word_units, window, gram, step)
    covers = levels(each.where("p is not null").select("_row", "_key", "p", "hs", "cs"), window)
    found = written(each.groupBy("_row").agg(F.collect_list("s").alias("starts")).join(covers, "_row", "left"), "doubling-candidates")
    discard(each)
    released(docs.sparkSession)
    texts = docs.select(row_key().alias("_row"), key_col("doc_id").alias("_key"), "text", *rest).repartition("_row")
    firsts = first_windows(texts, found, window, gram)
    return texts.join(found.join(firsts, "_row", "left"), "_row", "left")


def _lists(b: pa.RecordBatch, i: int, column: str) -> np.ndarray | None:
    x = b.column(column)[i]
    return x.values.to_numpy() if x.is_valid else None


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    A null or empty text has no words; what is kept of it is the empty string. Order is by doc_id, null with the
    least; different rows of one doc_id stand in the order of a hash of them. Rows alike in both id and text are one
    document, none of which removes another. Texts shorter than a window stay whole. An empty table gives an empty
    result. Other columns are not read.
    """
    gram = max(1, window // 2)
    rows = joined(docs, [F.col("doc_id").alias("_id")], window, gram)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, raw in enumerate(raw_texts(b.column("text"))):
                gone = removed_words(raw, _lists(b, i, "starts"), _lists(b, i, "covers"), _lists(b, i, "firsts"), window, gram)
                words = raw.split()
                n = len(words)
                if gone is not None:
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words taken out of text; a removed run leaves one line break. n_chars follows the text.

    Rows from which nothing goes are as they were. A row from which every word goes stays, with an empty text. Nulls,
    ties and repeated rows are as in substring_dedup. An empty table gives an empty result. Columns may have any names.
    """
    names = docs.columns
    gram = max(1, window // 2)
    others = [c for c in names if c != "text"]
    rows = joined(docs, [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(others)], window, gram)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for i, raw in enumerate(raw_texts(b.column("text"))):
                gone = removed_words(raw, _lists(b, i, "starts"), _lists(b, i, "covers"), _lists(b, i, "firsts"), window, gram)
                if gone is None or not gone.any():
                    texts.append(raw if b.column("text")[i].is_valid else None)
                    continue
                starts, ends = word_spans(raw)
                edge = np.flatnonzero(np.diff(~gone, prepend=False, append=False))
                texts.append(b"\n".join(raw[starts[lo] : ends[hi - 1]] for lo, hi in zip(edge[::2], edge[1::2], strict=True)))
            cols = {c: b.column(f"k{i}") for i, c in enumerate(others)}
            if "n_chars" in cols:
                was = cols["n_chars"].to_pylist()
                now = [w if t is None or not b.column("starts")[i].is_valid else code_points(t) for i, (t, w) in enumerate(zip(texts, was, strict=True))]
                cols["n_chars"] = pa.array(now, cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays([strings(texts) if c == "text" else cols[c] for c in names], names=[f"c{i}" for i in range(len(names))])

    return renamed(rows.mapInArrow(run, ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(names))), names, "c")


#: The same in SQL, for ids that are not repeated: every window of every text at once.
SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, unnest(range(1, len(w) + 1)) as pos, unnest(w) as word from w),
g as (select doc_id, i as pos, array_to_string(w[i:i + 19], ' ') as g from w, unnest(range(1, len(w) - 18)) t(i)),
f as (select doc_id, pos, row_number() over (partition by g order by doc_id, pos) > 1 as later from g),
c as (select p.doc_id, p.pos, p.word, coalesce(bool_or(later) over (partition by p.doc_id order by p.pos rows between 19 preceding and current row), false) as gone
      from p left join f on f.doc_id = p.doc_id and f.pos = p.pos),
k as (select doc_id, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by pos) filter (not gone) as kept from c group by 1)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k on k.doc_id = w.doc_id
"""
