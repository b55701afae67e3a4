"""Anchors: a content-defined choice of short windows, from which repeated long windows are found.

A text is a sequence of units (words or bytes). In every window of `window` units one gram of `gram` units is the
anchor: the one with the least scrambled hash, the leftmost of equals. Equal windows have equal anchors at equal
places in them, so a window can only repeat if its anchor does. Windows in a row that share their anchor form a
piece. Only pieces whose anchor occurs twice in the collection are looked at again.

A document is told apart by _row, a hash of its id and text; documents stand in order of _key, the id (null as the
least), then of _row. Rows that are alike in both id and text are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import key_col, mixed, raw_texts, released, word_runs, written

#: Units that are hashed at a time; a longer text is taken in overlapping blocks.
BLOCK = 1 << 20
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
Units = Callable[[bytes], np.ndarray]


def word_units(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    runs = [np.fromiter(map(digest, w), np.uint64, len(w)) for w in word_runs(raw)]
    return np.concatenate(runs) if runs else np.zeros(0, np.uint64)


def byte_units(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)


_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(which: int, n: int, inverse: bool) -> np.ndarray:
    held = _powers.get((which, inverse))
    if held is None or len(held) < n:
        b = pow(_ODD[which], -1, 1 << 64) if inverse else _ODD[which]
        held = np.full(max(n, 4096), b, np.uint64)
        held[0] = 1
        held = np.cumprod(held)
        _powers[which, inverse] = held
    return held[:n]


def prefix_sums(units: np.ndarray, which: int = 0) -> np.ndarray:
    """From these sums the hash of any span follows by one subtraction; see spans."""
    u = _OF_BYTE[units] if units.dtype == np.uint8 else units
    if which:
        u = mixed(u + np.uint64(0xA0761D6478BD642F))
    prefix = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(u * _power(which, len(units), False), out=prefix[1:])
    return prefix


def spans(units: np.ndarray, start: np.ndarray, size: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of spans of any sizes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    prefix = prefix_sums(units, which)
    return (prefix[start + size] - prefix[start]) * _power(which, len(prefix), True)[start]


def window_hashes(units: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of every window of size units."""
    n = len(units)
    if n < size:
        return np.zeros(0, np.uint64)
    prefix = prefix_sums(units, which)
    return (prefix[size:] - prefix[: n - size + 1]) * _power(which, n - size + 1, True)


def pieces(units: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Start of the first window, number of windows, anchor hash, anchor place and a hash of all units of each piece of a text."""
    starts, counts, hashes, places, wholes = [], [], [], [], []
    n = len(units)
    for at in range(0, max(1, n - window + 1), BLOCK):
        part = units[at : at + BLOCK + window - 1]
        if len(part) < window:
            break
        prefix, power = prefix_sums(part), _power(0, len(part) + 1, True)
        h = mixed((prefix[gram:] - prefix[: len(part) - gram + 1]) * power[: len(part) - gram + 1])
        width = window - gram + 1
        # the place in the low bits makes the leftmost of equals the least
        keys = (h & np.uint64(~((1 << 22) - 1) & (2**64 - 1))) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(keys) // width) * width, 2**64 - 1, np.uint64)
        padded[: len(keys)] = keys
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(keys) - width + 1
        least = np.minimum(back[:m], ahead[width - 1 : width - 1 + m])
        place = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
        s = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        starts.append(s + at)
        counts.append(np.diff(np.append(s, m)))
        wholes.append((prefix[s + counts[-1] + window - 1] - prefix[s]) * power[s])
        hashes.append(h[place[s]])
        places.append(place[s] + at)
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none, np.zeros(0, np.uint64)
    return tuple(map(np.concatenate, (starts, counts, hashes, places, wholes)))


def row_key(id_col: str = "doc_id") -> F.Column:
    return F.xxhash64(F.col(id_col), F.col("text"))


def keyed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """_row, _key and text."""
    return docs.select(row_key(id_col).alias("_row"), key_col(id_col).alias("_key"), F.col("text"))


def anchor_rows(docs: DataFrame, units: Units, window: int, gram: int, step: int = 0) -> DataFrame:
    """h, _row, s, n: a row a piece, from the scan itself.

    Within a batch of documents the rows of one anchor are summed up before they are shuffled: the first stands
    for all (n is 2), the others are known to repeat (n is 0) and need not meet it. So a hot anchor sends a row a batch.

    Without a step there are also c, a check (16 bits) of all units of the piece's windows, and w, its number of windows << 16
    and the distance of the anchor from its start << 1. With a step, one in so many anchors (by hash, so the same ones in equal texts) is a rung: it also has its place p,
    the _key and, of the windows from there of one, two, four, ... times the length, as far as the text goes, the hashes
    hs and cs (32 bits more).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, longer, held, checks, wheres = [], [], [], [], []
            for t in raw_texts(b.column(2)):
                u = units(t)
                got.append(pieces(u, window, gram))
                if step:
                    hs, cs, size = rungs(u, got[-1], window, step)
                    longer.append((hs, cs))
                    held.append(size)
                else:
                    checks.append(mixed(got[-1][4]) >> np.uint64(48))
                    wheres.append(got[-1][1] << 16 | (got[-1][3] - got[-1][0]) << 1)
            h, s, p = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, t) for i, t in ((2, np.uint64), (0, np.int64), (3, np.int64)))
            sizes = [len(g[0]) for g in got]
            row = np.repeat(b.column(0).to_numpy(), sizes)
            order = np.argsort(h, kind="stable")
            h, s, row = h[order], s[order], row[order]
            first = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
            size = np.diff(np.append(np.flatnonzero(first), len(h)))
            n = np.zeros(len(h), np.int8)
            n[first] = np.minimum(size, 2)
            slot = np.where(n > 0, h, mixed(row.astype(np.uint64) * np.uint64(31) + s.astype(np.uint64)))
            cols = {"h": pa.array(h.view(np.int64)), "slot": pa.array(slot.view(np.int64)), "_row": pa.array(row), "s": pa.array(s.astype(np.int32)), "n": pa.array(n)}
            if step:
                size = np.concatenate(held) if held else np.zeros(0, np.int64)
                none = size == 0
                ends, take = pa.array(np.append(0, np.cumsum(size)).astype(np.int32), mask=np.append(none, False)), pa.array(order)
                for name, i, kind in (("hs", 0, np.int64), ("cs", 1, np.int32)):
                    values = np.concatenate([x[i] for x in longer]) if longer else np.zeros(0, kind)
                    cols[name] = pa.ListArray.from_arrays(ends, pa.array(values.view(kind))).take(take)
                cols["p"] = pa.array(p[order].astype(np.int32), mask=none[order])
                cols["_key"] = pa.array(np.repeat(b.column(1).to_numpy(), sizes)[order], mask=none[order])
            else:
                c = np.concatenate(checks) if checks else np.zeros(0, np.uint64)
                cols["c"] = pa.array(c[order].astype(np.uint16).view(np.int16))
                w = np.concatenate(wheres) if wheres else np.zeros(0, np.int64)
                cols["w"] = pa.array(w[order].astype(np.int32))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return keyed(docs).mapInArrow(run, "h long, slot long, _row long, s int, n byte" + (RUNG if step else ", c short, w int"))


RUNG = ", hs array<long>, cs array<int>, p int, _key long"


def rungs(units: np.ndarray, got: tuple, window: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (two parts) of the longer windows of one anchor after the other; how many each anchor has, 0 where it is no rung."""
    _, _, h, p, _ = got
    left = np.where(h % np.uint64(step) == 0, (len(units) - p) // window, 0)
    size = np.frexp(left.astype(float))[1].astype(np.int64)  # of the lengths window, 2 * window, 4 * window, ... those that fit
    n = int(size.sum())
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), size
    level = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    at, length = np.repeat(p, size), window << level
    return spans(units, at, length), (spans(units, at, length, 1) >> np.uint64(32)).astype(np.uint32), size


def repeated(rows: DataFrame) -> DataFrame:
    """The rows (without slot and n) whose hash has a sum of n of two or more, or that were known to repeat."""
    names = [c for c in rows.columns if c not in ("slot", "n")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # the group that is open and repeats; the one row of the open group if its sum is 1 so far
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            h, n = b.column("h").to_numpy(), b.column("n").to_numpy()
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            total = np.add.reduceat(n.astype(np.int64), at)
            if h[0] == last:
                total[0] += 2
            keep = (np.repeat(total, np.diff(np.append(at, len(h)))) >= 2) | (n == 0)
            last, held = h[-1] if total[-1] >= 2 else None, None
            if total[-1] == 1:
                held = b.slice(at[-1] + int(np.argmax(n[at[-1] :] == 1)), 1)
            yield b.filter(pa.array(keep)).select(names)

    kinds = dict(rows.dtypes)
    dealt = rows.repartition("slot").select("n", *names).sortWithinPartitions("h")
    return dealt.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def candidates(docs: DataFrame, units: Units, window: int, gram: int, step: int = 0) -> DataFrame:
    """A written table of the pieces whose anchor occurs twice or more: h, _row, s, and c and w or, with a step, the columns of RUNG."""
    out = written(repeated(anchor_rows(docs, units, window, gram, step)), "repeated-pieces")
    released(docs.sparkSession)
    return out


def chosen(units: np.ndarray, starts: list[int] | np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, counts, anchor hashes and anchor places of the pieces of a text that are among starts."""
    s, n, h, p, _ = pieces(units, window, gram)
    own = np.isin(s, np.asarray(starts, np.int64))
    return s[own], n[own], h[own], p[own]


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... of count[0] numbers, then those of the next."""
    if not len(first):
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(ends[-1]) - np.repeat(ends - count, count) + np.repeat(first, count)


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n units lie in a window that begins at one of starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:n] > 0
