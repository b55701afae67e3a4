"""Burrows-Wheeler transform and common prefixes of a collection of strings, built column by column.

A string is cut into a head and a tail. The tails stand for the empty suffixes: they are sorted as wholes, with their
common prefixes, and each round inserts one symbol of every head that is long enough, from the right: the suffix that is
one longer finds its row by counting its symbol above the row of the suffix before (the last-to-first map), and its
common prefixes with its neighbours follow from the least common prefix between two rows of the round before. No
suffix that reaches into a head is ever compared or sorted. Suffixes with heads of different lengths count as different at the end of the
shorter head: this suits strings whose equal parts lie at the same distance from the cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def shared(tails: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each of the sorted tails with the one before, 0 for the first."""
    m = len(tails)
    size = np.fromiter(map(len, tails), np.int64, m)
    width = int(size.max(initial=0))
    out = np.zeros(m, np.int64)
    if m > 1 and width:
        cells = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tails), np.uint8).reshape(m, width)
        differ = cells[1:] != cells[:-1]
        out[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), np.minimum(size[1:], size[:-1]))
    return out


def build(heads: list[bytes], tails: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bwt, lcp) of all suffixes that begin in a head or with a tail, the tails first; these are sorted.

    A symbol is a byte plus one; 0 marks the start of a string. lcp is that of a row with the row above, counted up
    to most.
    """
    m = len(heads)
    size = np.fromiter(map(len, heads), np.int64, m)
    ends = np.cumsum(size)
    text = np.frombuffer(b"".join(heads), np.uint8)
    text = text.astype(np.uint16) + 1 if (text == 255).any() else text + np.uint8(1)
    kind = np.min_scalar_type(most + 1)
    padded = np.append(text, np.zeros(1, text.dtype))  # its last is the mark of a start

    def before(i: np.ndarray, k: int) -> np.ndarray:
        return padded[np.where(size[i] > k, ends[i] - 1 - k, len(text))]

    active = row = np.arange(m)
    bwt, lcp = before(active, 0), np.minimum(shared(tails), most).astype(kind)
    for k in range(1, int(size.max(initial=0)) + 1):
        more = size[active] >= k
        active, row = active[more], row[more]
        n, new = len(bwt), len(active)
        order = pc.array_sort_indices(pa.array(bwt)).to_numpy().view(np.int64)  # stable, by counting
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        q = rank[row]
        by_rank = np.argsort(q)
        active, row, q = active[by_rank], row[by_rank], q[by_rank]
        place = q + (m - (n - int(np.count_nonzero(bwt))))
        symbol = bwt[row]
        # neighbours with the same first symbol, and the least common prefix on the way to them
        up, down = order[np.maximum(q - 1, 0)], order[np.minimum(q + 1, n - 1)]
        has_up, has_down = (q > 0) & (bwt[up] == symbol), (q < n - 1) & (bwt[down] == symbol)
        own = np.zeros(new, kind)
        own[has_up] = np.minimum(_least(lcp, up[has_up] + 1, row[has_up] + 1), most - 1) + 1
        under = np.minimum(_least(lcp, row[has_down] + 1, down[has_down] + 1), most - 1) + 1
        at = place - np.arange(new)  # the new rows go before these old ones
        bwt, lcp = np.insert(bwt, at, before(active, k)), np.insert(lcp, at, own)
        lcp[place[has_down] + 1] = under
        ends_segment = place[~has_down] + 1
        lcp[ends_segment[ends_segment < n + new]] = 0  # another first symbol
        row = place
    return bwt, lcp


def _least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo:hi]) for each pair, lo < hi, pairs of one symbol in ascending order.

    Taken from the last to the first: there a pair ends behind the begin of the next, so nothing between them is read.
    """
    if not len(lo):
        return np.zeros(0, x.dtype)
    edges = np.column_stack((lo[::-1], hi[::-1])).ravel()
    return np.minimum.reduceat(np.append(x, x[-1:]), edges)[::2][::-1]


def rows_of(bwt: np.ndarray, m: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """String and length within the head of every row, by walking the last-to-first map from the tails."""
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), np.int64)
    step[order] = np.arange(len(bwt))
    string, length = np.empty(len(bwt), np.int32), np.zeros(len(bwt), np.int32)
    at, own = np.arange(m), np.arange(m, dtype=np.int32)
    string[at] = own
    for k in range(1, rounds + 1):
        go = bwt[at] != 0
        at, own = step[at[go]], own[go]
        string[at], length[at] = own, k
    return string, length


def repeats(strings: list[bytes], cuts: list[int], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """group, string, offset of every window of a length that occurs twice or more in the collection.

    A window begins at its string's cut or before, and windows count as equal only at the same distance from their cuts.
    """
    tails = [s[c : c + window] for s, c in zip(strings, cuts, strict=True)]
    by_tail = sorted(range(len(strings)), key=tails.__getitem__)
    bwt, lcp = build([strings[i][: cuts[i]] for i in by_tail], [tails[i] for i in by_tail], window)
    string, length = rows_of(bwt, len(strings), max(cuts, default=0))
    joins = lcp >= window
    inside = joins | np.append(joins[1:], False) if len(joins) else joins
    group = np.cumsum(~joins)[inside]
    string = np.array(by_tail, np.int64)[string[inside]]
    return group, string, np.array(cuts, np.int64)[string] - length[inside]
