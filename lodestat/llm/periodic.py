"""Periodic runs of words by an online sparse dynamic program over diagonals.

A diagonal is a lag q: word i matches on it where word i - q is the same. The match length of a lag grows while that
goes on; where it ends with m matches, the m + q words from the first matched one's partner on have the period q. A
lag is active only from where an earlier occurrence of the words at hand opens it, and a diagonal that ends long
enough emits its run at once.

Single words would open a diagonal for every earlier occurrence of "the". A run of period q has at least
max(12 - q, q) matches, so it is enough that the GRAM words from here on occurred before (lags under 12), the 12
words (lags 12 to 23), the 24 words (lags 24 to 47), and so on: none that can still become a run is left out.
From 12 words on, those that lie within a known run of a period up to half their number open nothing: what is left
occurs at most four times within the lags of its level, because nearer occurrences would make such a run. That
leaves out the run whose first half lies in one run of a short period and whose second half in another one; these
two then touch, and the lags between them are opened from there (`between`). So a text of n words costs some
n log n steps, whatever it repeats. An active lag advances many words at a time, on the words themselves; hashes
only open diagonals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import crc32_sql, mixed, raw_texts, word_runs

#: Least length of a run, and the words that open a lag under it.
LEAST, GRAM = 12, 6
#: Kept words that are joined and hashed at a time.
JOINED = 1 << 16
_EMPTY = np.zeros(0, np.int64)
_STATS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def numbered_words(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a whole text as numbers, and the word of each number."""
    seen: dict[bytes, int] = {}
    ids = [np.fromiter([seen.setdefault(w, len(seen)) for w in words], np.int64, len(words)) for words in word_runs(raw)]
    return (np.concatenate(ids) if ids else _EMPTY), list(seen)


def looped(ids: np.ndarray, h: int) -> np.ndarray:
    """Where h % 10 is 0: from word a on the text repeats p words; a and p follow from h."""
    n, g = len(ids), h // 10
    if h % 10 or not n:
        return ids
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], np.resize(ids[a : a + p], n - a)])


def match_start(ids: np.ndarray, at: int, lag: int) -> int:
    """The first word of the matches on this lag that go on up to word at."""
    step = 32
    while at > lag:
        low = max(lag, at - step)
        differ = np.flatnonzero(ids[low:at] != ids[low - lag : at - lag])
        if len(differ):
            return low + int(differ[-1]) + 1
        at, step = low, 2 * step
    return at


def match_end(ids: np.ndarray, at: int, lag: int) -> int:
    """Behind the last word of the matches on this lag that go on from word at."""
    step = 32
    while at < len(ids):
        high = min(len(ids), at + step)
        differ = np.flatnonzero(ids[at:high] != ids[at - lag : high - lag])
        if len(differ):
            return at + int(differ[0])
        at, step = high, 2 * step
    return at


def earlier(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place the last one before it with the same hash, -1 if none; and the places whose hash recurs."""
    h = hashes[places]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    prev = np.full(len(hashes), -1, np.int64)
    prev[places[order[1:][same]]] = places[order[:-1][same]]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return prev, places[again]


def opened(prev: np.ndarray, places: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place) of earlier occurrences from low to high words away, by lag and place; only the first of neighbours on a lag."""
    at, back, found = places, prev[places], []
    while len(at := at[ok := (back >= 0) & (at - back <= high)]):
        back = back[ok]
        far = at - back >= low
        found.append((at[far] - back[far], at[far]))
        back = prev[back]
    if not found:
        return _EMPTY, _EMPTY
    lag, place = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((place, lag))
    lag, place = lag[order], place[order]
    first = np.ones(len(lag), bool)
    first[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
    return lag[first], place[first]


def between(ids: np.ndarray, a: tuple[int, int], b: tuple[int, int], p: int) -> Iterator[tuple[int, int, int]]:
    """(lag, first match, end) of the diagonals on which run b repeats run a; both have period p and b begins before a has ended, or there.

    Words of both runs match on a lag if they do for p words, so every p-th lag matches wherever both runs reach.
    """
    (a_start, a_end), (b_start, b_end) = a, b
    unit, there = ids[a_end : a_end + p].tobytes(), ids[a_end - 2 * p + 1 : a_end].tobytes()
    at = there.find(unit)
    while at >= 0 and at % ids.itemsize:
        at = there.find(unit, at + 1)
    if at < 0:
        return
    for lag in range(2 * p - 1 - at // ids.itemsize, a_end - a_start + 1, p):
        first, end = max(b_start, a_start + lag), min(b_end, a_end + lag)
        first = match_start(ids, first, lag) if b_start == a_start + lag else first
        yield lag, first, match_end(ids, end, lag) if b_end == a_end + lag else end


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run, by start and period."""
    n, found = len(ids), {}
    if n < LEAST:
        return []

    def emit(lag: int, first: int, end: int) -> None:
        """A diagonal has ended; equal stretches keep their smallest period."""
        if end - first + lag >= max(LEAST, 2 * lag):
            key = first - lag, end - first + lag
            found[key] = min(lag, found.get(key, lag))

    unit = mixed(ids.astype(np.uint64) + np.uint64(1))
    base = np.uint64(0x9E3779B97F4A7C15)
    hashes, power = unit[: n - GRAM + 1].copy(), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(1, GRAM):
            hashes = hashes * base + unit[k : n - GRAM + 1 + k]
        for _ in range(GRAM):
            power = power * base
        size, low, high = GRAM, 1, LEAST - 1
        ordered = np.sort(hashes)
        places = np.arange(len(hashes)) if (ordered[1:] == ordered[:-1]).any() else _EMPTY
        while len(places) and 2 * low <= n:
            prev, places = earlier(hashes, places)
            fresh = np.ones(len(hashes), bool)
            if size >= LEAST:
                short: dict[int, list[tuple[int, int]]] = {}
                for (start, length), period in sorted(found.items()):
                    if 2 * period <= size:
                        short.setdefault(period, []).append((start, start + length))
                        fresh[start : max(start, start + length - size + 1)] = False
                for period in [p for p in short if 4 * p > size or size == LEAST]:
                    for a, b in zip(short[period], short[period][1:]):
                        for lag, first, end in between(ids, a, b, period) if b[0] <= a[1] else ():
                            emit(lag, first, end)
            active: dict[int, int] = {}
            for lag, at in zip(*(x.tolist() for x in opened(prev, places[fresh[places]], low, high)), strict=True):
                if at < active.get(lag, 0):
                    continue
                first, end = match_start(ids, at, lag), match_end(ids, at, lag)
                active[lag] = end
                emit(lag, first, end)
            places = places[places + 2 * size <= n]
            hashes = hashes[:-size] * power + hashes[size:] if len(places) else hashes
            power = power * power
            size, low, high = 2 * size, max(LEAST, 2 * low), max(2 * LEAST, 2 * low * 2) - 1
    return sorted((start, length, period) for (start, length), period in found.items())


def text_runs(raw: bytes, h: int) -> tuple:
    """The columns of _STATS for one whole text."""
    ids, names = numbered_words(raw)
    ids = looped(ids, h)
    runs = runs_of(ids)
    keep = np.ones(len(ids), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    kept, sha = ids[keep], hashlib.sha256()
    for at in range(0, len(kept), JOINED):
        sha.update((b" " if at else b"") + b" ".join([names[i] for i in kept[at : at + JOINED].tolist()]))
    listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode())
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *longest, listed.hexdigest(), sha.hexdigest())


def periodic_runs(docs: DataFrame, salt: str = "doc_id") -> DataFrame:
    """doc_id and _STATS of every row: its runs, the longest one, and its words without what runs repeat.

    One text in ten, by the CRC-32 of its id, gets a tail that loops before it is judged. A null or empty text has no
    words and no run; a null id counts as the empty text for its CRC. Repeated rows each get their own row, of equal
    runs the first and shortest period is named. An empty table gives an empty result. Other columns are not read. A
    text is one task's work: some 100 bytes of memory a word.
    """
    h = F.crc32(F.coalesce(F.col(salt).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"))
    fields = [x.split() for x in _STATS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(text_runs, raw_texts(b.column(1)), b.column(2).to_pylist()), strict=True)) or [[] for _ in fields]
            kinds = [pa.int64() if k == "long" else pa.string() for _, k in fields]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *(f for f, _ in fields)])

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {_STATS}")


#: Every pair of equal 6-word stretches of a text on every lag; islands of neighbouring pairs are the matches.
SQL = f"""
with own as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words, {crc32_sql('doc_id::varchar')} as h from documents),
sized as (select doc_id, words, len(words) as n, h % 10 = 0 and len(words) > 0 as loops, h // 10 as g, case when len(words) > 0 then (h // 10) % len(words) else 0 end as a from own),
periods as (select *, 1 + (n - a) // (3 + g % 8) as p from sized),
texts as (select doc_id, n, case when loops then list_transform(range(n), lambda i: words[(case when i >= a then a + (i - a) % p else i end) + 1]) else words end as words from periods),
grams as (select doc_id, n, i, array_to_string(words[i + 1:i + 6], ' ') as gram from (select *, unnest(range(n - 5)) as i from texts where n >= 12)),
pairs as (select x.doc_id, y.i - x.i as q, y.i from grams x join grams y on x.doc_id = y.doc_id and x.gram = y.gram and x.i < y.i and 2 * (y.i - x.i) <= x.n),
islands as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from pairs),
matches as (select doc_id, q, min(i) - q as start, count(*) + 5 + q as length from islands group by doc_id, q, island),
runs as (select doc_id, start, length, min(q) as period from matches where length >= greatest(12, 2 * q) group by doc_id, start, length),
listed as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines,
    first(struct_pack(start, length, period) order by length desc, start, period) as best from runs group by doc_id),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (select t.doc_id, string_agg(t.word, ' ' order by t.i) as words from (select doc_id, unnest(words) as word, unnest(range(n)) as i from texts) t
    left join gone g on g.doc_id = t.doc_id and g.i = t.i where g.i is null group by t.doc_id)
select d.doc_id, coalesce(l.n_runs, 0)::bigint as n_runs, l.best.start::bigint as start, l.best.length::bigint as length, l.best.period::bigint as period,
    (1000 * l.best.length // l.best.period)::bigint as exponent_milli, sha256(coalesce(l.lines, '')) as runs_sha256, sha256(coalesce(k.words, '')) as collapsed_sha256
from documents d left join listed l on l.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id
"""
