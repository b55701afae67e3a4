"""Characters of texts as small numbers, by a table of all code points, for Arrow functions that look at every one."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

#: Characters that are looked up at a time.
BLOCK = 1 << 20
POINTS = 0x110000


def texts_of(column: pa.Array) -> list[str | None]:
    """The texts, bytes that are no UTF-8 as U+FFFD."""
    return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def looked_up(text: str, table: np.ndarray) -> np.ndarray:
    """The table's number of every character."""
    parts = [table[np.frombuffer(text[i : i + BLOCK].encode("utf-32-le"), "<u4")] for i in range(0, len(text), BLOCK)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, table.dtype), *parts])


@cache
def kinds_of_letters() -> np.ndarray:
    r"""3 for [0-9], 2 for \s of SQL, 1 for what else is no \p{L}, 0 for letters."""
    out = np.fromiter((unicodedata.category(chr(i))[0] != "L" for i in range(POINTS)), np.uint8, POINTS)
    out[[ord(c) for c in "\t\n\f\r "]] = 2
    out[ord("0") : ord("9") + 1] = 3
    return out


@cache
def syllables_of_letters(vowels: str) -> np.ndarray:
    """Vowels in the lower-cased character."""
    out = np.zeros(POINTS, np.uint8)
    for i in range(0x10000):
        out[i] = sum(c in vowels for c in chr(i).lower())
    return out
