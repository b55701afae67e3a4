"""Quality by non-negative positive-unlabelled learning (see `pu`).

The trusted positives are texts labelled good, the unlabelled ones come from the corpus, and the class prior, the
share of good texts in it, is estimated from both (`pu.class_prior`), not from the labels: those marked bad are never
read. Features are the distinct words, their shapes (an upper-case letter as A, another letter as a, a digit as 9,
other characters as they are, runs of the same as one) and what the whole text is like: shares of kinds of
characters, of repeated lines and words, length of lines and words, each in steps. A text without words has only those.

Since most texts are good, what tells bad texts is rare among the unlabelled: features enter that one unlabelled text
or positive in RARE has (at least four) and whose share differs significantly between the two, either way.

The classifier is fitted on a bounded sample: at most POSITIVES trusted and UNLABELLED unlabelled texts, those with
the least hashes of their ids. Scoring reads every whole text.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm import pu

POSITIVES = 8192
UNLABELLED = 16384
#: Most features of the classifier, and the least significance, in standard errors.
FEATURES, SIGNIFICANT = 4096, 4.0
RARE = 500
FOLDS, FOLD = 3, 1
#: Bytes of a shape.
LONG = 40
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in range(256))
_KINDS = {
    b"upper": bytes(range(65, 91)), b"lower": bytes(range(97, 123)), b"high": bytes(range(128, 256)), b"digit": bytes(range(48, 58)),
    b"stop": b".,;:!?'\"()-", b"sign": b"#*$%&|<>/\\=+~^_@{}[]`",
}


def step(share: float) -> int:
    """0 to 20, finer near 0."""
    return int(20 * math.sqrt(min(1.0, share)))


def marks(raw: bytes, words: list[bytes], distinct: int) -> set[bytes]:
    """What the whole text is like."""
    n, size = len(words), max(1, sum(map(len, words)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    many = n.bit_length()
    out = {b"\x00words:%d" % many, b"\x00length:%d" % (size // max(1, n)), b"\x00line:%d" % (n // max(1, len(lines))).bit_length()}
    for name, kind in _KINDS.items():
        out.add(b"\x00%s:%d" % (name, step((len(raw) - len(raw.translate(None, kind))) / size)))
    fresh = step(distinct / max(1, n))
    out |= {b"\x00lines:%d" % step(1 - len(set(lines)) / max(1, len(lines))), b"\x00fresh:%d" % fresh, b"\x00fresh:%d:%d" % (many, fresh)}
    return out


def shapes(raw: bytes) -> set[bytes]:
    """The distinct shapes of the words of a text."""
    units = np.frombuffer(raw.translate(_SHAPE), np.uint8)
    first = np.ones(len(units), bool)
    first[1:] = units[1:] != units[:-1]
    return {b"\x00shape:" + x[:LONG] for x in set(units[first].tobytes().split())}


def features(text: str) -> set[bytes]:
    """The distinct words of a text, their shapes, and its marks."""
    raw = text.encode("utf-8", "surrogatepass").replace(b"\x00", b" ")
    words = raw.split()
    out = set(words)
    return out.union(shapes(raw), marks(raw, words, len(out)))


def finder(chosen: list[bytes]) -> pu.Finder:
    index, every = {f: i for i, f in enumerate(chosen)}, frozenset(chosen)
    return lambda text: {index[f] for f in features(text).intersection(every)}


READING = pu.Reading(features, finder)


def train(docs: DataFrame, labels: DataFrame, n_pos: int = POSITIVES, n_unl: int = UNLABELLED) -> pu.Model:
    """Learns from rows that are not held out. Without any positive the model has a bias only."""
    seen = ~pu.held_out(F.col("doc_id"), FOLDS, FOLD)
    return pu.fitted(pu.sampled(docs, labels, "quality", seen, n_pos, n_unl), READING, RARE, True, FEATURES, SIGNIFICANT, None)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on what is not held out and scores every document.

    A null text counts as an empty one, which has marks but no words. A row whose id is null is none of the held out
    ones and is not learned from. Repeated rows are scored each. Labels without a document, and null labels, count
    for nothing but are no error; a document with both labels is a positive. Without labels every score is 0.5. An
    empty table gives an empty result. Other columns are not read.
    """
    return pu.scored(docs, train(docs, labels), pu.held_out(F.col("doc_id"), FOLDS, FOLD))
