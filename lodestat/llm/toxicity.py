"""Toxicity by non-negative positive-unlabelled learning (see `pu`).

The positives are texts labelled toxic, the class prior is the share of toxic labels in all training labels and one
more label that is toxic by a twentieth. Features are the distinct lower-cased words of a text, each between spaces, and the pieces of
GRAMS bytes of these, so scripts that don't space their words have features too. Those enter that a fiftieth of the
positives, and at least four of them, hold and whose share differs significantly between positives and unlabelled
texts, either way: weights can have both signs. With three positives or fewer there is no such feature, and every
text gets the prior.

The classifier is fitted on a bounded sample: at most POSITIVES confirmed and UNLABELLED unlabelled texts, those with
the least hashes of their ids. Scoring reads every whole text.
"""

from __future__ import annotations

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm import pu

POSITIVES = 8192
UNLABELLED = 32768
#: Most features of the classifier, the most significant first, and the least significance, in standard errors.
FEATURES, SIGNIFICANT = 4096, 4.5
#: A feature has one in so many positives.
COMMON = 50
#: Lengths in bytes of the pieces of words that are features.
GRAMS = (4, 6, 9)
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
FOLDS, FOLD = 5, 0


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def features(text: str) -> set[bytes]:
    """The words between spaces, and what is GRAMS bytes long of these."""
    out = {b" " + w + b" " for w in words_of(text)}
    for w in list(out):
        for n in GRAMS:
            out.update([w[i : i + n] for i in range(len(w) - n + 1)])
    return out


def finder(features: list[bytes]) -> pu.Finder:
    """An automaton that finds all features in one pass over a text."""
    if not features:
        return lambda text: set()
    found = ahocorasick.Automaton()
    for i, f in enumerate(features):
        found.add_word(f.decode("latin-1"), i)
    found.make_automaton()
    return lambda text: {i for _, i in found.iter((b" " + b" ".join(words_of(text)) + b" ").decode("latin-1"))}


READING = pu.Reading(features, finder)


def train(docs: DataFrame, labels: DataFrame, n_pos: int = POSITIVES, n_unl: int = UNLABELLED) -> pu.Model:
    """Learns from rows that are not held out. Without any positive the model has a bias only."""
    seen = ~pu.held_out(F.col("doc_id"), FOLDS, FOLD)
    known = labels.where(seen & F.col("toxic").isNotNull()).agg(F.sum(F.col("toxic").cast("double")).alias("toxic"), F.count("*").alias("n")).first()
    prior = ((known["toxic"] or 0) + 0.05) / (known["n"] + 1)
    return pu.fitted(pu.sampled(docs, labels, "toxic", seen, n_pos, n_unl), READING, COMMON, False, FEATURES, SIGNIFICANT, prior)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on what is not held out and scores every document.

    A null or empty text gets the score of a text without any of the classifier's features. A row whose id is null is held out.
    Repeated rows are scored each. Labels without a document, and null labels, count for nothing but are no error;
    a document with both labels is a positive. An empty table gives an empty result. Other columns are not read.
    """
    return pu.scored(docs, train(docs, labels), pu.held_out(F.col("doc_id"), FOLDS, FOLD))
