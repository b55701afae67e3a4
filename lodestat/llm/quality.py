"""Quality rules under weak supervision.

Rules vote good or bad or abstain. A text is good or of one of a few kinds of bad; within each of these classes the
rules err independently. Expectation-maximisation over the counts of the vote patterns estimates how common each
class is and how often each rule votes bad in it: on good texts that is the rule's false alarms, on the others what
it detects. Rules that go together are explained by a kind of their own rather than counted twice. The number
of kinds, from 1 to KINDS, is the one with the least Bayesian information criterion. Good is the class of the
majority; its posterior probability decides, in place of a filter that every rule must pass.

Nothing bounds the estimates: half a vote for and half a vote against in each rate (Jeffreys' prior) and one text
in each class only keep them off 0 and 1.

Counts of patterns are gathered over all documents. There are at most 3 ** len(rules()) patterns, whatever the
size of the corpus; only they reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import raw_texts, renamed, word_runs, written

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper_words long, n_distinct_words long, n_alpha long, n_letter_words long"
#: Most kinds of bad texts.
KINDS = 4
SYMBOLS = b"#*$%&|<>"
_DROP_SPACE = bytes(range(256)), b" \t\n\r\x0b\x0c"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_OTHERS = bytes(set(range(256)) - set(_LETTERS))


def trigram_repeats(ids: np.ndarray, n_ids: int) -> int:
    """Words in 3-word windows that occur twice or more, the first included."""
    if len(ids) < 4:
        return 0
    ids = ids.astype(np.int64)
    pair = ids[:-1] * n_ids + ids[1:]
    if n_ids >= 1 << 20:
        pair, n_ids = np.unique(pair, return_inverse=True)[1].astype(np.int64), max(n_ids, len(pair))
    keys = pair[:-1] * n_ids + ids[2:]
    order = np.sort(keys)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(again):
        return 0
    at = np.minimum(np.searchsorted(again, keys), len(again) - 1)
    hit = again[at] == keys
    cover = np.zeros(len(ids), bool)
    for k in range(3):
        cover[k : k + len(hit)] |= hit
    return int(cover.sum())


def text_stats(raw: bytes) -> tuple[int, ...]:
    """The columns of STATS for one whole text."""
    seen: dict[bytes, int] = {}
    ids, upper = [], 0
    for words in word_runs(raw):
        ids.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)))
        upper += sum(map(bytes.isupper, words))
    all_ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    times = np.bincount(all_ids, minlength=len(seen))
    plain = sum(times[i] for w, i in seen.items() if w[0] not in _LETTERS and not w.translate(None, _OTHERS))
    packed = raw.translate(None, _DROP_SPACE[1])
    chars = len(packed) - len(packed.translate(None, bytes(range(0x80, 0xC0)))) if not packed.isascii() else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(all_ids), len(packed) - chars, len(packed) - len(packed.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        trigram_repeats(all_ids, len(seen) + 1), len(lines), upper, len(seen), len(packed) - len(packed.translate(None, _LETTERS)) - chars,
        len(all_ids) - int(plain),
    )


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row a document: the kept columns and STATS of its whole text."""
    fields = [x.split() for x in STATS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(text_stats, raw_texts(b.column(0))), strict=True)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c, pa.int64()) for c in cols)], names=[*(f"k{i}" for i in range(len(keep))), *(f[0] for f in fields)])

    rows = docs.select(F.col("text").alias("text"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)))
    schema = ", ".join([f"k{i} {dict(rows.dtypes)[f'k{i}']}" for i in range(len(keep))] + [STATS])
    return rows.mapInArrow(run, schema)


def ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, tuple[Column, Column]]:
    """Built when a session is there. Every threshold is a plain share of the text's own size."""
    few = F.col("n_words") < 50
    return {
        "symbols": (ratio("n_symbols", "n_words") > 0.1, ratio("n_symbols", "n_words") < 0.02),
        "dup_lines": (ratio("n_dup_lines", "n_lines") > 0.3, (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1)),
        "repeats": (ratio("n_repeat_words", "n_words") > 0.3, (ratio("n_repeat_words", "n_words") < 0.1) & ~few),
        "shouting": (ratio("n_upper_words", "n_words") > 0.3, ratio("n_upper_words", "n_words") < 0.1),
        "word_length": ((ratio("word_chars", "n_words") > 15) | (ratio("word_chars", "n_words") < 2.5), ratio("word_chars", "n_words").between(3, 12)),
        "letters": (ratio("n_alpha", "word_chars") < 0.7, ratio("n_alpha", "word_chars") > 0.85),
        "wordlike": (ratio("n_letter_words", "n_words") < 0.8, ratio("n_letter_words", "n_words") > 0.9),
        "variety": (ratio("n_distinct_words", "n_words") < 0.1, ratio("n_distinct_words", "n_words") > 0.3),
        "length": (few, F.col("n_words") >= 100),
    }


class Model:
    """share of each class (good is 0) and rate[class, rule] of bad votes among votes."""

    def __init__(self, share: np.ndarray, rate: np.ndarray):
        self.share, self.rate = share, rate

    def joint(self, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.log(self.share) + bad @ np.log(self.rate).T + good @ np.log1p(-self.rate).T

    def posterior(self, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        """Probability of each class for texts with these votes."""
        log = self.joint(bad, good)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def likelihood(self, bad: np.ndarray, good: np.ndarray, n: np.ndarray) -> float:
        return float(n @ np.logaddexp.reduce(self.joint(bad, good), axis=1))


def matrices(patterns: dict[str, int], n_rules: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bad votes, good votes and count of each pattern (one letter a rule: b, g or a)."""
    v = np.array([list(p) for p in patterns]).reshape(len(patterns), n_rules)
    return (v == "b").astype(float), (v == "g").astype(float), np.array(list(patterns.values()), float)


def started(bad: np.ndarray, n: np.ndarray, kinds: int) -> np.ndarray:
    """First guess at the classes: without a bad vote good; else by the rule that votes bad most often among those left, the last kind has the rest."""
    left = bad.any(axis=1)
    p = np.zeros((len(bad), kinds + 1))
    p[:, 0] = np.where(left, 0.1, 1.0)
    for k in range(1, kinds + 1):
        own = left & (bad[:, int(np.argmax((n * left) @ bad))] > 0) if k < kinds else left
        p[own, k], left = 0.9, left & ~own
    return p


def fit(patterns: dict[str, int], n_rules: int, kinds: int = KINDS, rounds: int = 2000) -> Model:
    """EM over pattern counts, for each number of kinds; the class with the greatest share comes first."""
    bad, good, n = matrices(patterns, n_rules)
    best, least = None, np.inf
    for k in range(1, kinds + 1):
        p, last = started(bad, n, k), -np.inf
        for _ in range(rounds):
            w = p * n[:, None]
            m = Model((w.sum(axis=0) + 1) / (n.sum() + k + 1), (w.T @ bad + 0.5) / (w.T @ (bad + good) + 1))
            p, now = m.posterior(bad, good), m.likelihood(bad, good, n)
            if now - last < 1e-10 * abs(now):
                break
            last = now
        criterion = (k + (k + 1) * n_rules) * np.log(n.sum()) - 2 * now
        if criterion < least:
            best, least = m, criterion
    order = np.argsort(-best.share, kind="stable")
    return Model(best.share[order], best.rate[order])


def votes() -> Column:
    """One letter a rule: b, g or a."""
    return F.concat(*(F.when(b, "b").when(g, "g").otherwise("a") for b, g in rules().values()))


def verdicts(stats: DataFrame) -> DataFrame:
    """The posterior of every vote pattern that occurs in stats: at most 3 ** len(rules()) rows."""
    found = {r["_votes"]: r["count"] for r in stats.groupBy(votes().alias("_votes")).count().collect()}
    rows = []
    if found:
        bad, good, _ = matrices(found, len(rules()))
        p = fit(found, len(rules())).posterior(bad, good)[:, 0]
        rows = [(k, float(x)) for k, x in zip(found, p, strict=True)]
    return stats.sparkSession.createDataFrame(rows, "_votes string, p_good double")


def judged(stats: DataFrame, table: DataFrame, threshold: float = 0.5) -> DataFrame:
    """stats with base_failed, p_good and kept."""
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stats.withColumn("_votes", votes()).join(F.broadcast(table), "_votes", "left").drop("_votes")
    return rows.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("p_good") >= threshold, F.lit(False)))


def quality(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document with its counts, base_failed, p_good and kept.

    A null or empty text has no words: all counts 0, base_failed true. Repeated rows each get their own row. An
    empty table gives an empty result. Other columns of docs are not read.
    """
    stats = written(with_stats(docs, [id_col]).withColumnRenamed("k0", id_col), "quality-stats")
    return judged(stats, verdicts(stats))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with all their columns as they were.

    A row with a null or empty text goes. Repeated rows stay or go together; ties at the threshold stay. Columns may
    have any names. An empty table gives an empty result.

    The texts are read and counted twice, which costs less than sending them through a shuffle to meet their
    verdicts; only the verdicts by vote pattern go to every task.
    """
    names = docs.columns
    table = verdicts(written(with_stats(docs, []), "quality-stats"))
    rows = judged(with_stats(docs, names), table).where("kept")
    return renamed(rows, names)
