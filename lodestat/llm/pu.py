"""Non-negative positive-unlabelled learning of a linear text classifier.

Trusted positives and unlabelled texts are given; the unlabelled ones are drawn from all training texts, whatever
their label says, so that they follow the corpus and the class prior holds for them. A linear classifier over the
presence of features is trained with the non-negative risk estimator

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

with the logistic loss l: the unlabelled texts stand for negatives once the share of positives among them, known
from the class prior, is taken off, and that estimate is not let below zero.

A text is read as a set of features. Those that are common enough are counted in tasks, then by feature, and only
they come to the driver; then the whole sample is searched for these, and the ones that tell the two apart enter the
classifier. Scoring searches a text for the classifier's features only.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import decoded

#: Features that a task counts before it passes the counts on.
COUNTED = 1 << 19
Finder = Callable[[str], set[int]]


@dataclass(frozen=True)
class Reading:
    """features: those of a text. finder: given features, a function that tells which of them (by place) a text has."""

    features: Callable[[str], set[bytes]]
    finder: Callable[[list[bytes]], Finder]


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo the folds, is that fold. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def sampled(docs: DataFrame, labels: DataFrame, label: str, seen: Column, n_pos: int, n_unl: int) -> DataFrame:
    """positive int, text of a bounded sample: texts labelled 1, and texts whatever their label; those with the least hashes of their ids among the seen ones."""
    seen = seen & F.col("doc_id").isNotNull()
    order = F.xxhash64("doc_id", F.lit(11))
    pos = labels.where(seen & (F.col(label) == 1)).select("doc_id").distinct().orderBy(order, "doc_id").limit(n_pos).withColumn("positive", F.lit(1))
    unl = docs.where(seen).select("doc_id").distinct().orderBy(order, "doc_id").limit(n_unl).withColumn("positive", F.lit(0))
    picked = F.broadcast(pos.unionByName(unl))  # at most n_pos + n_unl ids
    return docs.select("doc_id", "text").join(picked, "doc_id").select("positive", "text")


def feature_counts(sample: DataFrame, features: Callable[[], Callable[[str], set]], kind: str, among: pa.DataType) -> DataFrame:
    """f, p, u: in how many positives and unlabelled texts each feature occurs. features makes a task's reader of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, counts = features(), (Counter(), Counter())

        def put() -> Iterator[pa.RecordBatch]:
            for positive, c in enumerate(counts):
                n = pa.array(list(c.values()), pa.int64())
                none = pa.array(np.zeros(len(c), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), among), *((n, none) if positive else (none, n))], names=["f", "p", "u"])
                c.clear()

        for b in batches:
            for positive, text in zip(b.column(0).to_pylist(), decoded(b.column(1)), strict=True):
                counts[positive].update(read(text))
                if len(counts[positive]) > COUNTED:
                    yield from put()
        yield from put()

    return sample.mapInArrow(run, f"f {kind}, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def telling(sample: DataFrame, reading: Reading, n_p: int, n_u: int, rare: int, of_both: bool, most: int, significant: float) -> list[bytes]:
    """The features whose shares differ most significantly between positives and unlabelled texts, either way; at most so many.

    Those count that one in `rare` positives has, at least four, or (of_both) so many of the unlabelled: at most
    `rare` times the features of a text on the driver, whatever the corpus.
    """
    common = F.col("p") >= max(4, n_p // rare)
    common = common | (F.col("u") >= max(4, n_u // rare)) if of_both else common
    found = feature_counts(sample if of_both else sample.where("positive = 1"), lambda: reading.features, "binary", pa.binary()).where(common)
    candidates = sorted(bytes(r["f"]) for r in found.select("f").collect())
    counts = feature_counts(sample, lambda: reading.finder(candidates), "int", pa.int32())
    share = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n_p + 1 / n_u))
    return [candidates[r["f"]] for r in counts.withColumn("z", z).where(F.col("z") >= significant).orderBy(F.desc("z"), "f").limit(most).collect()]


class Model:
    """Weights of features and a bias; score() is the probability that a text is positive."""

    def __init__(self, reading: Reading, features: list[bytes], weights: np.ndarray, bias: float, prior: float = float("nan")):
        self.reading, self.features, self.weights, self.bias, self.prior = reading, features, weights, bias, prior
        self.at = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"at": None}

    def score(self, text: str) -> float:
        if self.at is None:
            self.at = self.reading.finder(self.features)
        g = self.bias + float(self.weights[sorted(self.at(text))].sum())
        return float(1 / (1 + np.exp(-np.clip(g, -50, 50))))


def risk(w: np.ndarray, bias: float, rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray, float]:
    """The non-negative risk of texts, and the gradient to descend by. rows and cols: the places of ones in the matrix of texts by features.

    Where the negatives' part is below zero it counts as zero, and the gradient is that which raises it again.
    """
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    g = bias + np.bincount(rows, weights=w[cols], minlength=len(positive))
    s = 1 / (1 + np.exp(-np.clip(g, -50, 50)))
    loss = np.logaddexp(0, g)
    rest = loss[~positive].sum() / n_u - prior * loss[positive].sum() / n_p
    as_negative = np.where(positive, -s * prior / n_p, s / n_u)
    d = np.where(positive, (s - 1) * prior / n_p, 0.0) + as_negative if rest >= 0 else -as_negative
    value = prior * np.logaddexp(0, -g[positive]).sum() / n_p + max(0.0, rest)
    return float(value), np.bincount(cols, weights=d[rows], minlength=len(w)), float(d.sum())


def taken(ends: np.ndarray, cols: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ones of some texts. Text i has the features cols[ends[i]:ends[i + 1]]."""
    size = ends[take + 1] - ends[take]
    rows = np.repeat(np.arange(len(take)), size)
    return rows, cols[np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ends[take], size)]


def nn_pu(ends: np.ndarray, cols: np.ndarray, positive: np.ndarray, n: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 3e-4, batch: int = 8192, seed: int = 0) -> tuple[np.ndarray, float]:
    """Adam over batches of positives and unlabelled texts; the mean of the second half of the way. Small batches are cut off at zero too often."""
    rng = np.random.default_rng(seed)
    x, mean = np.append(np.zeros(n), np.log(prior / (1 - prior))), np.zeros(n + 1)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    kinds = [np.flatnonzero(positive), np.flatnonzero(~positive)]
    for t in range(1, steps + 1):
        take = np.concatenate([rng.choice(k, min(batch, len(k))) for k in kinds])
        rows, own = taken(ends, cols, take)
        _, grad, slope = risk(x[:-1], x[-1], rows, own, positive[take], prior)
        grad = np.append(grad + decay * x[:-1], slope)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t > steps // 2:
            mean += x / (steps - steps // 2)
    return mean[:-1], float(mean[-1])


def class_prior(ends: np.ndarray, cols: np.ndarray, positive: np.ndarray, n: int, confidence: float = 0.1) -> float:
    """The share of positives among the unlabelled texts.

    A classifier that is trained on one half of the sample orders the other half. Of the unlabelled texts above a cut,
    no fewer than the share of positives times the positives' part above it are positive, so each cut bounds that share from above;
    the cut with the least bound, sampling error included, gives the estimate (best bin). Mean of both halves.
    """
    found, half = [], np.arange(len(positive)) % 2
    for k in (0, 1):
        fit, rest = np.flatnonzero(half == k), np.flatnonzero(half != k)
        if not positive[fit].any() or positive[fit].all() or not positive[rest].any() or positive[rest].all():
            continue
        rows, own = taken(ends, cols, fit)
        w, bias = nn_pu(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(fit)))]), own, positive[fit], n, 0.5)
        rows, own = taken(ends, cols, rest)
        g = bias + np.bincount(rows, weights=w[own], minlength=len(rest))
        p, u = np.sort(g[positive[rest]]), np.sort(g[~positive[rest]])
        cuts = np.unique(p)
        above = lambda x: 1 - np.searchsorted(x, cuts) / len(x)  # noqa: B023, E731
        error = np.sqrt(np.log(4 / confidence) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
        best = np.argmin((above(u) + error) / above(p))
        found.append(above(u)[best] / above(p)[best])
    return float(np.mean(found)) if found else 0.5


def fitted(sample: DataFrame, reading: Reading, rare: int, of_both: bool, most: int, significant: float, prior: float | None) -> Model:
    """prior: that of the positives; None: estimated from the sample. The others are telling()'s."""
    sample = sample.persist()
    try:
        sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
        n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
        if not n_p or not n_u:
            p = 0.5 if prior is None else prior
            return Model(reading, [], np.zeros(0), float(np.log(p / (1 - p))), p)
        chosen = telling(sample, reading, n_p, n_u, rare, of_both, most, significant)

        def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = reading.finder(chosen)
            for x in batches:
                texts = decoded(x.column(1))
                own = pa.array([sorted(at(t)) for t in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([x.column(0), own, pa.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())], names=["positive", "at", "crc"])

        got = sample.mapInArrow(picked, "positive int, at array<int>, crc long").orderBy("positive", "crc").toArrow()  # bounded as the sample is
    finally:
        sample.unpersist()
    at = got["at"].combine_chunks()
    ends, cols, positive = at.offsets.to_numpy().astype(np.int64), at.values.to_numpy(), got["positive"].to_numpy() == 1
    if prior is None:
        prior = class_prior(ends, cols, positive, len(chosen))
        prior = (prior * n_u + 1) / (n_u + 2)  # inside (0, 1)
    return Model(reading, chosen, *nn_pu(ends, cols, positive, len(chosen), prior), prior)


def scored(docs: DataFrame, model: Model, held: Column, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; the text alone decides the score."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(model.score, decoded(b.column(1))), pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
