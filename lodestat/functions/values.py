"""Column expressions for values: equality by type, normalisation, JSON salvage, check digits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they fold to. Fixed values.
ACCENTED, PLAIN = "áéíóöőúüűàèìòùâêîôûäëïçñß", "aeiooouuuaeiouaeiouaeicns"
EPSILON = 0.01


def squeezed(c: Column) -> Column:
    """White space folded to single spaces and trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def folded(c: Column) -> Column:
    """Lower case, accents off."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def equal_by_type(kind: Column, gold: Column, pred: Column, eps: float = EPSILON) -> Column:
    """Text values compared as their type asks: exact, loose, number, date, score (zero or not) or enum. NULL where a side is."""
    number = lambda c: c.try_cast("double")
    return (
        F.when(gold.isNull() | pred.isNull(), F.lit(None).cast("boolean"))
        .when(kind == "loose", folded(squeezed(gold)) == folded(squeezed(pred)))
        .when(kind == "number", F.coalesce(F.abs(number(gold) - number(pred)) <= eps, F.lit(False)))
        .when(kind == "date", F.coalesce(gold.try_cast("date") == pred.try_cast("date"), F.lit(False)))
        .when(kind == "score", F.coalesce((number(gold) == 0) == (number(pred) == 0), F.lit(False)))
        .when(kind == "enum", gold == pred)
        .otherwise(F.trim(gold) == F.trim(pred))
    )


def outcome(gold: Column, pred: Column, equal: Column) -> Column:
    """tp, fn, fp, mismatch or tn. A value where gold has none is fp, whatever it says."""
    return (
        F.when(gold.isNull() & pred.isNull(), "tn")
        .when(gold.isNull(), "fp")
        .when(pred.isNull(), "fn")
        .when(equal, "tp")
        .otherwise("mismatch")
    )


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of k in n; (0, 1) where n is 0."""
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low = F.when(n == 0, 0.0).otherwise(F.greatest(mid - half, F.lit(0.0)))
    high = F.when(n == 0, 1.0).otherwise(F.least(mid + half, F.lit(1.0)))
    return low, high


def log_factorial(n: Column) -> Column:
    """ln n!: the sum of logarithms up to 32, beyond that Stirling's series."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(32)), F.lit(1)).cast("long")), F.lit(0.0), lambda acc, i: acc + F.log(i.cast("double")))
    large = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 32, small).otherwise(large)


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: summed up to 32, beyond that from the series with Euler's constant."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(32)), F.lit(1)).cast("long")), F.lit(0.0), lambda acc, i: acc + 1 / i)
    large = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(n < 1, 0.0).when(n <= 32, small).otherwise(large)


def binomial_two_sided(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs at one half.

    The terms fall from the greatest one, that of the smaller count, so only those are summed that a double can tell: some
    twelve standard deviations of them, however many pairs there are.
    """
    n, k = b + c, F.least(b, c)
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * math.log(2)
    many = F.least(k, F.ceil(12 * F.sqrt(n.cast("double"))) + 50).cast("long")
    terms = F.aggregate(
        F.sequence(F.lit(0).cast("long"), many),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct((acc["term"] * (k - i) / (n - k + i + 1)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(top) * terms))


def salvaged_json(text: Column) -> Column:
    """The JSON object in a model's text: after </think>, inside a fence if there is one, else from the first brace to the last."""
    body = F.regexp_replace(text, r"(?s)^.*</think>", "")
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(body, r"(?s)\{.*\}", 0))


def check_digit_ok(digits: Column, weights: list[int]) -> Column:
    """Weighted sum of the leading digits plus the last one is a multiple of ten."""
    n = len(weights)
    total = sum((F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    return (F.length(digits) == n + 1) & ((total + F.substring(digits, n + 1, 1).cast("int")) % 10 == 0)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, whatever the script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def shingles(words: Column, n: int) -> Column:
    """All runs of n words as texts; none if there are fewer words. words should be a column: an expression would be worked out anew for every run."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """First eight hexadecimal digits of sha256, modulo."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % buckets


def seeded(seed: str, key: Column) -> Column:
    """Rank key for sampling that doesn't depend on the order of rows."""
    return F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256)
