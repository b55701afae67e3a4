"""Running sums over ranges, statistics of an arm, temperature, memorised grams, fielded search and candidate pairs against plain versions."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestat.operators import deciding, items, ordered, paired, retrieval, texts


def test_running_sums_over_many_values(spark):
    """200 000 distinct scores in three groups, one of which holds most rows, with ties and nulls."""
    r = np.random.default_rng(0)
    rows = pd.DataFrame({"g": r.choice(["a", "b", None], 200_000, p=[0.9, 0.09, 0.01]), "v": np.round(r.random(200_000), 7), "n": r.integers(1, 9, 200_000)})
    rows.loc[5, "v"] = None
    df = spark.createDataFrame([(g, None if pd.isna(v) else float(v), int(n)) for g, v, n in rows.itertuples(index=False)], "g string, v double, n long")
    each = df.groupBy("g", "v").agg(F.sum("n").alias("n"))
    got = ordered.running(each, [F.desc("v")], ["n"], "g").toPandas()
    for _, x in got.groupby("g", dropna=False):
        x = x.sort_values("v", ascending=False, na_position="last")
        assert (x["n_ahead"].to_numpy() == x["n"].cumsum().to_numpy() - x["n"].to_numpy()).all() and (x["n_all"] == x["n"].sum()).all()


def test_no_window_over_an_arm(spark):
    rows = spark.createDataFrame([(i, "a", i / 997 % 1, i % 3 > 0) for i in range(500)], "id long, arm string, conf double, correct boolean")
    for df in (deciding.aurc(rows, "arm"), deciding.auroc(rows, "conf", F.col("correct"), "arm"), deciding.equal_mass_bins(rows, 7, "arm"), deciding.fpr_at_recall(rows, "conf", F.col("correct"), 0.9, "arm")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Window")]
        assert any("_part#" in x for x in windows)
        # the others add up the ranges of a group, one row each
        assert all("_part#" in x or re.search(r"Window \[sum\(_.*\[_group#\d+\]$", x) for x in windows)


@pytest.mark.parametrize("n", [0, 1, 5, 7, 100, 1003])
def test_equal_mass_bins(spark, n):
    r = random.Random(n)
    rows = [(i, "a", r.choice([0.5, r.random()]), r.random() < 0.6) for i in range(n)]
    got = deciding.equal_mass_bins(spark.createDataFrame(rows, "id long, arm string, conf double, correct boolean"), 7, "arm").collect()
    want = [list(x) for x in np.array_split(sorted(rows, key=lambda x: (x[2], x[0])), 7)] if n else []
    assert {x["bin"]: x["n"] for x in got} == {i + 1: len(x) for i, x in enumerate(want) if x}
    for x in got:
        assert x["conf"] == pytest.approx(np.mean([float(y[2]) for y in want[x["bin"] - 1]]), abs=2e-6)


def test_arm_statistics_are_those_of_the_separate_queries(spark):
    r = random.Random(1)
    rows = [(i, r.choice("ab"), c, r.random() < c) for i, c in ((i, round(r.random(), 3)) for i in range(3000))] + [(9000, "c", 0.5, True), (9001, "d", 0.5, False)]
    df = spark.createDataFrame(rows, "id long, arm string, conf double, correct boolean")
    by = lambda x: {r["arm"]: r for r in x.collect()}
    got, curve, roc, tau = by(deciding.arm_statistics(df, 0.75, 30, "arm")), by(deciding.aurc(df, "arm")), by(deciding.auroc(df, "conf", F.col("correct"), "arm")), by(deciding.wilson_threshold(df, 0.75, 30, "arm"))
    assert set(got) == set("abcd")
    for arm, x in got.items():
        assert (x["rows"], x["right"], x["aurc"], x["best"]) == (curve[arm]["rows"], curve[arm]["right"], curve[arm]["aurc"], curve[arm]["best"])
        assert x["auroc"] == roc[arm]["auroc"] and x["tau"] == tau[arm]["tau"]
        inside = [c for _, a, s, c in rows if a == arm and x["tau"] is not None and s >= x["tau"]]
        assert x["precision"] == (round(sum(inside) / len(inside), 6) if inside else None)


def test_temperature(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        logits = [r.gauss(0, 1) for _ in range(4)]
        p = [math.exp(x) for x in logits]
        gold = r.choices(range(4), p)[0]
        rows += [(i, f"o{j}", 2.5 * logits[j], f"o{gold}") for j in range(4)]
    df = spark.createDataFrame([*rows, (1000, "o1", 0.0, "other")], "id long, option string, logp double, gold string")
    got = deciding.fit_temperature(df).first()

    def loss(t):
        return np.mean([math.log(sum(math.exp(x[2] / t) for x in rows[i : i + 4])) - next(x[2] for x in rows[i : i + 4] if x[1] == x[3]) / t for i in range(0, 1600, 4)])

    assert got["nll"] == pytest.approx(loss(got["temperature"])) and got["nll"] <= min(loss(t) for t in np.linspace(1.5, 4, 500)) + 1e-9
    assert deciding.fit_temperature(df.where("id = 1000")).count() == 0


def plain_longest(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        cur = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            cur[j] = prev[j - 1] + 1 if x == y else 0
        best, prev = max(best, *cur), cur
    return best


def test_memorised_is_with_one_reference(spark):
    refs = spark.createDataFrame([("a b c d e f g h",), ("b c d e f g h i",)], "text string")
    rows = spark.createDataFrame([(1, "a b c d e f g h i")], "id long, text string")
    assert [tuple(r) for r in texts.memorised(rows, refs, "id").collect()] == [(1, 8)]


def test_memorised_against_every_pair(spark):
    r = random.Random(3)
    refs = [" ".join(r.choice("abc") for _ in range(r.randrange(0, 90))) for _ in range(6)]
    rows = []
    for i in range(40):
        w = [r.choice("abcd") for _ in range(r.randrange(0, 30))]
        part = r.choice(refs).split()
        at = r.randrange(len(part) + 1)
        rows.append((i, " ".join(w + part[at : at + r.randrange(70)] + w[:5])))
    rows += [(100, None), (101, ""), (102, refs[2] + " " + refs[3]), (103, refs[0])]
    got = dict(map(tuple, texts.memorised(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(t,) for t in [*refs, None]], "text string"), "id", 4).collect()))
    want = {i: max(plain_longest((t or "").split(), x.split()) for x in refs) for i, t in rows}
    assert got == {i: n for i, n in want.items() if n >= 4}
    none = spark.createDataFrame([], "id long, text string")
    assert texts.memorised(none, none, "id").count() == 0


@pytest.mark.parametrize(("literal", "broadcast"), [(5000, 10**6), (0, 10**6), (0, 0)])
def test_fielded_bm25(spark, monkeypatch, literal, broadcast):
    """The three ways that terms reach the counts give the same."""
    monkeypatch.setattr(retrieval, "LITERAL_TERMS", literal)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", broadcast)
    r = random.Random(4)
    docs = [(i, " ".join(r.choice("the a b c d e f".split()) for _ in range(r.randrange(0, 4))), " ".join(r.choice("the the the a b g h".split()) for _ in range(r.randrange(0, 25))), i % 4 > 0) for i in range(120)] + [(500, None, None, True)]
    asked = [(i, " ".join(r.choice("the a b c d e f g h z".split()) for _ in range(3))) for i in range(8)] + [(9, None)]
    got = retrieval.fielded_bm25(spark.createDataFrame(docs, "id long, title string, text string, ok boolean"), spark.createDataFrame(asked, "query long, text string"), {"title": 2.0, "text": 1.0}, 5, active=F.col("ok")).collect()
    live = [d for d in docs if d[3]]
    want = []
    for q, t in asked:
        scores = {}
        for f, weight in ((1, 2.0), (2, 1.0)):
            words = {d[0]: (d[f] or "").split() for d in live}
            avg = np.mean([len(w) for w in words.values()])
            for i, w in words.items():
                s = 0.0
                for term in dict.fromkeys((t or "").split()):
                    n = sum(term in x for x in words.values())
                    s += weight * math.log(1 + (len(live) - n + 0.5) / (n + 0.5)) * w.count(term) * 2.2 / (w.count(term) + 1.2 * (0.25 + 0.75 * len(w) / avg))
                scores[i] = max(scores.get(i, 0.0), s)
        best = sorted(((-round(s, 4), i) for i, s in scores.items() if s > 0))[:5]
        want += [(q, i, -s, k + 1) for k, (s, i) in enumerate(best)]
    assert sorted((r["query"], r["id"], pytest.approx(r["score"], abs=2e-4), r["rank"]) for r in got) == sorted(want)


def test_duplicate_pairs(spark):
    rows = [(1, "large ring", "x", [1.0, 0.0]), (2, "blue ring 5", "y", [0.0, 1.0]), (3, "seawater", "x", [1.0, 0.0]), (4, "water 7", "y", [0.0, 1.0]), (5, "bolt 5", "z", [1.0, 0.1]), (6, "ring 6", "y", [1.0, 0.0]), (7, None, "q", None)]
    df = spark.createDataFrame(rows, "id long, name string, family string, v array<double>")
    every = spark.createDataFrame([(a[0], b[0]) for a in rows for b in rows], "query long, id long")
    got = {(r["id_a"], r["id_b"]): r["stem"] for r in retrieval.duplicate_pairs(every, df, 0.9).collect()}
    assert got == {(1, 2): True, (3, 4): True, (1, 5): False, (3, 5): False, (1, 6): True, (3, 6): False}


def test_next_line_distractors(spark):
    r = random.Random(5)
    rows = [(k, p, f"line {k} {p}") for k in range(6) for p in sorted(r.sample(range(40), 12 - 2 * k))]
    got = {(x["k"], x["pos"]): x for x in items.next_line_items(spark.createDataFrame(rows, "k long, pos int, line string"), "k").collect()}
    for k in range(6):
        own = [x for x in rows if x[0] == k]
        for (_, p, _), (_, _, gold) in zip(own, own[1:]):
            assert got[k, p]["gold"] == gold and got[k, p]["distractors"] == [x for _, o, x in own if abs(o - p) > 2][:3]


def test_average_rank(spark):
    rows = [("a", x) for x in (3.0, 1.0, 1.0, 2.0, None)] + [("b", 1.0)]
    got = paired.average_rank(spark.createDataFrame(rows, "g string, v double").where("v is not null"), F.col("v"), "g").collect()
    assert sorted((r["g"], r["v"], r["rank"]) for r in got) == [("a", 1.0, 1.5), ("a", 1.0, 1.5), ("a", 2.0, 3.0), ("a", 3.0, 4.0), ("b", 1.0, 1.0)]
