"""Published constants and small fixtures for the library's operators."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestat.functions import values
from lodestat.operators import curating, deciding, paired, retrieval, scoring, texts, verifying
from lodestat.sources import files


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_wilson(spark):
    lo, hi = values.wilson(F.lit(0), F.lit(36))
    assert one(spark, hi)[0] == pytest.approx(0.0964, abs=1e-4)
    lo, _ = values.wilson(F.lit(36), F.lit(36))
    assert one(spark, lo)[0] == pytest.approx(0.9036, abs=1e-4)
    assert tuple(one(spark, *(c.alias(n) for c, n in zip(values.wilson(F.lit(0), F.lit(0)), "ab", strict=True)))) == (0.0, 1.0)


@pytest.mark.parametrize("b,c,p", [(0, 6, 0.03125), (3, 3, 1.0), (30, 10, 0.002221), (0, 0, 1.0)])
def test_exact_binomial(spark, b, c, p):
    assert one(spark, values.binomial_two_sided(F.lit(b), F.lit(c)))[0] == pytest.approx(p, abs=2e-4)


def test_corrected_chi_squared_from_25_pairs_on(spark):
    p = spark.createDataFrame([(True, False)] * 30 + [(False, True)] * 10, "a boolean, b boolean")
    assert paired.mcnemar_p(p).first()["p"] == pytest.approx(0.002664, abs=1e-5)
    assert paired.mcnemar_p(p, exact_below=100).first()["p"] == pytest.approx(0.002221, abs=1e-5)


def test_holm(spark):
    ps = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.04)], "arm string, p double")
    assert [r["p_adjusted"] for r in paired.holm(ps).orderBy("arm").collect()] == [0.03, 0.04, 0.04]


def test_list_credit(spark):
    g = spark.createDataFrame([(1, "a"), (1, "c"), (2, "a"), (2, "b"), (2, "x")], "item int, element string")
    e = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b")], "item int, element string")
    assert {r["item"]: r["credit"] for r in scoring.list_credit(g, e).collect()} == {1: 0.666667, 2: 0.666667}


def test_outcomes_and_swap(spark):
    rows = [(1, 1, "f", "exact", "a", "a"), (1, 2, "f", "exact", None, "a"), (1, 3, "f", "exact", "a", None), (1, 4, "f", "number", "1.001", "1.0"), (1, 5, "f", "loose", "Ár  vas", "ar vas"), (1, 6, "f", "date", "2024-01-02", "2024-01-03"), (1, 7, "f", "score", "0", "0.0")]
    df = spark.createDataFrame(rows, "run int, doc int, field string, kind string, gold string, pred string")
    assert [r["outcome"] for r in scoring.with_outcomes(df).orderBy("doc").collect()] == ["tp", "fp", "fn", "tp", "tp", "mismatch", "tp"]
    p = spark.createDataFrame([(True, False)] * 6 + [(False, True)] * 2, "a boolean, b boolean")
    x, y = paired.mcnemar(p).first(), paired.mcnemar(p.select(F.col("b").alias("a"), F.col("a").alias("b"))).first()
    assert (x["n10"], x["n01"]) == (y["n01"], y["n10"]) and x["p_exact"] == y["p_exact"]


def test_bootstrap_brackets_the_point_and_repeats(spark):
    rows = spark.createDataFrame([(i // 5, i % 3 == 0, i % 2 == 0) for i in range(600)], "grp int, a boolean, b boolean")
    x = paired.bootstrap_difference(rows, "grp", 300).first()
    assert x["low"] <= x["point"] <= x["high"]
    y = paired.bootstrap_difference(rows.repartition(5), "grp", 300).first()
    assert x["verdict"] == y["verdict"] and list(x)[:5] == pytest.approx(list(y)[:5])


def test_aurc_best_order_has_no_excess(spark):
    rows = spark.createDataFrame([(1.0 - i / 10, i < 6) for i in range(10)], "conf double, correct boolean")
    r = deciding.aurc(rows).first()
    assert r["excess"] == 0 and r["aurc"] == r["best"]
    assert deciding.auroc(rows, "conf", F.col("correct")).first()["auroc"] == 1.0


def test_threshold_cuts_between_confidences_only(spark):
    rows = spark.createDataFrame([(0.9, True)] * 40 + [(0.5, False)] * 10 + [(0.5, True)] * 10, "conf double, correct boolean")
    assert deciding.wilson_threshold(rows, 0.9, 10).first()["tau"] == 0.9
    assert deciding.wilson_threshold(rows, 0.9999, 10).first()["tau"] is None


def test_json_salvage(spark):
    text = 'x {"no": 1} </think> see ```json\n{"a": {"b": 2}}\n``` ok'
    assert one(spark, values.salvaged_json(F.lit(text)))[0] == '{"a": {"b": 2}}'


def test_short_texts_as_one_gram(spark):
    pool = spark.createDataFrame([(1, "two words"), (2, "á b c d e f g h i"), (3, "")], "id long, text string")
    ev = spark.createDataFrame([(1, "Two  words!"), (2, "x á b c d e f g h y")], "id long, text string")
    got = {r["id"]: (r["share"], r["verdict"]) for r in curating.decontaminate(pool, ev).collect()}
    assert got == {1: (1.0, "drop"), 2: (0.5, "drop")}


def test_script_spans(spark):
    df = spark.createDataFrame([(1, "ab漢字c字"), (2, "none")], "id int, text string")
    got = [tuple(r) for r in texts.script_spans(df, "id", r"[\x{4E00}-\x{9FFF}]").orderBy("start").collect()]
    assert got == [(1, 2, "漢字"), (1, 5, "字")]


def test_indexation_and_penalty(spark):
    assert one(spark, verifying.indexed(F.lit(100.0), F.array(F.lit(0.03), F.lit(0.2)), 0.05))[0] == 120.0
    assert one(spark, verifying.penalty(F.lit(100), F.lit(1000.0), 0.01, 0.2))[0] == 200.0


def test_nearest_matches_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(200, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    got = {}
    for r in retrieval.nearest(df, df.where("id < 20"), 3, block=7).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"]))
    for q in range(20):
        assert [i for _, i in sorted(got[q])] == np.argsort(-sim[q])[:3].tolist()


def test_sources(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run/7_x.json").write_text('{"a": 1}')
    (tmp_path / "run/8_x.json").write_text("{broken")
    (tmp_path / "run/summary.json").write_text("{}")
    got = {r["doc"]: r["body"] for r in files.run_directory(spark, f"{tmp_path}/run").collect()}
    assert got == {"7": '{"a": 1}', "8": None}
    body = gzip.compress("\n".join(json.dumps({"id": i}) for i in range(3)).encode())
    (tmp_path / "x.jsonl.gz").write_bytes(body)
    assert files.checked_lines(spark, f"{tmp_path}/x.jsonl.gz", hashlib.sha256(body).hexdigest(), "id long").count() == 3
    with pytest.raises(ValueError):
        files.checked_lines(spark, f"{tmp_path}/x.jsonl.gz", "0" * 64, "id long")
    (tmp_path / "p.html").write_bytes("t\xf5r".encode("latin-1"))
    assert files.web_bytes(spark, f"{tmp_path}/p.html", "ISO-8859-1", {"õ": "ő"}).first()[1:] == ("tőr", 1)
    out = f"{tmp_path}/out"
    assert files.append_missing(spark.range(5), out, "id") == 5 and files.append_missing(spark.range(8), out, "id") == 3
    assert spark.read.parquet(out).count() == 8
    files.write_score_sheet(spark.createDataFrame([("a", "1")], "x string, y string"), f"{tmp_path}/csv")
    assert files.score_sheet(spark, f"{tmp_path}/csv", ["x", "y"]).first() == ("a", "1")
    files.write_json_lines(spark.range(2), f"{tmp_path}/jl")
    assert files.json_lines(spark, f"{tmp_path}/jl", "id long").count() == 2
    with pytest.raises(ValueError):
        files.exportable(spark.range(3), "n", 5)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
