"""Queries that have no SQL, and small helpers, against plain Python on the given tables."""

import json
import math
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestat.functions import values
from lodestat.operators import bounds, curating, deciding, items, models, paired, serving
from lodestat.plans import all as _all  # noqa: F401
from lodestat.plans import registry
from lodestat.sources import files

D = "/root/testdata/sf0.001"
DOCS = dict(zip(*pq.read_table(f"{D}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True))
LANGS = dict(zip(*pq.read_table(f"{D}/documents.parquet", columns=["doc_id", "lang"]).to_pydict().values(), strict=True))


def run(spark, name):
    return registry.queries()[name](spark, D).collect()


def test_scheme_distribution(spark):
    want = Counter()
    for text in DOCS.values():
        lines = [x for x in (text or "").split("\n") if x.strip(" ")]
        for i in range(0, len(lines) - 3, 4):
            seen = {}
            want["".join(seen.setdefault(re.sub(r"\W|\d|_", "", x.lower())[-2:], chr(65 + len(seen))) for x in lines[i : i + 4])] += 1
    assert {r["scheme"]: r["n"] for r in run(spark, "scheme_distribution")} == want


def test_block_building(spark):
    want = {}
    for k, text in DOCS.items():
        held = n = 0
        for x in (text or "").split("\n"):
            held += len(x) % 5 + 1
            if held >= 8:
                held, n = 0, n + 1
        want[k] = n
    assert {r["doc_id"]: r["n"] for r in run(spark, "block_building") if DOCS[r["doc_id"]] is not None} == {k: n for k, n in want.items() if DOCS[k] is not None}


def test_minimal_pairs(spark):
    bad, every = set(), {}
    for k, text in DOCS.items():
        marker = re.compile(r"(?i)\b(the|de|der|la)\b", re.ASCII)
        parts = re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", text)
        stems = [w[:4] for w in " ".join(text.split(" ")[:6]).lower().split(" ")]
        cover = lambda some: sum(w in " ".join(some).lower() for w in stems) / max(1, len(stems))  # noqa: B023, E731
        inside = [p for p in parts if marker.search(p)]
        every[k] = k // 2
        if not (inside and cover(inside) >= 1 / 3 and cover([p for p in parts if not marker.search(p)]) >= 1 / 3):
            bad.add(k // 2)
    assert {r["doc_id"] for r in run(spark, "minimal_pairs")} == {k for k, u in every.items() if u not in bad}


def test_number_mentions(spark):
    got = {}
    for r in run(spark, "number_mentions"):
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["value"], r["currency"]))
    for k, text in DOCS.items():
        found = sorted(got.get(k, []))
        assert found == items.numbers_of(text, LANGS[k])
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


@pytest.mark.parametrize(("text", "lang", "want"), [
    ("cost $1,234.50 today", "en", [(6, 14, 1234.5, "USD")]), ("kostet 1.234,50 € heute", "de", [(7, 15, 1234.5, "EUR")]), ("de -3,5 puis plus loin 12 euros", "fr", [(3, 7, -3.5, None), (23, 25, 12.0, "EUR")]),
    ("a-5 and x5 or 7", "en", [(2, 3, 5.0, None), (14, 15, 7.0, None)]), ("EUR 5 or 6 GBP", "en", [(4, 5, 5.0, "EUR"), (9, 10, 6.0, "GBP")]), ("euros5 1.234,5", "en", [(7, 14, 1234.5, None)]), ("", None, []),
])
def test_numbers_of(text, lang, want):
    assert items.numbers_of(text, lang) == want


def binomial_tail(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1))


def test_kmin_is_that_of_the_tail():
    for target in (0.5, 0.75, 0.95):
        want = [next((k for k in range(n + 1) if binomial_tail(k, n, target) <= 0.05), n + 1) for n in range(1, 200)]
        assert bounds.kmin_values(1, 200, target, 0.05) == want and bounds.kmin_values(120, 200, target, 0.05) == want[119:]


def test_exact_bounds(spark):
    for r in run(spark, "exact_bounds"):
        assert r["k"] == 0 or abs(binomial_tail(r["k"], r["n"], r["low"]) - 0.05) < 1e-3
    for r in run(spark, "poisson_rate"):
        mean = r["upper"] * r["n"] / 1e6
        assert abs(sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(r["k"] + 1)) - 0.05) < 1e-3
    assert abs(bounds.poisson_tail(10**6, 10**6) - 0.5) < 1e-3


def test_kmin_table(spark):
    table = {r["n"]: r["kmin"] for r in bounds.kmin_table(spark, 9000, 0.75).collect()}
    assert len(table) == 9000 and [table[n] for n in (1, 50, 4096, 4097, 9000)] == [bounds.kmin_values(n, n + 1, 0.75, 0.05)[0] for n in (1, 50, 4096, 4097, 9000)]
    assert run(spark, "kmin_table")


def test_residual_noise(spark):
    cells = spark.createDataFrame([(1000, 300, 3), (500, 200, 0)], "pool long, reviewed long, wrong long")
    r = bounds.residual_noise(cells).first()
    assert abs(r["mean"] - (1000 * 3.5 / 301 + 500 * 0.5 / 201) / 1500) < 2e-4 and r["mean"] < r["bound"] < 0.02 and r["within"]
    assert run(spark, "residual_noise")[0]["bound"] > 0


def test_models(spark):
    rows = registry.queries()["platt_calibration"](spark, D)
    from lodestat.plans.inputs import decisions

    both = rows.withColumnRenamed("conf", "p").join(decisions(spark, D).select("id", F.log(F.col("conf") / (1.0001 - F.col("conf"))).alias("x"), F.col("correct").cast("double").alias("y")), "id")
    a, b = both.agg(F.avg(F.col("p") - F.col("y")), F.avg((F.col("p") - F.col("y")) * F.col("x"))).first()
    assert abs(a) < 1e-3 and abs(b) < 1e-3  # the maximum of the likelihood
    scores = {r["id"]: r["score"] for r in run(spark, "style_classifier")}
    assert sum((scores[k] > 0.5) == (LANGS[k] == "en") for k in scores) > 0.9 * len(scores)
    r = run(spark, "shortcut_audit")[0]
    assert 0 <= r["auroc"] <= 1 and r["leaks"] == (max(r["auroc"], 1 - r["auroc"]) > 0.55)
    same = spark.createDataFrame([(str(i), f"common words {i % 7} here", float(i % 2)) for i in range(200)], "key string, text string, label double")
    told = spark.createDataFrame([(str(i), f"common words {'zzz' if i % 2 else 'here'}", float(i % 2)) for i in range(200)], "key string, text string, label double")
    assert not models.separability(same, "key", size=256).first()["iterate"] and models.separability(told, "key", size=256).first()["iterate"]
    assert run(spark, "real_vs_synthetic")


def test_section_items(spark):
    heads = {k: {x for x in (t or "").split("\n") if x.strip(" ") and len(x) < 20} for k, t in DOCS.items()}
    for r in run(spark, "section_items"):
        assert r["gold"] in heads[r["doc_id"]] and r["gold"] not in r["options"] and len(r["options"]) == min(4, len(heads[r["doc_id"]]) - 1)


def test_sources_round_trip(spark, tmp_path):
    rows = spark.read.parquet(f"{D}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal")
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    want = sorted(map(tuple, rows.collect()))
    files.write_json_lines(rows, f"{tmp_path}/lines")
    assert sorted(map(tuple, files.json_lines(spark, f"{tmp_path}/lines", schema).collect())) == want
    rows.repartition(3).write.option("compression", "gzip").json(f"{tmp_path}/gz")
    manifest = files.digests(spark, f"{tmp_path}/gz").collect()
    manifest = spark.createDataFrame(manifest)
    assert sorted(map(tuple, files.checked_lines(spark, f"{tmp_path}/gz", manifest, schema).collect())) == want
    with pytest.raises(ValueError):
        files.checked_lines(spark, f"{tmp_path}/gz", manifest.withColumn("sha256", F.lit("0" * 64)), schema)
    with pytest.raises(ValueError):
        files.checked_lines(spark, f"{tmp_path}/gz", manifest.limit(2), schema)
    files.write_score_sheet(rows.select("s_suppkey", F.lit("old").alias("grade")), f"{tmp_path}/sheet")
    sheet = files.rewritten_sheet(files.score_sheet(spark, f"{tmp_path}/sheet", ["s_suppkey", "grade"]), "grade", F.when(F.col("s_suppkey").cast("int") % 2 == 0, "even").otherwise("old"))
    assert all(r["grade"] == ("even" if int(r["s_suppkey"]) % 2 == 0 else "old") and r["rewritten"] == (int(r["s_suppkey"]) % 2 == 0) for r in sheet.collect())


def test_run_directory(spark, tmp_path):
    for name, body in (("d1_a.json", '{"x": 1}'), ("d2_b.json", "no json"), ("summary.json", "{}")):
        (tmp_path / name).write_text(body)
    got = {r["doc"]: r["body"] for r in files.run_directory(spark, str(tmp_path)).collect()}
    assert json.loads(got["d1"]) == {"x": 1} and got["d2"] is None and set(got) == {"d1", "d2"}


def test_series_and_orders(spark):
    r = spark.range(1).select(*(values.harmonic(F.lit(n)).alias(f"h{n}") for n in (0, 1, 32, 33, 5000)), *(values.log_factorial(F.lit(n)).alias(f"f{n}") for n in (0, 5, 40, 3000))).first()
    for n in (0, 1, 32, 33, 5000):
        assert abs(r[f"h{n}"] - sum(1 / i for i in range(1, n + 1))) < 1e-12 * max(1, n)
    for n in (0, 5, 40, 3000):
        assert abs(r[f"f{n}"] - math.lgamma(n + 1)) < 1e-9
    p = spark.range(1).select(values.binomial_two_sided(F.lit(9_900), F.lit(10_100)).alias("p")).first()["p"]
    assert abs(p - math.erfc(199 / math.sqrt(20_000) / math.sqrt(2))) < 1e-3
    rows = spark.range(5000).withColumn("w", F.col("id") % 7).withColumn("cell", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    got = {x["id"]: x for x in curating.in_hash_order(rows, "id", "s", "cell", weight="w").collect()}
    import hashlib

    for c in (None, 1, 2):
        own = sorted((i for i in range(5000) if (i % 3 or None) == c), key=lambda i: hashlib.sha256(f"s:{i}".encode()).hexdigest())
        before = 0
        for place, i in enumerate(own, 1):
            assert (got[i]["rank"], got[i]["size"], got[i]["before"]) == (place, len(own), before)
            before += i % 7


def test_growth_over_runs_of_steps(spark):
    rows = spark.createDataFrame([(s, float(s * s % 17)) for s in (0, 1, 5, 1023, 1024, 1025, 5000, 5001)], "step long, v double")
    got = {r["step"]: r["growth"] for r in serving.growth_per_step(rows, "step", "v").collect()}
    steps = sorted(got)
    assert got[0] is None and all(abs(got[b] - (b * b % 17 - a * a % 17)) < 1e-9 for a, b in zip(steps, steps[1:], strict=False))


def test_draws_are_poisson_and_even():
    w = paired.poisson_weights("k", 40_000)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs(paired.signs("k", 40_000).mean()) < 0.02


def test_aurc_of_many_rows(spark):
    rows = spark.range(3000).select((F.col("id") % 97 / 97.0).alias("conf"), (F.col("id") % 5 > 0).alias("correct"))
    r = deciding.aurc(rows).first()
    want = sum(j / (r["right"] + j) for j in range(1, r["rows"] - r["right"] + 1)) / r["rows"]
    assert abs(r["best"] - want) < 2e-6
