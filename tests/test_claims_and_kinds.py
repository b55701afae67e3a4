"""Role cues and risk by kind, worked out by hand."""

from pyspark.sql import functions as F

from lodestat.operators import deciding, verifying


def test_nearest_role_decides(spark):
    text = "The seller is Arva Ltd and the buyer is Bolt Inc, due 40 days."
    claims = [
        (1, 1, "Arva Ltd", "is Arva Ltd and"), (1, 2, "Arva Ltd", "is Arva Ltd and"), (1, 3, "40", "due 40 days"),
        (2, 1, "Arva", "is Arvb"), (3, 1, "x", "y"), (4, 2, "Bolt", "is Bolt"), (4, 1, "Bolt", "Bolt"), (5, 1, "A", "A"), (5, 2, "A", "A"),
    ]
    texts = [(1, text), (2, "seller is Arvb"), (3, None), (4, "is Bolt here"), (5, "seller A buyer")]
    got = verifying.claims_by_role(
        spark.createDataFrame(claims, "id int, field int, value string, span string"), spark.createDataFrame(texts, "id int, text string"), {1: "seller", 2: "buyer", 3: "due"}
    )
    assert {(r["id"], r["field"]): r["reason"] for r in got.collect()} == {
        (1, 1): None, (1, 2): "another role is nearer", (1, 3): None, (2, 1): "value not in span", (3, 1): "span not in text",
        (4, 2): "no role cue", (4, 1): "no role cue", (5, 1): None, (5, 2): "used before",
    }


def test_risk_by_kind(spark):
    rows = [("a", 0.9, True), ("a", 0.9, False), ("a", 0.5, True), ("a", 0.1, False), ("b", 0.7, True)]
    df = spark.createDataFrame(rows, "t string, conf double, correct boolean").withColumn("arm", F.lit("x"))
    got = {r["kind"]: r for r in deciding.risk_by_kind(df, F.col("t"), "arm").collect()}
    a, b = got["a"], got["b"]
    assert (a["rows"], a["sure_wrong"], a["plain_wrong"], a["unsure_wrong"], a["auroc"]) == (4, 1, 0, 1, 0.625)
    # steps: two rows at 1/2, one at 1/3, one at 1/2; best order: right, right, wrong (1/3), wrong (1/2)
    assert a["best"] == round((1 / 3 + 1 / 2) / 4, 6) and a["excess"] == round((1 + 1 / 3 + 1 / 2) / 4 - (1 / 3 + 1 / 2) / 4, 6)
    assert (b["best"], b["excess"], b["auroc"]) == (0.0, 0.0, None)
