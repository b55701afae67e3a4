"""Letters counted by table: odd texts against SQL."""

import duckdb
import pytest

from lodestat.plans import all as _all  # noqa: F401
from lodestat.plans import registry

TEXTS = [
    "a1 b", "ab", "", None, "éèê öŐ\n\n  \nIİ\x0b\x0bx ß\r\n\tÅ", "Ünï 日本語 ٣٤ ½ éé", "𝒳𝒴𝒵 👍🏽 a", "   ", "line one\nline two\nline three\nfour", "a\n\n" * 7, "aaaaaaaaaaaaaaaa\nb\naaaaaaaaaaaaaaaa\nb", "no\x00t", "A B C",
]


@pytest.fixture
def tables(spark, tmp_path):
    docs = [(i % 11, t) for i, t in enumerate(TEXTS)]  # two ids come twice
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x"), (2, "yz"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    return str(tmp_path), c


@pytest.mark.parametrize("name", ["gram_kinds", "form_specification"])
def test_odd_texts(spark, tables, name):
    d, c = tables
    df, want = registry.queries()[name](spark, d), c.sql(registry.oracle_sql()[name])
    order = sorted(df.columns)
    rows = lambda data, cols: sorted((tuple(r[cols.index(x)] for x in order) for r in data), key=repr)
    assert rows(map(tuple, df.collect()), df.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["gram_kinds", "form_specification"])
def test_no_expression_for_each_character(spark, tables, name):
    plan = registry.queries()[name](spark, tables[0])._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan and "rlike" not in plan and "array_join" not in plan and "mapinarrow" in plan
