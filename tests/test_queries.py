"""Every registered query of the library against its SQL in DuckDB; those without SQL are checked in test_brute_force."""

import datetime
import decimal
import math

import duckdb
import pytest

from lodestat.plans import all as _all  # noqa: F401
from lodestat.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}

ELSEWHERE = {"block_building", "exact_bounds", "kmin_table", "minimal_pairs", "number_mentions", "platt_calibration", "poisson_rate", "real_vs_synthetic", "residual_noise", "scheme_distribution", "section_items", "shortcut_audit", "style_classifier"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float) and not isinstance(v, bool):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, D)
    got = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert name in ELSEWHERE and got  # its values are checked in test_brute_force
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    order = sorted(df.columns)
    rows = lambda data, cols: sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in data), key=repr)
    assert rows(got, df.columns) == rows(want.fetchall(), want.columns)
