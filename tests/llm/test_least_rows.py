"""Only rows of one component give way to each other, whatever their ids."""

import corpus_pipeline
import pytest

from lodestat.llm import simhash

LONG = [" ".join(f"t{i}x{j}" for j in range(80)) for i in range(8)]


@pytest.mark.parametrize("stage", [lambda s, d: simhash.one_of_each(d), lambda s, d: corpus_pipeline.near_dedup_stage(s, d, "")])
def test_null_and_repeated_ids(spark, stage):
    rows = [(None, LONG[0]), (None, LONG[1]), (None, LONG[2]), (5, LONG[3]), (5, LONG[4]), (5, LONG[4]), (6, LONG[3]), (None, LONG[3]), (None, LONG[0])]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs).collect()), key=repr)
    assert got == sorted([(None, LONG[0]), (None, LONG[1]), (None, LONG[2]), (5, LONG[3]), (5, LONG[4])], key=repr)
