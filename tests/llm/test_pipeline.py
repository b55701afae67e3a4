"""The pipeline, stage by stage, against plain readings of what each stage must do."""

import corpus_pipeline
from test_jaccard import plain_least
from lodestat.llm import doubling, packing, quality, queries

D = "/root/testdata/sf0.001"


def bins(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["sequence_id"], []).append(r["length"])
    return out


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "substring dedup", "source mix", "best-fit packing"]
    rows = spark.read.parquet(f"{D}/documents.parquet")
    names = rows.columns
    before = rows
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, D)
        after = spark.createDataFrame(after.collect(), after.schema)
        if i < 4:
            assert after.columns == names
        seen.append(after)
        before = after
    ids = [{r["doc_id"] for r in s.collect()} for s in seen]
    kept = {r["doc_id"] for r in quality.quality(rows).where("kept").collect()}
    assert ids[0] == kept
    texts = {r["doc_id"]: r["text"] for r in seen[0].collect()}
    want = plain_least(texts)
    assert want <= ids[1] and len(texts) - len(ids[1]) >= 0.9 * (len(texts) - len(want))
    n = {r["doc_id"]: r for r in doubling.substring_dedup(seen[1]).collect()}
    for r in seen[2].collect():
        assert len(r["text"].encode().split()) == n[r["doc_id"]]["n_words"] - n[r["doc_id"]]["n_removed"]
    assert sum(r["n_removed"] for r in doubling.substring_dedup(seen[2]).collect()) <= sum(r["n_removed"] for r in n.values())
    words = lambda s: sum(len((r["text"] or "").encode().split()) for r in s.collect())
    assert abs(words(seen[3]) - 1.5 * words(seen[2])) < 0.05 * words(seen[2])
    held = lambda rows: list(bins(rows).values())
    limits = {"max_docs": corpus_pipeline.MOST_DOCS, "max_attention": corpus_pipeline.ATTENTION}
    for rule in ("dot", "norm"):  # both rules under every constraint, and each constraint binds
        rows = seen[4] if rule == "dot" else packing.pack_documents(seen[3], queries.tokenizer_path(), rule=rule, **limits)
        for b in held(rows):
            assert sum(b) <= 1024 and len(b) <= corpus_pipeline.MOST_DOCS and (sum(n * n for n in b) <= corpus_pipeline.ATTENTION or len(b) == 1)
    free = held(packing.pack_documents(seen[3], queries.tokenizer_path()))
    assert any(sum(n * n for n in b) > corpus_pipeline.ATTENTION and len(b) > 1 for b in free) or any(len(b) > corpus_pipeline.MOST_DOCS for b in free)


def test_run(spark):
    assert corpus_pipeline.run(spark, D).count() > 0


def test_stages_with_awkward_rows(spark):
    """Nulls in any column, repeated rows and ids, clashing further columns, no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, _row long, node int, fp string, k0 int, kept boolean, src int"
    long = [" ".join(f"w{i}x{j * j % 71}" for j in range(90)) for i in range(5)]
    rows = [(i, t, "en", None if i % 2 else "s", None if i == 3 else len(t), "k", 1, 2, "f", 3, True, 4) for i, t in enumerate(long)]
    rows += [rows[0], rows[0], (None, long[0], None, None, None, None, None, None, None, None, None, None), (None, long[4].upper(), None, None, None, None, None, None, None, None, None, None)]
    rows += [(7, None, None, "s", None, None, None, None, None, None, None, None), (8, "", "en", "s", 0, None, None, None, None, None, None, None), (3, long[2], "en", None, 1, "k", 1, 2, "f", 3, False, 4)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema).repartition(2)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            after = stage(spark, docs, D)
            if i < 4:
                assert after.columns == docs.columns and after.dtypes == docs.dtypes
            got = after.collect()
            assert bool(got) == bool(data)
            if i == 0 and data:
                assert {r["doc_id"] for r in got} == {None, 0, 1, 2, 3, 4} and sum(r["doc_id"] == 0 for r in got) == 3
            if i == 1 and data:
                assert len({r["text"] for r in got}) == len(got) == 5
            docs = spark.createDataFrame(got, after.schema) if i < 4 else docs
