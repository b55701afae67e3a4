"""The near-dedup stage against brute-force Jaccard of five-word shingles."""

import itertools

import corpus_pipeline
import numpy as np

from lodestat.llm import jaccard, simhash

D = "/root/testdata/sf0.01"


def plain_shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def plain_least(texts):
    """The least id of each component of texts (id to text) under similarity 0.8."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if min(len(sets[a]), len(sets[b])) * 5 >= max(len(sets[a]), len(sets[b])) * 4:
            both = len(sets[a] & sets[b])
            if both * 5 >= (len(sets[a]) + len(sets[b]) - both) * 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {find(i) for i in texts}


def test_stage_against_brute_force(spark):
    """On these texts exactly the documents stay that brute force keeps, though the method may lose links beyond five bits."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = plain_least(texts)
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, D).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_copies_are_found(spark):
    """Texts of which a few words are changed, at a similarity just above the limit: 98 in 100 at least."""
    rng = np.random.default_rng(2)
    texts = {}
    for i in range(150):
        w = [f"w{x}" for x in rng.zipf(1.3, 200) % 5000 + 7 * i]
        texts[2 * i] = " ".join(w)
        for at in (20, 90, 160)[: int(rng.integers(1, 4))]:
            w[at + int(rng.integers(0, 20))] = "changed"
        texts[2 * i + 1] = " ".join(w)
    want = plain_least(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    assert want <= got and len(texts) - len(got) >= 0.98 * (len(texts) - len(want))


def test_two_fingerprints_err_apart():
    """Of edited texts, hardly any is beyond reach of both: the distances by the two are not the same."""
    rng = np.random.default_rng(5)
    far = []
    for i in range(300):
        w = [f"w{x}" for x in rng.integers(0, 3000, 150)]
        v = list(w)
        for at in rng.choice(150, 4, replace=False):
            v[at] = "new"
        a, b = (simhash.word_set_simhashes(" ".join(t).encode()) for t in (w, v))
        far.append([(x ^ y).bit_count() for x, y in zip(a, b, strict=True)])
    far = np.array(far)
    assert abs(np.corrcoef(far.T)[0, 1]) < 0.3 and (far.min(axis=1) <= 10).all()


def test_boundary_and_common_passage(spark):
    """0.8 itself is a link; a passage that all texts share links none; empty texts are alike."""
    word = lambda *x: "w" + "_".join(map(str, x))
    exact = {10: " ".join(word("e", j) for j in range(13)), 11: " ".join(word("e", j) for j in range(13)).upper()}
    edge = {20: "p q r s t u v w x", 22: "P q  r s t u v w x"}
    passage = " ".join(word("common", j) for j in range(60))
    shared = {30 + i: passage + " " + " ".join(word(i, j, "own") for j in range(40)) for i in range(40)}
    texts = {**exact, **edge, **shared, 90: None, 91: "", 92: " \n", 93: "one", 94: "ONE"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == plain_least(texts)


def test_filter_loses_nothing(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for i in range(200):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 60))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, 5))).astype(np.uint64)]))
        if len(b):
            rows.append((i, len(a), tuple(jaccard.bitmap(a).tolist()), len(b), tuple(jaccard.bitmap(b).tolist())))
            want += [i] if jaccard.similar(a, b) else []
    df = spark.createDataFrame(rows, f"i int, {jaccard.FACTS}, {jaccard.FACTS.replace('n int', 'm int').replace('bits', 'others')}")
    both = df.select("i", "n", "bits").alias("x").join(df.selectExpr("i", "m n", "others bits").alias("y"), "i").where(jaccard.may_be_similar("x", "y"))
    assert set(want) <= {r["i"] for r in both.select("i").collect()} and want


def test_similar_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = [f"x{i}" for i in rng.integers(0, 6, int(rng.integers(0, 30)))]
        b = [w if rng.random() < 0.97 else "y" for w in a]
        x, y = plain_shingles(" ".join(a)), plain_shingles(" ".join(b))
        want = 5 * len(x & y) >= 4 * len(x | y)
        assert jaccard.similar(jaccard.shingles(" ".join(a).encode()), jaccard.shingles(" ".join(b).encode())) == want
