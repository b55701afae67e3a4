"""Operators 11 to 13 against plain versions."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from lodestat.llm import periodic, pu, quality_pu, queries, trie

DOCS = "doc_id long, text string, lang string, h long, n_runs long"
TALKS = "conv_id long, turn long, role string, text string, key string, block int, n long"


def plain_runs(ids):
    n, out = len(ids), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if ids[i] != ids[i - q]:
                i += 1
                continue
            a = i
            while i < n and ids[i] == ids[i - q]:
                i += 1
            if i - a + q >= max(12, 2 * q):
                out.setdefault((a - q, i - a + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_text_runs(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11_against_all_lags():
    r = random.Random(11)
    for _ in range(1500):
        n, m = r.randrange(220), r.choice([1, 2, 2, 3, 5, 20])
        x = [r.randrange(m) for _ in range(n)]
        for _ in range(r.randrange(4)):
            if n > 20:
                a, p = r.randrange(n), r.randrange(1, 40)
                for i in range(a + p, min(n, a + r.randrange(10, 150))):
                    x[i] = x[i - p]
        assert periodic.runs_of(np.array(x, np.int64)) == plain_runs(x)


def test_op11_runs_in_runs():
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a
    for x in (([0] * 50 + [1]) * 20, ([0] * 12 + [1]) * 30 + [0] * 100, [0] * 2000, ([0, 1] * 40 + [2]) * 12 + [0, 1] * 50, [0, 1] * 60 + [0] + [0, 1] * 70, b[:1200]):
        assert periodic.runs_of(np.array(x, np.int64)) == plain_runs(x)


def test_op11_work_is_bounded():
    """A word, a line or two short runs repeated half a million times."""
    for x, n in (([0] * 500_000, 1), (list(range(10)) * 50_000, 1), (([0] * 999 + [1]) * 500, 501)):
        assert len(periodic.runs_of(np.array(x, np.int64))) == n


def test_op11_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic, "JOINED", 3)
    texts = [None, "", " \n", "one", "a b " * 30, "x " * 11, "x " * 12, "é\x85 b\x0bc " * 9, " ".join(map(str, range(300))), " ".join(map(str, range(40))) * 3] + [" ".join(map(str, range(k))) for k in range(60)]
    rows = [(i, t, "en", 1, 2) for i, t in enumerate(texts)] + [(3, "one", "de", None, None), (None, "a b c d e f g h i", None, 0, 0), (None, None, None, None, None)]
    got = periodic.periodic_runs(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_text_runs(r[0], r[1]) for r in rows), key=repr)
    assert periodic.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        own[c].append((turn is not None, turn or 0, role, hashlib.md5((hashlib.md5(role.encode()).hexdigest() + text).encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(x)] for c, x in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    order = lambda c: -(2**63) if c is None else c
    for c in sorted(own, key=order):
        h = zlib.crc32(str(c).encode() if c is not None else b"") % 4
        head = own.get(c - c % 20, []) if c is not None else []
        seq = tuple(head[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    children = collections.Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode().split()) for q in below[p] if q)
        ids = ",".join("" if c is None else str(c) for c in ends.get(p, []))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], sum(not children[q] for q in below[p]), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(r, n):
    rows = []
    for c in range(n):
        for t in range(r.choice([0, 1, 2, 3, 5, 7])):
            rows.append((c * r.choice([1, 1, 7]), t, r.choice(["user", "bot", None, ""]), r.choice(["hi", "hi there you", "", None, "a b", f"own {c % 5}"])))
    return rows


@pytest.mark.parametrize(("turns", "piece"), [(1 << 18, 1024), (12, 2), (3, 1)])
def test_op12_against_sets(spark, monkeypatch, turns, piece):
    monkeypatch.setattr(trie, "BLOCK_TURNS", turns)
    monkeypatch.setattr(trie, "PIECE", piece)
    rows = talks(random.Random(turns), 90) + [(5, None, "user", "first"), (5, 0, "user", "hi"), (5, 0, "user", "hi"), (None, 1, "user", "hi"), (None, None, None, None)] + [(1000 + i, t, "user", "same") for i in range(30) for t in range(4)]
    df = spark.createDataFrame([(*x, "k", 1, 2) for x in rows], TALKS).repartition(3)
    assert sorted(map(tuple, trie.prefix_trie(df).collect()), key=repr) == plain_trie(rows)


def test_op12_searches():
    r = np.random.default_rng(0)
    lcp = r.integers(0, 5, 200)
    shared = trie.minima(lcp)
    at, depth = r.integers(0, 200, 500), r.integers(0, 6, 500)
    for i, d, left, right in zip(at, depth, trie.left_end(shared, at, depth), trie.right_end(shared, at, depth), strict=True):
        want = i
        while want > 0 and lcp[want] >= d:
            want -= 1
        assert left == want
        want = i
        while want + 1 < 200 and lcp[want + 1] >= d:
            want += 1
        assert right == want


def test_op12_long_and_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TALKS)).count() == 0
    df = spark.createDataFrame([(c, t, "user", f"word {t % 7} " * 3, "k", 1, 2) for c in (21, 22) for t in range(3000)], TALKS)
    got = trie.prefix_trie(df).collect()
    assert max(r["depth"] for r in got) == 3000 and all(r["n_leaves"] <= 2 for r in got)


@pytest.mark.parametrize("name", ["op3_quotation_links", "op11_periodic_runs", "op12_prefix_trie"])
def test_op3_op11_op12_sql(spark, name):
    d, duck = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df, want = queries.queries()[name](spark, d), duck.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    rows = lambda data, cols: sorted((tuple(r[cols.index(c)] for c in order) for r in data), key=repr)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


def test_op13_learns_from_positives_only(spark):
    r = np.random.default_rng(0)
    vocab = [f"Word{i}" for i in range(300)]
    texts, good = [], []
    for i in range(900):
        good.append(int(i % 5 > 0))
        t = list(r.choice(vocab, 60))
        texts.append(" ".join(t) + "." if good[-1] else " | ".join(x.upper() + "###" for x in t))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = [(i, good[i]) for i in range(900) if i % 3 < 2]
    table = lambda rows: spark.createDataFrame([*rows, (99999, 1), (None, 1), (7, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_pu.quality_scores(docs, table(labels)).collect()}
    assert len(got) == 902 and got[9000]["score"] == got[9001]["score"]
    for i in range(900):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert np.mean([got[i]["predicted"] == good[i] for i in range(900) if got[i]["held_out"]]) > 0.97
    # labels of bad texts, and of held-out ones, change nothing
    fewer = {r["doc_id"]: r["score"] for r in quality_pu.quality_scores(docs, table([x for x in labels if x[1] and not got[x[0]]["held_out"]])).collect()}
    assert all(abs(fewer[i] - got[i]["score"]) < 1e-9 for i in got)


def test_op13_prior():
    """The share of positives in the unlabelled half is found within a few hundredths."""
    r = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        n = 6000
        positive = r.random(n) < 0.4
        kind = positive | (r.random(n) < share)
        lists = [[int(x) for x in np.flatnonzero(r.random(20) < np.where(np.arange(20) < 10, 0.5 if k else 0.05, 0.05 if k else 0.5))] for k in kind]
        ends, cols = np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.array([x for y in lists for x in y])
        assert abs(pu.class_prior(ends, cols, positive, 20) - share) < 0.06


def test_op13_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = queries.op13_quality_classifier(spark, d).join(labels, "doc_id").where("held_out and quality is not null").collect()
    score, good = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    wins = (score[good == 1][:, None] > score[good == 0]).mean() + 0.5 * (score[good == 1][:, None] == score[good == 0]).mean()
    print("held out", wins, (score[good == 1] >= 0.5).mean(), (score[good == 0] >= 0.5).mean())
    assert wins > 0.97 and (score[good == 1] >= 0.5).mean() > 0.99 and (score[good == 0] >= 0.5).mean() < 0.45


def test_op13_awkward(spark):
    schema = "doc_id long, text string, quality int, positive int"
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_pu.quality_scores(spark.createDataFrame([], schema), none).count() == 0
    rows = [(1, "x" * 2_000_000, 0, 0), (1, "x" * 2_000_000, 0, 0), (None, None, None, None), (2, "\x00a b\x00", 1, 1), (3, "a b " * 300_000, 0, 0)]
    got = quality_pu.quality_scores(spark.createDataFrame(rows, schema), none).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {0.5}
    some = sorted(quality_pu.features(rows[3][1]))
    assert {some[i] for i in quality_pu.finder(some)(rows[3][1])} == set(some)
